"""Alert runs, investigations with their lists and histories, and what touches a subject, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import alert_runs as runs
from sleuthframe.operators import alerting
from sleuthframe.operators import dossiers as ds
from sleuthframe.operators import ingest
from sleuthframe.plans import queries_ingest as qi
from sleuthframe.plans import queries_links as ql
from sleuthframe.plans import world as w
from sleuthframe.plans.lineage import written
from sleuthframe.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def at(day: str):
    return F.lit(day).cast("timestamp_ntz")


# --- runs of the alert rules -------------------------------------------------------------------------------------

#: Days of the two runs.
FIRST, SECOND = "2000-06-01", "2001-08-02"


def suppressions(spark, d):
    """Some subjects are quiet, for one rule or all, and a few rules are."""
    who = table(spark, d, "customer").where("c_custkey % 5 = 0")
    one = F.col("c_custkey") % 10 == 5
    people = who.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"), F.when(one, "assessment.elevated").alias("rule"), F.col("c_custkey").cast("string").alias("subject"),
        F.when(F.col("c_custkey") % 20 == 15, at("2000-12-31")).otherwise(at("2001-09-01")).alias("expires_at"), (F.col("c_custkey") % 30 == 0).alias("revoked"),
    )
    key = F.col("r_regionkey")
    rules = table(spark, d, "region").select(
        F.concat(F.lit("R"), key.cast("string")).alias("id"), F.when(key == 0, "assessment.escalated").when(key == 1, "convergence.assessed_cluster").otherwise("assessment.elevated").alias("rule"), F.lit(None).cast("string").alias("subject"),
        F.when(key == 1, at("2001-01-01")).otherwise(at("2001-09-01")).alias("expires_at"), (key >= 2).alias("revoked"),
    )
    return people.unionByName(rules)


def alert_links(spark, d):
    """Users in contact as links; three contacts establish one."""
    n = F.col("n")
    return ql.met(spark, d).select("a", "b", F.least(F.lit(1.0), n / 4).alias("strength"), F.lit(0.5).alias("coverage"), F.when(n >= 3, "established").otherwise("possible").alias("tier"))


def alert_pass(spark, d, day: str):
    """The alerts of one run and what they rest on."""
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("cluster"))
    current = written(runs.current_findings(w.assessments(spark, d).where(F.col("computed_at") < at(day)).drop("run", "state")))
    fired = runs.firings(current, alert_links(spark, d), members)
    return written(runs.raised(fired, current, members, suppressions(spark, d), at(day)))


def alert_runs(spark, d):
    """Queue after the first run, alerts of the second, queue after it; analysts have taken on some of the first's."""
    first = runs.brought_in(None, alert_pass(spark, d, FIRST), at(FIRST)).drop("change")
    taken = F.col("key") < "8"
    queue = first.withColumns({"state": F.when(taken, "acknowledged").otherwise(F.col("state")), "assignee": F.when(taken, "analyst")})
    alerts = alert_pass(spark, d, SECOND)
    return alerts, runs.brought_in(queue, alerts, at(SECOND))


def _run_sql(k: int, day: str) -> str:
    """CTEs of a run: cur, fired, raised."""
    mark = "count(*) || ':' || sum(CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT))"
    rank = "CASE {0} WHEN 'insufficient' THEN 0 WHEN 'clear' THEN 1 WHEN 'notable' THEN 2 WHEN 'elevated' THEN 3 END"
    return f"""cur{k} AS MATERIALIZED (SELECT * FROM (SELECT subject, band, score, coverage, computed_at, lag(band) OVER (PARTITION BY subject ORDER BY computed_at) AS previous, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC) AS r
 FROM (SELECT *, row_number() OVER (PARTITION BY subject, computed_at ORDER BY id DESC) AS k FROM assessments WHERE computed_at < TIMESTAMP '{day}') WHERE k = 1) WHERE r = 1),
rise{k} AS (SELECT *, {rank.format('band')} - {rank.format('previous')} AS rise FROM cur{k}),
conv{k} AS (SELECT cluster, count(*) AS size, count(*) FILTER (band IN ('elevated', 'notable')) AS n, avg(coverage) FILTER (band IN ('elevated', 'notable')) AS coverage FROM mem LEFT JOIN cur{k} USING (subject) GROUP BY 1 HAVING n >= 2),
fired{k} AS (SELECT 'assessment.elevated' AS rule, CAST(subject AS VARCHAR) AS ref, subject, least(1.0, score / 100) AS magnitude, coverage AS confidence FROM cur{k} WHERE band = 'elevated'
 UNION ALL SELECT 'assessment.escalated', CAST(subject AS VARCHAR), subject, least(1.0, rise / 3), coverage FROM rise{k} WHERE rise > 0 AND band IN ('elevated', 'notable')
 UNION ALL SELECT 'correlation.established_pair', a || '|' || b, unnest([a, b]), least(1.0, n / 4), 0.5 FROM met WHERE n >= 3
 UNION ALL SELECT 'convergence.assessed_cluster', cluster, subject, n / size, coverage FROM conv{k} JOIN mem USING (cluster)),
quiet{k} AS (SELECT * FROM sup WHERE NOT revoked AND expires_at > TIMESTAMP '{day}'),
narrow{k} AS (SELECT f.rule, f.ref, min(CASE WHEN q.rule IS NOT NULL THEN id END) AS both_, min(CASE WHEN q.rule IS NULL THEN id END) AS alone FROM fired{k} f JOIN quiet{k} q ON q.subject = CAST(f.subject AS VARCHAR) AND (q.rule IS NULL OR q.rule = f.rule) GROUP BY f.rule, f.ref),
sums{k} AS (SELECT rule, ref, {mark.format('CAST(subject AS VARCHAR)')} AS mark, max(magnitude) AS magnitude, max(confidence) AS confidence, min(cluster) AS cluster, coalesce(max(computed_at) FILTER (band IN ('elevated', 'notable')), TIMESTAMP '{day}') AS evidence_at
 FROM fired{k} LEFT JOIN mem USING (subject) LEFT JOIN cur{k} USING (subject) GROUP BY rule, ref),
raised{k} AS MATERIALIZED (SELECT substr(sha256(s.rule || '@1::' || mark), 1, 32) AS key, s.rule, substr(sha256(CASE WHEN cluster IS NULL THEN 'scope:' || mark ELSE 'cluster:' || cluster END), 1, 32) AS group_key, coalesce(both_, least(alone, q.id)) AS suppressed_by,
 least(1.0, CASE WHEN s.rule = 'convergence.assessed_cluster' THEN 1.5 ELSE 1.0 END * confidence * magnitude * greatest(0.25, pow(0.5, greatest(0, epoch(TIMESTAMP '{day}') - epoch(evidence_at)) / 86400.0 / 30))) AS priority
 FROM sums{k} s LEFT JOIN narrow{k} n ON n.rule = s.rule AND n.ref = s.ref LEFT JOIN (SELECT rule, min(id) AS id FROM quiet{k} WHERE subject IS NULL GROUP BY 1) q ON q.rule = s.rule)"""


RUNS = f"""WITH {ql.MET}, mem AS (SELECT c_custkey AS subject, c_nationkey || '-' || c_mktsegment AS cluster FROM customer),
sup AS (SELECT 'C' || c_custkey AS id, CASE WHEN c_custkey % 10 = 5 THEN 'assessment.elevated' END AS rule, CAST(c_custkey AS VARCHAR) AS subject, CASE WHEN c_custkey % 20 = 15 THEN TIMESTAMP '2000-12-31' ELSE TIMESTAMP '2001-09-01' END AS expires_at, c_custkey % 30 = 0 AS revoked FROM customer WHERE c_custkey % 5 = 0
 UNION ALL SELECT 'R' || r_regionkey, CASE r_regionkey WHEN 0 THEN 'assessment.escalated' WHEN 1 THEN 'convergence.assessed_cluster' ELSE 'assessment.elevated' END, NULL, CASE WHEN r_regionkey = 1 THEN TIMESTAMP '2001-01-01' ELSE TIMESTAMP '2001-09-01' END, r_regionkey >= 2 FROM region),
{_run_sql(1, FIRST)}, {_run_sql(2, SECOND)},
after AS (SELECT coalesce(y.key, x.key) AS key, coalesce(y.rule, x.rule) AS rule, CASE WHEN y.key IS NULL THEN x.priority ELSE y.priority END AS priority, CASE WHEN y.key IS NULL THEN x.group_key ELSE y.group_key END AS group_key, CASE WHEN y.key IS NULL THEN x.suppressed_by ELSE y.suppressed_by END AS suppressed_by,
 CASE WHEN x.key < '8' THEN 'acknowledged' ELSE 'open' END AS state, CASE WHEN x.key < '8' THEN 'analyst' END AS assignee, (x.key IS NOT NULL)::BIGINT + (y.key IS NOT NULL)::BIGINT AS occurrences, CASE WHEN x.key IS NULL THEN 'created' WHEN y.key IS NULL THEN 'unchanged' ELSE 'repeated' END AS change FROM raised1 x FULL JOIN raised2 y ON y.key = x.key)"""


@query(w.sql("assessments contacts", f"{RUNS} SELECT key, rule, round(priority + 1e-9, 4) AS priority, CASE WHEN priority + 1e-9 >= 0.55 THEN 'high' WHEN priority + 1e-9 >= 0.3 THEN 'medium' ELSE 'low' END AS level, group_key, suppressed_by, state, assignee, occurrences, change FROM after"))
def alert_queue_after_runs(spark, d):
    """The queue after two runs of four rules over the whole ledger: renewed alerts keep what analysts made of them."""
    _, after = alert_runs(spark, d)
    return after.select("key", "rule", F.round(F.col("priority") + runs.TIE, 4).alias("priority"), "level", "group_key", "suppressed_by", "state", "assignee", "occurrences", "change")


@query(
    w.sql(
        "assessments contacts",
        f"""{RUNS} SELECT (SELECT count(DISTINCT (rule, ref)) FROM fired2) AS n_firings, count(*) AS n_alerts, count(*) FILTER (change = 'created') AS n_created, count(*) FILTER (change = 'repeated') AS n_repeated, count(r.suppressed_by) AS n_suppressed, count(DISTINCT r.group_key) AS n_groups FROM raised2 r JOIN after USING (key)""",
    )
)
def alert_run_report(spark, d):
    """What the second run found, opened, repeated and suppressed."""
    alerts, after = alert_runs(spark, d)
    return runs.run_report(alerts, after)


@query(
    """SELECT c_custkey AS id, c_custkey % 7 AS days FROM customer WHERE (c_custkey % 3 <> 0 OR c_custkey % 4 <> 0) AND c_custkey % 7 > 0 AND c_custkey % 7 * 16 <= 90 AND length(trim(CASE WHEN c_custkey % 5 = 0 THEN 'see above   ' ELSE c_mktsegment || ' is known' END)) >= 10"""
)
def suppressions_accepted(spark, d):
    """Suppressions that analysts ask for, of which those without a rule and a subject, an end within 90 days or a reason are turned away."""
    key = F.col("c_custkey")
    asked = table(spark, d, "customer").select(
        key.alias("id"), F.when(key % 3 != 0, "assessment.elevated").alias("rule"), F.when(key % 4 != 0, key.cast("string")).alias("subject"), at("2001-08-02").alias("created_at"),
        (at("2001-08-02") + F.make_dt_interval(days=(key % 7 * 16).cast("int"))).alias("expires_at"), F.when(key % 5 == 0, "see above   ").otherwise(F.concat("c_mktsegment", F.lit(" is known"))).alias("note"), (key % 7).alias("days"),
    )
    return alerting.accepted_suppressions(asked).select("id", "days")


# --- dead letters once more --------------------------------------------------------------------------------------

#: The mapping after it was put right: the subject is the record's own number.
CORRECTED = ingest.Mapping(subject="id", time="at", attributes={"value": "body.v"})


@query(
    """WITH l AS (SELECT event_id AS letter, event_type AS connector, event_id % 5 = 0 AS lost, event_id % 3 = 0 AS known, event_id % 41 = 0 AS bad, event_id % 7 = 0 AS done, ts FROM events WHERE event_id % 37 = 0 OR event_id % 41 = 0)
SELECT letter, connector, CASE WHEN done OR NOT (lost OR bad) THEN 'resolved' ELSE 'failed' END AS status, CASE WHEN done OR lost THEN 1 ELSE 2 END AS replay_count, CASE WHEN NOT (done OR lost OR bad) THEN CAST(letter AS VARCHAR) END AS subject,
 CASE WHEN NOT (done OR lost OR bad) THEN date_trunc('second', ts) END AS occurred_at, NOT (done OR lost OR bad OR known) AS created, CASE WHEN done THEN NULL WHEN lost THEN 'no stored record' WHEN bad THEN 'not a time' END AS error FROM l"""
)
def letter_replays(spark, d):
    """Dead letters of the first mapping through the corrected one: what was missing a user maps now, a broken time still doesn't."""
    landed = written(ingest.landed(qi.raw(spark, d)))
    failed = ingest.mapped(landed, qi.MAPPING).where("stage <> 'ok'")
    letters = failed.select(F.col("event_id").alias("letter"), "connector", F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("raw_id"), F.when(F.col("event_id") % 7 == 0, "resolved").otherwise("failed").alias("status"), F.lit(1).alias("replay_count"))
    known = landed.where("event_id % 3 = 0").select("connector", "hash")
    return ingest.replayed(letters, landed.select(F.col("event_id").alias("raw_id"), "payload"), CORRECTED, known).drop("hash")


@query("SELECT event_id, CASE WHEN event_id % 11 > 1 THEN date_trunc('second', ts) - CASE WHEN event_id % 11 = 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END END AS occurred_at FROM events")
def lenient_times(spark, d):
    """Times as feeds write them, with Z, an offset or no zone; what is none is null and no error."""
    ts, kind = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.col("event_id") % 11
    text = F.when(kind == 0, "soon").when(kind == 1, F.lit(None)).when(kind == 2, F.concat(ts, F.lit("+02:00"))).when(kind == 3, ts).otherwise(F.concat(ts, F.lit("Z")))
    return w.activity(spark, d).select("event_id", ingest.lenient_time(text).alias("occurred_at"))


# --- investigations ----------------------------------------------------------------------------------------------


def investigation_items(spark, d):
    """What hangs off each customer's investigation: their ledger's rows by what they say, and the accounts they dealt with."""
    rows = w.assessments(spark, d)
    day, key = F.col("computed_at"), F.col("id")
    part = lambda which, ended, note: rows.where(which).select(F.col("subject").alias("investigation"), key.alias("item"), day.alias("at"), ended.alias("ended_at"), F.col(note).alias("note"))
    later = lambda test, days: F.when(test, day + F.expr(f"interval {days} days"))
    lines = w.numbered_lines(spark, d).join(rows.select(key.alias("l_orderkey"), "subject"), "l_orderkey")
    dealt = lines.select(F.col("subject").alias("investigation"), F.col("l_suppkey").alias("item"), F.col("l_shipdate").alias("at"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate") + F.expr("interval 30 days")).alias("ended_at"), F.col("l_linestatus").alias("note"))
    never = F.lit(None).cast("timestamp_ntz")
    return ds.items(
        alerts=part("band = 'elevated'", later(key % 7 == 0, 10), "state"), entities=dealt, findings=part("band = 'notable'", later(key % 5 == 0, 20), "state"), actions=part("id % 2 = 0", later(F.col("state") == "F", 5), "band"),
        assessments=part("id % 4 = 0", later(key % 8 == 0, 40), "band"), reviews=part("id % 9 = 0", never, "band"),
    )


ITEMS = """it AS (SELECT subject AS investigation, 'alerts' AS list, CAST(id AS VARCHAR) AS item, computed_at AS begun, CASE WHEN id % 7 = 0 THEN computed_at + INTERVAL 10 DAY END AS ended_at, state AS note FROM assessments WHERE band = 'elevated'
 UNION ALL SELECT subject, 'findings', CAST(id AS VARCHAR), computed_at, CASE WHEN id % 5 = 0 THEN computed_at + INTERVAL 20 DAY END, state FROM assessments WHERE band = 'notable'
 UNION ALL SELECT subject, 'actions', CAST(id AS VARCHAR), computed_at, CASE WHEN state = 'F' THEN computed_at + INTERVAL 5 DAY END, band FROM assessments WHERE id % 2 = 0
 UNION ALL SELECT subject, 'assessments', CAST(id AS VARCHAR), computed_at, CASE WHEN id % 8 = 0 THEN computed_at + INTERVAL 40 DAY END, band FROM assessments WHERE id % 4 = 0
 UNION ALL SELECT subject, 'reviews', CAST(id AS VARCHAR), computed_at, NULL, band FROM assessments WHERE id % 9 = 0
 UNION ALL SELECT subject, 'entities', CAST(l_suppkey AS VARCHAR), l_shipdate, CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 30 DAY END, l_linestatus FROM numbered JOIN assessments ON id = l_orderkey)"""
#: Items of a list that are shown.
SHOWN = 8


def _counts(name: str) -> str:
    return f"count(it.item) FILTER (list = '{name}') AS n_{name}, count(it.item) FILTER (list = '{name}' AND ended_at IS NULL) AS n_{name}_standing, coalesce(string_agg(item || '@' || strftime(begun, '%Y-%m-%d') || CASE WHEN ended_at IS NULL THEN '' ELSE '-' END, ' ' ORDER BY place) FILTER (list = '{name}' AND place <= {SHOWN}), '') AS {name}"


@query(
    w.sql(
        "assessments numbered",
        f"""WITH {ITEMS}, p AS (SELECT *, row_number() OVER (PARTITION BY investigation, list ORDER BY begun, item, ended_at NULLS FIRST, note) AS place FROM it), n AS (SELECT investigation, max(c) > {SHOWN} AS truncated FROM (SELECT investigation, list, count(*) AS c FROM it GROUP BY 1, 2) GROUP BY 1)
SELECT c_custkey AS investigation, {', '.join(_counts(name) for name in ds.LISTS)}, coalesce(any_value(truncated), false) AS truncated FROM customer LEFT JOIN p it ON it.investigation = c_custkey LEFT JOIN n ON n.investigation = c_custkey GROUP BY c_custkey""",
    )
)
def investigation_dossiers(spark, d):
    """Every investigation with its six lists, their true and standing numbers, and the first of each."""
    heads = table(spark, d, "customer").select(F.col("c_custkey").alias("investigation"))
    found = ds.dossiers(heads, investigation_items(spark, d), SHOWN)
    told = lambda name: F.array_join(F.transform(name, lambda x: F.concat(x["item"], F.lit("@"), F.date_format(x["at"], "yyyy-MM-dd"), F.when(x["ended_at"].isNull(), "").otherwise("-"))), " ")
    return found.withColumns({name: told(name) for name in ds.LISTS})


@query(
    w.sql(
        "assessments numbered",
        f"""WITH {ITEMS}, e AS (SELECT investigation, begun, CASE list WHEN 'alerts' THEN 'alert_attached' WHEN 'entities' THEN 'entity_linked' WHEN 'findings' THEN 'finding_recorded' WHEN 'actions' THEN 'action_recorded' WHEN 'assessments' THEN 'assessment_recorded' ELSE 'reviewed' END AS event, item, note FROM it
 UNION ALL SELECT investigation, ended_at, CASE list WHEN 'alerts' THEN 'alert_detached' WHEN 'entities' THEN 'entity_unlinked' WHEN 'findings' THEN 'finding_withdrawn' WHEN 'actions' THEN 'action_completed' ELSE 'assessment_withdrawn' END, item, note FROM it WHERE ended_at IS NOT NULL),
v AS (SELECT subject, computed_at, band, state, lag(band) OVER o AS old_band, lag(state) OVER o AS old_state, row_number() OVER o AS r FROM assessments WINDOW o AS (PARTITION BY subject ORDER BY computed_at, id))
SELECT investigation, begun AS at, event, NULL AS field, NULL AS old_value, NULL AS new_value, item || ': ' || note AS note FROM e UNION ALL SELECT subject, computed_at, 'field_changed', 'band', old_band, band, NULL FROM v WHERE r > 1 AND old_band IS DISTINCT FROM band UNION ALL SELECT subject, computed_at, 'field_changed', 'state', old_state, state, NULL FROM v WHERE r > 1 AND old_state IS DISTINCT FROM state""",
    )
)
def investigation_history(spark, d):
    """All events of all investigations: items attached and taken off, fields changed."""
    versions = w.assessments(spark, d).select(F.col("subject").alias("investigation"), F.col("computed_at").alias("at"), "id", "band", "state")
    return ds.history(investigation_items(spark, d), ds.field_changes(versions, ["band", "state"]))


@query(
    w.sql(
        "assessments",
        """WITH t AS (SELECT subject, ['open', 'active', 'closed'][id % 3 + 1] AS s, ['confirmed', 'unfounded', 'inconclusive', 'referred'][id % 4 + 1] AS o, computed_at, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id DESC) AS r FROM assessments)
SELECT subject AS investigation, s AS state, CASE WHEN s = 'closed' THEN o END AS outcome, CASE WHEN s = 'closed' THEN computed_at END AS closed_at FROM t WHERE r = 1""",
    )
)
def investigation_closures(spark, d):
    """How investigations stand: outcomes and times of closing of those that are closed and weren't opened again."""
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (F.col("id") % n).cast("int"))
    moves = w.assessments(spark, d).select(F.col("subject").alias("investigation"), F.col("computed_at").alias("at"), "id", pick(alerting.CASE_MOVES, 3).alias("to_state"), pick(alerting.OUTCOMES, 4).alias("outcome"))
    return ds.closures(moves)


# --- what else touches a subject ---------------------------------------------------------------------------------


@query(
    w.sql(
        "assessments numbered",
        """WITH l AS (SELECT DISTINCT l_suppkey AS subject, subject AS case_id FROM numbered JOIN assessments ON id = l_orderkey WHERE l_returnflag <> 'R' AND l_suppkey % 20 = 0), c AS (SELECT subject AS case_id, min(computed_at) AS opened_at FROM assessments GROUP BY 1)
SELECT l.subject, case_id, opened_at FROM l JOIN c USING (case_id)""",
    )
)
def related_cases(spark, d):
    """Cases that every twentieth account is linked to, those it was taken off left out."""
    rows = w.assessments(spark, d)
    lines = w.numbered_lines(spark, d).join(rows.select(F.col("id").alias("l_orderkey"), F.col("subject").alias("case_id")), "l_orderkey")
    linked = lines.select("case_id", F.col("l_suppkey").alias("subject"), (F.col("l_returnflag") == "R").alias("removed"))
    cases = rows.groupBy(F.col("subject").alias("case_id")).agg(F.min("computed_at").alias("opened_at"))
    return ds.related_cases(w.accounts(spark, d).where("ref % 20 = 0").select(F.col("ref").alias("subject")), linked, cases)


@query(w.sql("assessments", "SELECT subject, id AS alert, computed_at AS at, place, total FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id) AS place, count(*) OVER (PARTITION BY subject) AS total FROM assessments WHERE subject % 20 = 0 AND band IN ('elevated', 'notable')) WHERE place <= 20"))
def related_alerts(spark, d):
    """The twenty newest alerts about every twentieth subject, and how many there are."""
    rows = w.assessments(spark, d).where(F.col("band").isin("elevated", "notable"))
    wanted = table(spark, d, "customer").where("c_custkey % 20 = 0").select(F.col("c_custkey").alias("subject"))
    return ds.newest_of(wanted, rows.select("subject", F.col("id").alias("alert"), F.col("computed_at").alias("at")), "alert")


@query(
    w.sql(
        "contacts",
        f"""WITH {ql.MET}, e AS (SELECT a AS subject, b AS other, n FROM met UNION ALL SELECT b, a, n FROM met), p AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY least(1.0, n / 4) DESC, other) AS place, count(*) OVER (PARTITION BY subject) AS total FROM e WHERE subject % 20 = 0)
SELECT subject, other, round(least(1.0, n / 4), 4) AS strength, CASE WHEN n >= 3 THEN 'established' ELSE 'possible' END AS tier, place, total, CASE WHEN n >= 2 THEN 'communication,affiliation' ELSE 'affiliation,communication' END AS dimensions FROM p WHERE place <= 50""",
    )
)
def subject_links(spark, d):
    """The fifty strongest links of every twentieth user, from either end, with what they rest on, the strongest first."""
    links = alert_links(spark, d)
    told = ql.met(spark, d).select("a", "b", F.explode(F.array(F.struct(F.lit("communication").alias("dimension"), F.least(F.lit(1.0), F.col("n") / 3).alias("raw")), F.struct(F.lit("affiliation").alias("dimension"), F.lit(0.5).alias("raw")))).alias("e")).select("a", "b", "e.*")
    wanted = w.activity(spark, d).where("ref % 20 = 0").select(F.col("ref").alias("subject"))
    return ds.links_of(wanted, links, told).withColumns({"strength": F.round("strength", 4), "dimensions": F.array_join(F.transform("dimensions", lambda x: x["dimension"]), ",")})
