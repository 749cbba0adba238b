"""Assessment and alerting queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import alerting, assessment, graph, rollups, sequences
from sleuthframe.plans import world as w
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


def rounded(df, *names, digits: int = 4):
    return df.withColumns({n: F.round(n, digits) for n in names})


def shipment_magnitudes(spark, d):
    """A row a shipment with the magnitude of each of its signals."""
    rows = w.shipments(spark, d)
    share = rollups.corridor_shares(rows).select("origin", "destination", "share")
    manifest = assessment.manifest_discrepancy(F.when(F.col("flagged").isNotNull(), F.array("flagged")), F.array(F.lit(False)))
    found = rows.join(F.broadcast(share), ["origin", "destination"])
    return found.select(F.col("shipment_id").alias("subject"), manifest.alias("manifest_discrepancy"), assessment.route_detour(F.col("detour")).alias("route_detour"), assessment.rare_corridor(F.col("share")).alias("rare_corridor"))


def shipment_signals(spark, d):
    return assessment.signals_of_rows("Shipment", shipment_magnitudes(spark, d))


@query(
    w.sql(
        "shipments",
        """WITH c AS (SELECT origin, destination, count(*) / sum(count(*)) OVER () AS share FROM shipments GROUP BY 1, 2),
x AS (SELECT shipment_id AS subject, CASE WHEN flagged IS NULL THEN NULL WHEN flagged THEN 1.0 ELSE 0.0 END AS m, CASE WHEN detour < 1.25 THEN 0.0 WHEN detour >= 2.5 THEN 1.0 ELSE (detour - 1.25) / 1.25 END AS r,
 CASE WHEN share >= 0.005 THEN 0.0 WHEN 0.005 - share < 0 THEN 0.0 WHEN 0.005 - share >= 0.004 THEN 1.0 ELSE (0.005 - share) / 0.004 END AS k FROM shipments JOIN c USING (origin, destination)),
y AS (SELECT subject, coalesce(4 * m, 0) + 3 * r + 2 * k AS earned, (CASE WHEN m IS NULL THEN 0 ELSE 4 END + 5) / 9 AS coverage FROM x),
z AS (SELECT subject, coverage, least(100.0, earned / 5 * 100) AS raw FROM y)
SELECT subject, round(coverage, 4) AS coverage, round(raw, 4) AS score, CASE WHEN coverage < 0.25 THEN 'insufficient' WHEN raw >= 60 AND coverage >= 0.4 THEN 'elevated' WHEN raw >= 30 THEN 'notable' ELSE 'routine' END AS band FROM z""",
    )
)
def shipment_scores(spark, d):
    return rounded(assessment.row_scores("Shipment", shipment_magnitudes(spark, d)).select("subject", "coverage", "score", "band"), "coverage", "score")


def owner_signals(spark, d):
    """Owners (nations) over their accounts, users and customers."""
    accounts = w.accounts(spark, d).select(F.col("nation").alias("subject"), "ref", (F.col("ref") % 5 == 0).alias("offshore"))
    subjects = w.nations(spark, d).select(F.col("nation").alias("subject"))
    money = w.transfers(spark, d)
    calls = w.activity(spark, d).select((F.col("ref") % 40).cast("int").alias("ref"), "ts")
    profile = sequences.burst_profile(calls, 48).withColumnRenamed("ref", "subject")
    directs = table(spark, d, "customer").where("c_acctbal > 9700").select(F.col("c_nationkey").alias("subject"))
    burst = sequences.burst_profile(rollups.both_ways(money).select("ref", "ts"), 6)
    return assessment.signals_long(
        "Person", funds_cycle=assessment.funds_cycle(subjects, accounts, graph.funds_cycles(money), money), transaction_burst=assessment.transaction_burst(subjects, accounts, burst),
        communication_burst=assessment.communication_burst(subjects, profile), offshore_banking=assessment.offshore_share(subjects, accounts), directorship_spread=assessment.directorship_spread(subjects, directs),
    )


@query(
    w.sql(
        "accounts",
        """WITH o AS (SELECT nation AS subject, avg(CASE WHEN ref % 5 = 0 THEN 1.0 ELSE 0.0 END) AS offshore FROM accounts GROUP BY 1), c AS (SELECT c_nationkey AS subject, count(*) AS n FROM customer WHERE c_acctbal > 9700 GROUP BY 1)
SELECT n.nation AS subject, round(offshore, 4) AS offshore, CASE WHEN coalesce(c.n, 0) < 3 THEN 0.0 WHEN c.n >= 6 THEN 1.0 ELSE round((c.n - 3) / 3, 4) END AS directs FROM nations n LEFT JOIN o ON o.subject = n.nation LEFT JOIN c ON c.subject = n.nation""",
    )
)
def owner_structure_signals(spark, d):
    subjects = w.nations(spark, d).select(F.col("nation").alias("subject"))
    accounts = w.accounts(spark, d).select(F.col("nation").alias("subject"), (F.col("ref") % 5 == 0).alias("offshore"))
    directs = table(spark, d, "customer").where("c_acctbal > 9700").select(F.col("c_nationkey").alias("subject"))
    a, b = assessment.offshore_share(subjects, accounts), assessment.directorship_spread(subjects, directs)
    return rounded(a.withColumnRenamed("magnitude", "offshore").join(b.withColumnRenamed("magnitude", "directs"), "subject"), "offshore", "directs")


@query()
def owner_scores(spark, d):
    found = assessment.scores(owner_signals(spark, d))
    return rounded(found.withColumn("families", F.array_join("families", ",")), "coverage", "raw", "score")


@query(
    w.sql(
        "assessments",
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id DESC) AS n FROM assessments), a AS (SELECT subject, band FROM r WHERE n = 1 AND band IN ('elevated', 'notable')), b AS (SELECT subject, band FROM r WHERE n = 2 AND band IN ('elevated', 'notable'))
SELECT subject, 'publish' AS action, band FROM a UNION ALL SELECT subject, 'retract', band FROM b WHERE subject NOT IN (SELECT subject FROM a)""",
    )
)
def published_assertions(spark, d):
    from pyspark.sql.window import Window

    order = Window.partitionBy("subject").orderBy(F.desc("computed_at"), F.desc("id"))
    ranked = w.assessments(spark, d).withColumn("n", F.row_number().over(order))
    return assessment.published(ranked.where("n = 1"), ranked.where("n = 2"))


@query(
    w.sql(
        "assessments",
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id DESC) AS n FROM assessments), t AS (SELECT c_custkey AS subject FROM customer WHERE c_acctbal > 8000)
SELECT band, count(*) AS n_found, (SELECT count(*) FROM t) AS n_true, count(t.subject) AS n_hit, round(count(t.subject) / count(*), 4) AS precision, round(count(t.subject) / (SELECT count(*) FROM t), 4) AS recall FROM r LEFT JOIN t ON t.subject = r.subject WHERE n = 1 GROUP BY band""",
    )
)
def evaluation_by_band(spark, d):
    truth = table(spark, d, "customer").where("c_acctbal > 8000").select(F.col("c_custkey").alias("subject"))
    return rounded(assessment.precision_recall(rollups.latest_per(w.assessments(spark, d), "subject"), truth, "band"), "precision", "recall")


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id DESC) AS n FROM assessments) WHERE n = 1)"


@query(w.sql("assessments", f"WITH {LATEST} SELECT 'assessment.elevated' AS rule, substr(sha256('assessment.elevated@1::' || subject), 1, 32) AS key, round(least(1.0, score / 100), 4) AS magnitude, round(coverage, 4) AS confidence FROM latest WHERE band = 'elevated'"))
def rule_elevated(spark, d):
    found = alerting.elevated(rollups.latest_per(w.assessments(spark, d), "subject"))
    return rounded(found.select("rule", "key", "magnitude", "confidence"), "magnitude", "confidence")


@query(
    w.sql(
        "assessments",
        """WITH t AS (SELECT *, row_number() OVER (PARTITION BY subject, computed_at ORDER BY id DESC) AS k FROM assessments), p AS (SELECT *, lag(band) OVER (PARTITION BY subject ORDER BY computed_at) AS previous, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC) AS n FROM t WHERE k = 1),
q AS (SELECT subject, coverage, CASE band WHEN 'insufficient' THEN 0 WHEN 'notable' THEN 2 WHEN 'elevated' THEN 3 ELSE -1 END AS now, CASE previous WHEN 'insufficient' THEN 0 WHEN 'notable' THEN 2 WHEN 'elevated' THEN 3 ELSE -1 END AS before FROM p WHERE n = 1)
SELECT CAST(subject AS VARCHAR) AS subject, round(least(1.0, (now - before) / 3), 4) AS magnitude, round(coverage, 4) AS confidence FROM q WHERE before >= 0 AND now > before AND now >= 2""",
    )
)
def rule_escalated(spark, d):
    found = alerting.escalated(w.assessments(spark, d))
    return rounded(found.select(F.col("scope")[0].alias("subject"), "magnitude", "confidence"), "magnitude", "confidence")


def all_alerts(spark, d):
    ledger = w.assessments(spark, d)
    current = rollups.latest_per(ledger, "subject")
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("cluster"))
    alerts = alerting.elevated(current).unionByName(alerting.escalated(ledger)).unionByName(alerting.convergences(members, current))
    return alerts, members, ledger


@query(
    w.sql(
        "assessments",
        f"""WITH {LATEST}, m AS (SELECT c_custkey AS subject, c_nationkey || '-' || c_mktsegment AS cluster FROM customer), s AS (SELECT cluster, count(*) AS size FROM m GROUP BY 1)
SELECT cluster, count(*) AS n, round(count(*) / size, 6) AS magnitude, round(avg(coverage), 6) AS confidence FROM m JOIN latest USING (subject) JOIN s USING (cluster) WHERE band IN ('elevated', 'notable') GROUP BY cluster, size HAVING count(*) >= 2""",
    )
)
def rule_convergence(spark, d):
    alerts, members, ledger = all_alerts(spark, d)
    found = alerts.where("rule = 'convergence.assessed_cluster'").select("key", "scope", "magnitude", "confidence")
    named = found.join(members.select(F.col("subject").cast("string").alias("s"), "cluster"), F.col("scope")[0] == F.col("s"))
    return rounded(named.select("cluster", F.size("scope").cast("long").alias("n"), "magnitude", "confidence"), "magnitude", "confidence", digits=6)


@query()
def alert_groups(spark, d):
    alerts, members, ledger = all_alerts(spark, d)
    now = F.lit("2001-08-02").cast("timestamp_ntz")
    return rounded(alerting.prioritised(alerting.grouped(alerts, members), now).withColumn("rules", F.array_join("rules", ",")), "priority")


@query()
def suppressed_alerts(spark, d):
    alerts, _, _ = all_alerts(spark, d)
    rules = spark.sql(
        """select id, rule, subject, expires_at, revoked from values (1, 'assessment.elevated', null, timestamp_ntz'2001-07-01', timestamp_ntz'2001-09-01', false, 'known noise here'), (2, 'assessment.elevated', '7', timestamp_ntz'2001-07-01', timestamp_ntz'2001-09-01', false, 'cleared by analyst'),
        (3, null, '7', timestamp_ntz'2001-01-01', timestamp_ntz'2001-06-30', false, 'over by now'), (4, 'assessment.escalated', null, timestamp_ntz'2001-07-01', timestamp_ntz'2001-09-01', true, 'revoked already') as t(id, rule, subject, made, expires_at, revoked, note)"""
    )
    return alerting.suppressed(alerts, rules, F.lit("2001-08-02").cast("timestamp_ntz")).select("key", "rule", "suppressed_by")


@query(
    w.sql(
        "assessments",
        """WITH q AS (SELECT CAST(subject AS VARCHAR) AS key, band AS rule, count(*) AS occurrences, min(computed_at) AS first_seen, max(computed_at) AS last_seen FROM assessments WHERE subject % 3 <> 0 GROUP BY 1, 2),
r AS (SELECT CAST(subject AS VARCHAR) AS key, min(band) AS rule FROM assessments WHERE run = '2001-07' GROUP BY 1), k AS (SELECT key, min(rule) AS rule, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM q GROUP BY 1)
SELECT coalesce(k.key, r.key) AS key, coalesce(k.rule, r.rule) AS rule, coalesce(occurrences, 0) + CASE WHEN r.key IS NULL THEN 0 ELSE 1 END AS occurrences, CASE WHEN k.key IS NULL THEN 'created' WHEN r.key IS NULL THEN 'unchanged' ELSE 'repeated' END AS change FROM k FULL JOIN r ON k.key = r.key""",
    )
)
def alert_upsert(spark, d):
    """A queue after one more run."""
    rows = w.assessments(spark, d).withColumn("key", F.col("subject").cast("string"))
    queue = rows.where("subject % 3 <> 0").groupBy("key").agg(F.min("band").alias("rule"), F.count(F.lit(1)).alias("occurrences"), F.min("computed_at").alias("first_seen"), F.max("computed_at").alias("last_seen"))
    run = rows.where("run = '2001-07'").select("key", F.col("band").alias("rule"))
    return alerting.upserted(queue, run, F.lit("2001-08-01").cast("timestamp_ntz")).select("key", "rule", "occurrences", "change")


@query(
    w.sql(
        "assessments",
        """WITH r AS (SELECT id AS key, ['open', 'acknowledged', 'investigating', 'resolved', 'dismissed'][id % 5 + 1] AS from_state, ['open', 'acknowledged', 'investigating', 'resolved', 'dismissed', 'lost'][id // 5 % 6 + 1] AS to_state, CASE WHEN id % 3 = 0 THEN 'seen' WHEN id % 3 = 1 THEN 'duplicate' END AS reason,
 CASE WHEN id % 7 = 0 THEN 'open' ELSE ['open', 'acknowledged', 'investigating', 'resolved', 'dismissed'][id % 5 + 1] END AS state FROM assessments),
m AS (SELECT unnest(['open>acknowledged', 'open>investigating', 'open>dismissed', 'acknowledged>investigating', 'acknowledged>dismissed', 'acknowledged>open', 'investigating>resolved', 'investigating>dismissed', 'investigating>acknowledged', 'resolved>investigating', 'resolved>open', 'dismissed>open', 'dismissed>investigating']) AS move)
SELECT key, from_state, to_state, CASE WHEN to_state = 'lost' THEN 'no such state' WHEN state <> from_state THEN 'state has changed' WHEN from_state = to_state THEN 'nothing would change' WHEN from_state || '>' || to_state NOT IN (FROM m) THEN 'no such move'
 WHEN to_state = 'dismissed' AND coalesce(reason, '') <> 'duplicate' THEN 'a dismissal needs a known reason' END AS why FROM r""",
    )
)
def state_transitions(spark, d):
    rows = w.assessments(spark, d).withColumn("key", F.col("id"))
    states = F.array(*[F.lit(s) for s in (*alerting.ALERT_MOVES, "lost")])
    at = lambda i: F.get(states, i.cast("int"))
    wanted = rows.select("key", at(F.col("id") % 5).alias("from_state"), at(F.floor(F.col("id") / 5) % 6).alias("to_state"), F.when(F.col("id") % 3 == 0, "seen").when(F.col("id") % 3 == 1, "duplicate").alias("reason"))
    state = rows.select("key", F.when(F.col("id") % 7 == 0, "open").otherwise(at(F.col("id") % 5)).alias("state"))
    return alerting.transitions(wanted, state).select("key", "from_state", "to_state", "why")


@query(
    w.sql(
        "assessments",
        """WITH r AS (SELECT id AS key, ['open', 'active', 'closed'][id % 3 + 1] AS from_state, ['open', 'active', 'closed'][id // 3 % 3 + 1] AS to_state FROM assessments)
SELECT key, from_state, to_state, CASE WHEN from_state = to_state THEN 'nothing would change' WHEN from_state = 'closed' AND to_state = 'open' THEN 'no such move' END AS why FROM r""",
    )
)
def case_transitions(spark, d):
    """Moves of investigations: a closed one is opened again as active."""
    states = F.array(*[F.lit(s) for s in alerting.CASE_MOVES])
    rows = w.assessments(spark, d).select(F.col("id").alias("key"), F.get(states, (F.col("id") % 3).cast("int")).alias("from_state"), F.get(states, (F.floor(F.col("id") / 3) % 3).cast("int")).alias("to_state"), F.lit(None).cast("string").alias("reason"))
    return alerting.transitions(rows, rows.select("key", F.col("from_state").alias("state")), alerting.CASE_MOVES).select("key", "from_state", "to_state", "why")


def closed_alerts(spark, d):
    """Assessments as alerts that analysts have closed."""
    reasons = F.array(*[F.lit(r) for r in alerting.DISMISSALS])
    state = F.when(F.col("id") % 3 == 0, "resolved").when(F.col("id") % 3 == 1, "dismissed").otherwise("open")
    return w.assessments(spark, d).select(F.col("id").alias("key"), F.col("band").alias("rule"), state.alias("state"), F.when(F.col("id") % 3 == 1, F.get(reasons, (F.floor(F.col("id") / 3) % 5).cast("int"))).alias("reason"))


@query(
    w.sql(
        "assessments",
        """WITH c AS (SELECT band AS rule, id % 3 AS k, id % 3 = 1 AND id // 3 % 5 = 0 AS wrong FROM assessments)
SELECT rule, count(*) FILTER (WHERE k = 0 OR wrong) AS n_judged, count(*) FILTER (WHERE wrong) AS n_wrong, count(*) FILTER (WHERE k = 1 AND NOT wrong) AS n_out_of_scope, round(count(*) FILTER (WHERE wrong) / count(*) FILTER (WHERE k = 0 OR wrong), 4) AS false_positive_rate FROM c GROUP BY 1""",
    )
)
def rule_quality(spark, d):
    """How often each rule was wrong; dismissals that only narrow the scope don't count against it."""
    return rounded(alerting.rule_quality(closed_alerts(spark, d)), "false_positive_rate")


def alert_queue(spark, d):
    """Assessments as a queue with states, levels and people who work on them."""
    states = F.array(*[F.lit(s) for s in alerting.ALERT_MOVES])
    level = F.when(F.col("band") == "elevated", "high").when(F.col("band") == "notable", "medium").otherwise("low")
    return w.assessments(spark, d).select(F.col("id").alias("key"), F.get(states, (F.col("id") % 5).cast("int")).alias("state"), level.alias("level"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("analyst"), (F.col("subject") % 9).cast("string"))).alias("assignee"), F.array("band").alias("rules"), "score")


QUEUE = """queue AS (SELECT id AS key, id % 5 AS s, CASE band WHEN 'elevated' THEN 'high' WHEN 'notable' THEN 'medium' ELSE 'low' END AS level, CASE WHEN id % 4 <> 0 THEN 'analyst' || (subject % 9) END AS assignee, band, score FROM assessments),
l AS (SELECT 'open' AS listing, key FROM queue WHERE s < 3 UNION ALL SELECT 'mine', key FROM queue WHERE s < 3 AND assignee = 'analyst3' UNION ALL SELECT 'unassigned', key FROM queue WHERE s < 3 AND assignee IS NULL
 UNION ALL SELECT 'high', key FROM queue WHERE s < 3 AND level = 'high' UNION ALL SELECT 'rule', key FROM queue WHERE s < 3 AND band = 'notable' UNION ALL SELECT 'closed', key FROM queue WHERE s >= 3)"""


@query(w.sql("assessments", f"WITH {QUEUE} SELECT listing, key, count(*) OVER (PARTITION BY listing) AS total FROM l"))
def queue_listings(spark, d):
    """The six listings of the alert queue, each with its true number."""
    queue, working = alert_queue(spark, d), ("open", "acknowledged", "investigating")
    parts = {
        "open": alerting.listed(queue, working), "mine": alerting.listed(queue, working, assignee="analyst3"), "unassigned": alerting.listed(queue, working, unassigned=True),
        "high": alerting.listed(queue, working, level="high"), "rule": alerting.listed(queue, working, rule="notable"), "closed": alerting.listed(queue, ("resolved", "dismissed")),
    }
    out = None
    for name, rows in parts.items():
        rows = rows.select(F.lit(name).alias("listing"), "key", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(w.sql("assessments", "SELECT subject, id, CASE WHEN total > 5 THEN 'truncated' ELSE 'complete' END AS coverage FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id) AS r, count(*) OVER (PARTITION BY subject) AS total FROM assessments) WHERE r <= 5"))
def timeline_preview(spark, d):
    return alerting.preview(w.assessments(spark, d).withColumn("ts", F.col("computed_at")), "subject", 5).select("subject", "id", "coverage")


@query(
    w.sql(
        "assessments",
        "SELECT state AS outcome, band AS rule, count(DISTINCT subject) AS n_investigations, count(DISTINCT id) AS n_alerts FROM assessments WHERE state <> 'O' GROUP BY 1, 2",
    )
)
def outcomes_by_rule(spark, d):
    return w.assessments(spark, d).where("state <> 'O'").groupBy(F.col("state").alias("outcome"), F.col("band").alias("rule")).agg(F.countDistinct("subject").alias("n_investigations"), F.countDistinct("id").alias("n_alerts"))


@query(w.sql("assessments", "SELECT id, CASE WHEN id % 4 = 0 THEN 'reviewed' WHEN id % 4 = 1 THEN NULL ELSE state END AS state, band FROM assessments"))
def partial_update(spark, d):
    rows = w.assessments(spark, d).select("id", "state", "band")
    changes = rows.select("id", F.when(F.col("id") % 4 == 0, "reviewed").alias("state"), (F.col("id") % 4 < 2).alias("set_state"))
    return alerting.partly_updated(rows, changes, "id", ["state"]).select("id", "state", "band")


@query(w.sql("assessments", "SELECT id, printf('%s %d: %s at %.2f, evidence %d %%', band, subject, state, score, CAST(round(coverage * 100) AS INTEGER)) AS headline FROM assessments"))
def narratives(spark, d):
    """One line of prose for every assessment."""
    return w.assessments(spark, d).select("id", F.format_string("%s %d: %s at %.2f, evidence %d %%", "band", "subject", "state", "score", F.round(F.col("coverage") * 100).cast("int")).alias("headline"))
