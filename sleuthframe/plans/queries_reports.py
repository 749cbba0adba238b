"""Rates of assessments, signals and alerts against planted storylines, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import alert_runs, reports
from sleuthframe.operators.rollups import latest_per
from sleuthframe.plans import queries_alerts as qa
from sleuthframe.plans import queries_dossiers as qd
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


def labels(spark, d):
    """Customers with high balances take part in their segment's storyline; those in debt are planted without one; one segment leaves no trace."""
    rows = table(spark, d, "customer").where("c_acctbal > 7000 or c_acctbal < -500")
    story = F.when(F.col("c_mktsegment") == "MACHINERY", "identity_overlap").otherwise(F.col("c_mktsegment"))
    return rows.select(F.col("c_custkey").alias("subject"), F.when(F.col("c_acctbal") > 7000, story).alias("storyline"))


LABELS = "labels_ AS (SELECT c_custkey AS subject, CASE WHEN c_acctbal > 7000 THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN 'identity_overlap' ELSE c_mktsegment END END AS storyline FROM customer WHERE c_acctbal > 7000 OR c_acctbal < -500)"
BEYOND = "beyond AS (SELECT unnest(['document_forgery_ring', 'identity_overlap']) AS storyline)"


@query(
    w.sql(
        "assessments",
        f"""WITH {qa.LATEST}, {LABELS}, t AS (SELECT l.subject, band, score, x.subject IS NOT NULL AS known, x.storyline IS NOT NULL AS story FROM latest l LEFT JOIN labels_ x ON x.subject = l.subject), top AS (SELECT * FROM t ORDER BY score DESC, subject LIMIT 50),
m AS (SELECT 'elevated' AS measure, count(*) FILTER (band = 'elevated') AS selected, count(*) FILTER (band = 'elevated' AND known) AS true_positives, count(*) FILTER (known) AS labelled FROM t UNION ALL SELECT 'notable_or_better', count(*) FILTER (band IN ('elevated', 'notable')), count(*) FILTER (band IN ('elevated', 'notable') AND known), count(*) FILTER (known) FROM t
 UNION ALL SELECT 'elevated_storyline_only', count(*) FILTER (band = 'elevated'), count(*) FILTER (band = 'elevated' AND story), count(*) FILTER (story) FROM t UNION ALL SELECT 'top', count(*), count(*) FILTER (known), (SELECT count(*) FROM t WHERE known) FROM top)
SELECT *, round(true_positives / selected, 4) AS precision, round(true_positives / labelled, 4) AS recall FROM m""",
    )
)
def assessment_rates(spark, d):
    """Current assessments against planted subjects: elevated, notable or better, storylines only, and the fifty highest scores."""
    return reports.assessment_rates(latest_per(w.assessments(spark, d), "subject"), labels(spark, d))


@query(
    w.sql(
        "assessments",
        f"""WITH {qa.LATEST}, {LABELS}, {BEYOND}, s AS (SELECT storyline, count(*) AS planted, count(*) FILTER (band = 'elevated') AS n_elevated, count(*) FILTER (band IN ('elevated', 'notable')) AS n_notable, count(*) FILTER (band = 'insufficient') AS n_insufficient FROM latest JOIN labels_ USING (subject) WHERE storyline IS NOT NULL GROUP BY 1)
SELECT storyline, coalesce(planted, 0) AS planted, coalesce(n_elevated, 0) AS n_elevated, coalesce(n_notable, 0) AS n_notable, coalesce(n_insufficient, 0) AS n_insufficient, round(n_notable / planted, 4) AS recall, storyline NOT IN ('document_forgery_ring', 'identity_overlap') AS detectable FROM s FULL JOIN beyond USING (storyline)""",
    )
)
def assessment_storylines(spark, d):
    """How far the subjects of each storyline got, those that leave no trace listed as such."""
    return reports.assessment_storylines(latest_per(w.assessments(spark, d), "subject"), labels(spark, d))


@query(
    w.sql(
        "shipments",
        """WITH c AS (SELECT origin, destination, count(*) / sum(count(*)) OVER () AS share FROM shipments GROUP BY 1, 2), x AS (SELECT shipment_id, CAST(flagged AS INTEGER) AS manifest_discrepancy, least(1.0, greatest(0.0, (detour - 1.25) / 1.25)) AS route_detour, least(1.0, greatest(0.0, (0.005 - share) / 0.004)) AS rare_corridor, shipment_id % 1000 = 1 AS known FROM shipments JOIN c USING (origin, destination)),
s AS (SELECT 'manifest_discrepancy' AS signal, manifest_discrepancy AS m, known FROM x UNION ALL SELECT 'route_detour', route_detour, known FROM x UNION ALL SELECT 'rare_corridor', rare_corridor, known FROM x)
SELECT signal, count(m) AS evaluable, count(*) - count(m) AS not_evaluable, count(*) FILTER (m > 0) AS fired, count(*) FILTER (m > 0 AND known) AS fired_on_labelled, round(count(*) FILTER (m > 0) / count(m), 4) AS fire_rate, round(count(*) FILTER (m > 0 AND known) / nullif(count(*) FILTER (m > 0), 0), 4) AS precision FROM s GROUP BY 1""",
    )
)
def signal_rates(spark, d):
    """How often each signal of a shipment could be judged, fired, and fired on a planted one (an order's first)."""
    signals = written(qa.shipment_signals(spark, d))
    known = w.numbered_lines(spark, d).where("r = 1").select(F.col("edge_id").alias("subject"), F.lit("first lines").alias("storyline"))
    return reports.signal_rates(signals, known)


def alert_scopes(spark, d):
    """Whom the alerts over the whole ledger are about: ``key`` (rule and ref), ``rule``, ``subject``."""
    members = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.concat_ws("-", "c_nationkey", "c_mktsegment").alias("cluster"))
    current = written(alert_runs.current_findings(w.assessments(spark, d).where(F.col("computed_at") < qd.at(qd.SECOND)).drop("run", "state")))
    fired = alert_runs.firings(current, qd.alert_links(spark, d), members)
    return written(fired.select(F.concat_ws("::", "rule", "ref").alias("key"), "rule", "subject"))


def planted(spark, d):
    """The labels' storylines as kinds, with a story a nation."""
    nation = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("story"))
    return labels(spark, d).where("storyline is not null").join(nation, "subject").select("story", F.col("storyline").alias("kind"), F.col("subject").cast("string").alias("subject"))


SCOPES = f"""{qd.RUNS}, {LABELS}, planted AS (SELECT c_nationkey AS story, storyline AS kind, subject FROM labels_ JOIN customer ON c_custkey = subject WHERE storyline IS NOT NULL),
scopes AS (SELECT rule || '::' || ref AS key, rule, subject FROM fired2), alerted AS (SELECT DISTINCT subject FROM scopes)"""


@query(
    w.sql(
        "assessments contacts",
        f"""{SCOPES}, n AS (SELECT (SELECT count(DISTINCT key) FROM scopes) AS alerts, (SELECT count(*) FROM alerted) AS subjects, (SELECT count(*) FROM alerted WHERE subject IN (SELECT subject FROM planted)) AS labelled,
 (SELECT count(DISTINCT subject) FROM planted WHERE kind <> 'identity_overlap') AS reachable, (SELECT count(DISTINCT subject) FROM planted WHERE kind <> 'identity_overlap' AND subject IN (FROM alerted)) AS reached)
SELECT *, round(labelled / subjects, 4) AS precision, round(reached / reachable, 4) AS recall, round(1 - labelled / subjects, 4) AS unlabelled FROM n""",
    )
)
def alert_rates(spark, d):
    """Alerts against planted storylines: precision over all alerted, recall over what could be reached."""
    return reports.alert_rates(alert_scopes(spark, d), planted(spark, d))


@query(w.sql("assessments contacts", f"{SCOPES} SELECT rule, count(DISTINCT key) AS alerts, count(DISTINCT subject) AS subjects, count(DISTINCT subject) FILTER (subject IN (SELECT subject FROM planted)) AS labelled, round(count(DISTINCT subject) FILTER (subject IN (SELECT subject FROM planted)) / count(DISTINCT subject), 4) AS precision FROM scopes GROUP BY 1"))
def alert_rules(spark, d):
    """Each rule's alerts, subjects, and planted ones among them."""
    return reports.alert_rules(alert_scopes(spark, d), planted(spark, d))


@query(
    w.sql(
        "assessments contacts",
        f"""{SCOPES}, m AS (SELECT kind, count(*) AS members, count(*) FILTER (subject IN (FROM alerted)) AS alerted FROM planted GROUP BY 1), r AS (SELECT kind, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM planted JOIN scopes USING (subject) GROUP BY 1), b AS (SELECT unnest(['document_forgery_ring', 'identity_overlap']) AS kind)
SELECT kind, coalesce(members, 0) AS members, coalesce(alerted, 0) AS alerted, round(alerted / members, 4) AS recall, coalesce(rules, '') AS rules, kind NOT IN (FROM b) AS reachable FROM m FULL JOIN b USING (kind) LEFT JOIN r USING (kind)""",
    )
)
def alert_storylines(spark, d):
    """How many members of each kind of storyline were alerted, and by which rules."""
    return reports.alert_storylines(alert_scopes(spark, d), planted(spark, d)).withColumn("rules", F.array_join("rules", ","))
