"""Read-model queries over the append-only ledgers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.plans import world as w
from sleuthframe.sources.tables import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    """Register a query by its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


@query(
    w.sql(
        "accounts transfers activity contacts assessments",
        """SELECT 'accounts' AS ledger, count(*) AS n FROM accounts UNION ALL SELECT 'transfers', count(*) FROM transfers UNION ALL SELECT 'activity', count(*) FROM activity
UNION ALL SELECT 'contacts', count(*) FROM contacts UNION ALL SELECT 'assessments', count(*) FROM assessments""",
    )
)
def ledger_counts(spark, d):
    """How many rows each ledger has; one row per ledger, also for empty ones."""
    parts = [v(spark, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v.__name__).alias("ledger"), "n") for v in (w.accounts, w.transfers, w.activity, w.contacts, w.assessments)]
    first, *rest = parts
    for part in rest:
        first = first.unionByName(part)
    return first


@query(
    w.sql(
        "accounts",
        """SELECT coalesce(band, 'unassessed') AS band, count(DISTINCT country) AS n_countries, count(DISTINCT region) AS n_regions, count(lat) AS n_located, count(*) AS n_total,
 string_agg(DISTINCT region, ',' ORDER BY region) AS regions FROM accounts GROUP BY 1""",
    )
)
def band_spread(spark, d):
    """How far the members of a band are spread, with the basis: how many of them are located at all."""
    rows = w.accounts(spark, d).groupBy(F.coalesce("band", F.lit("unassessed")).alias("band"))
    return rows.agg(
        F.count_distinct("country").alias("n_countries"), F.count_distinct("region").alias("n_regions"), F.count("lat").alias("n_located"), F.count(F.lit(1)).alias("n_total"),
        F.array_join(F.sort_array(F.collect_set("region")), ",").alias("regions"),
    )


@query(
    w.sql(
        "activity",
        """WITH l AS (SELECT max(ts) AS upto FROM activity),
recent AS (SELECT lane, count(*) AS n_recent, count(*) FILTER (WHERE value < 5) AS n_failed FROM activity, l WHERE ts > upto - INTERVAL 24 HOUR GROUP BY 1),
ever AS (SELECT lane, count(*) AS n_ever, max(ts) AS last_ts FROM activity GROUP BY 1)
SELECT ever.lane, n_ever, CAST(floor(epoch(last_ts)) AS BIGINT) AS last_seen, coalesce(n_recent, 0) AS n_recent, coalesce(n_failed, 0) AS n_failed,
 CASE WHEN n_recent > 0 THEN round(n_failed / n_recent, 4) END AS failed_share FROM ever LEFT JOIN recent ON ever.lane = recent.lane""",
    )
)
def connector_health(spark, d):
    """Each feed with its last day's records and failures; feeds that were silent have zeros and no share."""
    rows = w.activity(spark, d)
    upto = rows.agg(F.max("ts").alias("upto"))
    recent = rows.join(F.broadcast(upto)).where(F.col("ts") > F.col("upto") - F.expr("INTERVAL 24 HOURS"))  # one row
    recent = recent.groupBy("lane").agg(F.count(F.lit(1)).alias("n_recent"), F.count_if(F.col("value") < 5).alias("n_failed"))
    ever = rows.groupBy("lane").agg(F.count(F.lit(1)).alias("n_ever"), F.unix_timestamp(F.max("ts").cast("timestamp")).alias("last_seen"))
    n_recent, n_failed = F.coalesce("n_recent", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    return ever.join(recent, "lane", "left").select("lane", "n_ever", "last_seen", n_recent.alias("n_recent"), n_failed.alias("n_failed"), F.when(n_recent > 0, F.round(n_failed / n_recent, 4)).alias("failed_share"))


@query("SELECT o_orderkey AS alert, len(list_distinct(list(l_suppkey))) AS n_scope FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING list_contains(list(l_suppkey), 7)")
def scope_containment(spark, d):
    """The alerts whose scope (an array) has one subject."""
    scopes = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    scopes = scopes.groupBy(F.col("o_orderkey").alias("alert")).agg(F.collect_set("l_suppkey").alias("scope"))
    return scopes.where(F.array_contains("scope", F.lit(7).cast("long"))).select("alert", F.size("scope").cast("long").alias("n_scope"))


@query(
    w.sql(
        "assessments",
        """SELECT c_custkey AS subject, (SELECT count(*) FROM assessments a WHERE a.subject = c_custkey) AS n_all, (SELECT count(*) FROM assessments a WHERE a.subject = c_custkey AND a.state = 'O') AS n_open,
 (SELECT count(DISTINCT run) FROM assessments a WHERE a.subject = c_custkey) AS n_runs, (SELECT max(score) FROM assessments a WHERE a.subject = c_custkey AND a.band = 'elevated') AS top_elevated FROM customer""",
    )
)
def investigation_counts(spark, d):
    """Per subject, several counts of its ledger rows in one aggregation; subjects without any have zeros."""
    rows = w.assessments(spark, d).groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("state") == "O").alias("n_open"), F.count_distinct("run").alias("n_runs"), F.max(F.when(F.col("band") == "elevated", F.col("score"))).alias("top_elevated")
    )
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))
    return everyone.join(rows, "subject", "left").select("subject", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_all", "n_open", "n_runs")], "top_elevated")


@query(
    w.sql(
        "transfers",
        """WITH sent AS (SELECT DISTINCT src AS ref, dst AS other FROM transfers WHERE src <> dst), got AS (SELECT DISTINCT dst AS ref, src AS other FROM transfers WHERE src <> dst),
b AS (SELECT ref, count(*) AS n_both FROM (SELECT * FROM sent INTERSECT SELECT * FROM got) GROUP BY 1), s AS (SELECT ref, count(*) AS n_sent_only FROM (SELECT * FROM sent EXCEPT SELECT * FROM got) GROUP BY 1)
SELECT ref, coalesce(n_both, 0) AS n_both, coalesce(n_sent_only, 0) AS n_sent_only FROM (SELECT DISTINCT ref FROM sent) LEFT JOIN b USING (ref) LEFT JOIN s USING (ref)""",
    )
)
def counterparty_sets(spark, d):
    """How many accounts each one trades with both ways and only outwards, without gathering the sets."""
    moved = w.transfers(spark, d).where("src <> dst")
    ways = moved.select(F.col("src").alias("ref"), F.col("dst").alias("other"), F.lit(1).alias("out")).unionByName(moved.select(F.col("dst").alias("ref"), F.col("src").alias("other"), F.lit(0).alias("out")))
    pairs = ways.groupBy("ref", "other").agg(F.max("out").alias("sent"), F.min("out").alias("least"))
    counts = pairs.where("sent = 1").groupBy("ref").agg(F.count_if(F.col("least") == 0).alias("n_both"), F.count_if(F.col("least") == 1).alias("n_sent_only"))
    return counts


@query(
    w.sql(
        "assessments",
        """WITH g AS (SELECT subject, count(*) AS n, bool_or(band = 'elevated') AS hot, round(avg(score), 4) AS mean_score FROM assessments GROUP BY 1)
SELECT row_number() OVER (ORDER BY hot DESC, n DESC, mean_score DESC NULLS LAST, subject) AS place, subject, n, hot, mean_score FROM g ORDER BY place LIMIT 100""",
    )
)
def ordered_groups(spark, d):
    """The first hundred groups: elevated before others, then by size and mean score, nulls last."""
    groups = w.assessments(spark, d).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("band") == "elevated").alias("hot"), F.round(F.avg("score"), 4).alias("mean_score"))
    top = groups.orderBy(F.desc("hot"), F.desc("n"), F.desc_nulls_last("mean_score"), "subject").limit(100)
    order = F.row_number().over(w.Window.orderBy(F.desc("hot"), F.desc("n"), F.desc_nulls_last("mean_score"), "subject"))  # a hundred rows
    return top.select(order.cast("long").alias("place"), "subject", "n", "hot", "mean_score")
