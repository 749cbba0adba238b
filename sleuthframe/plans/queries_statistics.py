"""Temporal and spatial statistics over daily lanes and located accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import patterns, rollups, sequences, statistics
from sleuthframe.plans import world as w
from sleuthframe.plans.queries_rollups import DENSE, HAVERSINE, dense_days
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


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query()
def lane_rate_changes(spark, d):
    """Exact comparison of the last week with the two before it."""
    counts = sequences.recent_and_baseline(dense_days(spark, d), 7, 14)
    return rounded(statistics.compare_rates(counts), "ratio", "ratio_low", "ratio_high", "p_value")


@query(
    w.sql(
        "activity",
        f"""WITH {DENSE}, m AS (SELECT max(day) AS last FROM dense), c AS (SELECT lane, sum(CASE WHEN last - day < 7 THEN total ELSE 0 END) AS a, sum(CASE WHEN last - day >= 7 AND last - day < 21 THEN total ELSE 0 END) AS b FROM dense, m GROUP BY lane)
SELECT lane, round(a * 14 / (b * 7), 6) AS ratio FROM c WHERE a + b > 0""",
    )
)
def lane_rate_ratios(spark, d):
    counts = sequences.recent_and_baseline(dense_days(spark, d), 7, 14)
    return rounded(statistics.compare_rates(counts).where("evaluable").select("lane", "ratio"), "ratio")


@query()
def unusual_days(spark, d):
    return rounded(statistics.unusual_days(dense_days(spark, d)), "expected", "p_value").withColumn("day", F.col("day").cast("string"))


@query(
    w.sql(
        "activity",
        f"""WITH {DENSE}, a AS (SELECT lane, total, row_number() OVER (PARTITION BY lane ORDER BY day) AS i FROM dense),
p AS (SELECT a.lane, sum(sign(b.total - a.total)) AS s, median((b.total - a.total) / (b.i - a.i)) AS slope FROM a JOIN a b ON a.lane = b.lane AND a.i < b.i GROUP BY 1),
t AS (SELECT lane, sum(c) AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT lane, total, count(*) AS c FROM a GROUP BY 1, 2) GROUP BY 1)
SELECT p.lane, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS s, round((s - sign(s)) / sqrt((n * (n - 1) * (2 * n + 5) - ties) / 18), 6) AS z, round(slope, 6) AS slope FROM p JOIN t ON p.lane = t.lane""",
    )
)
def lane_trends(spark, d):
    return rounded(statistics.trend(dense_days(spark, d)).select("lane", "n", "s", "z", "slope"), "z", "slope")


@query()
def lane_change_points(spark, d):
    return rounded(statistics.change_points(dense_days(spark, d)), "statistic", "p_value")


@query(
    w.sql(
        "activity",
        f"""WITH {DENSE}, c AS (SELECT lane, isodow(day) - 1 AS k, sum(total) AS o FROM dense GROUP BY 1, 2), g AS (SELECT lane, sum(o) AS n FROM c GROUP BY 1)
SELECT c.lane, CAST(n AS BIGINT) AS n, round(sum(pow(o - n / 7, 2) / (n / 7)), 6) AS statistic, arg_max(k, (o, -k)) AS busiest, arg_min(k, (o, k)) AS quietest FROM c JOIN g ON c.lane = g.lane GROUP BY c.lane, n HAVING n >= 35""",
    )
)
def weekly_patterns(spark, d):
    return rounded(statistics.weekly_pattern(dense_days(spark, d)).where("evaluable").select("lane", "n", "statistic", "busiest", "quietest"), "statistic")


def located_customers(spark, d):
    """Customers near a point of their nation: a few hundred km around."""
    rows = table(spark, d, "customer").join(w.nations(spark, d), F.col("c_nationkey") == F.col("nation"))
    lat = (F.col("nation") * 37) % 120 - 60 + (F.col("c_custkey") * 13 % 17) / 10.0
    lng = (F.col("nation") * 91) % 340 - 170 + (F.col("c_custkey") * 29 % 23) / 10.0
    band = F.when(F.col("c_acctbal") >= 8000, "elevated").when(F.col("c_acctbal") >= 5000, "notable")
    return rows.select(F.col("c_custkey").alias("ref"), "country", lat.cast("double").alias("lat"), lng.cast("double").alias("lng"), F.col("c_acctbal").alias("balance"), band.alias("band"))


LOCATED = """located AS (SELECT c_custkey AS ref, country, (nation * 37) % 120 - 60 + (c_custkey * 13 % 17) / 10.0::DOUBLE AS lat, (nation * 91) % 340 - 170 + (c_custkey * 29 % 23) / 10.0::DOUBLE AS lng, c_acctbal AS balance,
 CASE WHEN c_acctbal >= 8000 THEN 'elevated' WHEN c_acctbal >= 5000 THEN 'notable' END AS band FROM customer JOIN nations ON c_nationkey = nation)"""
NEAR = f"near AS (SELECT a.ref AS a, b.ref AS b, b.balance AS v FROM located a, located b WHERE {HAVERSINE.format('a.lat', 'b.lat', 'a.lng', 'b.lng')} <= {{km}})"


@query(
    w.sql(
        "nations",
        f"""WITH {LOCATED}, {NEAR.format(km=25)}, core AS (SELECT a FROM near GROUP BY 1 HAVING count(*) >= 4),
e AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)), c AS (SELECT a AS node, a AS component FROM core UNION SELECT e.b, c.component FROM c JOIN e ON e.a = c.node),
k AS (SELECT node, min(component) AS component FROM c GROUP BY 1), o AS (SELECT b AS ref, min(component) AS component FROM near JOIN k ON k.node = near.a GROUP BY 1)
SELECT l.ref, coalesce(k.component, o.component) AS cluster, k.component IS NOT NULL AS core FROM located l LEFT JOIN k ON k.node = l.ref LEFT JOIN o ON o.ref = l.ref""",
        recursive=True,
    )
)
def dense_regions(spark, d):
    return statistics.dense_regions(located_customers(spark, d), 25.0, 4)


@query()
def region_summaries(spark, d):
    points = located_customers(spark, d)
    found = statistics.region_summaries(points, statistics.dense_regions(points, 25.0, 4))
    return rounded(found, "lat", "lng", "radius_km", "mean_km", "density", digits=4)


@query(
    w.sql(
        "nations",
        f"""WITH {LOCATED}, {NEAR.format(km=120)}, g AS (SELECT count(*) AS n, avg(balance) AS m, stddev_pop(balance) AS s FROM located), k AS (SELECT a AS ref, count(*) AS w, sum(v) AS wx FROM near GROUP BY 1)
SELECT ref, w AS n_near, round((wx - m * w) / (s * sqrt(greatest(1e-12, (n * w - w * w) / (n - 1)))), 4) AS z FROM k, g""",
    )
)
def hot_spot_scores(spark, d):
    found = statistics.hot_spots(located_customers(spark, d), "balance", 120.0)
    return found.select("ref", "n_near", F.round("z", 4).alias("z"))


@query()
def hot_spots(spark, d):
    return rounded(statistics.hot_spots(located_customers(spark, d), "balance", 120.0), "z", "p_value", digits=4)


def lane_days(spark, d):
    """``lane, day, total, elevated``: events a day, and those of a high value."""
    rows = w.activity(spark, d).select("lane", F.to_date("ts").alias("day"), "value")
    return rows.groupBy("lane", "day").agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("value") > 90, 1)).alias("elevated"))


SERIES = """seen AS (SELECT lane, CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (value > 90) AS elevated FROM activity GROUP BY 1, 2), g AS (SELECT max(day) AS last FROM seen),
grid AS (SELECT lane, last, CAST(last - k AS DATE) AS day, k FROM (SELECT DISTINCT lane FROM seen), g, (SELECT CAST(unnest(range(120)) AS INTEGER) AS k)), full_days AS (SELECT lane, grid.day, coalesce(total, 0) AS total, coalesce(elevated, 0) AS elevated, k < 30 AS in_window FROM grid LEFT JOIN seen USING (lane, day))"""


@query(
    w.sql(
        "activity",
        f"""WITH {SERIES}, c AS (SELECT lane, sum(total) FILTER (in_window) AS recent_n, sum(total) FILTER (NOT in_window) AS baseline_n FROM full_days GROUP BY 1), a AS (SELECT lane, total, row_number() OVER (PARTITION BY lane ORDER BY day) AS i FROM full_days),
t AS (SELECT a.lane, sum(sign(b.total - a.total)) AS s, median((b.total - a.total) / (b.i - a.i)) AS slope, count(DISTINCT b.total) > 1 AS varied FROM a JOIN a b ON a.lane = b.lane AND a.i < b.i GROUP BY 1), wd AS (SELECT lane, isodow(day) - 1 AS k, sum(total) AS o FROM full_days GROUP BY 1, 2),
wk AS (SELECT lane, arg_max(k, (o, -k)) AS busiest, arg_min(k, (o, k)) AS quietest, sum(o) >= 35 AS enough FROM wd GROUP BY 1)
SELECT c.lane, CAST(recent_n AS BIGINT) AS recent_n, CAST(baseline_n AS BIGINT) AS baseline_n, CASE WHEN varied THEN CAST(s AS BIGINT) END AS trend_s, CASE WHEN varied THEN round(slope, 6) END AS slope, CASE WHEN enough THEN busiest END AS busiest, CASE WHEN enough THEN quietest END AS quietest FROM c JOIN t USING (lane) JOIN wk USING (lane)""",
    )
)
def temporal_lanes(spark, d):
    """Of each lane's last 30 days and the 90 before: counts, trend, and the days of the week with most and least."""
    lanes, _ = patterns.temporal_analysis(lane_days(spark, d))
    return lanes.select("lane", "recent_n", "baseline_n", "trend_s", F.round("slope", 6).alias("slope"), "busiest", "quietest")


@query(w.sql("activity", f"WITH {SERIES} SELECT lane, day, total, elevated, in_window, round((sum(total) OVER (PARTITION BY lane) - total) / 119, 6) AS expected FROM full_days"))
def temporal_days(spark, d):
    """Each of those days, and what the lane's others would let expect."""
    _, days = patterns.temporal_analysis(lane_days(spark, d))
    return days.select("lane", "day", "total", "elevated", "in_window", F.round("expected", 6).alias("expected"))


@query()
def temporal_analysis(spark, d):
    """The same with all tests: how sure a change, trend, split or week is, and how many days are unusual."""
    lanes, _ = patterns.temporal_analysis(lane_days(spark, d))
    return rounded(lanes, "ratio", "ratio_low", "ratio_high", "change_p", "trend_z", "trend_p", "slope", "split_statistic", "split_p", "weekly_p")


def mapped_customers(spark, d):
    return located_customers(spark, d).join(w.nations(spark, d).select("country", "region"), "country")


@query(
    w.sql(
        "nations",
        f"""WITH {LOCATED}, r AS (SELECT country, radians(lat) AS a, radians(lng) AS b, band FROM located), m AS (SELECT country, count(*) AS entity_count, count(*) FILTER (band = 'elevated') AS elevated_count, count(band) AS assessed_count, avg(cos(a) * cos(b)) AS x, avg(cos(a) * sin(b)) AS y, avg(sin(a)) AS z FROM r GROUP BY 1),
p AS (SELECT m.*, region, degrees(atan2(z, sqrt(x * x + y * y))) AS lat, degrees(atan2(y, x)) AS lng FROM m JOIN nations USING (country)), s AS (SELECT count(*) AS n, avg(elevated_count) AS mean, stddev_pop(elevated_count) AS sd FROM p),
k AS (SELECT a.country, count(*) AS w, sum(b.elevated_count) AS wx FROM p a, p b WHERE {HAVERSINE.format("a.lat", "b.lat", "a.lng", "b.lng")} <= 1200 GROUP BY 1)
SELECT country, region, entity_count, elevated_count, assessed_count, round(lat, 4) AS lat, round(lng, 4) AS lng, w AS n_near, round((wx - mean * w) / (sd * sqrt(greatest(1e-12, (n * w - w * w) / (n - 1)))), 4) AS z FROM p JOIN k USING (country), s""",
    )
)
def spatial_hotspots(spark, d):
    """Countries by how many of their customers are elevated, against those around them: within 1,200 km instead of 250, as these countries are far apart."""
    _, hot, _ = patterns.spatial_analysis(mapped_customers(spark, d), 25.0, 4, 1200.0)
    return rounded(hot, "lat", "lng", "z", digits=4).select("country", "region", "entity_count", "elevated_count", "assessed_count", "lat", "lng", "n_near", "z")


@query()
def spatial_totals(spark, d):
    """How many customers are located, in how many concentrations, and how many in none."""
    return patterns.spatial_analysis(mapped_customers(spark, d), 25.0, 4)[2]


def account_features(spark, d):
    """Transfers of each account from either side: how many, how much, and the most within a day."""
    ways = rollups.both_ways(w.transfers(spark, d))
    sums = ways.groupBy("ref").agg(F.count(F.lit(1)).alias("tx_count"), F.round(F.sum("amount"), 2).alias("total"))
    burst = sequences.bursts(ways.select("ref", "ts"), 24).groupBy("ref").agg(F.max("in_span").alias("burst"))
    return sums.where("tx_count >= 3").join(burst, "ref")


FEATURES = """ways AS (SELECT src AS ref, amount, ts FROM transfers UNION ALL SELECT dst, amount, ts FROM transfers),
b AS (SELECT ref, max(c) AS burst FROM (SELECT ref, count(*) OVER (PARTITION BY ref ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS c FROM ways) GROUP BY 1),
f AS (SELECT ref, count(*) AS tx_count, round(sum(amount), 2) AS total FROM ways GROUP BY 1 HAVING count(*) >= 3)"""


@query(w.sql("transfers", f"WITH {FEATURES} SELECT f.ref, tx_count, total, burst FROM f JOIN b ON f.ref = b.ref"))
def account_features_table(spark, d):
    return account_features(spark, d)


@query(
    w.sql(
        "transfers",
        f"""WITH {FEATURES}, x AS (SELECT f.*, burst FROM f JOIN b ON f.ref = b.ref), g AS (SELECT avg(tx_count) AS a1, stddev_pop(tx_count) AS s1, avg(total) AS a2, stddev_pop(total) AS s2, avg(burst) AS a3, stddev_pop(burst) AS s3 FROM x)
SELECT ref, round(greatest(abs(tx_count - a1) / s1, abs(total - a2) / s2, abs(burst - a3) / s3), 4) AS z FROM x, g""",
    )
)
def anomaly_scores(spark, d):
    return statistics.anomalies(account_features(spark, d), ["tx_count", "total", "burst"]).select("ref", F.round("z", 4).alias("z"))


@query()
def anomalies(spark, d):
    return rounded(statistics.anomalies(account_features(spark, d), ["tx_count", "total", "burst"]), "z", "isolation", digits=4)
