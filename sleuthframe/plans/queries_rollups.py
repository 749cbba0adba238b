"""Rollup, sequence and join-shaped queries over the world's views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import geo, rollups, sequences
from sleuthframe.plans import world as w

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


BOTH = "ways AS (SELECT src AS ref, dst AS other, amount, ts FROM transfers UNION ALL SELECT dst, src, amount, ts FROM transfers)"
DAILY = "daily AS (SELECT lane, CAST(ts AS DATE) AS day, count(*) AS total, count(*) FILTER (WHERE value >= 50) AS elevated FROM activity GROUP BY 1, 2)"
DENSE = (
    DAILY
    + """, days AS (SELECT unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily), INTERVAL 1 DAY))::DATE AS day),
dense AS (SELECT l.lane, d.day, coalesce(total, 0) AS total, coalesce(elevated, 0) AS elevated FROM (SELECT DISTINCT lane FROM daily) l CROSS JOIN days d LEFT JOIN daily x ON x.lane = l.lane AND x.day = d.day)"""
)
HAVERSINE = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({1} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({1})) * pow(sin(radians({3} - {2}) / 2), 2))))"


def dense_days(spark, d):
    return rollups.densified(rollups.daily_counts(w.activity(spark, d), F.col("value") >= 50))


@query(w.sql("activity", f"WITH {DENSE} SELECT lane, CAST(day AS VARCHAR) AS day, total, elevated, round((sum(total) OVER (PARTITION BY lane) - total) / (count(*) OVER (PARTITION BY lane) - 1), 6) AS expected FROM dense"))
def daily_lanes_expected(spark, d):
    """Which days depart from the rest: dense daily counts and the mean of the lane's other days."""
    return sequences.leave_one_out(dense_days(spark, d), "lane", "total").withColumns({"day": F.col("day").cast("string"), "expected": F.round("expected", 6)})


@query(w.sql("accounts", "SELECT ref, name FROM accounts WHERE ref IS NOT NULL"))
def label_scan(spark, d):
    return w.accounts(spark, d).where("ref is not null").select("ref", "name")


@query(w.sql("transfers", "SELECT edge_id, src, dst, amount, ts FROM transfers WHERE amount IS NOT NULL AND ts IS NOT NULL"))
def edge_scan(spark, d):
    return w.transfers(spark, d).where("amount is not null and ts is not null")


@query(w.sql("accounts", "SELECT ref, coalesce(nullif(name, ''), CAST(ref AS VARCHAR), 'Unknown') AS name, coalesce(band, 'unassessed') AS band FROM accounts WHERE band IS NULL AND region = 'ASIA' ORDER BY ref LIMIT 20"))
def browse_unassessed(spark, d):
    """A page of the nodes without a band in one region."""
    rows = w.accounts(spark, d).where(F.col("band").isNull() & (F.col("region") == "ASIA"))
    return rows.orderBy("ref").limit(20).select("ref", F.coalesce(F.nullif("name", F.lit("")), F.col("ref").cast("string"), F.lit("Unknown")).alias("name"), F.coalesce("band", F.lit("unassessed")).alias("band"))


@query(w.sql("transfers accounts", f"WITH {BOTH} SELECT a.ref, count(b.ref) AS degree FROM accounts a LEFT JOIN ways b ON a.ref = b.ref GROUP BY 1"))
def degree_count(spark, d):
    return rollups.degrees(w.accounts(spark, d), w.transfers(spark, d))


@query(w.sql("transfers accounts", f"WITH {BOTH} SELECT b.ref, a.region AS label, count(DISTINCT other) AS n FROM ways b JOIN accounts a ON a.ref = b.other GROUP BY 1, 2"))
def connection_summary(spark, d):
    return rollups.connections_by(w.accounts(spark, d), w.transfers(spark, d), "region")


@query(
    w.sql(
        "accounts shipments",
        """WITH ends AS (SELECT origin AS region, shipment_id FROM shipments WHERE flagged UNION SELECT destination, shipment_id FROM shipments WHERE flagged),
c AS (SELECT region, count(*) AS n_nodes, count(*) FILTER (WHERE band = 'elevated') AS n_elevated, count(band) AS n_assessed, count(DISTINCT country) AS n_countries FROM accounts GROUP BY 1)
SELECT c.*, coalesce(f.n, 0) AS n_flagged_routes FROM c LEFT JOIN (SELECT region, count(*) AS n FROM ends GROUP BY 1) f ON f.region = c.region""",
    )
)
def region_rollup(spark, d):
    return rollups.region_rollup(w.accounts(spark, d), w.shipments(spark, d))


@query(
    w.sql(
        "accounts",
        """WITH m AS (SELECT country, count(*) AS n_nodes, count(*) FILTER (WHERE band = 'elevated') AS n_elevated, count(lat) AS n_located,
 avg(cos(radians(lat)) * cos(radians(lng))) AS x, avg(cos(radians(lat)) * sin(radians(lng))) AS y, avg(sin(radians(lat))) AS z FROM accounts GROUP BY 1)
SELECT country, n_nodes, n_elevated, n_located, round(degrees(atan2(z, sqrt(x * x + y * y))), 4) AS lat, round(degrees(atan2(y, x)), 4) AS lng FROM m""",
    )
)
def country_rollup(spark, d):
    return rollups.country_rollup(w.accounts(spark, d)).withColumns({"lat": F.round("lat", 4), "lng": F.round("lng", 4)})


@query(
    w.sql(
        "shipments",
        """SELECT least(origin, destination) AS region_a, greatest(origin, destination) AS region_b, count(*) AS n, count(*) FILTER (WHERE flagged) AS n_flagged, count(*) FILTER (WHERE flagged IS NULL) AS n_unassessed,
 CASE WHEN count(flagged) > 0 THEN round(count(*) FILTER (WHERE flagged) / count(flagged), 3) END AS flagged_rate FROM shipments WHERE origin <> destination GROUP BY 1, 2""",
    )
)
def corridor_rollup(spark, d):
    return rollups.corridor_rollup(w.shipments(spark, d))


@query(w.sql("shipments", "SELECT origin, destination, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM shipments GROUP BY 1, 2"))
def corridor_frequencies(spark, d):
    return rollups.corridor_shares(w.shipments(spark, d)).withColumn("share", F.round("share", 6))


@query(w.sql("accounts", "WITH b AS (SELECT unnest(['elevated', 'notable', 'routine', 'insufficient', 'unassessed']) AS band) SELECT b.band, count(a.ref) AS n FROM b LEFT JOIN (SELECT ref, coalesce(band, 'unassessed') AS band FROM accounts) a ON a.band = b.band GROUP BY 1"))
def band_distribution(spark, d):
    return rollups.band_distribution(w.accounts(spark, d), ("elevated", "notable", "routine", "insufficient", "unassessed"))


@query(
    w.sql(
        "accounts transfers activity",
        """SELECT (SELECT count(*) FROM accounts) AS n_accounts, (SELECT count(*) FROM transfers) AS n_transfers, (SELECT count(*) FROM activity) AS n_events,
 (SELECT count(*) FROM activity WHERE ts >= (SELECT max(ts) FROM activity) - INTERVAL 7 DAY) AS n_events_week, (SELECT count(band) FROM accounts) AS n_assessed""",
    )
)
def dashboard_summary(spark, d):
    """One row of counts, the last week hung on the newest event."""
    events = w.activity(spark, d).select("ts")
    newest = events.agg(F.max("ts").alias("newest"))
    week = events.join(F.broadcast(newest)).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("ts") >= F.col("newest") - F.expr("interval 7 days")).alias("n_events_week"))
    nodes = w.accounts(spark, d).agg(F.count(F.lit(1)).alias("n_accounts"), F.count("band").alias("n_assessed"))
    return nodes.join(w.transfers(spark, d).agg(F.count(F.lit(1)).alias("n_transfers"))).join(week)  # one row each


@query(w.sql("assessments", "SELECT subject, id, computed_at, score, band FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id DESC) AS n FROM assessments) WHERE n = 1"))
def latest_assessment(spark, d):
    return rollups.latest_per(w.assessments(spark, d), "subject").select("subject", "id", "computed_at", "score", "band")


@query(w.sql("assessments", "SELECT id, subject, run, band, state FROM assessments WHERE run = (SELECT run FROM assessments WHERE state = 'F' GROUP BY run ORDER BY max(computed_at) DESC NULLS LAST, run DESC LIMIT 1)"))
def latest_complete_run(spark, d):
    ledger = w.assessments(spark, d)
    done = ledger.where("state = 'F'").groupBy("run").agg(F.max("computed_at").alias("finished_at"))
    run = done.orderBy(F.desc_nulls_last("finished_at"), F.desc("run")).limit(1).select("run")
    return ledger.join(F.broadcast(run), "run").select("id", "subject", "run", "band", "state")


@query(w.sql("assessments", "SELECT run, count(*) FILTER (WHERE state = 'O') AS n_open, count(*) FILTER (WHERE state = 'F') AS n_closed, count(*) FILTER (WHERE band = 'elevated') AS n_elevated, count(DISTINCT subject) AS n_subjects FROM assessments GROUP BY 1"))
def queue_counts(spark, d):
    return w.assessments(spark, d).groupBy("run").agg(F.count_if(F.col("state") == "O").alias("n_open"), F.count_if(F.col("state") == "F").alias("n_closed"), F.count_if(F.col("band") == "elevated").alias("n_elevated"), F.countDistinct("subject").alias("n_subjects"))


@query(w.sql("assessments", "SELECT band, state, count(*) AS n FROM assessments GROUP BY 1, 2"))
def band_state_counts(spark, d):
    return w.assessments(spark, d).groupBy("band", "state").agg(F.count(F.lit(1)).alias("n"))


@query(
    w.sql(
        "assessments",
        """WITH b AS (SELECT run AS id, state, max(computed_at) AS finished_at, count(*) AS n FROM assessments GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY finished_at DESC NULLS LAST, id DESC) AS r FROM b)
SELECT state, count(*) AS samples, round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM k WHERE r <= 20 GROUP BY 1""",
    )
)
def volume_baseline(spark, d):
    batches = w.assessments(spark, d).groupBy(F.col("run").alias("id"), "state").agg(F.max("computed_at").alias("finished_at"), F.count(F.lit(1)).alias("n"))
    return rollups.volume_baseline(batches, "state").withColumns({"mean": F.round("mean", 6), "deviation": F.round("deviation", 6)})


@query(w.sql("activity", "SELECT lane, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90 FROM activity WHERE value IS NOT NULL GROUP BY 1"))
def nearest_rank_percentiles(spark, d):
    return rollups.nearest_rank(w.activity(spark, d), "lane", "value", {"p50": 0.5, "p90": 0.9})


@query(w.sql("accounts", "SELECT ref, balance, round((SELECT count(*) FROM accounts b WHERE b.balance < a.balance) / (SELECT count(*) FROM accounts), 6) AS rank FROM accounts a"))
def rank_of_balance(spark, d):
    return rollups.rank_of(w.accounts(spark, d), "balance").select("ref", "balance", F.round("rank", 6).alias("rank"))


@query(w.sql("activity", "SELECT ref, string_agg(DISTINCT lane, ',' ORDER BY lane) AS lanes, count(DISTINCT lane) AS n_lanes FROM activity GROUP BY 1"))
def distinct_sources(spark, d):
    return w.activity(spark, d).groupBy("ref").agg(F.collect_set("lane").alias("s")).select("ref", F.array_join(F.sort_array("s"), ",").alias("lanes"), F.size("s").cast("long").alias("n_lanes"))


@query(w.sql("activity", "SELECT ref, max(c) AS max_burst FROM (SELECT ref, count(*) OVER (PARTITION BY ref ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS c FROM activity) GROUP BY 1"))
def max_burst(spark, d):
    return sequences.bursts(w.activity(spark, d).select("ref", "ts"), 6).groupBy("ref").agg(F.max("in_span").alias("max_burst"))


@query(
    w.sql(
        "activity",
        """WITH s AS (SELECT ref, ts, count(*) OVER v AS c, min(ts) OVER v AS b FROM activity WINDOW v AS (PARTITION BY ref ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)),
g AS (SELECT ref, count(*) AS n, max(c) AS peak, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM s GROUP BY 1),
f AS (SELECT ref, b AS peak_start FROM (SELECT ref, b, row_number() OVER (PARTITION BY ref ORDER BY c DESC, b) AS r FROM s) WHERE r = 1)
SELECT ref, n, peak, peak_start, round(n * 21600000000 / us, 3) AS expected, round(peak / greatest(n * 21600000000 / us, 0.5), 2) AS ratio FROM g JOIN f USING (ref) WHERE n >= 2 AND us > 0""",
    )
)
def burst_profile(spark, d):
    return sequences.burst_profile(w.activity(spark, d), 6)


@query(
    w.sql(
        "activity",
        f"""WITH {DENSE}, m AS (SELECT max(day) AS last FROM dense) SELECT lane, CAST(sum(CASE WHEN last - day < 7 THEN total ELSE 0 END) AS BIGINT) AS recent_n, 7 AS recent_days,
 CAST(sum(CASE WHEN last - day >= 7 AND last - day < 21 THEN total ELSE 0 END) AS BIGINT) AS baseline_n, 14 AS baseline_days FROM dense, m GROUP BY lane""",
    )
)
def recent_vs_baseline(spark, d):
    return sequences.recent_and_baseline(dense_days(spark, d), 7, 14)


@query(w.sql("activity", f"WITH {DENSE} SELECT lane, isodow(day) - 1 AS weekday, CAST(sum(total) AS BIGINT) AS n FROM dense GROUP BY 1, 2"))
def weekday_counts(spark, d):
    return dense_days(spark, d).groupBy("lane", F.weekday("day").cast("long").alias("weekday")).agg(F.sum("total").alias("n"))


@query(
    w.sql(
        "assessments",
        """WITH t AS (SELECT subject, computed_at, band, row_number() OVER (PARTITION BY subject, computed_at ORDER BY id DESC) AS r FROM assessments),
p AS (SELECT subject, computed_at, lag(band) OVER (PARTITION BY subject ORDER BY computed_at) AS previous FROM t WHERE r = 1)
SELECT a.id, a.subject, a.band, p.previous FROM assessments a JOIN p ON a.subject = p.subject AND a.computed_at = p.computed_at""",
    )
)
def previous_assessment(spark, d):
    return sequences.previous_of(w.assessments(spark, d), "subject", "band", "computed_at", "id").select("id", "subject", "band", "previous")


@query(w.sql("assessments", "SELECT id, round(greatest(0.25, pow(0.5, greatest(date_diff('day', computed_at, (SELECT max(computed_at) FROM assessments)), 0) / 30.0)), 6) AS recency FROM assessments"))
def recency_weights(spark, d):
    ledger = w.assessments(spark, d)
    now = ledger.agg(F.max("computed_at").alias("now"))
    return ledger.join(F.broadcast(now)).select("id", F.round(sequences.decay(F.datediff("now", "computed_at")), 6).alias("recency"))


@query(w.sql("assessments", "SELECT id, score, subject FROM assessments WHERE band = 'elevated' ORDER BY score DESC NULLS LAST, id LIMIT 50"))
def top_queue(spark, d):
    return w.assessments(spark, d).where("band = 'elevated'").orderBy(F.desc_nulls_last("score"), "id").limit(50).select("id", "score", "subject")


@query(w.sql("assessments", "SELECT id, subject, (SELECT count(*) FROM assessments) AS total FROM assessments ORDER BY id LIMIT 25 OFFSET 50"))
def paged_scan(spark, d):
    """A page and the true total."""
    ledger = w.assessments(spark, d)
    page = ledger.orderBy("id").offset(50).limit(25).select("id", "subject")
    return page.join(F.broadcast(ledger.agg(F.count(F.lit(1)).alias("total"))))


@query(
    w.sql(
        "assessments",
        "SELECT subject, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY score DESC, id) FILTER (WHERE r <= 8) AS top_ids FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY score DESC, id) AS r FROM assessments) GROUP BY 1",
    )
)
def nested_top_rows(spark, d):
    """Each subject with its eight strongest rows in order."""
    ledger = w.assessments(spark, d)
    parent = ledger.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    found = rollups.nested(parent, ledger, "subject", [-F.col("score"), F.col("id")], ["id"], "rows", 8)
    return found.select("subject", "n", F.array_join(F.transform("rows", lambda r: r["id"].cast("string")), ",").alias("top_ids"))


@query(
    w.sql(
        "transfers accounts",
        "SELECT edge_id, a.name AS src_name, b.name AS dst_name, a.region AS src_region, b.region AS dst_region FROM transfers JOIN accounts a ON src = a.ref LEFT JOIN accounts b ON dst = b.ref",
    )
)
def owner_star_join(spark, d):
    """Transfers with both ends resolved."""
    a = w.accounts(spark, d).select("ref", "name", "region")
    left = a.toDF("src", "src_name", "src_region")
    return w.transfers(spark, d).join(left, "src").join(a.toDF("dst", "dst_name", "dst_region"), "dst", "left").select("edge_id", "src_name", "dst_name", "src_region", "dst_region")


@query(w.sql("contacts", "SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM contacts WHERE a <> b GROUP BY 1, 2"))
def contact_pairs(spark, d):
    return w.contacts(spark, d).where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(w.sql("assessments accounts", "SELECT ref, name FROM accounts WHERE ref NOT IN (SELECT subject FROM assessments WHERE band = 'elevated')"))
def isolated_nodes(spark, d):
    return w.accounts(spark, d).join(w.assessments(spark, d).where("band = 'elevated'").select(F.col("subject").alias("ref")), "ref", "left_anti").select("ref", "name")


@query(w.sql("assessments accounts", "SELECT ref, name FROM accounts WHERE ref IN (SELECT subject FROM assessments WHERE band = 'elevated')"))
def semi_join_assessed(spark, d):
    return w.accounts(spark, d).join(w.assessments(spark, d).where("band = 'elevated'").select(F.col("subject").alias("ref")), "ref", "left_semi").select("ref", "name")


@query(
    w.sql(
        "transfers",
        """SELECT a.edge_id, b.edge_id AS next_id, round(b.amount / a.amount, 4) AS retention FROM transfers a JOIN transfers b ON b.src = a.dst AND b.edge_id <> a.edge_id
 AND abs(epoch_us(b.ts) - epoch_us(a.ts)) <= 7 * 86400000000 AND b.amount <= a.amount AND b.amount >= 0.85 * a.amount WHERE a.amount > 0""",
    )
)
def successor_transfers(spark, d):
    """Transfers that pass on what another one brought: within a week, 85 to 100 % of it."""
    from sleuthframe.operators.graph import successors

    return successors(w.transfers(spark, d), days=7, least=0.85).select("edge_id", "next_id", F.round("retention", 4).alias("retention"))


@query(w.sql("accounts", f"SELECT a.ref AS a, b.ref AS b, round({HAVERSINE.format('a.lat', 'b.lat', 'a.lng', 'b.lng')}, 4) AS km FROM accounts a, accounts b WHERE a.ref < b.ref AND {HAVERSINE.format('a.lat', 'b.lat', 'a.lng', 'b.lng')} <= 1500"))
def near_pairs(spark, d):
    nodes = w.accounts(spark, d)
    return geo.within_km(nodes, nodes, 1500.0, ordered=True).select("a", "b", F.round("km", 4).alias("km"))


@query(w.sql("activity", "SELECT n + (SELECT coalesce(max(event_id), 0) FROM activity) AS number, 'ALT' || lpad(CAST(n + (SELECT max(event_id) FROM activity) AS VARCHAR), 7, '0') AS code, ref FROM (SELECT row_number() OVER (ORDER BY ref) AS n, ref FROM (SELECT DISTINCT ref FROM activity))"))
def allocated_codes(spark, d):
    """New codes go on from the greatest there is."""
    rows = w.activity(spark, d)
    old = rows.select(F.concat(F.lit("ALT"), F.lpad(F.col("event_id").cast("string"), 7, "0")).alias("code"))
    made = sequences.allocate(old, rows.select("ref").distinct(), "ALT", ["ref"])
    return made.select(F.regexp_extract("code", r"(\d+)$", 1).cast("long").alias("number"), "code", "ref")


@query(
    w.sql(
        "assessments",
        "SELECT subject AS entity, 'band' AS field, band AS value FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY computed_at DESC, id DESC) AS r FROM assessments WHERE computed_at <= TIMESTAMP '1998-01-01') WHERE r = 1",
    )
)
def replay_as_of(spark, d):
    """Fields of each subject as they stood at a time."""
    events = w.assessments(spark, d).select(F.col("id").alias("event_id"), F.col("subject").alias("entity"), F.lit("band").alias("field"), F.col("band").alias("new_value"), F.col("computed_at").alias("occurred_at"))
    return sequences.replayed(events, F.lit("1998-01-01").cast("timestamp_ntz"))


@query(
    w.sql(
        "assessments",
        """WITH o AS (SELECT *, lag(band) OVER (PARTITION BY subject ORDER BY computed_at, id) AS was, row_number() OVER (PARTITION BY subject ORDER BY computed_at, id) AS n FROM assessments),
b AS (SELECT subject AS entity, id AS event_id, was AS expected, row_number() OVER (PARTITION BY subject ORDER BY computed_at, id) AS r FROM o WHERE n > 1 AND was IS DISTINCT FROM CASE WHEN id % 10 = 0 THEN 'forged' ELSE was END)
SELECT entity, event_id, expected FROM b WHERE r = 1""",
    )
)
def replay_verification(spark, d):
    """The first event of each subject that claims another old value than replay has; every tenth is forged here."""
    from pyspark.sql.window import Window

    order = Window.partitionBy("subject").orderBy("computed_at", "id")
    claimed = F.when(F.col("id") % 10 == 0, "forged").otherwise(F.lag("band").over(order))
    events = w.assessments(spark, d).withColumn("old_value", claimed).select(F.col("id").alias("event_id"), F.col("subject").alias("entity"), F.lit("band").alias("field"), "old_value", F.col("band").alias("new_value"), F.col("computed_at").alias("occurred_at"))
    return sequences.replay_breaks(events).select("entity", "event_id", "expected")
