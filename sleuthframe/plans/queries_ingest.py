"""Ingestion and provenance queries over events as raw records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import ingest
from sleuthframe.plans import world as w
from sleuthframe.sources import feeds

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    """Register a query by its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def raw(spark, d):
    """Events as JSON records: some come twice, some lack their user, some have a broken time or an extra field."""
    rows = w.activity(spark, d)
    who = F.when(F.col("event_id") % 37 != 0, F.concat(F.lit("PRS"), F.col("ref").cast("string")))
    when = F.when(F.col("event_id") % 41 == 0, "soon").otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    payload = F.to_json(F.struct(F.col("event_id").alias("id"), who.alias("who"), when.alias("at"), F.struct(F.col("value").cast("long").alias("v"), F.when(F.col("event_id") % 100 == 0, "x").alias("extra")).alias("body")))
    once = rows.select(F.col("lane").alias("connector"), payload.alias("payload"), "event_id", "ts")
    return once.unionByName(once.where("event_id % 10 = 0"))


MAPPING = ingest.Mapping(subject="who", time="at", required=("id",), prefixes={"PRS": "Person", "ORG": "Organization"}, attributes={"value": "body.v", "extra": "body.extra"})


@query("SELECT event_type AS connector, count(*) AS n FROM events GROUP BY 1")
def landed_records(spark, d):
    """Raw records landed once for each content."""
    return ingest.landed(raw(spark, d)).groupBy("connector").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT event_type AS connector, CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 THEN 'validate' ELSE 'ok' END AS stage,
 CASE WHEN event_id % 37 = 0 THEN 'missing: who' WHEN event_id % 41 = 0 THEN 'not a time' END AS reason, count(*) AS n FROM events GROUP BY 1, 2, 3"""
)
def dead_letters(spark, d):
    found = ingest.mapped(ingest.landed(raw(spark, d)), MAPPING)
    return found.groupBy("connector", "stage", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, 'PRS' || user_id AS subject, 'Person' AS subject_type, date_trunc('second', ts) AS occurred_at, CAST(trunc(value) AS BIGINT)::VARCHAR AS value FROM events WHERE event_id % 37 <> 0 AND event_id % 41 <> 0")
def mapped_records(spark, d):
    found = ingest.mapped(ingest.landed(raw(spark, d)), MAPPING).where("stage = 'ok'")
    return found.select("event_id", "subject", "subject_type", "occurred_at", F.col("attributes")["value"].alias("value"))


@query("SELECT count(*) FILTER (WHERE user_id >= 100) AS n_resolve, count(*) FILTER (WHERE user_id < 100) AS n_ok FROM events WHERE event_id % 37 <> 0 AND event_id % 41 <> 0")
def resolve_failures(spark, d):
    known = w.activity(spark, d).where("ref < 100").select(F.concat(F.lit("PRS"), F.col("ref").cast("string")).alias("subject"))
    found = ingest.resolved(ingest.mapped(ingest.landed(raw(spark, d)), MAPPING), known)
    return found.agg(F.count_if(F.col("stage") == "resolve").alias("n_resolve"), F.count_if(F.col("stage") == "ok").alias("n_ok"))


@query("SELECT event_type AS connector, 'body.extra' AS path, count(*) AS n FROM events WHERE event_id % 100 = 0 GROUP BY 1")
def schema_drift(spark, d):
    lanes = w.activity(spark, d).select(F.col("lane").alias("connector")).distinct()
    known = lanes.select("connector", F.explode(F.array(*[F.lit(p) for p in ("id", "who", "at", "body", "body.v")])).alias("path"))
    return ingest.drift(ingest.landed(raw(spark, d)), known)


HOURLY = "h AS (SELECT lane AS connector, date_trunc('day', ts) AS finished_at, count(*) AS n, count(*) FILTER (WHERE value < 50) AS failed FROM activity GROUP BY 1, 2)"


def daily_batches(spark, d):
    day = w.activity(spark, d).groupBy(F.col("lane").alias("connector"), F.date_trunc("day", "ts").alias("finished_at")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 50).alias("failed"))
    return day.withColumn("id", F.col("finished_at"))


@query(w.sql("activity", f"WITH {HOURLY} SELECT connector, CAST(CAST(finished_at AS DATE) AS VARCHAR) AS day, n AS fetched, failed FROM h WHERE n >= 20 AND failed >= 0.5 * n"))
def quarantine(spark, d):
    batches = daily_batches(spark, d).select("connector", F.to_date("finished_at").cast("string").alias("day"), F.col("n").alias("fetched"), "failed")
    return ingest.quarantined(batches)


@query(
    w.sql(
        "activity",
        f"""WITH {HOURLY}, k AS (SELECT *, row_number() OVER (PARTITION BY connector ORDER BY finished_at DESC) AS r FROM h), b AS (SELECT connector, count(*) AS c, avg(n) AS mean, stddev_pop(n) AS deviation FROM k WHERE r <= 20 GROUP BY 1)
SELECT h.connector, n, round(mean, 4) AS mean, round((n - mean) / deviation, 4) AS z FROM h JOIN b ON h.connector = b.connector WHERE c >= 5 AND deviation > 0 AND abs((n - mean) / deviation) >= 3""",
    )
)
def volume_drift(spark, d):
    batches = daily_batches(spark, d)
    return ingest.odd_volumes(batches, batches.select("connector", "n")).select("connector", "n", F.round("mean", 4).alias("mean"), F.round("z", 4).alias("z"))


@query("SELECT o_custkey AS connector, 'stopped' AS status FROM orders GROUP BY 1 HAVING o_custkey % 5 <> 0 AND max(o_orderdate) < TIMESTAMP '2001-08-01' - INTERVAL 720 HOUR")
def stale_connectors(spark, d):
    last = w.assessments(spark, d).groupBy(F.col("subject").alias("connector")).agg(F.max("computed_at").alias("last_success"))
    return ingest.stale(last.withColumn("expected_hours", F.when(F.col("connector") % 5 != 0, 720)), F.lit("2001-08-01").cast("timestamp_ntz"))


@query("SELECT o_custkey AS connector, o_custkey || ':' || CAST(floor(epoch(TIMESTAMP '2001-08-01') / 2592000) AS BIGINT) AS idempotency_key FROM orders GROUP BY 1 HAVING o_custkey % 7 <> 0 AND o_custkey % 11 <> 0 AND epoch(max(o_orderdate)) <= epoch(TIMESTAMP '2001-08-01') - 2592000")
def due_connectors(spark, d):
    last = w.assessments(spark, d).groupBy(F.col("subject").alias("connector")).agg(F.max("computed_at").alias("last_run"))
    rows = last.withColumns({"enabled": F.col("connector") % 7 != 0, "quarantined": F.col("connector") % 11 == 0, "interval_s": F.lit(2_592_000)})
    return ingest.due(rows, F.lit("2001-08-01").cast("timestamp_ntz")).select("connector", "idempotency_key")


@query(
    """WITH j AS (SELECT o_orderkey AS job, o_orderkey % 6 AS a, CASE WHEN o_orderkey % 3 = 0 THEN 'done' WHEN o_orderkey % 3 = 1 THEN 'failed' ELSE 'released' END AS outcome FROM orders), t AS (SELECT *, a + CASE WHEN outcome = 'released' THEN 0 ELSE 1 END AS n FROM j)
SELECT job, CASE WHEN outcome = 'done' THEN 'complete' WHEN outcome = 'released' THEN 'queued' WHEN n >= 5 THEN 'dead' ELSE 'queued' END AS state, n AS attempts, CASE WHEN outcome = 'released' THEN 30 WHEN outcome = 'failed' AND n < 5 THEN CAST(least(900, 5 * pow(2, n - 1)) AS INTEGER) END AS delay_s FROM t"""
)
def queue_transitions(spark, d):
    rows = w.assessments(spark, d)
    jobs = rows.select(F.col("id").alias("job"), (F.col("id") % 6).alias("attempts"), F.when(F.col("id") % 3 == 0, "done").when(F.col("id") % 3 == 1, "failed").otherwise("released").alias("outcome"))
    return ingest.next_state(jobs)


def assertions(spark, d):
    """What each month's ledger asserts about its subjects; later rows supersede, every eighth is retracted."""
    from pyspark.sql.window import Window

    rows = w.assessments(spark, d)
    order = Window.partitionBy("subject", "state").orderBy("computed_at", "id")
    later = F.lead("computed_at").over(order)
    return rows.select(
        "id", "subject", F.col("state").alias("predicate"), F.col("band").alias("object"), F.col("computed_at").alias("asserted_at"), F.when(F.col("id") % 8 == 0, F.col("computed_at") + F.expr("interval 30 days")).alias("retracted_at"),
        F.when(F.col("id") % 3 != 0, later).alias("superseded_at"), F.when(F.col("id") % 2 == 0, "assessed").otherwise("judged").alias("kind"),
    )


ASSERTIONS = """assertions_ AS (SELECT id, subject, state AS predicate, band AS object, computed_at AS asserted_at, CASE WHEN id % 8 = 0 THEN computed_at + INTERVAL 30 DAY END AS retracted_at,
 CASE WHEN id % 3 <> 0 THEN lead(computed_at) OVER (PARTITION BY subject, state ORDER BY computed_at, id) END AS superseded_at FROM assessments)"""


@query(w.sql("assessments", f"WITH {ASSERTIONS} SELECT id, subject, predicate, object FROM assertions_ WHERE asserted_at <= TIMESTAMP '1999-06-30' AND (retracted_at IS NULL OR retracted_at > TIMESTAMP '1999-06-30') AND (superseded_at IS NULL OR superseded_at > TIMESTAMP '1999-06-30')"))
def belief_as_of(spark, d):
    return ingest.believed(assertions(spark, d), F.lit("1999-06-30").cast("timestamp_ntz")).select("id", "subject", "predicate", "object")


@query(w.sql("assessments", f"WITH {ASSERTIONS}, n AS (SELECT * FROM assertions_ WHERE retracted_at IS NULL AND superseded_at IS NULL), s AS (SELECT subject, predicate, count(DISTINCT object) AS n_sides FROM n GROUP BY 1, 2 HAVING count(DISTINCT object) > 1) SELECT n.id, n.subject, n.predicate, n.object, n_sides FROM n JOIN s ON s.subject = n.subject AND s.predicate = n.predicate"))
def belief_conflicts(spark, d):
    return ingest.conflicts(assertions(spark, d)).select("id", "subject", "predicate", "object", "n_sides")


@query(w.sql("assessments", "SELECT subject AS assertion, count(DISTINCT CASE WHEN score >= 50 THEN run END) AS supporting, count(DISTINCT CASE WHEN score < 50 THEN run END) AS contradicting FROM assessments GROUP BY 1"))
def corroboration(spark, d):
    rows = w.assessments(spark, d).select(F.col("subject").alias("assertion"), F.when(F.col("score") >= 50, "supports").otherwise("contradicts").alias("stance"), F.col("run").alias("source_group"))
    return ingest.corroboration(rows)


@query(
    w.sql(
        "accounts assessments",
        """WITH o AS (SELECT DISTINCT subject AS ref, band AS value FROM assessments WHERE subject % 2 = 0) SELECT a.ref, a.band AS value, CASE WHEN a.ref NOT IN (SELECT ref FROM o) THEN 'unattributed' WHEN EXISTS (SELECT 1 FROM o WHERE o.ref = a.ref AND o.value = a.band) THEN 'reported' ELSE 'modified' END AS status FROM accounts a WHERE band IS NOT NULL""",
    )
)
def attribute_provenance(spark, d):
    properties = w.accounts(spark, d).where("band is not null").select("ref", F.lit("band").alias("field"), F.col("band").alias("value"))
    seen = w.assessments(spark, d).where("subject % 2 = 0").select(F.col("subject").alias("ref"), F.lit("band").alias("field"), F.col("band").alias("value"))
    none = assertions(spark, d).where(F.lit(False))
    return ingest.attribute_status(properties, seen, none).select("ref", "value", "status")


@query("SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS value, CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 2 ELSE 1 END AS seen FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0")
def upsert_sink(spark, d):
    rows = w.activity(spark, d).select(F.col("event_id").alias("key"))
    old = rows.where("key % 3 = 0").withColumns({"value": F.lit("old"), "seen": F.lit(1).cast("long")})
    return feeds.upserted(old, rows.where("key % 2 = 0").withColumn("value", F.lit("new")), "key", "seen")


@query("SELECT DISTINCT event_id AS key FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0")
def insert_if_absent(spark, d):
    rows = w.activity(spark, d).select(F.col("event_id").alias("key"))
    return feeds.inserted(rows.where("key % 3 = 0"), rows.where("key % 2 = 0").union(rows.where("key % 4 = 0")), "key")
