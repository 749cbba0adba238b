"""Links between customers over eight dimensions, with their SQL.

Customers are the subjects. A user and an account with a customer's number are
that customer's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import correlation as c
from sleuthframe.operators import linking
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


def subjects(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("subject"))


def owned_keys(spark, d):
    """What subjects have, by source: ``source, subject, key``, each once."""
    met = ql.met(spark, d)
    correspondents = met.select(F.col("a").alias("subject"), F.col("b").alias("key")).unionByName(met.select(F.col("b").alias("subject"), F.col("a").alias("key")))
    corridors = table(spark, d, "customer").select(F.col("c_custkey").alias("subject"), F.col("c_nationkey").alias("key"))
    parts = {"shared_counterparty": ql.partners(spark, d), "co_attendance": ql.slots(spark, d), "communication_shared": correspondents, "affiliation": ql.affiliations(spark, d), "shared_corridor": corridors}
    rows = None
    for source, owned in parts.items():
        own = owned.select(F.lit(source).alias("source"), F.col("subject").cast("long").alias("subject"), F.col("key").cast("string").alias("key"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.join(subjects(spark, d), "subject", "left_semi").distinct()


def direct_pairs(spark, d):
    """Contacts and paths between subjects: two tables of pairs."""
    people = subjects(spark, d)
    known = lambda rows: rows.join(people.toDF("a"), "a", "left_semi").join(people.toDF("b"), "b", "left_semi")
    reach = written(ql.funds_reach(spark, d))
    return known(ql.met(spark, d)), known(c.funds_path(reach, w.transfers(spark, d))), reach.where("truncated").select("subject").distinct()


def prepared(spark, d):
    owned, population = written(owned_keys(spark, d)), subjects(spark, d).count()
    direct, paths, cut = direct_pairs(spark, d)
    return owned, population, written(direct), written(paths), cut


OWN = """own AS MATERIALIZED (SELECT DISTINCT source, subject, key FROM (
 SELECT 'shared_counterparty' AS source, o_custkey AS subject, CAST(l_partkey AS VARCHAR) AS key FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'co_attendance', ref, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') || '|' || lane FROM activity
 UNION ALL SELECT 'communication_shared', a, CAST(b AS VARCHAR) FROM met UNION ALL SELECT 'communication_shared', b, CAST(a AS VARCHAR) FROM met UNION ALL SELECT 'affiliation', c_custkey, c_mktsegment || '-' || c_nationkey FROM customer
 UNION ALL SELECT 'shared_corridor', c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer) WHERE subject IN (SELECT c_custkey FROM customer)),
size AS MATERIALIZED (SELECT source, key, n, CASE WHEN n < 2 OR n >= p THEN 0 ELSE ln(p / n) / ln(p) END AS weight FROM (SELECT source, key, count(*) AS n FROM own GROUP BY 1, 2), (SELECT count(*)::DOUBLE AS p FROM customer)),
known_met AS (SELECT * FROM met WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer)), known_paths AS (SELECT * FROM paths WHERE a IN (SELECT c_custkey FROM customer) AND b IN (SELECT c_custkey FROM customer))"""
PROPOSED = """few AS (SELECT source, subject, key FROM own JOIN size USING (source, key) WHERE n BETWEEN 2 AND 250),
proposed AS MATERIALIZED (SELECT a, b, bit_or(bit) AS sources FROM (SELECT x.subject AS a, y.subject AS b, CASE x.source WHEN 'shared_counterparty' THEN 1 WHEN 'co_attendance' THEN 2 WHEN 'communication_shared' THEN 4 WHEN 'affiliation' THEN 8 ELSE 16 END AS bit
 FROM few x JOIN few y ON x.source = y.source AND x.key = y.key AND x.subject < y.subject UNION ALL SELECT a, b, 32 FROM known_met UNION ALL SELECT a, b, 64 FROM known_paths) GROUP BY 1, 2)"""
BASE = f"WITH {ql.MET}, {ql.PATHS}, {OWN}"


@query(w.sql("activity contacts transfers", f"{BASE}, {PROPOSED} SELECT a, b, CAST(sources AS INTEGER) AS sources FROM proposed"))
def candidate_sources(spark, d):
    """Pairs of customers that any of seven sources proposes, with a bit for each."""
    owned, population, direct, paths, _ = prepared(spark, d)
    sizes = written(linking.key_sizes(owned, population))
    return linking.proposed_pairs(owned, sizes, {"communication_direct": direct, "funds_path": paths})


@query(
    w.sql(
        "activity contacts transfers",
        f"""{BASE}, sums AS (SELECT source, count(*) AS keys, count(*) FILTER (n > 250) AS skipped, CAST(coalesce(sum(n * (n - 1) / 2) FILTER (n <= 250), 0) AS BIGINT) AS proposed, CAST(coalesce(sum(n * (n - 1) / 2) FILTER (n > 250), 0) AS BIGINT) AS not_proposed FROM size GROUP BY 1),
told AS (SELECT source, string_agg(key || ' (' || n || ' subjects)', '; ' ORDER BY n DESC, key) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, key) AS r FROM size WHERE n > 250) WHERE r <= 10 GROUP BY 1)
SELECT sums.*, examples FROM sums LEFT JOIN told USING (source) UNION ALL SELECT 'communication_direct', 0, 0, count(*), 0, NULL FROM known_met UNION ALL SELECT 'funds_path', 0, 0, count(*), 0, NULL FROM known_paths""",
    )
)
def candidate_report(spark, d):
    """By source, how many keys and pairs were looked at, and which keys were too large for it."""
    owned, population, direct, paths, _ = prepared(spark, d)
    return linking.candidate_report(linking.key_sizes(owned, population), {"communication_direct": direct, "funds_path": paths})


def subject_links(spark, d, every=False):
    """Links of customers; ``every``: of keys of any size."""
    owned, population, direct, paths, cut = prepared(spark, d)
    activity, places = w.activity(spark, d).select(F.col("ref").alias("subject"), "ts"), ql.places(spark, d)
    has = lambda source: owned.where(F.col("source") == source).select("subject").distinct()
    often = lambda rows, n: rows.groupBy("subject").count().where(F.col("count") >= n).select("subject")
    able = {
        "shared_counterparty": has("shared_counterparty"), "funds_path": w.accounts(spark, d).select(F.col("ref").alias("subject")), "co_attendance": has("co_attendance"), "communication": has("communication_shared"),
        "affiliation": has("affiliation"), "shared_corridor": has("shared_corridor"), "proximity": often(places, 2), "coincidence": often(activity, 3),
    }
    return linking.link_subjects(owned, population, direct, paths, places, activity, linking.able_subjects(able, cut), every=every)


LINKED = f"""{BASE}, {PROPOSED},
shared AS MATERIALIZED (SELECT p.a, p.b, x.source, count(*) AS shared, sum(weight) AS observed FROM proposed p JOIN own x ON x.subject = p.a JOIN own y ON y.subject = p.b AND y.source = x.source AND y.key = x.key JOIN size s ON s.source = x.source AND s.key = x.key GROUP BY 1, 2, 3),
deals AS (SELECT subject, count(*) AS n FROM own WHERE source = 'shared_counterparty' GROUP BY 1), whole AS (SELECT count(*) AS d, avg(weight) AS mean FROM size WHERE source = 'shared_counterparty'),
lifted AS (SELECT a, b, observed / (x.n * y.n / d * mean) AS v FROM shared JOIN deals x ON x.subject = a JOIN deals y ON y.subject = b, whole WHERE source = 'shared_counterparty'),
named AS MATERIALIZED (SELECT * FROM (SELECT a, b, 'shared_counterparty' AS dim, 'financial' AS family, least(1.0, greatest(0.0, (v - 3) / 5)) AS raw, 1.0 AS top FROM lifted UNION ALL SELECT a, b, 'funds_path', 'financial', raw, 1.0 FROM known_paths
 UNION ALL SELECT a, b, 'co_attendance', 'social', least(1.0, greatest(0.0, (observed - 0.6) / 1.4)), 1.0 FROM shared WHERE source = 'co_attendance' UNION ALL SELECT a, b, 'affiliation', 'social', least(1.0, greatest(0.0, (observed - 0.4) / 1.2)), 1.0 FROM shared WHERE source = 'affiliation'
 UNION ALL SELECT a, b, 'shared_corridor', 'logistical', observed, 0.85 FROM shared WHERE source = 'shared_corridor' UNION ALL SELECT a, b, 'communication', 'social', least(1.0, n / 3), 1.0 FROM known_met
 UNION ALL SELECT s.a, s.b, 'communication', 'social', least(1.0, greatest(0.0, (observed - 0.7) / 1.5)), 1.0 FROM shared s WHERE source = 'communication_shared' AND NOT EXISTS (SELECT 1 FROM known_met m WHERE m.a = s.a AND m.b = s.b)) WHERE raw > 0),
asked AS MATERIALIZED (SELECT DISTINCT a, b FROM named WHERE raw >= 0.25), {ql.MIDDLES}, {ql.COINCIDENT},
near AS (SELECT q.a, q.b, {ql.KM} AS km FROM asked q JOIN middles x ON x.subject = q.a JOIN middles y ON y.subject = q.b),
every AS (SELECT named.* FROM named SEMI JOIN asked USING (a, b) UNION ALL SELECT a, b, 'proximity', 'spatial', least(1.0, greatest(0.0, (25 - km) / 23)), 0.25 FROM near WHERE km < 25 UNION ALL SELECT a, b, 'coincidence', 'temporal', least(1.0, greatest(0.0, (lift - 1.8) / 0.8)), 0.2 FROM coincident WHERE lift > 1.8),
best AS (SELECT a, b, family, max(raw) AS raw, max(top) AS top, bool_or(dim = 'funds_path') AS path FROM every GROUP BY 1, 2, 3),
scored AS (SELECT a, b, 1 - product(1 - round(raw * top + 1e-9, 4)) + 1e-9 AS strength, coalesce(string_agg(family, ',' ORDER BY family) FILTER (raw >= 0.25 AND top > 0.5), '') AS families, coalesce(string_agg(family, ',' ORDER BY family) FILTER (raw >= 0.25 AND top < 0.5), '') AS supporting, count(*) FILTER (raw >= 0.25 AND top > 0.5) AS nf, bool_or(path) AS path FROM best GROUP BY 1, 2),
bits AS (SELECT subject, bit_or(bit) AS able FROM (SELECT subject, CASE source WHEN 'shared_counterparty' THEN 1 WHEN 'co_attendance' THEN 4 WHEN 'communication_shared' THEN 8 WHEN 'affiliation' THEN 16 ELSE 32 END AS bit FROM own UNION ALL SELECT ref, 2 FROM accounts UNION ALL SELECT subject, 64 FROM middles UNION ALL SELECT ref, 128 FROM en WHERE n >= 3) GROUP BY 1),
linked AS (SELECT s.a, s.b, strength, families, supporting, nf, bit_count((x.able & y.able) & CASE WHEN NOT path AND (s.a IN (FROM cut) OR s.b IN (FROM cut)) THEN 253 ELSE 255 END) AS evaluable FROM scored s JOIN bits x ON x.subject = s.a JOIN bits y ON y.subject = s.b WHERE nf > 0 AND strength >= 0.3)"""


@query(
    w.sql(
        "accounts activity contacts transfers",
        f"""{LINKED} SELECT a, b, round(strength, 4) AS strength, CASE WHEN strength >= 0.6 AND nf >= 2 AND evaluable >= 4 THEN 'established' WHEN strength >= 0.45 THEN 'probable' ELSE 'possible' END AS tier,
 round(evaluable / 8, 4) AS coverage, CAST(evaluable AS INTEGER) AS evaluable, families, supporting FROM linked""",
    )
)
def scored_links(spark, d):
    """Links between customers: strength, tier, how much could be judged, and the families that say so."""
    return subject_links(spark, d).withColumns({k: F.array_join(k, ",") for k in ("families", "supporting")})


def clustered(spark, d):
    return c.clusters(written(subject_links(spark, d, every=True)))


@query()
def link_clusters(spark, d):
    found, _ = clustered(spark, d)
    return found.withColumn("families", F.array_join("families", ","))


@query()
def cluster_members(spark, d):
    _, members = clustered(spark, d)
    return members
