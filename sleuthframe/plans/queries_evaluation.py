"""How right the engine's answers are, hash chains, and projections kept up by changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sleuthframe.operators import chains, evaluation, profiles, projections
from sleuthframe.operators import records as rec
from sleuthframe.operators import resolution as r
from sleuthframe.plans import queries_correlation as qc
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


# --- resolution --------------------------------------------------------------------------------------------------


def people(spark, d):
    """Parts as people: ``ref, name, born, phone, city, country``."""
    key = F.col("p_partkey")
    born = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), (key * 37 % 18_000).cast("int")), "yyyy-MM-dd")
    phone = F.concat(F.lit("+44 "), F.lpad((key * 7919 % 10_000_000_000).cast("string"), 10, "2"))
    return table(spark, d, "part").select(key.alias("ref"), F.col("p_name").alias("name"), born.alias("born"), phone.alias("phone"), F.col("p_brand").alias("city"), F.col("p_type").alias("country"))


def judged(pairs):
    """Labelled pairs of people with ``verdict, blocked``, by name, date of birth, phone, city and country."""
    left, right = (F.col(f"left_{c}") for c in ("name", "phone")), (F.col(f"right_{c}") for c in ("name", "phone"))
    (name_a, phone_a), (name_b, phone_b) = left, right
    dates = r.date_similarity(r.parsed_date(F.col("left_born")), r.parsed_date(F.col("right_born")))
    same = lambda c: F.when(F.col(f"left_{c}").isNotNull() & F.col(f"right_{c}").isNotNull(), (F.lower(f"left_{c}") == F.lower(f"right_{c}")).cast("double"))
    rules = {"name": (3.0, r.name_similarity(r.normalised(name_a), r.normalised(name_b))), "born": (3.0, dates), "phone": (3.0, r.phone_similarity(r.phone_digits(phone_a), r.phone_digits(phone_b))), "city": (0.5, same("city")), "country": (0.75, same("country"))}
    keyed = pairs.withColumn("pair", F.xxhash64("kind", "left_ref", "right_ref"))
    sides = [rec.blocking_keys(keyed.select("pair", F.col(f"{s}_ref").alias("ref"), *[F.col(f"{s}_{c}").alias(c) for c in ("name", "born", "phone", "city", "country")]), "pair").select("pair", F.transform("keys", lambda k: k["key"]).alias(f"keys_{s}")) for s in ("left", "right")]
    both = keyed.join(sides[0], "pair").join(sides[1], "pair")
    return r.compared(both, rules, "phone", dates <= r.DISAGREE).select("kind", "same", "left_ref", "right_ref", "verdict", F.arrays_overlap("keys_left", "keys_right").alias("blocked"))


@query()
def resolution_evaluation(spark, d):
    """By kind of slip and over all, how many of planted duplicates are found, and of different people taken for one."""
    rows = written(people(spark, d))
    keys = rec.keyed(rec.blocking_keys(rows)).where("kind <> 'name_country'")
    blocked = r.block_pairs(keys.groupBy("ref").agg(F.collect_set("key").alias("keys")))[0]
    return evaluation.resolution_rates(judged(written(evaluation.labelled_pairs(rows, blocked))))


def mixed_profiles(spark, d):
    """Parts as profiles of the four types."""
    rows = people(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("ref"), "p_size", "p_type"), "ref")
    number = lambda step: F.lpad((F.col("ref") * step % 10_000_000_000).cast("string"), 10, "3")
    return rows.select(
        F.concat(F.lit("R"), F.col("ref").cast("string")).alias("ref"), F.element_at(F.array(*[F.lit(x) for x in ("Person", "Organization", "Vehicle", "Device")]), (F.col("ref") % 4 + 1).cast("int")).alias("entity_type"), "name",
        F.col("born").alias("date_of_birth"), F.col("born").alias("registration_date"), "phone", "city", "country", number(7919).alias("plate"), number(104_729).alias("imei"), number(1_299_709).alias("mac"), F.col("p_size").cast("string").alias("make"), F.col("p_type").alias("device_type"),
    )


PROFILES = """pf AS (SELECT p_partkey AS k, 'R' || p_partkey AS ref, p_partkey % 4 AS kind, lpad(CAST(p_partkey * 7919 % 10000000000 AS VARCHAR), 10, '3') AS plate, lpad(CAST(p_partkey * 104729 % 10000000000 AS VARCHAR), 10, '3') AS imei, lpad(CAST(p_partkey * 1299709 % 10000000000 AS VARCHAR), 10, '3') AS mac FROM part)"""


@query(
    f"""WITH {PROFILES} SELECT 'X' || substr(ref, 2) AS probe, CASE WHEN k % 60 = 2 THEN 'ambiguous' ELSE 'matched' END AS verdict, CASE WHEN k % 60 <> 2 THEN ref END AS match, 1 AS searched, false AS truncated, ref AS candidates FROM pf WHERE k % 20 IN (2, 3)"""
)
def identifier_verdicts(spark, d):
    """Vehicles and devices under new refs, some of them with another make or type: found by their numbers."""
    rows = mixed_profiles(spark, d)
    number = F.substring("ref", 2, 20).cast("long")
    probes = rows.where(number % 20 < 4).where(number % 20 > 1).withColumn("make", F.when(number % 60 == 2, "other").otherwise(F.col("make")))
    found = profiles.probe_verdicts(probes.withColumn("ref", F.concat(F.lit("X"), number.cast("string"))), rows)
    return found.withColumn("candidates", F.array_join("candidates", ","))


@query()
def probe_verdicts(spark, d):
    """What every twentieth profile is taken for when it comes again under another ref, with a slip in its name."""
    rows = mixed_profiles(spark, d)
    number = F.substring("ref", 2, 20).cast("long")
    probes = rows.where(number % 20 < 4).withColumns({"ref": F.concat(F.lit("X"), number.cast("string")), "name": F.concat("name", F.lit("e"))})
    return profiles.probe_verdicts(probes, rows).withColumn("candidates", F.array_join("candidates", ","))


# --- correlation -------------------------------------------------------------------------------------------------


def planted(spark, d):
    """Customers with high balances, by segment and nation, and some by nation alone: ``ref, storyline``."""
    rows = table(spark, d, "customer")
    both = rows.where("c_acctbal > 5000").select(F.col("c_custkey").alias("ref"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("storyline"))
    return both.unionByName(rows.where("c_acctbal > 8000").select(F.col("c_custkey").alias("ref"), F.concat(F.lit("nation-"), F.col("c_nationkey").cast("string")).alias("storyline")))


TRUTH = """, planted AS (SELECT c_custkey AS ref, c_mktsegment || '-' || c_nationkey AS storyline FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'nation-' || c_nationkey FROM customer WHERE c_acctbal > 8000),
both_in AS (SELECT x.storyline, x.ref AS a, y.ref AS b FROM planted x JOIN planted y ON x.storyline = y.storyline AND x.ref < y.ref), truth AS (SELECT DISTINCT a, b FROM both_in),
found AS (SELECT a, b, CASE WHEN strength >= 0.6 AND nf >= 2 AND evaluable >= 4 THEN 'established' WHEN strength >= 0.45 THEN 'probable' ELSE 'possible' END AS tier, (a, b) IN (SELECT (a, b) FROM truth) AS hit, a IN (SELECT ref FROM planted) AND b IN (SELECT ref FROM planted) AS known FROM linked)"""


def found_links(spark, d):
    return written(qc.subject_links(spark, d).select("a", "b", "tier"))


@query(
    w.sql(
        "accounts activity contacts transfers",
        f"""{qc.LINKED}{TRUTH}, taken AS (SELECT 'strict' AS measure, count(*) AS selected, count(*) FILTER (hit) AS true_positives FROM found UNION ALL SELECT 'discriminative', count(*), count(*) FILTER (hit) FROM found WHERE known
 UNION ALL SELECT 'published', count(*), count(*) FILTER (hit) FROM found WHERE tier IN ('established', 'probable')), all_true AS (SELECT count(*) AS labelled FROM truth)
SELECT measure, selected, true_positives, labelled, round(true_positives / nullif(selected, 0), 4) AS precision, round(true_positives / nullif(labelled, 0), 4) AS recall FROM taken, all_true""",
    )
)
def link_rates(spark, d):
    """Links against planted storylines: all of them, those that can be judged, and those that are published."""
    return evaluation.link_rates(found_links(spark, d), planted(spark, d), qc.subjects(spark, d))


@query(
    w.sql(
        "accounts activity contacts transfers",
        f"""{qc.LINKED}{TRUTH}, story AS (SELECT storyline, count(*) AS subjects, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM planted GROUP BY 1), linked_in AS (SELECT storyline, count(*) AS recovered FROM both_in JOIN linked USING (a, b) GROUP BY 1)
SELECT storyline, subjects, pairs, coalesce(recovered, 0) AS recovered, round(coalesce(recovered, 0) / nullif(pairs, 0), 4) AS recall FROM story LEFT JOIN linked_in USING (storyline)""",
    )
)
def storyline_recovery(spark, d):
    """By storyline, how many of its pairs were linked."""
    return evaluation.storyline_recovery(found_links(spark, d), planted(spark, d), qc.subjects(spark, d))


@query()
def cluster_purity(spark, d):
    """How much of each cluster's planted members belongs to one storyline."""
    return evaluation.cluster_purity(qc.clustered(spark, d)[1], planted(spark, d))


# --- chains ------------------------------------------------------------------------------------------------------


FIELDS = ["event_id", "lane", "us"]


def audit_log(spark, d):
    """What each user did, as a chain of entries."""
    rows = w.activity(spark, d).select(F.col("ref").alias("chain"), "event_id", "lane", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return chains.append_entries(rows, ["us", "event_id"], FIELDS)


CHAIN = """e AS (SELECT ref AS chain, event_id, lane, '=' || event_id || '|=' || lane || '|=' || epoch_us(ts) AS body, row_number() OVER (PARTITION BY ref ORDER BY ts, event_id) AS seq FROM activity)"""


@query(
    w.sql(
        "activity",
        f"""WITH {CHAIN}, c AS (SELECT chain, event_id, seq, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || body) AS entry_hash FROM e WHERE seq = 1
 UNION ALL SELECT e.chain, e.event_id, e.seq, c.entry_hash, sha256(c.entry_hash || '|' || e.body) FROM c JOIN e ON e.chain = c.chain AND e.seq = c.seq + 1) SELECT * FROM c""",
        recursive=True,
    )
)
def audit_chain(spark, d):
    """Every user's events as a hash chain."""
    return audit_log(spark, d).select("chain", "event_id", "seq", "prev_hash", "entry_hash")


@query(
    w.sql(
        "activity",
        f"""WITH {CHAIN}, k AS (SELECT *, event_id % 101 = 7 AS gone, lag(event_id % 101 = 7) OVER (PARTITION BY chain ORDER BY seq) AS cut FROM e), l AS (SELECT * FROM k WHERE NOT gone),
f AS (SELECT chain, seq, 'content' AS fault FROM l WHERE event_id % 97 = 5 UNION ALL SELECT chain, seq, 'gap' FROM l WHERE cut)
SELECT chain, count(*) AS entries, coalesce(any_value(n), 0) AS n_faults, any_value(s) AS first_seq, any_value(t) AS first_fault FROM l LEFT JOIN (SELECT chain, count(*) AS n, min(seq) AS s, arg_min(fault, (seq, fault)) AS t FROM f GROUP BY 1) USING (chain) GROUP BY 1""",
    )
)
def audit_breaks(spark, d):
    """The same chains with some entries forged and some taken out: what each chain shows of it."""
    log = audit_log(spark, d).where("event_id % 101 <> 7").withColumn("lane", F.when(F.col("event_id") % 97 == 5, "forged").otherwise(F.col("lane")))
    return chains.chain_report(log, FIELDS)


# --- projections -------------------------------------------------------------------------------------------------


SHOWN, VALUES = "band <> 'insufficient'", ["band", "score"]


@query(
    w.sql(
        "assessments",
        """WITH last AS (SELECT max(run) AS run FROM assessments), n AS (SELECT subject, arg_max(band, (computed_at, id)) AS band, arg_max(score, (computed_at, id)) AS score FROM assessments WHERE subject IN (SELECT subject FROM assessments JOIN last USING (run)) GROUP BY 1),
o AS (SELECT subject, arg_max(band, (computed_at, id)) AS band, arg_max(score, (computed_at, id)) AS score FROM assessments WHERE run <> (FROM last) GROUP BY 1), x AS (SELECT * FROM n WHERE band <> 'insufficient'), y AS (SELECT * FROM o WHERE band <> 'insufficient' AND subject IN (SELECT subject FROM n)),
z AS (SELECT subject, CASE WHEN y.band IS NULL THEN 'insert' WHEN x.band IS NULL THEN 'remove' WHEN (x.band, x.score) IS DISTINCT FROM (y.band, y.score) THEN 'change' END AS action, coalesce(x.band, y.band) AS band, coalesce(x.score, y.score) AS score FROM x FULL JOIN y USING (subject))
SELECT action, subject, band, score FROM z WHERE action IS NOT NULL""",
    )
)
def projection_changes(spark, d):
    """What the last run of assessments does to the bands shown on subjects."""
    ledger = w.assessments(spark, d)
    last = F.broadcast(ledger.agg(F.max("run").alias("run")))  # one row
    before, new = ledger.join(last, "run", "left_anti"), ledger.join(last, "run", "left_semi")
    return projections.changes(projections.rebuilt(before, "subject", VALUES, SHOWN), ledger, new, "subject", VALUES, SHOWN)
