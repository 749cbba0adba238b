"""Links over eight dimensions from seven sources, against plain Python and a planted case for every tier."""

import datetime
import itertools
import math
import random

import pytest

from sleuthframe.operators import linking

DAY = datetime.datetime(2024, 1, 1)
OWNED = "source string, subject long, key string"


def plain_rarity(n, population):
    return 0.0 if n < 2 or n >= population else math.log(population / n) / math.log(population)


@pytest.fixture(scope="module")
def world():
    """Keys of all sources, one of them shared by nearly all."""
    rng = random.Random(11)
    owned = {(source, rng.randrange(40), f"k{rng.randrange(30)}") for source in linking.KEYED for _ in range(150)}
    return owned | {("affiliation", s, "hub") for s in range(0, 40, 2)} | {("shared_corridor", s, "route") for s in range(30)}


def plain_shared(owned, population, large=True, fan_out=8):
    by_key = {}
    for source, subject, key in owned:
        by_key.setdefault((source, key), set()).add(subject)
    small, out = set(), {}
    for (source, _), members in by_key.items():
        if len(members) <= fan_out:
            small |= {(a, b, source) for a, b in itertools.combinations(sorted(members), 2)}
    pairs = {(a, b) for a, b, _ in small}
    for (source, _), members in by_key.items():
        for a, b in itertools.combinations(sorted(members), 2):
            if len(members) <= fan_out or (large and (a, b) in pairs and plain_rarity(len(members), population)):
                n, w = out.get((a, b, source), (0, 0.0))
                out[a, b, source] = (n + 1, w + plain_rarity(len(members), population))
    return small, out, by_key


def test_candidates_and_what_they_share(spark, world):
    table = spark.createDataFrame(sorted(world), OWNED)
    sizes = linking.key_sizes(table, 40)
    direct = spark.createDataFrame([(1, 2, 3), (38, 39, 1)], "a long, b long, n long")
    shared = linking.shared_keys(table, sizes, 8)
    small, want, by_key = plain_shared(world, 40)
    assert {(r["a"], r["b"], r["source"]) for r in shared.collect()} == small
    masks = {}
    for a, b, source in small:
        masks[a, b] = masks.get((a, b), 0) | 1 << linking.SOURCES.index(source)
    for pair in ((1, 2), (38, 39)):
        masks[pair] = masks.get(pair, 0) | 1 << linking.SOURCES.index("communication_direct")
    pairs = linking.candidate_pairs(shared, {"communication_direct": direct})
    assert {(r["a"], r["b"]): r["sources"] for r in pairs.collect()} == masks
    whole = linking.with_large_keys(linking.candidate_pairs(shared, {}), shared, table, sizes, 8)
    assert {(r["a"], r["b"], r["source"]): (r["shared"], pytest.approx(r["observed"])) for r in whole.collect()} == want
    report = {r["source"]: r for r in linking.candidate_report(sizes, {"communication_direct": direct}, 8, 2).collect()}
    for source in linking.KEYED:
        n = {k: len(m) for (s, k), m in by_key.items() if s == source}
        over = sorted((-v, k) for k, v in n.items() if v > 8)
        assert (report[source]["keys"], report[source]["skipped"]) == (len(n), len(over))
        assert report[source]["proposed"] == sum(math.comb(v, 2) for v in n.values() if v <= 8) and report[source]["not_proposed"] == sum(math.comb(-v, 2) for v, _ in over)
        assert (report[source]["examples"] or "") == "; ".join(f"{k} ({-v} subjects)" for v, k in over[:2])
    assert report["communication_direct"]["proposed"] == 2


def link_rows(spark, same=None):
    """1-2 share a rare part, a rare organisation and calls; 3-4 one call of three and days in common, 13-14 the call alone; 5-6 a near place alone; 7-8 one organisation; 9-10 calls, but little to judge by; 11-12 an account and its holder."""
    own = [("shared_counterparty", s, k) for s, k in ((1, "rare"), (2, "rare"), (11, "x"), (12, "x"), (11, "y"), (12, "y"))]
    own += [("shared_counterparty", s, f"own{s}-{i}") for s in range(1, 60) for i in range(3)]
    own += [("affiliation", s, k) for s, k in ((1, "club"), (2, "club"), (7, "firm"), (8, "firm"))] + [("affiliation", s, f"org{s}") for s in range(1, 60)]
    calls = spark.createDataFrame([(1, 2, 5), (3, 4, 1), (9, 10, 4), (13, 14, 1)], "a long, b long, n long")
    paths = spark.createDataFrame([(1, 2, 0.1)], "a long, b long, raw double")
    places = spark.createDataFrame([(s, 10.0 + s // 2 * 5, 20.0) for s in range(1, 9) for _ in range(2)], "subject long, lat double, lng double")
    times = spark.createDataFrame([(s, DAY + datetime.timedelta(days=30 * i, hours=s)) for s in (1, 2, 3, 4) for i in range(3)], "subject long, ts timestamp_ntz")
    everyone = spark.createDataFrame([(s,) for s in range(1, 60) if s not in (9, 10)], "subject long")
    able = linking.able_subjects({name: everyone for name in linking.DIMENSIONS[:6]} | {"communication": everyone.unionByName(spark.createDataFrame([(9,), (10,)], "subject long"))}, spark.createDataFrame([(3,)], "subject long"))
    found = linking.link_subjects(spark.createDataFrame(own, OWNED), 60, calls, paths, places, times, able, same)
    return {(r["a"], r["b"]): r for r in found.collect()}


def test_every_tier_occurs_for_its_reasons(spark):
    rows = link_rows(spark)
    assert rows[1, 2]["tier"] == "established" and rows[1, 2]["families"] == ["financial", "social"] and rows[1, 2]["evaluable"] == 6 and rows[1, 2]["coverage"] == 0.75
    assert rows[3, 4]["tier"] == "probable" and rows[3, 4]["families"] == ["social"] and rows[3, 4]["supporting"] == ["temporal"]
    assert rows[3, 4]["evaluable"] == 5  # its search for paths was cut short
    assert rows[13, 14]["tier"] == "possible" and rows[13, 14]["strength"] == pytest.approx(0.3333) and rows[13, 14]["supporting"] == []
    assert (5, 6) not in rows  # nearness alone is no link
    assert rows[9, 10]["strength"] == 1.0 and rows[9, 10]["tier"] == "probable" and rows[9, 10]["evaluable"] == 1  # one family, and little to judge by
    assert (11, 12) in rows and (7, 8) in rows


def test_one_thing_seen_twice_is_no_link(spark):
    assert (11, 12) not in link_rows(spark, spark.createDataFrame([(12, 11)], "a long, b long"))


def test_lift_is_over_what_chance_would_share(spark):
    own = [("shared_counterparty", s, k) for s in (1, 2) for k in ("p", "q")] + [("shared_counterparty", s, f"k{i}") for s in range(3, 30) for i in range(s % 7)]
    table = spark.createDataFrame(own, OWNED)
    sizes = linking.key_sizes(table, 30)
    none = spark.createDataFrame([], "a long, b long, n long")
    found = linking.identifying(linking.shared_keys(table, sizes), table, sizes, none, spark.createDataFrame([], "a long, b long, raw double"))
    got = {(r["a"], r["b"]): r["raw"] for r in found.collect()}
    by_key = {}
    for _, s, k in own:
        by_key.setdefault(k, set()).add(s)
    mean = sum(plain_rarity(len(m), 30) for m in by_key.values()) / len(by_key)
    lift = 2 * plain_rarity(2, 30) / (2 * 2 / len(by_key) * mean)
    assert got[1, 2] == pytest.approx(min(1.0, max(0.0, (lift - 3) / 5))) and got[1, 2] > 0


def test_without_a_fan_out_keys_of_any_size_propose_pairs(spark):
    owned = spark.createDataFrame([("affiliation", i, "large") for i in range(300)] + [("shared_corridor", i, "small") for i in range(3)], "source string, subject long, key string")
    sizes = linking.key_sizes(owned, 1000)
    found = {(r["a"], r["b"]): r["sources"] for r in linking.proposed_pairs(owned, sizes, {}, None).collect()}
    assert found == {(a, b): 8 + 16 * (b < 3) for a in range(300) for b in range(a + 1, 300)}
    assert linking.proposed_pairs(owned, sizes, {}).count() == 3


def test_a_round_of_louvain_sums_links_before_they_are_shuffled(spark):
    from pyspark.sql import functions as F

    from sleuthframe.operators import communities

    links = spark.createDataFrame([(a, b, 1.0) for a in range(4) for b in range(4) if a != b], "ref long, other long, w double")
    at = spark.createDataFrame([(a, 3.0, 0) for a in range(4)], "ref long, k double, c long")
    moves = communities._best_moves(links, at, F.lit(True), 12.0)
    assert "REPARTITION" not in moves._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in moves.collect()} == {(a, 0) for a in range(4)}


def test_scoring_moves_no_pair(spark):
    names = [f"raw_{name}" for name in linking.DIMENSIONS]
    pairs = spark.createDataFrame([(1, 2, 255, False, *[0.5] * 8), (3, 4, 255, True, *[0.1] * 8)], "a long, b long, able int, cut boolean, " + ", ".join(f"{n} double" for n in names))
    scored = linking.score_links(pairs)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()
    (row,) = scored.collect()
    assert row["families"] == ["financial", "logistical", "social"] and row["supporting"] == ["spatial", "temporal"] and row["evaluable"] == 8
    assert row["strength"] == pytest.approx(1 - 0.5 * 0.5 * (1 - 0.425) * (1 - 0.125) * 0.9, abs=6e-5)


def test_with_every_key_large_ones_propose_all_that_can_be_links(spark, world):
    owned = spark.createDataFrame(sorted(world), OWNED)
    direct = spark.createDataFrame([(1, 2, 3), (38, 39, 1)], "a long, b long, n long")
    paths = spark.createDataFrame([(5, 6, 0.4)], "a long, b long, raw double")
    places = spark.createDataFrame([(s, 10.0 + s % 3 / 20, 20.0) for s in range(0, 40, 3) for _ in range(2)], "subject long, lat double, lng double")
    times = spark.createDataFrame([(s, DAY + datetime.timedelta(days=40 * i, hours=s % 30)) for s in range(0, 40, 4) for i in range(3)], "subject long, ts timestamp_ntz")
    able = linking.able_subjects({name: spark.range(40).toDF("subject") for name in linking.DIMENSIONS})
    found = lambda **how: {tuple(map(str, r)) for r in linking.link_subjects(owned, 40, direct, paths, places, times, able, **how).collect()}
    whole = found(fan_out=1_000)
    assert found(fan_out=6, every=True) == whole
    assert found(fan_out=6) < whole
    sizes = linking.key_sizes(owned, 40)
    backed = spark.createDataFrame([(s, s % 3 == 0, s % 4 == 0) for s in range(40)], "subject long, located boolean, active boolean")
    large = owned.join(sizes.where("n > 6 and weight > 0"), ["source", "key"])
    assert 0 < linking.unlisted(owned, sizes, backed, 6).count() < large.count()
