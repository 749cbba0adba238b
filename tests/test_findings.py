"""Queries on rows that the smallest tables lack, and steps held against plainer ones."""

import datetime
import math
import random
import re

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.operators import assessment, correlation, geo, graph, linking, resolution, search, sequences
from sleuthframe.plans import queries_links


def test_different_keys_with_one_phone_are_a_common_end(spark, tmp_path):
    rows = [(5, "a", "b", "t", 1), (55, "a", "b", "t", 2), (7, "a", "b", "t", 2), (12_345_678_901, "a", "b", "t", 3), (12_345_678_902, "a", "b", "t", 4)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {(r["a"], r["b"]): r["similarity"] for r in queries_links.field_similarity(spark, str(tmp_path)).collect()}
    assert got[5, 55] == 0.9 and got[7, 55] == 1.0 and got[5, 7] == 0.0 and got[12_345_678_901, 12_345_678_902] == 0.9


def test_all_anchors_are_kept_without_a_bound(spark):
    rows = spark.range(12_100).selectExpr("id as subject", "cast(id as double) as score", "1 as n_fired")
    found, total = correlation.anchors(rows, None)
    assert found.count() == total == 12_100
    assert correlation.anchors(rows)[0].count() == 12_000


def test_every_target_is_followed_without_a_bound(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(i, 0, 10 + i, 100.0 + i, day) for i in range(3)] + [(10 * i + j, 10 + i, 1000 + 500 * i + j, 90.0, day) for i in range(3) for j in range(401)]
    rows = [(e, *r[1:]) for e, r in enumerate(rows)]
    money = spark.createDataFrame(rows, "edge_id long, src long, dst long, amount double, ts timestamp_ntz")
    subjects = spark.createDataFrame([(0, 0)], "subject long, ref long")
    found = graph.forward_reach(subjects, money, most=None)
    assert found.count() == 3 + 3 * 401 and found.where("truncated").isEmpty()
    assert graph.forward_reach(subjects, money).count() == 3 + 400


def test_similar_vectors_by_blocks_rank_as_all_pairs_do(spark, monkeypatch):
    monkeypatch.setattr(graph, "QUERY_BLOCK", 4)
    rng = random.Random(5)
    rows = [(i, [rng.choice([0.0, 1.0, 0.5]) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5), (61, None), (62, [1.0, None, 0.0, 0.0, 0.0]), (63, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "ref long, vector array<double>")
    asked = vectors.where("ref % 9 = 0 or ref >= 60")
    got = {(r["ref"], r["rank"]): (r["other"], r["similarity"]) for r in graph.most_similar(vectors, asked, 7).collect()}
    every = asked.select(F.col("ref").alias("q"), F.col("vector").alias("qv")).join(vectors, F.col("q") != F.col("ref")).select("q", "ref", graph.cosine(F.col("vector"), F.col("qv")).alias("s"))
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc_nulls_last("s"), "ref"))).where("rank <= 7")
    assert got == {(r["q"], r["rank"]): (r["ref"], r["s"]) for r in ranked.collect()}


def test_names_alike_are_looked_at_once(spark, monkeypatch):
    seen = []
    plain = search.similar_words
    monkeypatch.setattr(search, "similar_words", lambda terms, words: seen.append((terms.count(), words.count())) or plain(terms, words))
    names = spark.range(200).selectExpr("id as ref", "concat('azure ', if(id % 2 = 0, 'linen', 'almond')) as name")
    found = search.search_names(names, names.selectExpr("ref as query", "name as text").where("query < 4"), 3)
    assert seen == [(3, 3)]
    got = {q: [r["ref"] for r in found.where(f"query = {q}").orderBy("rank").collect()] for q in range(4)}
    assert got == {0: [0, 2, 4], 1: [1, 3, 5], 2: [0, 2, 4], 3: [1, 3, 5]}


def test_scores_of_names_that_come_again_are_kept():
    resolution.name_score.cache_clear()
    assert {resolution.name_score("mary ann lee", "m lee") for _ in range(5)} == {resolution.name_score("mary ann lee", "m lee")}
    assert resolution.name_score.cache_info().misses == 1


def test_coincidences_over_chunks_count_each_event_once(spark, monkeypatch):
    monkeypatch.setattr(correlation, "CHUNK", 2)
    rng, day, hour = random.Random(11), datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    rows = [(s, day + rng.randrange(24 * 60) * hour) for s in range(8) for _ in range(2 + 3 * s)]
    rows += [(1, rows[-1][1])] * 2
    pairs = [(a, b) for a in range(8) for b in range(8)]
    found = correlation.coincidences(spark.createDataFrame(rows, "subject long, ts timestamp_ntz"), spark.createDataFrame(pairs, "a long, b long"))
    of = lambda s: [t for x, t in rows if x == s]
    want = {(a, b): sum(any(abs(t - u) <= 24 * hour for u in of(b)) for t in of(a)) for a, b in pairs if a < b and len(of(a)) >= 3 and len(of(b)) >= 3}
    assert {(r["a"], r["b"]): r["hits"] for r in found.collect()} == want
    assert "cover" in found._jdf.queryExecution().optimizedPlan().toString()  # stretches of time, not an array of events a day


def test_distances_by_bits_are_those_of_the_paths(spark):
    rng = random.Random(2)
    edges = spark.createDataFrame([(rng.randrange(150), rng.randrange(150)) for _ in range(170)] + [(900, 900)], "src long, dst long")
    sources = spark.range(140).select(F.col("id").alias("ref")).unionByName(spark.createDataFrame([(900,), (901,)], "ref long"))
    got = sorted(tuple(r) for r in graph.distances_from(sources, edges, 6).collect())
    assert got == sorted((r["a"], r["b"], r["length"]) for r in graph.paths_from(sources, edges, 6).collect())


def test_pairs_of_one_key_each_are_not_added_up(spark):
    owned = spark.createDataFrame([(i, f"k{i % 3}") for i in range(9)] + [(0, "k0")], "subject long, key string")
    found = correlation.shared_rarity(owned, 9)
    more = correlation.shared_rarity(owned.unionByName(spark.createDataFrame([(100, "x"), (100, "y")], "subject long, key string")), 9)
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == 9 and rows == sorted(map(tuple, more.collect()))
    grouped = lambda df: "Aggregate [a#" in df._jdf.queryExecution().optimizedPlan().toString()
    assert grouped(more) and not grouped(found)


def test_betweenness_writes_no_row_a_source_and_node(spark, monkeypatch):
    rng = random.Random(9)
    edges = spark.createDataFrame([(rng.randrange(60), rng.randrange(60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(25)] + [(300, 300)], "src long, dst long")
    sources = spark.range(0, 130, 3).select(F.col("id").alias("ref"))
    tables, plain = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: tables.append(df.columns) or plain(df))
    monkeypatch.setattr(graph, "HELD_STATES", 400)
    got = {r["ref"]: round(r["score"], 9) for r in graph.betweenness(edges, sources).collect()}
    assert tables == [["ref", "other"], ["source"]]
    monkeypatch.setattr(graph, "HELD_LINKS", 0)
    joined = {r["ref"]: round(r["score"], 9) for r in graph.betweenness(edges, sources).collect()}
    assert got == joined and got[110] > 0
    assert len(tables) > 4 and max(len(df) for df in tables) == 4


def test_bursts_add_up_no_span_again_for_each_row(spark):
    rng, day, hour = random.Random(3), datetime.datetime(2024, 1, 1), datetime.timedelta(hours=1)
    rows = [(r, day + rng.randrange(60) * hour) for r in range(4) for _ in range(5 + 20 * r)] + [(9, day), (9, None)]
    events = spark.createDataFrame(rows, "ref long, ts timestamp_ntz")
    frame = "over (partition by ref order by ts range between interval 6 hours preceding and current row)"
    plain = events.selectExpr("ref", "ts", f"count(1) {frame} as in_span", f"min(ts) {frame} as begins")
    found = sequences.bursts(events, 6)
    assert sorted(map(str, found.collect())) == sorted(map(str, plain.drop("begins").collect()))
    profile = sequences.burst_profile(events, 6)
    want = plain.groupBy("ref").agg(F.max("in_span").alias("peak"), F.min_by("begins", F.struct(-F.col("in_span"), F.col("begins"))).alias("peak_start")).where("ref < 9")
    assert sorted(map(tuple, profile.select("ref", "peak", "peak_start").collect())) == sorted(map(tuple, want.collect()))
    assert "INTERVAL '-" not in profile._jdf.queryExecution().optimizedPlan().toString() + found._jdf.queryExecution().optimizedPlan().toString()
    assert "INTERVAL '-" in plain._jdf.queryExecution().optimizedPlan().toString()


def _pairs_of(rows):
    """By pair the number of keys both have, and by key its subjects."""
    by_key = {}
    for s, k in set(rows):
        by_key.setdefault(k, set()).add(s)
    found = {}
    for members in by_key.values():
        for a in members:
            for b in members:
                if a < b:
                    found[a, b] = found.get((a, b), 0) + 1
    return found


def test_pairs_are_summed_where_they_are_whether_keys_are_shared_by_few_or_many(spark, monkeypatch):
    monkeypatch.setattr(correlation, "PAIRS", 20)
    monkeypatch.setattr(correlation, "FAN_OUT", 10)
    rng = random.Random(8)
    few = [(rng.randrange(60), f"k{rng.randrange(40)}") for _ in range(160)]
    many = [(s, f"h{k}") for s in range(70) for k in range(30) if rng.random() < 0.9]
    for rows, split in ((few, False), (many, True)):
        owned, want = spark.createDataFrame(rows, "subject long, key string"), _pairs_of(rows)
        found = correlation.candidates(owned)[0]
        assert {(r["a"], r["b"]): r["n_keys"] for r in found.collect()} == want and found.count() == len(want)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and ("(i#" in plan) == split
        counted = correlation.shared_rarity(owned, 70, counted=True)
        keys = {s: len({k for t, k in rows if t == s}) for s, _ in rows}
        assert {(r["a"], r["b"]): (r["shared"], r["n_a"], r["n_b"]) for r in counted.collect()} == {(a, b): (n, keys[a], keys[b]) for (a, b), n in want.items()}
        plain, other = correlation.lift(correlation.shared_rarity(owned, 70), owned, 70), correlation.lift(counted, owned, 70)
        fine = lambda df: sorted((r["a"], r["b"], r["shared"], r["n_a"], r["n_b"], round(r["lift"], 9)) for r in df.collect())
        assert fine(plain) == fine(other)


def test_candidates_of_all_sources_are_summed_up_once(spark):
    rng = random.Random(4)
    rows = sorted({(rng.choice(linking.KEYED[:3]), rng.randrange(30), f"k{rng.randrange(12)}") for _ in range(200)})
    owned = spark.createDataFrame(rows, "source string, subject long, key string")
    sizes = linking.key_sizes(owned, 30)
    direct = {"communication_direct": spark.createDataFrame([(1, 2), (40, 41)], "a long, b long"), "funds_path": spark.createDataFrame([(1, 2)], "a long, b long")}
    once = linking.proposed_pairs(owned, sizes, direct, 6)
    want = linking.candidate_pairs(linking.shared_keys(owned, sizes, 6), direct)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, want.collect())) and once.where("a = 40").first()["sources"] == 32
    by_pair = lambda df: re.findall(r"hashpartitioning\(a#\d+L?, b#", df._jdf.queryExecution().executedPlan().toString())
    assert by_pair(want) and not by_pair(once)


def test_points_of_one_cell_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(geo, "BLOCK", 8)
    blocks, plain = [], geo.F.ceil
    monkeypatch.setattr(geo.F, "ceil", lambda c: blocks.append(c) or plain(c))
    rng = random.Random(3)
    rows = [(i, 10 + rng.random() * 0.3, 20 + rng.random() * 0.3) for i in range(90)] + [(90, 0.0, 179.95), (91, 0.0, -179.95), (92, 89.99, 10.0), (93, 89.99, -170.0), (94, None, 1.0)]
    points = spark.createDataFrame(rows, "ref long, lat double, lng double").cache()
    x, y = points.toDF("a", "lat1", "lng1"), points.toDF("b", "lat2", "lng2")
    every = x.crossJoin(y).select("a", "b", geo.haversine_km(F.col("lat1"), F.col("lng1"), F.col("lat2"), F.col("lng2")).alias("km")).where("km <= 20")
    want = {(r["a"], r["b"]): round(r["km"], 6) for r in every.collect()}
    assert {(r["a"], r["b"]): round(r["km"], 6) for r in geo.within_km(points, points, 20.0).collect()} == want and len(blocks) == 2
    once = geo.within_km(points, points, 20.0, ordered=True).collect()
    assert {(r["a"], r["b"]): round(r["km"], 6) for r in once} == {k: v for k, v in want.items() if k[0] < k[1]} and len(once) < len(want)


def test_shipments_are_scored_row_by_row_as_by_their_signals(spark):
    rows = spark.createDataFrame([(i, *m) for i, m in enumerate([(1.0, 0.5, 0.2), (0.0, 0.0, 0.0), (None, 1.0, 0.7), (None, None, None), (1.0, None, 0.0), (None, None, 0.3)])], "subject long, manifest_discrepancy double, route_detour double, rare_corridor double")
    columns = "subject", "coverage", "raw", "score", "band"
    found = assessment.row_scores("Shipment", rows)
    want = assessment.scores(assessment.signals_of_rows("Shipment", rows))
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_probe_takes_its_blocks_from_their_heads(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(resolution, "written", lambda df: kept.append(df.cache()) or df)
    index = spark.range(300).selectExpr("id as ref", "concat('k', id % 3) as key").union(spark.range(10).selectExpr("id as ref", "'k1' as key")).union(spark.range(5).selectExpr("id as ref", "'k1' as key"))
    asked = spark.createDataFrame([(1, ["k1"]), (2, ["k0", "k1"]), (3, ["none"]), (4, ["k2", "k2"]), (5, [])], "probe long, keys array<string>")
    got = {r["probe"]: (r["refs"], r["n_refs"]) for r in resolution.probes(asked, index, 4).collect()}
    assert got == {1: ([0, 1, 2, 3], 107), 2: ([0, 1, 2, 3], 203), 3: (None, 0), 4: ([2, 5, 8, 11], 100), 5: (None, 0)}
    assert all(len(r["refs"]) == 4 for r in kept[0].collect()) and kept[0].count() == 3


def test_links_around_meet_lists_of_seeds(spark, monkeypatch):
    monkeypatch.setattr(graph, "SEEDS", 3)
    rng = random.Random(11)
    rows = [(i, rng.randrange(40), rng.randrange(40)) for i in range(90)] + [(90, 1, 1), (5, 1, 2), (5, 1, 2), (None, 3, 4)]
    edges = spark.createDataFrame(rows, "edge_id long, src long, dst long")
    nodes, links = graph.neighbourhood(spark.range(0, 40, 4).withColumnRenamed("id", "ref"), edges, 2, 12)
    hops = {(r["seed"], r["ref"]): r["hops"] for r in nodes.collect()}
    near = lambda s, x: hops.get((s, x), 2) < 2
    want = sorted({(s, str(e), a, b, (s, a) not in hops or (s, b) not in hops) for s in range(0, 40, 4) for e, a, b in rows if near(s, a) or near(s, b)})
    assert sorted((r["seed"], str(r["edge_id"]), r["src"], r["dst"], r["beyond"]) for r in links.collect()) == want
    assert {w[4] for w in want} == {True, False}


def test_ways_are_dealt_by_subject_and_target_once(spark, monkeypatch):
    day = datetime.datetime(2024, 1, 1)
    rows = [(1, 0, 1, 100.0, day), (2, 1, 2, 99.0, day), (3, 1, 2, 81.0, day), (4, 2, 3, 80.0, day), (5, 1, 4, 79.0, day)]
    money = spark.createDataFrame(rows, "edge_id long, src long, dst long, amount double, ts timestamp_ntz")
    kind, dealt = type(money), []
    plain = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *by: dealt.append((*by, len(df.columns))) or plain(df, *by))
    found = graph.forward_reach(spark.createDataFrame([(7, 0)], "subject long, ref long"), money, hops=3, most=None)
    assert sorted((r["ref"], r["hops"], r["carried"]) for r in found.collect()) == [(1, 1, 1.0), (2, 2, 0.99), (3, 3, 0.8)]
    assert dealt == [("subject", "at", 5), ("subject", "at", 7), ("subject", "at", 7)]


def test_walk_similarity_asks_for_every_user(spark, small):
    from sleuthframe.plans import queries_graph as q

    met = q.met(spark, small).where("src <> dst")
    people = {r[0] for r in met.select("src").union(met.select("dst")).distinct().collect()}
    ranks = {}
    for row in q.walk_similarity(spark, small).collect():
        ranks.setdefault(row["ref"], []).append(row["rank"])
    assert set(ranks) == people and {tuple(sorted(r)) for r in ranks.values()} == {tuple(range(1, min(10, len(people) - 1) + 1))}


def test_pairs_of_one_key_are_made_by_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    owned = spark.createDataFrame([(s, f"k{s % 3}") for s in range(90)], "subject long, key string")
    monkeypatch.setattr(correlation, "PAIRS", 100)
    found = correlation.shared_dimension(owned, 90, 0.1, 0.5, digits=5)
    raw = round((math.log(3) / math.log(90) - 0.1) / 0.4, 5)
    assert {tuple(r) for r in found.collect()} == {(a, b, raw) for a in range(90) for b in range(a + 1, 90) if a % 3 == b % 3}
    assert found.rdd.getNumPartitions() >= 13  # 1,305 pairs
