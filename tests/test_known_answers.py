"""Small inputs with known answers."""

import pytest

from pyspark.sql import functions as F

from sleuthframe.functions import distributions as dist
from sleuthframe.operators import assessment, components, correlation, ingest, resolution, sequences
from sleuthframe.streaming import feeds


def test_components_take_loops_repeats_and_nulls(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 2), (3, 3), (7, 8), (None, 8), (9, 9)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.connected_components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_components_of_a_long_chain_and_of_nothing(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r["component"] for r in components.connected_components(chain).collect()} == {0}
    assert components.connected_components(chain.limit(0)).count() == 0


@pytest.mark.parametrize(("a", "b", "least"), [("sarah ellis", "ellis sarah", 1.0), ("sarah jane ellis", "sarah ellis", 0.85), ("j smith", "john a smith", 0.85)])
def test_names_match_in_any_order(a, b, least):
    assert resolution.name_score(a, b) >= least


def test_organisations_have_no_initials():
    assert resolution.name_score("b smith", "bona adler smith", person=False) < 0.85


def test_recency_halves_in_thirty_days_down_to_a_quarter(spark):
    rows = spark.createDataFrame([(0.0,), (30.0,), (3650.0,)], "age double").select(sequences.decay(F.col("age")).alias("d"))
    assert [round(r["d"], 6) for r in rows.collect()] == [1.0, 0.5, 0.25]


def test_intervals_and_tails():
    low, high = dist.clopper_pearson(5, 10)
    assert low == pytest.approx(0.18709, abs=1e-4) and high == pytest.approx(0.81291, abs=1e-4)
    assert dist.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0)
    assert dist.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-5)
    assert dist.chi_square_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-5)


def test_equal_payloads_have_one_canonical_form():
    assert ingest.canonical('{"b": 1, "a": [2, 3]}') == ingest.canonical('{"a":[2,3],"b":1}')


def test_streamed_lines_arrive_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    feed = feeds.read_json_lines(spark, str(source))
    assert feed.isStreaming
    query = feed.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert spark.table("arrived").count() == 2


def test_pairs_of_keys_beyond_the_fan_out(spark):
    own = {i: {"hot", f"k{i % 7}"} | ({"big"} if i % 2 else set()) for i in range(600)}
    rows = spark.createDataFrame([(i, k) for i, keys in own.items() for k in keys] * 2, "subject long, key string")
    pairs, large = correlation.candidates(rows)
    want = {(a, b): len(own[a] & own[b]) for a in own for b in own if a < b}
    assert {(r["a"], r["b"]): r["n_keys"] for r in pairs.collect()} == want
    assert {r["key"]: r["n"] for r in large.collect()} == {"hot": 600, "big": 300}
    kept, told = correlation.candidates(rows, 250)
    assert kept.count() == sum(a % 7 == b % 7 for a, b in want) and told.count() == 2
    keyed = spark.createDataFrame([(i, ["one"]) for i in range(100)], "ref long, keys array<string>")
    assert resolution.block_pairs(keyed, None)[0].count() == 4950 and resolution.block_pairs(keyed)[0].count() == 0


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from sleuthframe.plans import lineage

    session = lambda master: SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master=master, getConf=dict))
    assert lineage.scratch_folder(session("local[4]"), "t-")
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(ValueError):
            lineage.scratch_folder(session(master), "t-")


def random_graph(seed=3, n=26, m=30):
    import random

    draw = random.Random(seed)
    return sorted({tuple(sorted(draw.sample(range(n), 2))) for _ in range(m)})


def reach(links, start, without=None):
    found, todo = {start}, [start]
    while todo:
        at = todo.pop()
        for a, b in links:
            if (a, b) != without and at in (a, b) and (other := a + b - at) not in found:
                found.add(other)
                todo.append(other)
    return found


def test_bridges_are_the_links_whose_loss_splits(spark):
    from sleuthframe.operators import graph

    links = random_graph()
    rows = [("x", a, b) for a, b in links] + [("y", b, a) for a, b in links] * 2 + [("z", 1, 2), ("z", 2, 3), ("z", 3, 1), ("z", 5, 5)]
    found = graph.bridges(spark.createDataFrame(rows, "cluster string, a long, b long")).collect()
    want = {(a, b) for a, b in links if b not in reach(links, a, (a, b))}
    assert want and {(r["cluster"], r["a"], r["b"]) for r in found} == {(c, a, b) for c in "xy" for a, b in want}
    assert graph.bridges(spark.createDataFrame([], "cluster string, a long, b long")).count() == 0


def test_betweenness_counts_shortest_paths(spark):
    from itertools import combinations

    from sleuthframe.operators import graph

    links = random_graph(5, 14, 18)
    near = {v: {a + b - v for a, b in links if v in (a, b)} for e in links for v in e}

    def paths(a, b):
        front = [[a]]
        while front:
            if done := [p for p in front if p[-1] == b]:
                return done
            seen = {v for p in front for v in p}
            front = [[*p, v] for p in front for v in near[p[-1]] if v not in seen]
        return []

    want = dict.fromkeys(near, 0.0)
    for a, b in combinations(sorted(near), 2):
        ways = paths(a, b)
        for p in ways:
            for v in p[1:-1]:
                want[v] += 1 / len(ways)
    edges = spark.createDataFrame(links, "src long, dst long")
    found = {r["ref"]: r["score"] for r in graph.betweenness(edges, edges.select(F.col("src").alias("ref")).union(edges.select("dst"))).collect()}
    assert {v: pytest.approx(x) for v, x in want.items() if x} == found


def test_clusters_have_degrees_and_bridges(spark):
    groups = [(1, 2), (2, 3), (1, 3), (3, 4), (11, 12), (12, 13), (11, 13), (21, 22)]
    rows = [(a, b, 0.5 + (a + b) / 100, ["social"]) for a, b in groups] + [(3, 11, 0.2, ["financial"])]
    found, members = correlation.clusters(spark.createDataFrame(rows, "a long, b long, strength double, families array<string>"), most=3)
    got = {r["cluster"]: r for r in found.collect()}
    assert set(got) == {1, 11} and got[1]["size"] == 4 and got[11]["n_links"] == 3
    assert (got[1]["n_bridges"], got[1]["weakest_bridge"], got[11]["n_bridges"], got[11]["weakest_bridge"]) == (1, 0.57, 0, None)
    assert got[1]["over_merged"] and not got[11]["over_merged"] and got[1]["families"] == ["social"]
    assert {(r["cluster"], r["subject"]): r["degree"] for r in members.collect()} == {(1, 1): 2, (1, 2): 2, (1, 3): 3, (1, 4): 1, (11, 11): 2, (11, 12): 2, (11, 13): 2}


def test_blocking_keys_of_all_kinds(spark):
    from sleuthframe.operators import records

    rows = spark.createDataFrame([(1, "Dr Jane Roe", "1980-02-03", "Bonn", "DE", "+49 (0) 151-2345678", "b x-12", "", None), (2, None, None, None, None, "12", None, None, None)], "ref long, name string, born string, city string, country string, phone string, plate string, imei string, mac string")
    found = {(r["ref"], r["kind"]): r["key"] for r in records.keyed(records.blocking_keys(rows)).collect()}
    assert found == {(1, "phonetic"): "ph:J500-R000", (1, "surname_year"): "sy:roe|1980", (1, "surname_city"): "sc:roe|bonn", (1, "name_country"): "nc:dr jane roe|de", (1, "phone"): "tel:12345678", (1, "plate"): "plate:BX12"}


def test_the_guard_names_what_may_not_be_read(spark):
    from sleuthframe.operators import records

    with pytest.raises(ValueError, match="risk_score, storyline_id"):
        records.check_admissible(spark.createDataFrame([(1, 2, 3)], "storyline_id int, ref int, risk_score int"))


def test_places_over_all_rows_without_one_window(spark):
    rows = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"))
    found = sequences.numbered(rows, [F.desc("v")], "place")
    assert all(r["place"] == 1000 - r["v"] for r in found.collect())
    tests = spark.createDataFrame([(i, p) for i, p in enumerate((0.001, 0.04, 0.03, 0.9, None, 0.02))], "ref long, p double")
    kept = {r["ref"] for r in sequences.false_discovery(tests, "p", ["ref"]).where("kept").collect()}
    assert kept == {0, 1, 2, 5}


def test_a_fingerprint_tells_any_changed_parameter():
    model = assessment.SIGNALS
    assert assessment.fingerprint(model) == assessment.fingerprint(dict(reversed(model.items()))) != assessment.fingerprint({"a": 1})
