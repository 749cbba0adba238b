"""Evaluation, hash chains, projections and feeds against plain Python."""

import datetime
import hashlib
import itertools
import json
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sleuthframe.operators import chains, evaluation, projections
from sleuthframe.operators.ingest import Mapping, content_hash
from sleuthframe.sources import feeds
from sleuthframe.streaming import feeds as streams

DAY = datetime.datetime(2024, 1, 1)
PEOPLE = "ref long, name string, born string, phone string, city string, country string"


# Resolution


def test_slips_change_what_they_say_and_leave_out_what_they_cannot(spark):
    rows = [(1, "Ann Mary Lee", "1980-03-05", "+44 020 1234 5678", "Ely", "UK"), (2, "Bo", "1980-03-25", None, None, None), (3, None, None, "123", "X", "Y"), (4, "Al Bo", "1980-04-04", "", "X", "Y")]
    table = spark.createDataFrame(rows, PEOPLE)
    got = {kind: {r["ref"]: r for r in evaluation.slipped(table, kind).collect()} for kind in evaluation.SLIPS}
    assert {r: x["name"] for r, x in got["name_middle_dropped"].items()} == {1: "Ann Lee"}
    assert {r: x["name"] for r, x in got["name_abbreviated"].items()} == {1: "A Mary Lee", 4: "A Bo"}
    assert {r: x["name"] for r, x in got["name_reordered"].items()} == {1: "Lee Ann Mary", 4: "Bo Al"}
    assert {r: x["born"] for r, x in got["dob_transposed"].items()} == {1: "1980-05-03"}
    assert set(got["dob_missing"]) == {1, 2, 4} and all(x["born"] is None for x in got["dob_missing"].values())
    assert {r: x["phone"] for r, x in got["phone_reformatted"].items()} == {1: "012345678"[-9:]}
    assert set(got["phone_missing"]) == {1, 3, 4}
    assert {r: (x["name"], x["city"], x["born"], x["country"]) for r, x in got["sparse_record"].items()} == {1: ("Ann Mary Lee", "Ely", None, None), 2: ("Bo", None, None, None), 4: ("Al Bo", "X", None, None)}


def test_a_typo_swaps_two_inner_letters(spark):
    names = ["abcdefgh", "Anna Maria", "abc", "aaaa"] + ["xyzw" + "abc"[i % 3] * (i % 4) + "q" for i in range(40)]
    table = spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(names)], PEOPLE)
    found = {r["ref"]: r["name"] for r in evaluation.slipped(table, "name_typo").collect()}
    assert len(found) > 20 and not {2, 3} & set(found)
    for ref, name in found.items():
        at = [i for i, (x, y) in enumerate(zip(names[ref], name, strict=True)) if x != y]
        assert len(at) == 2 and at[1] == at[0] + 1 and at[0] >= 1 and names[ref][at[0]] == name[at[1]] and names[ref][at[1]] == name[at[0]]
    assert found == {r["ref"]: r["name"] for r in evaluation.slipped(table, "name_typo").collect()}


def plain_rates(rows):
    c = Counter()
    for _, same, verdict, blocked in rows:
        found = verdict in ("auto", "review")
        c["tp" if same and found else "fp" if found else "fn" if same else "tn"] += 1
        c["atp"] += same and verdict == "auto"
        c["afp"] += not same and verdict == "auto"
        c["missed"] += same and not blocked
        c["through"] += same and found and blocked
    share = lambda a, b: pytest.approx(a / b, abs=5.1e-5) if b else None
    true = c["tp"] + c["fn"]
    f1 = share(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"]) if c["tp"] else None
    return (len(rows), c["tp"], c["fp"], c["tn"], c["fn"], c["atp"], c["afp"], c["missed"], share(c["tp"], c["tp"] + c["fp"]), share(c["tp"], true), f1, share(c["atp"], c["atp"] + c["afp"]), share(true - c["missed"], true), share(c["through"], true))


def test_confusion_by_kind(spark):
    rng = random.Random(2)
    rows = [(kind, same, rng.choice(["auto", "review", "reject", "insufficient"]), rng.random() < 0.7) for kind, same in (("typo", True), ("missing", True), ("distinct", False)) for _ in range(40)] + [("never", True, "reject", False)]
    found = {r["kind"]: tuple(r)[1:] for r in evaluation.resolution_rates(spark.createDataFrame(rows, "kind string, same boolean, verdict string, blocked boolean")).collect()}
    for kind in (None, "typo", "missing", "distinct", "never"):
        assert found[kind] == plain_rates([r for r in rows if kind in (None, r[0])])


def test_labelled_pairs_are_each_slip_of_each_and_pairs_of_two(spark):
    table = spark.createDataFrame([(i, f"Given{i} Mid Family{i % 3}", "1980-03-05", "0201234567", "c", "d") for i in range(30)], PEOPLE)
    rows = evaluation.labelled_pairs(table, spark.createDataFrame([(1, 4), (2, 5)], "a long, b long")).collect()
    kinds = Counter(r["kind"] for r in rows)
    assert all(kinds[k] == 30 for k in evaluation.SLIPS if k != "name_typo") and kinds["distinct_blocked"] == 2 and kinds["distinct"] == 29
    assert all((r["left_ref"] == r["right_ref"]) == r["same"] for r in rows)


# Correlation


def test_link_rates_recovery_and_purity(spark):
    rng = random.Random(6)
    planted = sorted({(rng.randrange(40), f"s{rng.randrange(5)}") for _ in range(45)} | {(90, "s0"), (91, "s0")})
    anchors = range(38)
    links = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(150)})
    tiers = {pair: rng.choice(["established", "probable", "possible"]) for pair in links}
    P, A = spark.createDataFrame(planted, "ref long, storyline string"), spark.createDataFrame([(a,) for a in anchors], "subject long")
    L = spark.createDataFrame([(*p, t) for p, t in tiers.items()], "a long, b long, tier string")
    of = {}
    for ref, story in planted:
        if ref in anchors:
            of.setdefault(ref, set()).add(story)
    truth = {p for p in itertools.combinations(sorted(of), 2) if of[p[0]] & of[p[1]]}
    picks = {"strict": set(links), "discriminative": {p for p in links if p[0] in of and p[1] in of}, "published": {p for p in links if tiers[p] != "possible"}}
    got = {r["measure"]: tuple(r)[1:] for r in evaluation.link_rates(L, P, A).collect()}
    for name, chosen in picks.items():
        hits = len(chosen & truth)
        assert got[name] == (len(chosen), hits, len(truth), pytest.approx(hits / len(chosen), abs=5.1e-5), pytest.approx(hits / len(truth), abs=5.1e-5))
    for r in evaluation.storyline_recovery(L, P, A).collect():
        members = sorted(x for x in of if r["storyline"] in of[x])
        pairs = set(itertools.combinations(members, 2))
        assert (r["subjects"], r["pairs"], r["recovered"]) == (len(members), len(pairs), len(pairs & set(links)))
    empty = {r["measure"]: tuple(r)[1:] for r in evaluation.link_rates(L.limit(0), P, A).collect()}
    assert empty["strict"] == (0, 0, len(truth), None, 0.0)
    clusters = [(c, s) for c in range(6) for s in rng.sample(range(45), 6)]
    stories = {}
    for ref, story in planted:
        stories.setdefault(ref, set()).add(story)
    want = {}
    for c in range(6):
        counts = Counter(t for cc, s in clusters if cc == c for t in stories.get(s, ()))
        labelled = sum(1 for cc, s in clusters if cc == c and s in stories)
        if labelled >= 2:
            main = min(counts, key=lambda t: (-counts[t], t))
            want[c] = (labelled, main, pytest.approx(counts[main] / labelled, abs=5.1e-5))
    assert {r["cluster"]: tuple(r)[1:] for r in evaluation.cluster_purity(spark.createDataFrame(clusters, "cluster long, subject long"), P).collect()} == want


# Chains


def test_chains_are_written_in_order_continued_and_verified(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["x", None, "p|q", "back\\slash"])) for i in range(60)]
    table = spark.createDataFrame(rows, "chain string, at long, what string").repartition(5)
    first = chains.append_entries(table.where("at < 40"), ["at"], ["at", "what"])
    log = first.unionByName(chains.append_entries(table.where("at >= 40"), ["at"], ["at", "what"], first))
    for chain in ("a", "b", None):
        last = "0" * 64
        entries = [r for r in log.orderBy("seq").collect() if r["chain"] == chain]
        assert [r["seq"] for r in entries] == list(range(1, len(entries) + 1)) and [r["at"] for r in entries] == [at for c, at, _ in rows if c == chain]
        for r in entries:
            told = "-" if r["what"] is None else "=" + r["what"].replace("\\", "\\\\").replace("|", "\\p")
            assert r["prev_hash"] == last
            last = hashlib.sha256(f"{last}|={r['at']}|{told}".encode()).hexdigest()
            assert r["entry_hash"] == last
    assert {tuple(r)[2:] for r in chains.chain_report(log, ["at", "what"]).collect()} == {(0, None, None)}
    forged = log.where("not (coalesce(chain, '') = 'b' and seq = 3)").withColumn("what", F.when((F.col("chain") == "a") & (F.col("seq") == 2), "forged").otherwise(F.col("what")))
    forged = forged.withColumn("prev_hash", F.when(F.col("chain").isNull() & (F.col("seq") == 4), F.lit("f" * 64)).otherwise(F.col("prev_hash")))
    faults = {(r["chain"], r["seq"], r["fault"]) for r in chains.chain_faults(forged, ["at", "what"]).collect()}
    assert faults == {("a", 2, "content"), ("b", 4, "gap"), (None, 4, "content"), (None, 4, "link")}
    assert {r["chain"]: (r["n_faults"], r["first_seq"], r["first_fault"]) for r in chains.chain_report(forged, ["at", "what"]).collect()} == {"a": (1, 2, "content"), "b": (1, 4, "gap"), None: (2, 4, "content")}


# Projections


def test_three_runs_of_changes_equal_a_rebuild(spark):
    rng = random.Random(9)
    schema = "id long, subject long, computed_at long, band string, score double"
    ledger, shown = [], spark.createDataFrame([], "subject long, band string, score double")
    actions = Counter()
    for run in range(3):
        new = [(100 * run + i, rng.randrange(25), 10 * run + rng.randrange(-8, 9), rng.choice(["elevated", "routine", "insufficient"]), rng.choice([1.0, 2.0, None])) for i in range(20)]
        ledger += new
        whole, fresh = spark.createDataFrame(ledger, schema), spark.createDataFrame(new, schema)
        delta = projections.changes(shown, whole, fresh, "subject", ["band", "score"], "band <> 'insufficient'")
        actions.update(r["action"] for r in delta.collect())
        once = projections.applied(shown, delta, "subject", ["band", "score"])
        twice = projections.applied(once, delta, "subject", ["band", "score"])
        want = sorted(map(tuple, projections.rebuilt(whole, "subject", ["band", "score"], "band <> 'insufficient'").collect()))
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect())) == want
        shown = spark.createDataFrame(once.collect(), shown.schema)
    assert set(actions) == {"insert", "change", "remove"}


# Feeds


def write(folder, name, text, age):
    path = folder / name
    path.write_text(text)
    os.utime(path, (1_700_000_000 + age, 1_700_000_000 + age))


def test_a_feed_stops_at_its_ceilings_and_goes_on_where_it_stopped(spark, tmp_path):
    write(tmp_path, "b.jsonl", "".join(json.dumps({"n": i}) + "\n\n" for i in range(7)), 10)
    write(tmp_path, "a.json", json.dumps([{"n": i} for i in range(100, 103)]), 20)
    write(tmp_path, "c.json", '{"n": 200}', 20)
    write(tmp_path, "d.json", '{"n": 201}\n{"n": 202}', 30)
    write(tmp_path, "empty.json", "", 31)
    write(tmp_path, "big.json", '{"n": "' + "x" * 500 + '"}', 40)
    write(tmp_path, "e.json", "not json", 50)
    write(tmp_path, "other.txt", "no", 50)
    cursor, seen, batches, refused = None, [], 0, []
    while True:
        got = feeds.fetch(spark, str(tmp_path), cursor, most_records=3, most_files=4, file_bytes=300)
        rows = [r["payload"] for r in got.records.collect()]
        refused += got.refused
        assert len(rows) <= 3
        if not rows and not got.deferred:
            break
        batches += 1
        assert batches < 20 and got.cursor != cursor
        cursor, seen = got.cursor, seen + rows
    numbers = [json.loads(x)["n"] for x in seen if x.startswith("{")]
    assert sorted(numbers) == [*range(7), 100, 101, 102, 200, 201, 202] and seen[-1] == "not json" and len(seen) == 14
    assert {os.path.basename(p) for p in refused} == {"big.json"}
    assert feeds.fetch(spark, str(tmp_path), cursor).records.isEmpty()
    by_bytes = feeds.fetch(spark, str(tmp_path), most_bytes=60)
    assert by_bytes.deferred and {os.path.basename(r["file"]) for r in by_bytes.records.collect()} == {"b.jsonl"}
    write(tmp_path, "b.jsonl", '{"n": 6}\n{"n": 7}\n', 60)
    again = feeds.fetch(spark, str(tmp_path), cursor).records.withColumn("hash", content_hash(F.col("payload")))
    landed = spark.createDataFrame([(x,) for x in seen if x.startswith("{")], "payload string").withColumn("hash", content_hash(F.col("payload")))
    assert [json.loads(r["payload"])["n"] for r in feeds.inserted(landed, again, "hash").collect()] == [7]


def test_streams_of_events_out_of_order(spark, tmp_path):
    at = lambda h: DAY + datetime.timedelta(hours=h)
    batches = [[(1, "x", at(1)), (1, "x", at(3)), (2, "y", at(2))], [(1, "x", at(2)), (2, "y", at(30)), (1, "y", at(5))], [(2, "y", at(80)), (1, "x", at(79))], [(2, "y", at(150))]]
    source, out = tmp_path / "in", tmp_path / "out"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "ref long, lane string, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))
        for p in source.glob("part-*"):
            if not p.name.startswith("part-done"):
                p.rename(source / f"part-done-{i}-{p.name}")
                os.utime(source / f"part-done-{i}-{p.name}", (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema("ref long, lane string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(source))

    def run(frame, name):
        frame.writeStream.format("parquet").option("path", str(out / name)).option("checkpointLocation", str(out / f"{name}-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(str(out / name)).collect()

    lanes = {(r["lane"], r["day"].day): r["total"] for r in run(streams.daily_lanes(events), "lanes")}
    assert lanes[("x", 1)] == 3 and lanes[("y", 1)] == 2 and lanes[("y", 2)] == 1
    bursts = {(r["ref"], r["peak_at"].hour, r["n"]) for r in run(streams.exact_bursts(events, 2, 2), "bursts")}
    assert bursts == {(1, 3, 2), (1, 2, 2), (1, 5, 2)}


def test_landing_maps_each_batch_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text('{"who": "p1", "at": "2024-01-01T00:00:00Z"}\nnot json\n{"at": "2024-01-01T00:00:00Z"}\n')
    mapping = Mapping(subject="who", time="at")
    for _ in range(2):
        streams.land(streams.read_json_lines(spark, str(source)), mapping, str(tmp_path / "good"), str(tmp_path / "dead"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 1
    dead = spark.read.parquet(str(tmp_path / "dead")).collect()
    assert len(dead) == 2 and all(r["stage"] != "ok" and r["reason"] for r in dead)
