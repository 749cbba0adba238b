"""Resampling, exact dedup and collocations (11 to 13) on small frames with nulls, empty and long texts, ties, repeats, clashing columns and no rows, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from sleuthframe.llm import collocations, exact, resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{i % 997}" for i in range(60_000))


def frame(spark, rows, schema):
    """With columns whose names the operators use inside."""
    extra = {c: F.lit(1) for c in ("score", "key", "n", "words", "rank", "weight", "body", "owner", "slot", "id", "ids", "items", "a", "word", "bucket")}
    return spark.createDataFrame(rows, schema).withColumns(extra)


# Resampling


def plain_features(text, longest):
    words = WORD.findall((text or "").translate(LOW))
    return words, [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, longest, buckets, percent, least, seed):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(crc, plain_features(text, longest)[1]))
    for text in target:
        t.update(map(crc, plain_features(text, longest)[1]))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for doc, text in docs:
        words, features = plain_features(text, longest)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in map(crc, features)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words), len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    held = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    ranks = {id(r): k + 1 for k, r in enumerate(held[: percent * len(held) // 100])}
    return sorted(([*r, ranks.get(id(r))] for r in rows), key=repr)


def sample_texts(n, seed=5):
    rng = random.Random(seed)
    return [" ".join(rng.choice(["Tax", "law", "été", "B2B", "x", "the", "of", "Straße"]) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_is_what_plain_python_draws(spark, longest):
    docs = [(i, t) for i, t in enumerate(sample_texts(200))] + [(None, "a " * 30), (-5, None), (-6, ""), (7, "tax " * 25), (8, LONG)]
    target = ["tax law tax", None, "The of"]
    found = resampling.resample(frame(spark, docs, "doc_id long, text string").repartition(3), frame(spark, [(t,) for t in target], "text string"), longest, 50, 30, 20, 11)
    assert found.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted((list(r) for r in found.collect()), key=repr) == plain_resample(docs, target, longest, 50, 30, 20, 11)


def test_resampling_blocks_and_slices_of_any_size_give_the_same(spark, monkeypatch):
    docs = [(i, t) for i, t in enumerate([*sample_texts(60), LONG])]
    whole = [resampling.feature_buckets(t.encode(), 3, 97) for _, t in docs]
    monkeypatch.setattr(resampling, "SLICE", 7)
    for (n, at, counts), (_, text) in zip(whole, docs, strict=True):
        again = resampling.feature_buckets(text.encode(), 3, 97)
        assert again[0] == n and (again[1] == at).all() and (again[2] == counts).all()


def test_resampling_persists_csr_blocks(spark):
    matrix = resampling.count_matrix(frame(spark, [(1, "a b a"), (2, None), (3, "c")], "doc_id long, text string").coalesce(1), 1, 10)
    (row,) = matrix.collect()
    assert row["ids"] == [1, 2, 3] and row["words"] == [3, 0, 1] and row["indptr"] == [0, 2, 2, 3] and sorted(row["data"]) == [1, 1, 2]
    assert resampling.column_sums(matrix, 10).sum() == 4


def test_resampling_files_have_few_blocks(spark, monkeypatch):
    """What a task unpacks at once is bounded, whatever the size of what it reads."""
    monkeypatch.setattr(resampling, "BLOCK_ROWS", 1)
    matrix = resampling.count_matrix(frame(spark, [(i, f"a b w{i}") for i in range(50)], "doc_id long, text string").coalesce(1))
    sizes = [pq.ParquetFile(f.removeprefix("file:").replace("///", "/")).metadata.num_rows for f in matrix.inputFiles()]
    assert sum(sizes) == 50 and max(sizes) <= resampling.FILE_BLOCKS
    assert resampling.column_sums(matrix).sum() == 150


def test_resampling_of_nothing_and_of_repeated_rows(spark):
    none = frame(spark, [], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    twice = frame(spark, [(1, "a " * 30)] * 4, "doc_id long, text string")
    assert sorted(r["rank"] or 0 for r in resampling.resample(twice, none, percent=50).collect()) == [0, 0, 1, 2]


# Exact dedup


def plain_groups(rows):
    bodies = {}
    for doc, text in rows:
        bodies.setdefault((text or "").translate(LOW), []).append(doc)
    out = []
    for doc, text in rows:
        body = (text or "").translate(LOW)
        keep = max((d for d in bodies[body] if d is not None), default=None)
        out.append((doc, keep, len(bodies[body]), doc == keep, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(out, key=repr)


GROUPS = [(1, "A b"), (2, "a B"), (3, "a b "), (4, None), (5, ""), (6, "É"), (7, "é"), (None, "a b"), (8, LONG), (9, LONG.upper()), (9, LONG), (None, "alone"), (10, "x\u0000y"), (11, "İ"), (12, "i̇")]
GROUPS += [(100 + i, f"Text {i % 37} of {i % 11}") for i in range(300)] + [(1000 + i, "HOT text") for i in range(400)]


@pytest.mark.parametrize("capacity", [None, 300])
def test_exact_groups(spark, capacity):
    found = exact.exact_groups(frame(spark, GROUPS, "doc_id long, text string").repartition(5), capacity=capacity)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_groups(GROUPS)


def test_exact_groups_tell_texts_with_one_key_apart(spark):
    weak = lambda body: F.shiftleft((F.length(body) % 5).cast("long"), 60)
    found = exact.exact_groups(frame(spark, GROUPS, "doc_id long, text string"), weak, 2000)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_groups(GROUPS)


def test_exact_groups_of_nothing(spark):
    assert exact.exact_groups(frame(spark, [], "doc_id long, text string")).count() == 0


def plain_directory(keys, capacity, deepest):
    """Buckets by splitting one after the other."""
    done, left = [], [(0, 0, keys)]
    while left:
        depth, slot, own = left.pop()
        if sum(b for _, b in own) > capacity and len(own) > 1 and depth < deepest:
            for bit in (0, 1):
                left.append((depth + 1, slot * 2 + bit, [(k, b) for k, b in own if (k % 2**64) >> (63 - depth) & 1 == bit]))
        else:
            done.append((depth, slot, len(own), sum(b for _, b in own)))
    return sorted(done)


def test_directory_doubles_as_one_split_after_the_other(spark):
    rng = random.Random(3)
    alike = [(12345 << 40) + i for i in range(3)]  # alike in more bits than even keys need
    keys = [(rng.randrange(-(2**63), 2**63), rng.randrange(1, 90)) for _ in range(400)] + [(k, 300) for k in alike] + [(5, 10_000)]
    table = spark.createDataFrame(keys, "key long, bytes long")
    found = exact.directory(table, 500)
    want = plain_directory(keys, 500, exact.DEEPEST)
    assert sorted((r["depth"], r["slot"], r["keys"], r["bytes"]) for r in found.collect()) == want
    assert max(d for d, *_ in want) > 20 and sum(2.0**-d for d, *_ in want) == 1.0
    shared = exact.owners(found, 6).collect()
    starts = {(r["slot"] << (62 - r["depth"])): r["owner"] for r in shared if r["keys"]}
    assert [starts[k] for k in sorted(starts)] == sorted(starts.values()) and max(starts.values()) == 5


def test_index_is_in_files_by_bucket(spark, tmp_path):
    entries, buckets = exact.build_index(spark.createDataFrame(GROUPS, "doc_id long, text string"), str(tmp_path / "x"), capacity=2000)
    assert entries.count() == len({(t or "").translate(LOW) for _, t in GROUPS})
    assert entries.select("bucket").distinct().count() == buckets.where("keys > 0").count() > 8
    assert all(r["bucket"].rstrip("-") == f"{r['key'] % 2**64:064b}"[: len(r["bucket"]) - 1] for r in entries.select("bucket", "key").collect())


# Collocations


def plain_collocations(rows, longest, least, covered, most):
    count, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count.update((lang, tuple(words[i : i + n])) for i in range(len(words) - n + 1))
    found = {p: n for p, n in count.items() if n >= least}
    longer = Counter()
    for (lang, p), n in found.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                longer[lang, p[i : i + size]] = max(longer[lang, p[i : i + size]], n)
    out = []
    for lang in total:
        rated = []
        for (of, p), a in found.items():
            if of == lang and len(p) > 1 and not (longer[of, p] and 100 * longer[of, p] >= covered * a):
                score, _, left, right = min((2_000_000 * a // (found[lang, p[:k]] + found[lang, p[k:]]), k, found[lang, p[:k]], found[lang, p[k:]]) for k in range(1, len(p)))
                rated.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k + 1, p.decode(), -a, left, right, total[lang], -s) for k, (s, a, p, left, right) in enumerate(sorted(rated)[:most])]
    return sorted(out)


def prose(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Été", "ß", "-", "A", "É"]
    phrases = ["united States of america", "New york", "it is", "the The the the", "once upon a time"]
    text = lambda: "".join(rng.choice([rng.choice(words), rng.choice(phrases), words[min(29, int(rng.expovariate(0.3)))]]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", " \r\n"]) for _ in range(rng.randrange(80)))
    return [(text(), rng.choice(["en", "en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize(("longest", "least", "most"), [(4, 5, 2000), (4, 2, 7), (3, 4, 50), (5, 3, 100), (2, 5, 30)])
def test_collocations(spark, longest, least, most):
    rows = [*prose(150, longest), (None, "en"), ("", None), (LONG, "de"), ("a\u0000b " * 9, "x"), ("same line same line", "en"), ("same line same line", "en")]
    found = collocations.collocations(frame(spark, rows, "text string, lang string").repartition(4), longest, least, 80, most)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, longest, least, 80, most)


def test_collocations_with_rare_words_joined_and_hot_pivots_dealt_out(spark, monkeypatch):
    """All but six words' numbers are joined, texts are read in short runs, and pivots are salted."""
    rows = prose(120, 9)
    monkeypatch.setattr(collocations, "PIVOT_ROWS", 20)
    monkeypatch.setattr(collocations, "COMMON", 3)
    monkeypatch.setattr(collocations, "ROW_BYTES", 50)
    found = collocations.collocations(frame(spark, rows, "text string, lang string"), 4, 3, 80, 500, held_bytes=6 * 128)
    assert sorted(tuple(r) for r in found.collect()) == plain_collocations(rows, 4, 3, 80, 500)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(frame(spark, [], "text string, lang string")).count() == 0
    assert collocations.collocations(frame(spark, [("one two", "en")], "text string, lang string")).count() == 0


def test_fragments_own_each_run_once():
    """Every run of words is in exactly one fragment, over the pivot, as its first rarest word."""
    rng = random.Random(1)
    ids = [rng.choice([1, 1, 2, 3, 4, 5, collocations.GAP]) for _ in range(300)]
    padded = [collocations.GAP] * 4 + ids + [collocations.GAP] * 4
    pivot, _, n, *sides = collocations.fragment_rows(np.array(padded, np.int64), 4, np.zeros(1, np.int64))
    got = Counter()
    for row in range(len(pivot)):
        left, right = [int(s[row]) >> 32 for s in sides], [int(s[row]) & 0xFFFFFFFF for s in sides]
        for i in range(4):
            for j in range(4 - i):
                if i + j and all(left[:i]) and all(right[:j]):
                    got[(*left[:i][::-1], int(pivot[row]), *right[:j])] += int(n[row])
    want = Counter(tuple(ids[i : i + k]) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if collocations.GAP not in ids[i : i + k])
    assert got == want


def test_phrases_of_fragments_cross_the_shuffle_in_parts(spark):
    """A window's fragments are a row a part, not one a fragment, and each pivot's are in one part."""
    docs = frame(spark, [(f"{w} {v} {w} {v}", "en") for w in ("a", "b", "c") for v in ("d", "e", "f")], "text string, lang string").coalesce(1)
    texts = docs.select("lang", F.col("text").cast("binary").alias("raw"), F.lit(None).cast("map<binary,long>").alias("rare"))
    rows = collocations.fragments(texts, {"en": {w.encode(): i + 1 for i, w in enumerate("abcdef")}}, np.zeros(1, np.int64), 4, 3).collect()
    parts = [np.frombuffer(r["rows"], np.int64).reshape(5, -1) for r in rows]
    assert len({r["part"] for r in rows}) == len(rows) <= 3
    assert sum(len(set(p[0])) for p in parts) == len({x for p in parts for x in p[0].tolist()})
    found = Counter()
    for p in parts:
        (g0, g1), _, n = collocations.phrases_over_pivot(p, 4)
        found.update(dict(zip(zip(g0.tolist(), g1.tolist(), strict=True), n.tolist(), strict=True)))
    assert found[1 << 32 | 4, 0] == 2 and found[4 << 32 | 1, 0] == 1 and found[1 << 32 | 4, 1 << 32 | 4] == 1 and sum(found.values()) == 9 * 6
