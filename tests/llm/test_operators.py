"""Operators on small frames with nulls, empty and long texts, ties, repeats, clashing columns and no rows, against plain Python."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sleuthframe.llm import chat, decontam, html, langid, media, packing, quality, simhash, toxicity, urls

LONG = " ".join(f"w{i % 997}" for i in range(60_000))
DOCS = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, LONG), (6, LONG + " end"), (7, "One"), (None, "the cat sat on the mat"), (7, "One")]


def frame(spark, rows, schema="doc_id long, text string"):
    """With columns whose names the operators use inside."""
    extra = {c: F.lit(1) for c in ("score", "print", "key", "mark", "size", "n", "component", "words", "part", "length")}
    return spark.createDataFrame(rows, schema).withColumns(extra)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def bits(a, b):
    return bin((a ^ b) & (1 << 64) - 1).count("1")


def plain_components(rows):
    """(id, print) pairs to component ids, by comparing all with all."""
    prints = sorted({p for _, p in rows})
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, p in enumerate(prints):
        for q in prints[i + 1 :]:
            if bits(p, q) <= 2:
                parent[root(p)] = root(q)
    least = {}
    for doc, p in rows:
        if doc is not None:
            least[root(p)] = min(doc, least.get(root(p), doc))
    return {p: least.get(root(p)) for p in prints}


def test_near_duplicates(spark):
    found = simhash.near_duplicates(frame(spark, DOCS)).collect()
    assert len(found) == len(DOCS)
    want = plain_components([(r["doc_id"], r["print"]) for r in found])
    assert all(r["component_id"] == want[r["print"]] for r in found)
    by_id = {r["doc_id"]: r for r in found}
    assert by_id[1]["component_id"] == by_id[2]["component_id"] == by_id[None]["component_id"] == 1
    assert by_id[3]["print"] == by_id[4]["print"] == 0 and by_id[5]["component_id"] == by_id[6]["component_id"] == 5
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("center", [0, 0x123456789ABCDEF0])
def test_links_of_crowded_and_thin_buckets(spark, center):
    near = {center, *(center ^ (1 << a) for a in range(40)), *(center ^ (1 << a) ^ (1 << b) for a in range(8) for b in range(a)), 0x0F0F0F0F0F0F0F0F, 0x0F0F0F0F0F0F0F0E ^ 1 << 40, 1 << 50 | 7 << 20}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in near]
    edges = simhash.near_links(spark.createDataFrame(signed, "print long")).collect()
    assert all(bits(r["a"], r["b"]) <= 2 for r in edges)
    parent = {p[0]: p[0] for p in signed}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for r in edges:
        parent[root(r["a"])] = root(r["b"])
    want = plain_components([(p, p) for (p,) in signed])
    for p in parent:
        assert {q for q in parent if root(q) == root(p)} == {q for q in want if want[q] == want[p]}


def plain_contamination(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for item, text in items:
        w = split(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, ids = split(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if owners := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    ids |= {str(x) for x in owners if x is not None}
        out.append((doc, len(w), len(hit), len(ids), sorted(ids), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


@pytest.mark.parametrize(
    "items",
    [
        [(1, ITEM), (2, "Short item"), (3, "solo"), (4, None), (5, "!!!"), (6, ITEM), (None, "two words"), (10, "ÉTÉ a b c")],
        [(1, ITEM), (2, ITEM.replace("gamma", "delta"))],
        [],
        [(1, None)],
    ],
)
def test_contamination(spark, items):
    docs = [
        (1, f"x {ITEM.upper()} y"), (2, "short, ITEM! solo? two-words"), (3, None), (4, ""), (5, ITEM[:60]), (6, " ".join([ITEM] * 3)), (6, "another text solo"), (None, ITEM), (8, "Été a b c été"),
        (8, "Été a b c été"), (9, "solo " * 300 + LONG), (10, "item short item"), (11, ITEM.rsplit(" ", 2)[0]), (12, "delta " * 40),
    ]
    found = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit("w")))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in found.collect()]
    assert sorted(got, key=repr) == plain_contamination(docs, items)
    assert decontam.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_contamination_plan_is_native(spark):
    found = decontam.contamination(frame(spark, DOCS), spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_reply_trees(spark):
    messages = [  # tree 1 branches, 2 is a chain of 70, 3 a cycle, None a tree too
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "good", 2.0), (1, 3, 1, "assistant", "bad", -1.0), (1, 4, 2, "user", None, 0.0), (1, 5, 3, "user", "late", 9.0), (1, 5, 3, "user", "late", 9.0),
        *[(2, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", None) for i in range(70)],
        (3, 1, 2, "user", "a", 0.0), (3, 2, 1, "user", "b", 0.0), (None, 1, 99, None, "</s>", 0.0), (1, None, 1, "user", "lost", 0.0),
    ]
    rows = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string, score double").withColumn("leaf", F.lit(1))
    best = {r["tree"]: r for r in chat.format_conversations(rows).collect()}
    assert [t for _, t in chat.read_turns(best[1]["formatted"])] == ["q", "bad", "late"] and best[1]["leaf"] == 5
    assert [t for _, t in chat.read_turns(best[2]["formatted"])] == [f"t{i}" for i in range(70)]
    assert chat.read_turns(best[None]["formatted"]) == [("", "</s>")] and 3 not in best
    every = chat.format_conversations(rows, best=None).where("tree = 1").collect()
    assert sorted(r["leaf"] for r in every) == [4, 5]
    assert chat.format_conversations(rows.where(F.lit(False))).count() == 0


def test_linear_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (2, 1, None, "x" * 100_000), (None, 3, "user", "n")]
    shaped = {r["tree"]: r for r in chat.format_conversations(chat.turns_as_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert chat.read_turns(shaped[1]["formatted"]) == [("system", ""), ("user", "a"), ("user", "a")]
    assert chat.read_turns(shaped[2]["formatted"]) == [("", "x" * 100_000)] and shaped[None]["n_turns"] == 1


def test_media_columns(spark):
    stored = media.store_texts(frame(spark, DOCS))
    found = media.decode_media(stored).collect()
    assert len(found) == len(DOCS)
    for r in found:
        text = next(t for d, t in DOCS if d == r["doc_id"])
        data, n = media.payload(text)
        assert bytes(r["payload"]) == data and r["n_bytes"] == n and r["n_frames"] == len(data) // 576
        assert sum(map(sum, r["histograms"])) == 3 * len(data)
    broken = spark.createDataFrame([(1, 2, bytearray(b"GIF89a")), (2, 3, None)], "doc_id long, n_bytes long, media binary")
    assert [(r["media_bytes"], r["payload"]) for r in media.decode_media(broken).orderBy("doc_id").collect()] == [(6, None), (None, None)]
    assert media.decode_media(media.store_texts(frame(spark, []))).count() == 0


def test_packing(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = packing.pack(frame(spark, DOCS), path).collect()
    encode, want = packing.rank_encoder(path), []
    for doc, text in DOCS:
        ids = [*encode(text or ""), 0]
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(doc, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(frame(spark, []), path).count() == 0


def test_packing_of_added_tokens(spark):
    import public_tokenizers

    got = packing.pack(spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.tiktoken")).first()
    assert got["length"] == 2 and got["ids_crc32"] == zlib.crc32((50256).to_bytes(4, "little") + bytes(4))


def test_html_rows(spark):
    pages = [(1, "u", "<article><p>A"), (2, None, None), (None, "u", ""), (1, "u", "<article><p>A"), (4, "u", "<p>" + "<div>" * 20_000)]
    found = html.extract(spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(1, "u", "A", 1), (2, None, "", 0), (None, "u", "", 0), (1, "u", "A", 1), (4, "u", "", 0)], key=repr)


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def plain_rule(host, path):
    fits = [(len(r), r, a) for a, r in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    good = [f"https://www.library{i}.example.org/en/{i}.html" for i in range(40)]
    bad = [f"http://casino-win{i}.example.org/fr/{i}" for i in range(30)]
    given = ["http://A.Example.com/en/7?x", "https://example.com/en/8", "x://net/de/1", "http://notnet/de/", "ftp://b.example.net/de/80#a", "a://org/es/", None, "", "no scheme", "http://", "http://h", "http://h?q/p", "http://Ü.com/en/", *good, *bad]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string").withColumn("host", F.lit(1))
    found = {r["page_id"]: r for r in urls.judge(rows, RULES).collect()}
    for i, u in enumerate(given):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule, action = plain_rule(host, path)
        assert (found[i]["host"], found[i]["path"], found[i]["rule"]) == (host, path, rule)
        assert found[i]["verdict"] in ((action,) if action else ("allow", "block"))
    verdicts = [found[i]["verdict"] for i, u in enumerate(given) if u in good]
    assert verdicts.count("allow") >= len(good) - 1
    assert [found[i]["verdict"] for i, u in enumerate(given) if u in bad].count("block") >= 25
    assert urls.judge(rows.where(F.lit(False)), RULES).count() == 0


def test_urls_are_scored_by_all_pairs_however_rare(spark):
    import pandas as pd

    stem = lambda i: hashlib.md5(str(i).encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop"))
    given = [f"https://{stem(i)}.example.org/{'käse' if i % 3 else '😀'}/{i}" for i in range(2500)] + [f"http://casino.{stem(i)[:9]}.net/{i}" for i in range(60)] * 2 + [None, "http://a"] + ["http://same.org/"] * 500
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string")
    found = urls.judge(rows, [("allow", "unused.test/")]).collect()
    spelled = {r["page_id"]: r for r in rows.select("page_id", urls.spelling(*urls.host_and_path(F.col("url"))).alias("s"), F.pmod(F.xxhash64("s"), F.lit(urls.FOLDS)).alias("fold")).collect()}
    texts = {True: [], False: []}
    for i, u in enumerate(given):
        if u and spelled[i]["fold"]:
            texts["casino" in u].append(spelled[i]["s"])

    def model(ts):
        pairs = [(t[max(0, i - k) : i], t[i]) for t in ts for i in range(1, len(t)) for k in range(min(urls.ORDER, i) + 1)]
        return urls.MarkovModel(pd.DataFrame(pairs, columns=["context", "next"]).groupby(["context", "next"]).size().reset_index(name="n"))

    ratio = urls.Ratio(model(texts[True]), model(texts[False]))
    assert sum(map(len, texts[False])) > 60_000 and len(found) == len(given)
    for r in found:
        assert r["score"] == pytest.approx(ratio.score(spelled[r["page_id"]]["s"]), abs=1e-9)


def test_urls_of_sites_without_a_seed_are_found(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = urls.judge(pages, RULES, tuple(s for s in urls.SEEDS if s not in ("casino", "win"))).where("rule is null and host <> ''").select("host", "verdict").collect()
    withheld = [r["verdict"] for r in found if "casino-win" in r["host"]]
    plain = [r["verdict"] for r in found if "-" not in r["host"]]
    assert withheld and set(withheld) == {"block"} and plain.count("block") <= 0.03 * len(plain)


def test_samples_are_bounded_by_different_values(spark):
    rows = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    kept = quality.bounded_sample(rows.where("key <> 'hot'"), "key", 1000)
    assert 800 <= kept.count() <= 1200
    assert quality.bounded_sample(rows, "id", 50_000).count() == 40_000
    assert quality.bounded_sample(rows.where("id < 0"), "id", 10).count() == 0


def labelled(spark, texts):
    docs = frame(spark, [(i, t) for i, (t, _) in enumerate(texts)])
    labels = spark.createDataFrame([(i, y, y) for i, (_, y) in enumerate(texts) if y is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality(spark):
    texts = [(f"The quick fox number {i} is on the hill and it was {i * i} of them, as we said. It is so.", 1) for i in range(150)] + [("spam!! " * (i + 5) + "$$$", 0) for i in range(90)] + [(None, None), ("", None), (LONG, None)]
    docs, labels = labelled(spark, texts)
    trees = quality.fit(quality.labelled_texts(docs, labels, "quality", F.col("doc_id") % 3 != 1))
    found = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, trees, "quality_score").collect()}
    held = [i for i in range(240) if i % 3 == 1]
    assert sum((found[i] >= 0.5) == bool(texts[i][1]) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == len(texts)
    assert quality.score(docs.where(F.lit(False)), trees).count() == 0
    nothing = quality.fit(quality.labelled_texts(docs, labels.where(F.lit(False)), "quality", F.lit(True)))
    assert quality.score(docs, nothing).count() == len(texts)


def test_toxicity(spark):
    texts = [(f"word{i} then wubblex{'abcde'[i % 5]} came {i}", 1) for i in range(40)] + [(f"word{i} then nothing came {i}", 0) for i in range(160)] + [("you are a pathetic clown", None), ("a fine day", None), (None, None), ("", None), (LONG, None)]
    docs, labels = labelled(spark, texts)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, F.col("doc_id") % 4 != 2))
    assert any("wubblex".startswith(s) for s in model.lexicon.stems)
    found = {r["doc_id"]: r["t"] >= toxicity.THRESHOLD for r in toxicity.score(docs, model, "t").collect()}
    held = [i for i in range(200) if i % 4 == 2]
    assert all(found[i] == bool(texts[i][1]) for i in held)
    assert found[200] and not any(found[i] for i in range(201, 205))
    empty = toxicity.fit(toxicity.labelled_sample(docs, labels.where(F.lit(False)), F.lit(True)))
    assert toxicity.score(docs.where("doc_id = 200"), empty, "t").first()["t"] >= toxicity.THRESHOLD


def test_slurs_count_only_in_company(spark):
    word = lambda i, k: f"grack{'abcdefgh'[(i + k) % 8]}{'xyzw'[(i * 3 + k) % 4]}"
    texts = [(f"so {word(i, 0)} went on. then {word(i, 1)} came to it, and {word(i, 2)} stayed {i}", 1) for i in range(60)]
    texts += [(f"so {word(i, 0)} went on. then nobody came to it {i}" if i % 4 == 0 else f"so he went on. then nobody came to it {i}", 0) for i in range(400)]
    docs, labels = labelled(spark, texts)
    model = toxicity.fit(toxicity.labelled_sample(docs, labels, F.col("doc_id") % 4 != 2))
    assert any(s.startswith("grack"[: len(s) - 1]) for s in model.lexicon.slurs)
    found = {r["doc_id"]: r["t"] >= toxicity.THRESHOLD for r in toxicity.score(docs, model, "t").collect()}
    assert all(found[i] == bool(y) for i, (_, y) in enumerate(texts) if i % 4 == 2)


def test_every_declared_language_is_told_apart(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [a + b for a in letters[:12] for b in letters[:10]]
    words = lambda i: " ".join("".join(random.Random(i * 100 + k).choices(letters, k=4)) for k in range(12))
    rows = [(k * len(names) + i, f"{words(i)} {words(i)}", n) for k in range(4) for i, n in enumerate(names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, declared string").withColumns({c: F.lit(None).cast("string") for c in ("suffix", "host", "domain")})
    docs = docs.withColumns({c: F.lit("own") for c in ("at", "evidence", "host_log", "language")})
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(found) == len(rows) and all(r["at"] == r["evidence"] == r["host_log"] == "own" for r in found.values())
    assert sum(found[i]["text_language"] == n for i, _, n in rows) >= 0.95 * len(rows)


def test_language(spark):
    words = {"en": "the house and the garden with flowers", "de": "das haus und der garten mit blumen", "fr": "la maison et le jardin avec des fleurs"}
    rows = [(f"{t} {i}", lang if i % 10 else "en", "host-" + lang) for lang, t in words.items() for i in range(30)] + [(None, "fr", "host-fr"), ("", None, None), ("123", "de", "new"), ("garten haus", None, "host-de")]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, declared string, host string")
    docs = docs.withColumns({"suffix": F.lit(None).cast("string"), "domain": F.lit("all"), "p": F.lit(1), "share": F.lit(2)})
    address = [F.lit(t) for t in ("mail to a.b@shop.example.de, or", "see https://x.org/a.b", "none.com", "")]
    assert tuple(spark.range(1).select(*[langid.address_suffix(t).alias(f"c{i}") for i, t in enumerate(address)]).first()) == ("de", "org", None, None)
    found = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    assert len(found) == len(rows) and found[0]["share"] == 2 and found[0]["p"] == 1
    for i, lang in enumerate([x for x in words for _ in range(30)]):
        assert found[i]["language"] == lang and found[i]["kept"]
    assert not found[90]["kept"] and not found[91]["kept"] and not found[92]["kept"] and found[93]["language"] == "de"
    nobody = langid.identify(docs.withColumn("declared", F.lit(None).cast("string")))
    assert [r["language"] for r in nobody.collect()] == [None] * len(rows)
    assert langid.identify(docs.where(F.lit(False))).count() == 0
    url = F.lit("https://a.b.example.de:80/x")
    assert tuple(spark.range(1).select(*langid.host_domain_suffix(url), langid.declared_language(F.lit("<HTML class=a lang='DE-at'>"))).first()) == ("a.b.example.de", "example.de", "de", "de")


def test_digest_of_turns(spark, small):
    from sleuthframe.llm.queries_digest import PLANTED, op1_chat_format

    found = {r["conv_id"]: r for r in op1_chat_format(spark, small).collect()}
    told = f"user\n{PLANTED}\nassistant\n{PLANTED}\n"
    assert found[-1]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest() and found[-1]["loss_chars"] == len(PLANTED)


def test_contamination_in_blocks_of_a_large_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 256)  # four rows a block, windows beyond a broadcast
    items = [(1, ITEM), (2, "solo")]
    docs = [(1, f"x {ITEM.upper()} y solo"), (2, "word " * 300 + ITEM), (3, None), (4, ITEM[:60])]
    found = decontam.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["item_ids"], r["contaminated"]) for r in found.collect()]
    assert sorted(got, key=repr) == plain_contamination(docs, items)


def test_windows_over_every_border_of_a_run(spark):
    words = ITEM.split()[:13]
    docs = [(k, " ".join(["no"] * k + words + ["no"] * 30)) for k in range(240, 262)]
    found = decontam.contamination(frame(spark, docs), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string"))
    assert {(r["doc_id"], r["n_hit"]) for r in found.collect()} == {(k, 13) for k, _ in docs}


def test_reply_trees_dealt_by_node(spark, monkeypatch):
    messages = [(1, 1, None, "user", "q"), (1, 2, 1, "assistant", "b"), (1, 2, 1, "assistant", "a"), (None, 1, None, "user", "x"), (None, 2, 1, None, None), (-1, 1, None, "user", "y")]
    rows = spark.createDataFrame(messages, "tree long, node long, parent long, role string, text string").withColumn("score", F.lit(0.0))
    shaped = lambda: sorted(((r["tree"], r["leaf"], chat.read_turns(r["formatted"])) for r in chat.format_conversations(rows).collect()), key=repr)
    together = shaped()
    assert together == [(-1, 1, [("user", "y")]), (1, 2, [("user", "q"), ("assistant", "a")]), (None, 2, [("user", "x"), ("", "")])]
    monkeypatch.setattr(chat, "TOGETHER", 0)
    assert shaped() == together


def test_links_of_linear_conversations(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", None), (None, 3, "user", "n")], "conv_id long, turn long, role string, text string")
    columns = ["tree", "node", "parent", "score"]
    assert sorted(map(repr, chat.turn_links(rows).select(columns).collect())) == sorted(map(repr, chat.turns_as_trees(rows).select(columns).collect()))
