"""Helpers that need no Spark."""

import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sleuthframe.llm import chat, html, langid, media, packing, quality, simhash, toxicity, urls

TRICKY = st.lists(st.sampled_from([*"<s>/[]\\\nbléあ😀", "</s>", "[INST]", "[/INST]", "\\b"]), max_size=20).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "a\nb", "<s>", "\\n"]), TRICKY), max_size=6))
@settings(max_examples=200, deadline=None)
def test_chat_round_trip(turns):
    formatted, spans = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for role, t in turns if role == "assistant"]
    for role, text in turns:
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
@settings(max_examples=60, deadline=None)
def test_lzw_round_trip(data, bits):
    data = bytes(b & ((1 << bits) - 1) for b in data)
    stream = media.lzw_encode(data, bits)
    assert media.lzw_decode(stream, bits, len(data)) == data
    assert media.lzw_decode_many([stream] * 3, bits, len(data)) == [data] * 3


def test_lzw_full_table_and_broken_streams():
    noise = np.random.default_rng(1).integers(0, 256, 20_000, dtype=np.uint8).tobytes()
    stream = media.lzw_encode(noise)
    assert media.lzw_decode(stream, 8, len(noise)) == noise
    assert media.lzw_decode_many([stream, stream[:500]], 8, len(noise))[0] == noise
    half = media.lzw_decode(stream[:500], 8, len(noise))
    assert noise.startswith(half) and half
    assert media.lzw_decode_many([stream[:500]], 8, len(noise)) == [half]


def test_gif_rules():
    palette = np.zeros((256, 3), np.uint8)
    palette[1], palette[2] = (255, 0, 0), (0, 255, 0)

    def picture(left, top, pixels, disposal, transparent=None, interlaced=False):
        pixels = np.array(pixels, np.uint8)
        return media.Picture(left, top, pixels.shape[1], pixels.shape[0], palette, interlaced, 5, disposal, transparent, 8, media.lzw_encode(pixels.tobytes()))

    base = picture(0, 0, [[1, 1], [1, 1]], 1)
    over = picture(0, 0, [[2, 9]], 3, transparent=9)
    erased = picture(1, 1, [[2]], 2)
    last = picture(0, 1, [[2]], 1)
    shown = media.composite(2, 2, (p := [base, over, erased, last]), media.decode_streams(p))
    red, green, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 0, 0)
    colours = [[tuple(map(int, c)) for row in f.rgba for c in row] for f in shown]
    assert colours[0] == [red] * 4
    assert colours[1] == [green, red, red, red]
    assert colours[2] == [red, red, red, green]
    assert colours[3] == [red, red, green, none]
    rows = np.arange(10, dtype=np.uint8)[:, None]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    grey = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
    mixed = media.Picture(0, 0, 1, 10, grey, True, 0, 0, None, 8, media.lzw_encode(rows[order].tobytes()))
    assert media.composite(1, 10, [mixed], media.decode_streams([mixed]))[0].rgba[:, 0, 0].tolist() == list(range(10))
    with pytest.raises(ValueError):
        media.read_gif(b"not a picture at all")


@given(st.text(max_size=2500))
@settings(max_examples=60, deadline=None)
def test_media_round_trip(text):
    data, n = media.payload(text)
    assert n == len(text.encode("utf-8", "surrogatepass")) and len(data) % 576 == 0 and len(data) > 0
    gif = media.write_gif(np.frombuffer(data, np.uint8).reshape(-1, 24, 24), media._GREYS)
    assert b"".join(f.rgba[..., 0].tobytes() for f in media.read_gif(gif)) == data
    assert media.tail_crc32(data) == zlib.crc32(data[-32:])


def test_golay_finds_every_pair_within_two_bits():
    draw = np.random.default_rng(0)
    a = draw.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    flips = np.uint64(1) << draw.integers(0, 64, (2, 3000)).astype(np.uint64)
    left, right = simhash.golay_keys(a), simhash.golay_keys(a ^ flips[0] ^ flips[1])
    shared = set(zip(*(x.tolist() for x in left), strict=True)) & set(zip(*(x.tolist() for x in right), strict=True))
    assert {r for r, _ in shared} == set(range(3000))
    assert np.bincount(left[0]).max() <= 3 * 22


def test_fingerprint_by_hand():
    import xxhash

    def plain(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    for text in (None, "", "  \n", "One", "one TWO", "É a b c d", "x " * 70_000 + "y", "a b c\x0bd e"):
        assert simhash.fingerprint(text) == plain(text)


def test_packing_plan_places_every_piece_once():
    draw = np.random.default_rng(3)
    for lengths in ([], [2048], [1] * 5000, [1500] * 40 + [548] * 37 + [3] * 11, draw.integers(1, 2049, 3000).tolist()):
        counts = {int(x): int(n) for x, n in zip(*np.unique(lengths, return_counts=True), strict=True)} if lengths else {}
        plan = packing.packing_plan(counts)
        filled: dict[int, list] = {}
        for row in plan.itertuples():
            for k in range(row.copies):
                filled.setdefault(row.sequence + k, []).append((row.offset, row.length))
        assert sum(map(len, filled.values())) == len(lengths)
        assert plan.groupby("length")["copies"].sum().to_dict() == counts
        for parts in filled.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        if lengths:
            assert len(filled) <= max(1.01 * sum(lengths) / 2048 + 1, sum(x > 1024 for x in lengths))


def test_token_ids_are_those_of_the_tokenizers_file():
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    encode = packing.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() + ["", " ", "  a", "a \n\n b", "<|endoftext|> x", "It's 12½ 日本 😀\r\n", "\x00 a"]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == want.ids


def test_text_ids_are_those_of_the_tokenizers_file_with_its_added_tokens():
    import public_tokenizers
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    encode = packing.text_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    texts += [end, f"{end} x", f"a {end}", f"  a \n {end}  \n b{end}{end}'s", f"<|{end}|>", "<|endoftext|", "<|EndOfText|>", "", " ", "日本 😀\r\n"]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text) == want.ids
    assert encode(end) == [50256]


def test_html_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header>Top</header><nav><a href=x>Home</a></nav>
    <div class="ad">Buy</div><article><header><h1>A &amp; B</h1></header><p>One <b>two</b><br>three<p>Four &lt;4&gt;<form>Name</form><aside>Side</aside>
    <div class='cookie-notice'>Cookies</div><ul><li>item</li></ul><section id=comments><p>Reader says</p></section></article><footer>&copy;</footer></body></html>"""
    assert html.main_text(page) == "A & B\n\nOne two three\n\nFour <4>\n\nitem"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == html.main_text("<p") == ""
    assert html.main_text("<article><p>a<!-- b --> c < d <") == "a c < d <"


def test_html_two_passes():
    long = "The cat sat on the mat and it was the best of all the days that we had, for it was in the sun and by the sea with you. " * 3
    page = f"<body><div><a href=1>Home</a> <a href=2>News</a></div><div><h2>Short heading</h2><p>{long}</p><p>Short one.</p><p>{long}</p></div><div><a href=3>Terms</a></div></body>"
    text = " ".join(long.split())
    assert html.main_text(page) == f"Short heading\n\n{text}\n\nShort one.\n\n{text}"


PROSE = "The cat sat on the mat and it was the best of all the days that we had, for it was in the sun and by the sea with you. "
PLAIN = "Zor bel tak mip sul rav den kol fim wex yan pod gar hul nib qua ret sop wim lan. "


def by_hand(page):
    """Both passes' outcome for a flat container of (text, share of link characters) without marks, block by block."""
    label = []
    for text, links in page:
        words = text.lower().replace(",", "").replace(".", "").split()
        density = sum(w in html.STOPS for w in words) / len(words)
        if links > 0.2 or (len(text) < 70 and links):
            label.append("bad")
        elif len(text) > 140 and density >= 0.18:
            label.append("good")
        else:
            label.append("near" if len(text) >= 70 and density >= 0.08 else "short")
    kept = []
    for i, own in enumerate(label):
        before = next((x for x in reversed(label[:i]) if x in ("good", "bad")), None)
        after = next((x for x in label[i + 1 :] if x in ("good", "bad")), None)
        sides = {before, after} - {None}
        kept.append(own == "good" or own == "near" and "good" in sides or own == "short" and sides == {"good"})
    return kept


@given(st.lists(st.sampled_from([(PROSE * 2, 0), (PROSE, 0), (PLAIN * 2, 0), ("A few words of it.", 0), (PROSE * 2, 1), ("Home", 1), (PLAIN[:60], 0)]), min_size=1, max_size=9))
@settings(max_examples=300, deadline=None)
def test_html_passes_by_hand(page):
    page = [(" ".join(t.split()), links) for t, links in page]
    markup = "".join(f"<p><a href=x>{t}</a></p>" if links else f"<p>{t}</p>" for t, links in page)
    assert html.main_text(f"<body><div>{markup}</div></body>") == "\n\n".join(t for (t, _), keep in zip(page, by_hand(page), strict=True) if keep)


def test_html_every_rule_counts(monkeypatch):
    link = f"<p><a href=1>{PROSE * 2}</a></p>"
    page = f"<body><div><p>{PROSE * 2}</p><p>{PLAIN * 3}</p><p>Short one.</p><p>{PROSE}</p></div><div>{link}<p>Short two.</p><p>{PLAIN * 3}</p></div></body>"
    whole = html.main_text(page)
    assert whole.count("\n\n") == 3 and "Short two" not in whole
    mixed = f"<body><div><p>{PROSE * 2}</p><p>Odd bit of foo.</p><p>{PLAIN}</p><p><a href=1>{PROSE * 2}</a></p></div><div><p>{PLAIN * 3}</p><p>{PROSE}</p></div></body>"
    told = [whole, html.main_text(mixed)]
    for name, value in (("MAX_LINKS", 9.0), ("STOP_HIGH", 2.0), ("STOP_LOW", 0.0), ("SHORT", 0), ("LONG", 10_000)):
        with monkeypatch.context() as m:
            m.setattr(html, name, value)
            changed = [html.main_text(page), html.main_text(mixed)]
        assert changed != told, name


def test_html_pages_of_the_tables_without_their_marks():
    import re

    import pyarrow.parquet as pq

    kept = lost = dropped = left = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        truth = [b.region == "main" for b in html.blocks(page)]
        bare = html.blocks(re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", page.replace(' class="ad"', "")))
        found = html.judged(bare)
        for want, got in zip(truth, found, strict=True):
            kept, lost, dropped, left = kept + (want and got), lost + (want and not got), dropped + (not want and not got), left + (got and not want)
    assert kept >= 0.9 * (kept + lost) and dropped >= 0.9 * (dropped + left)


def test_html_link_lists_inside_a_marked_article():
    long = "Zor bel tak mip sul rav den kol fim wex yan pod gar hul nib qua ret sop. " * 2
    text = " ".join(long.split())
    links = "".join(f"<li><a href={i}>Story {i}</a></li>" for i in range(3))
    page = f"<article><h1><a href=0>Title</a></h1><p>{long}</p><p>Short.</p><p>{long} <a href=1>one</a></p><div><h2>Elsewhere</h2><ul>{links}<li>More</li></ul><p>{f'<a href=9>{long}</a>'}</p></div></article>"
    assert html.main_text(page) == f"Title\n\n{text}\n\nShort.\n\n{text} one"
    assert html.main_text(f"<main><p>Alone</p><ul>{links}</ul></main>") == ""
    assert html.main_text("<main><h1>Title</h1><p>Alone</p></main>") == "Title\n\nAlone"


def test_boosted_trees_learn_and_flatten():
    draw = np.random.default_rng(5)
    x = draw.normal(size=(800, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    model = quality.boost(x[:600], y[:600], trees=40)
    assert ((model.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.9
    assert quality.boost(x[:0], y[:0]).predict(x[:3]).tolist() == pytest.approx([0.5] * 3)
    assert (quality.boost(x[:50], np.ones(50)).predict(x[:3]) > 0.9).all()
    assert len(quality.statistics(None)) == len(quality.statistics("a b")) == len(quality.FEATURES)


def test_toxic_grammar_tells_clauses_apart():
    matcher = toxicity.Matcher(toxicity.Lexicon(frozenset({"zorp"}), frozenset({"bla"})))
    kind = lambda text: {k for k, n in zip(toxicity.KINDS, matcher.counts(text), strict=True) if n}
    assert kind("such an idiot") == {"bare"} and kind("ZORP!") == {"bare"} and kind("blaxx") == {"bare"} and kind("bla") == set()
    assert kind("you are an idiot") == {"targeted"}
    assert kind("you are not an idiot") == {"negated"}
    assert kind('she said "you idiot"') == {"reported"}
    assert kind("i will kill you") == {"threat"} and kind("kill the process") == set() and kind("i will kill it") == set()
    assert kind("not. idiot") == {"bare"}
    slurred = toxicity.Matcher(toxicity.Lexicon(slurs=frozenset({"gra*", "dro"})))
    told = lambda text: {k: n for k, n in zip(toxicity.KINDS, slurred.counts(text), strict=True) if n}
    assert told("a grack here") == {"lone": 1} and told("a gra here") == {}
    assert told("a grack. and then a dro") == {"lone": 1, "chained": 1}
    assert told("a grack" + ". so" * 9 + ". a dro") == {"lone": 2}
    assert told("you are a dro and an idiot") == {"targeted": 2}  # the clause's heaviest arc says what its arcs count as
    assert kind(None) == kind("") == set()


def test_entries_that_come_again_within_reach():
    found = toxicity.entries("Wubble one. two wubbly. " + "x. " * 20 + "wubble")
    assert {"wubble", "wubb*", "+wubb*"} <= found and "+wubble" not in found
    assert toxicity.entries("Wubble wubble", frozenset({"+wubble", "wub*"})) == {"+wubble", "wub*"}
    assert toxicity.entries(None) == set()


def test_hash_bounds_of_any_size():
    from sleuthframe.llm.quality import hash_bound

    assert hash_bound(10, 5) == hash_bound(10, 10) == (1 << 63) - 1
    for most, n in ((1, 2), (12_000, 12_000 * 10**7), (20_000, 10**15)):
        share = (hash_bound(most, n) + (1 << 63)) / (1 << 64)
        assert share == pytest.approx(most / n, rel=1e-3) and share > 0


def test_markov_ratio_prefers_its_class():
    import pandas as pd

    def model(texts):
        rows = [(t[max(0, i - k) : i], t[i]) for t in texts for i in range(1, len(t)) for k in range(min(4, i) + 1)]
        return urls.MarkovModel(pd.DataFrame(rows, columns=["context", "next"]).groupby(["context", "next"]).size().reset_index(name="n"))

    ratio = urls.Ratio(model(["^casino-win.com$", "^win-casino.org$"]), model(["^library.org$", "^museum.org$"]))
    assert ratio.score("^casino.net$") > 0 > ratio.score("^library.com$")
    assert ratio.score("^$") == ratio.score("^$")


def test_trigrams():
    assert langid.trigrams(None).sum() == langid.trigrams("12 34").sum() == 0
    assert (langid.trigrams("Abc, ABC!") == langid.trigrams("abc abc")).all()


@pytest.mark.parametrize("page", ["<p>" + "<div>" * 40_000, "<div>x" * 40_000, "<div>" * 20_000 + "</section>" * 20_000, "<h1>a" * 40_000, "<main>x" * 40_000, "<li>x" * 40_000, "<a href=x>y" * 40_000])
def test_html_of_any_nesting_takes_time_in_proportion(page):
    """A quarter of a page takes about a quarter of its time; when every opened element looked at all around it, a sixteenth."""

    def seconds(text):
        began = time.process_time()
        html.main_text(text)
        return time.process_time() - began

    seconds(page[:1000])
    assert seconds(page) < 9 * max(seconds(page[: len(page) // 4]), 0.03)
