"""Benchmark decontamination: a prefix-filtered set join with exact verification, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.plans.lineage import materialise

#: Words of a window, words of a shingle, and hit words that make a document contaminated: 1 / SHARE of its words.
WINDOW, SHINGLE, SHARE = 13, 3, 20
#: A table made of the benchmark alone is broadcast up to so many bytes, which are counted first; beyond, it is shuffled or taken in blocks.
BROADCAST_BYTES = 32 << 20
#: Bytes of a broadcast row of numbers, and words of a text that are one row.
ROW_BYTES, BLOCK = 64, 256

# Fixed value: what stands between words, after lower-casing A-Z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    text = F.coalesce(text, F.lit(""))
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(text))
    return F.array_remove(F.split(low, BETWEEN), "")


def small(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` marked for broadcast if its texts, with 64 bytes a row, are within BROADCAST_BYTES."""
    size = sum((F.octet_length(c) for c in texts), F.lit(64))
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def in_blocks(df: DataFrame, key: str) -> list[DataFrame]:
    """``df``, which has numbers alone, as one or more broadcast tables of at most about BROADCAST_BYTES each, by ``key``."""
    n = max(1, -(-df.count() * ROW_BYTES // BROADCAST_BYTES))
    return [F.broadcast(df.where(F.pmod(key, F.lit(n)) == i)) for i in range(n)]


def shingle_key(at: Column, size: int) -> Column:
    """A number for the ``size`` words from a place (from 0) of ``words``; equal numbers of different shingles only make more candidates."""
    return F.xxhash64(F.lit(size), *[F.get("words", at + k) for k in range(size)])


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``item_id, win, length, size, keys``: every window of every item that has words.

    ``win`` is the window's words joined by spaces, ``keys`` are the numbers of its
    runs of ``size`` words (SHINGLE, or all of a shorter window), in order.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.size("words")).where("n > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.col("n") - WINDOW + 1, F.lit(1)))
    cut = items.select("item_id", "words", F.explode(starts).alias("at")).select("item_id", F.slice("words", F.col("at"), F.lit(WINDOW)).alias("words"))
    cut = cut.withColumn("length", F.size("words")).withColumn("size", F.least("length", F.lit(SHINGLE)))
    by_size = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE + 1):
        keys = F.transform(F.sequence(F.lit(0), F.col("length") - size), lambda i: shingle_key(i, size))  # noqa: B023 (called at once)
        by_size = F.when(F.col("size") == size, keys).otherwise(by_size)
    return cut.select("item_id", F.array_join("words", " ").alias("win"), "length", "size", by_size.alias("keys"))


def document_shingles(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per document, place and shingle size: ``doc_id, mark, words, at, from, key``.

    ``words`` is a run of some 280 words around the place, ``at`` the place in the
    run and ``from`` the run's place in the document: so a row is small in the
    longest text too, and any window over the place lies within the run.
    """
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    lead = lambda b: F.least(b, F.lit(WINDOW))
    run = lambda b: F.struct((b - lead(b)).alias("from"), lead(b).alias("lead"), F.slice("words", b - lead(b) + 1, lead(b) + BLOCK + WINDOW).alias("words"))
    runs = texts.select("doc_id", "mark", F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - 1, F.lit(BLOCK)), run)).alias("r")).select("doc_id", "mark", "r.*")
    own = F.sequence(F.col("lead"), F.least(F.col("lead") + BLOCK, F.size("words")) - 1)
    at = runs.select("doc_id", "mark", "words", "from", F.explode(own).alias("at"))
    key = lambda size: F.when(F.col("at") + size <= F.size("words"), shingle_key(F.col("at"), size))
    if len(sizes) == 1:
        return at.withColumn("key", key(sizes[0])).where("key is not null")
    return at.withColumn("key", F.explode(F.array(*[key(size) for size in sizes]))).where("key is not null")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """How much of each document is made of benchmark windows.

    ``docs`` needs ``doc_id`` and ``text``, ``benchmark`` needs ``item_id`` and
    ``text``; other columns are ignored. Returns a row per row of ``docs``:
    ``doc_id, mark`` (a hash of the text, which tells repeated ids apart),
    ``n_words, n_hit, n_items, item_ids`` (sorted strings) and ``contaminated``.
    Null and empty texts have no words; null item ids aren't counted; an empty
    benchmark contaminates nothing.

    A first pass over the texts counts the benchmark's shingles in all documents.
    As a window must be there whole, one shingle is its prefix: the rarest one; a
    window with a shingle that no document has is left out. The second pass joins
    the documents' shingles to the prefixes alone. Where one stands, the window
    would begin a known number of words before and be of a known length; if that
    lies within the document, its words are compared with the windows', which is
    exact. Prefixes that exceed a broadcast are joined in several blocks, one pass
    each, so texts are never shuffled.
    """
    windows = materialise(benchmark_windows(benchmark))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect()) or [SHINGLE]  # SHINGLE rows at most
    known = materialise(windows.select(F.explode("keys").alias("key")).distinct())
    shingles = document_shingles(docs, sizes)
    counted = [shingles.select("key").join(block, "key").groupBy("key").agg(F.count(F.lit(1)).alias("n")) for block in in_blocks(known, "key")]
    counts = counted[0]
    for more in counted[1:]:
        counts = counts.unionByName(more)

    parts = windows.dropDuplicates(["win"]).select("win", "length", F.size("keys").alias("whole"), F.posexplode("keys").alias("before", "key"))
    ranked = parts.join(counts, "key").groupBy("win").agg(F.min(F.struct("n", "key", "before")).alias("rarest"), F.count(F.lit(1)).alias("there"), F.first("length").alias("length"), F.first("whole").alias("whole"))
    ranked = materialise(ranked.where("there = whole").select("win", "length", "rarest.key", "rarest.before"))

    begin = F.col("at") - F.col("before")
    within = (begin >= 0) & (begin + F.col("length") <= F.size("words"))
    sought, wanted = small(ranked.select("win"), "win"), None
    for block in in_blocks(materialise(ranked.select("key", "before", "length").distinct()), "key"):
        near = shingles.join(block, "key").where(within)
        near = near.select("doc_id", "mark", (F.col("from") + begin).alias("start"), "length", F.array_join(F.slice("words", begin + 1, F.col("length")), " ").alias("win"))
        wanted = near if wanted is None else wanted.unionByName(near)
    hits = materialise(wanted.join(sought, "win"))

    owners = windows.where("item_id is not null").select("win", F.col("item_id").cast("string").alias("item")).distinct()
    spans = F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("stop"))))
    covered = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")),
        lambda a: a["n"],
    )
    hit = hits.join(small(owners, "win", "item"), "win", "left").groupBy("doc_id", "mark").agg(covered.alias("n_hit"), F.sort_array(F.collect_set("item")).alias("item_ids")).alias("h")
    base = docs.select("doc_id", F.xxhash64("text").alias("mark"), F.size(words_of(F.col("text"))).alias("n_words")).alias("d")
    joined = base.join(hit, F.col("d.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("d.mark") == F.col("h.mark")), "left")
    n_hit, item_ids = F.coalesce("h.n_hit", F.lit(0)), F.coalesce("h.item_ids", F.array().cast("array<string>"))
    return joined.select(
        "d.doc_id", "d.mark", F.col("d.n_words").cast("long").alias("n_words"), n_hit.cast("long").alias("n_hit"), F.size(item_ids).cast("long").alias("n_items"),
        item_ids.alias("item_ids"), ((n_hit > 0) & (SHARE * n_hit >= F.col("d.n_words"))).alias("contaminated"),
    )
