"""Packing documents into sequences: a linear grouping scheme over a length histogram."""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.plans.lineage import materialise

#: Tokens of a sequence and the id that ends a document.
CAPACITY, END_ID = 2048, 0
#: Lengths of at least this many tokens are large: they go through grouping and configurations.
LARGE = 256
#: Equal-cardinality groups that large lengths are rounded up within.
GROUPS = 1024
# Fixed value: the byte-level tokenizer's splitting pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _encoding(path: str, added: dict[str, int]):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added)


def rank_encoder(path: str):
    """A function from a text to its ids, by a file of byte-level BPE ranks (``base64 rank`` lines).

    The ids are those of the ``tokenizers`` file of the same vocabulary with
    special tokens read as ordinary text (a test holds them against each other);
    merging by ranks takes a third of the CPU time.
    """
    return _encoding(path, {}).encode_ordinary


def text_encoder(path: str):
    """A function from a text to the ids that the ``tokenizers`` file beside the ranks file gives it without further settings.

    The file (``.json``) names added tokens; where one stands in a text it is its
    own id, and what is between them is encoded by ranks.
    """
    added = json.loads(Path(path).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens that take more than their own characters aren't supported")
    encoding = _encoding(path, {t["content"]: t["id"] for t in added})
    return lambda text: encoding.encode(text, allowed_special="all")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and then END_ID; a null text is empty. Longer ones are
    cut so that all pieces but the first have ``capacity`` ids.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = text_encoder(tokenizer)
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
                ids = np.array([*(encode(text) if isinstance(text, str) else ()), END_ID], "<u4")
                total, start, piece = len(ids), 0, 0
                stop = total % capacity or capacity
                while start < total:
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    start, stop, piece = stop, stop + capacity, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECES)


@dataclass
class Run:
    """``copies`` sequences that hold the same lengths: (length, rank of the first copy's piece)."""

    copies: int
    items: list[tuple[int, int]] = field(default_factory=list)
    free: int = CAPACITY


def equal_groups(counts: dict[int, int], groups: int) -> list[list[int]]:
    """Lengths in falling order, in at most ``groups`` classes of about as many pieces each."""
    total, made, held = sum(counts.values()), [], 0
    for length in sorted(counts, reverse=True):
        if not made or held * groups >= total * len(made):
            made.append([])
        made[-1].append(length)
        held += counts[length]
    return made


def best_filling(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """How many of each size fill a sequence best, one of ``first`` being in it.

    A knapsack over the few sizes: of all fillings that the stock allows, one
    with the fewest unused tokens; among those, one with large sizes.
    """
    room = capacity - sizes[first]
    reach = np.zeros(room + 1, bool)
    reach[0] = True
    came = np.full(room + 1, -1, np.int64)
    for k in range(first, len(sizes)):
        stock = left[k] - (k == first)
        for _ in range(min(stock, room // sizes[k])):
            fresh = np.zeros_like(reach)
            fresh[sizes[k] :] = reach[: room + 1 - sizes[k]]
            fresh &= ~reach
            if not fresh.any():
                break
            came[fresh] = k
            reach |= fresh
        if reach[room]:
            break
    use, at = [0] * len(sizes), int(np.flatnonzero(reach)[-1])
    use[first] = 1
    while at:
        use[came[at]] += 1
        at -= sizes[came[at]]
    return use


def plan_large(counts: dict[int, int], capacity: int, groups: int) -> list[Run]:
    """Sequences of large lengths.

    Groups are rounded up to their greatest length, the few rounded sizes are
    arranged in configurations used as often as the stock allows, and then the
    real lengths, in falling order within each group, take the places. Places
    whose real lengths agree over a stretch of copies make one run.
    """
    classes = equal_groups(counts, groups)
    sizes = [c[0] for c in classes]
    left = [sum(counts[x] for x in c) for c in classes]
    stock = [[[length, 0, counts[length]] for length in c] for c in classes]
    runs = []
    for first in range(len(sizes)):
        while left[first]:
            use = best_filling(sizes, left, first, capacity)
            times = min(left[k] // n for k, n in enumerate(use) if n)
            for k, n in enumerate(use):
                left[k] -= n * times
            slots = [_take(stock[k], times) for k, n in enumerate(use) for _ in range(n)]
            edges = sorted({0, times} | {at for slot in slots for at, _, _ in slot})
            for a, b in zip(edges, edges[1:], strict=False):
                run = Run(b - a, free=capacity)
                for slot in slots:
                    at, length, rank = next(x for x in reversed(slot) if x[0] <= a)
                    run.items.append((length, rank + a - at))
                    run.free -= length
                runs.append(run)
    return runs


def _take(stock: list[list[int]], times: int) -> list[tuple[int, int, int]]:
    """``times`` pieces off a group's stock: (first copy, length, its rank) for each stretch of one length."""
    taken, at = [], 0
    while at < times:
        length, rank, n = stock[0]
        now = min(n, times - at)
        taken.append((at, length, rank))
        at += now
        if now == n:
            stock.pop(0)
        else:
            stock[0][1:] = [rank + now, n - now]
    return taken


def add_small(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, falling: each small length goes where the fewest tokens stay free.

    Runs of like sequences are filled at once; a run that is only partly needed
    is split. Ranks of a length are handed out in order.
    """
    by_free: dict[int, list[Run]] = {}
    frees: list[int] = []

    def put(run: Run) -> None:
        if run.free not in by_free:
            by_free[run.free] = []
            insort(frees, run.free)
        by_free[run.free].append(run)

    for run in runs:
        put(run)
    for length in sorted(counts, reverse=True):
        rank, n = 0, counts[length]
        while n:
            k = bisect_left(frees, length)
            if k == len(frees):
                each = capacity // length
                if n >= each:
                    run = Run(n // each, free=capacity)
                    fit = each
                else:
                    run, fit = Run(1, free=capacity), n
            else:
                run = by_free[frees[k]].pop()
                if not by_free[frees[k]]:
                    del by_free[frees.pop(k)]
                fit = min(run.free // length, max(1, n // run.copies))
                if n < run.copies:
                    put(Run(run.copies - n, [(x, r + n) for x, r in run.items], run.free))
                    run.copies = n
            for _ in range(fit):
                run.items.append((length, rank))
                run.free -= length
                rank += run.copies
                n -= run.copies
            put(run)
    return [run for free in frees for run in by_free[free]]


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> pd.DataFrame:
    """Where the pieces of each length go: ``length, rank, copies, sequence, offset``.

    Pieces of ``length`` with ranks from ``rank`` on go to as many sequences as
    ``copies``, from ``sequence`` on, each at ``offset``. Both the input and the
    plan depend on the number of different lengths (``capacity`` at most), not on
    the number of documents.
    """
    runs = plan_large({x: n for x, n in counts.items() if x >= large}, capacity, groups)
    runs = add_small(runs, {x: n for x, n in counts.items() if x < large}, capacity)
    rows, sequence = [], 0
    for run in runs:
        offset = 0
        for length, rank in run.items:
            rows.append((length, rank, run.copies, sequence, offset))
            offset += length
        sequence += run.copies
    return pd.DataFrame(rows, columns=["length", "rank", "copies", "sequence", "offset"]).sort_values(["length", "rank"], ignore_index=True)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, large: int = LARGE, groups: int = GROUPS) -> DataFrame:
    """Pack all of ``docs`` into sequences of at most ``capacity`` tokens.

    ``docs`` needs ``doc_id`` and ``text``. Returns a row per piece with
    ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``; see
    ``token_pieces``. Null and empty texts are one END_ID each, repeated rows are
    packed as often as they are there, an empty table gives an empty table.

    The driver gets the histogram of lengths (``capacity`` numbers at most) and
    plans runs of like sequences. Each piece finds its place by its rank among
    the pieces of its length. Ranks are counted in parts by a hash of the piece,
    so a length that many documents share is spread over many tasks.
    """
    spark = docs.sparkSession
    pieces = materialise(token_pieces(docs, tokenizer, capacity))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = materialise(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(packing_plan(counts, capacity, large, groups))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).select("length", "part", "base")
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(order)).join(bases, ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth") - 1).drop("part", "base", "nth")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = plan.value
        span = np.int64(1) << 48
        keys = table["length"].to_numpy(np.int64) * span + table["rank"].to_numpy(np.int64)
        first, sequence, offset = (table[c].to_numpy(np.int64) for c in ("rank", "sequence", "offset"))
        for frame in frames:
            at = np.searchsorted(keys, frame["length"].to_numpy(np.int64) * span + frame["rank"].to_numpy(np.int64), "right") - 1
            yield frame[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(doc_id=frame["doc_id"].astype("Int64"), sequence_id=sequence[at] + frame["rank"].to_numpy() - first[at], offset=offset[at])

    return ranked.mapInPandas(place, PIECES + ", sequence_id long, offset long")
