"""Near-duplicates: SimHash fingerprints joined by Golay-code keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.components import connected_components
from sleuthframe.plans.lineage import materialise

#: Shingle length, hash seed and differing bits of the contract.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Buckets of more different fingerprints than this are split by neighbouring words instead of joined in pairs.
PAIR_BUCKET = 16
#: The 64 bits in three segments: (shift, bits).
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Shingles hashed at once, which bounds a task's memory for long texts.
BLOCK = 1 << 16

# Fixed value: generator polynomial of the perfect binary Golay code (23, 12).
GOLAY = 0b101011100011


def _remainders(words: np.ndarray) -> np.ndarray:
    """Each 23-bit word modulo the generator polynomial: its syndrome of 11 bits."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where((rest >> bit) & 1, GOLAY << (bit - 11), 0)
    return rest


def _correctors() -> np.ndarray:
    """By syndrome, the only error of at most three bits that has it."""
    table = np.zeros(1 << 11, np.int64)
    ones = 1 << np.arange(23)
    errors = [np.zeros(1, np.int64), ones]
    i, j = np.triu_indices(23, 1)
    errors.append(ones[i] | ones[j])
    three = np.array([ones[a] | ones[b] | ones[c] for a in range(23) for b in range(a + 1, 23) for c in range(b + 1, 23)])
    for e in [*errors, three]:
        table[_remainders(e)] = e
    return table


_CORRECT = _correctors()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the Golay codeword nearest to each 23-bit word."""
    return (words ^ _CORRECT[_remainders(words)]) >> 11


def nearby_indices(words: np.ndarray, bits: int) -> np.ndarray:
    """Row by row, the codeword indices of a word and of its one-bit neighbours.

    Two words that differ in at most two bits have a neighbour in common, and so
    an index. Repeats within a row are -1.
    """
    flips = np.concatenate([[0], 1 << np.arange(bits)])
    found = np.sort(codeword_index((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), -1), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): two fingerprints within two bits share a key.

    Of three segments one has no error (two errors, three segments); it goes into
    the key as it is. The segment after it has at most two errors, so the two
    fingerprints have one of its codeword indices in common.
    """
    rows, keys = [], []
    unsigned = prints.astype(np.uint64)
    parts = [((unsigned >> np.uint64(s)) & np.uint64((1 << b) - 1)).astype(np.int64) for s, b in SEGMENTS]
    for i, part in enumerate(parts):
        j = (i + 1) % len(parts)
        near = nearby_indices(parts[j], SEGMENTS[j][1])
        row, at = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((i << 36) | (part[row] << 12) | near[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of one text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        part = words[at : at + min(BLOCK, n - at) + SHINGLE - 1]
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        line = b" ".join(part)
        starts = [0, *ends[:-1].tolist()]
        stops = (ends - 1).tolist()[min(SHINGLE, len(part)) - 1 :]
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        prints = np.array([fingerprint(t if isinstance(t, str) else None) for t in frame["text"]], np.uint64)
        yield pd.DataFrame({"doc_id": frame["doc_id"], "mark": frame["mark"], "print": prints.view(np.int64)})


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        prints = frame["print"].to_numpy(np.int64)
        row, key = golay_keys(prints.view(np.uint64))
        yield pd.DataFrame({"key": key, "print": prints[row]})


def near_links(prints: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` that join all fingerprints within two bits into components.

    ``prints`` has different values in ``print``. Buckets of up to PAIR_BUCKET
    fingerprints are joined in pairs and verified. Fingerprints of larger buckets
    are grouped by each 64-bit word at most one bit away: two of them share such
    a word exactly if they differ in two bits or fewer, and no word has more than
    65, so the work stays linear however many near copies there are.
    """
    keyed = prints.select("print").mapInPandas(_keys, "key long, print long")
    size = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(keyed.join(size, "key"))
    small = shared.where(F.col("n") <= PAIR_BUCKET)
    pairs = (
        small.select("key", F.col("print").alias("a"))
        .join(small.select("key", F.col("print").alias("b")), "key")
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    flips = F.array(F.lit(0).cast("long"), *[F.lit(v - (1 << 64) if v >> 63 else v).cast("long") for v in (1 << b for b in range(64))])
    words = (
        shared.where(F.col("n") > PAIR_BUCKET)
        .select("print")
        .distinct()
        .select("print", F.explode(flips).alias("flip"))
        .groupBy(F.col("print").bitwiseXOR(F.col("flip")).alias("word"))
        .agg(F.collect_list("print").alias("near"))
        .where(F.size("near") > 1)
        .select(F.explode("near").alias("a"), F.array_min("near").alias("b"))
        .where("a <> b")
    )
    return pairs.unionByName(words).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, mark, print, part, component_id`` of every row of ``docs``.

    ``mark`` is a hash of the text, which tells repeated ids apart, ``print`` the
    fingerprint as a long, ``part`` the least fingerprint of the component.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Texts are
    fingerprinted once; exact copies meet in one fingerprint, and only different
    fingerprints are joined. Null and empty texts have the fingerprint 0 and link
    like any other. Repeated rows come back as often as they are there. A null
    ``doc_id`` is never the smallest of its component unless all are null. An
    empty table gives an empty table.
    """
    marked = materialise(docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInPandas(_fingerprints, "doc_id long, mark long, print long"))
    first = marked.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    parts = connected_components(near_links(first))
    joined = first.join(parts, first["print"] == parts["node"], "left").select("print", "first_id", F.coalesce("component", "print").alias("part"))
    joined = materialise(joined)
    least = joined.groupBy("part").agg(F.min("first_id").alias("component_id"))
    return marked.join(joined.join(least, "part").select("print", "part", "component_id"), "print").select("doc_id", "mark", "print", "part", "component_id")
