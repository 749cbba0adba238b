"""Importance resampling towards a target: hashed feature counts in CSR blocks, column sums, and a sparse matrix-vector product."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from sleuthframe.operators.sequences import numbered
from sleuthframe.plans.lineage import materialise, scratch_folder

#: Columns of the matrix, words of the longest feature, words a drawn document has at least, and percent of those that are drawn.
BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Features after which a block is closed, rows of a block and blocks of a file at most, and bytes of a text that are taken apart at once.
BLOCK_FEATURES, BLOCK_ROWS, FILE_BLOCKS, SLICE = 1 << 17, 4096, 16, 4 << 20

# A-Z to a-z, and what a word is made of, in the bytes of UTF-8.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_lists(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each SLICE of it, cut where no word is."""
    low, at = raw.translate(LOWER), 0
    while at < len(low):
        end = len(low)
        if end - at > SLICE:
            last = WORD.match(low, at + SLICE)  # the word that the cut would meet ends first
            end = last.end() if last else at + SLICE
        yield WORD.findall(low, at, end)
        at = end


def feature_buckets(raw: bytes, longest: int, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Words of a text, and its buckets with their counts."""
    words_seen, carried, sums = 0, [], None
    for words in word_lists(raw):
        words_seen += len(words)
        hashes = [np.fromiter(map(crc32, words), np.int64, len(words))]
        joined = carried + words
        for size in range(2, longest + 1):
            first = max(0, len(carried) - size + 1)  # runs that end in this slice
            runs = [b" ".join(joined[i : i + size]) for i in range(first, len(joined) - size + 1)]
            hashes.append(np.fromiter(map(crc32, runs), np.int64, len(runs)))
        carried = joined[max(0, len(joined) - longest + 1) :] if longest > 1 else []
        found = np.unique(np.concatenate(hashes) % buckets, return_counts=True)
        if sums is None:
            sums = found
        else:
            both, at = np.unique(np.concatenate([sums[0], found[0]]), return_inverse=True)
            total = np.zeros(len(both), np.int64)
            np.add.at(total, at, np.concatenate([sums[1], found[1]]))
            sums = (both, total)
    return (words_seen, *(sums or (np.zeros(0, np.int64), np.zeros(0, np.int64))))


def count_matrix(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The document-by-bucket counts of ``docs`` as CSR blocks, written to the shared folder and read back.

    A row is a block: ``ids, words`` (a value a document), ``indptr`` (one more),
    and ``indices, data`` (a value for each bucket that a document has). A block
    ends with BLOCK_FEATURES counts or BLOCK_ROWS documents. A reader unpacks up to
    4,096 rows of a file at once, however long their lists are, so a file has
    FILE_BLOCKS at most.
    """
    id_type = docs.schema["doc_id"].dataType
    schema = StructType([
        StructField("ids", ArrayType(id_type)), StructField("words", ArrayType(LongType())), StructField("indptr", ArrayType(IntegerType())),
        StructField("indices", ArrayType(IntegerType())), StructField("data", ArrayType(LongType())),
    ])

    def block(ids: list, words: list[int], counts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ends = np.cumsum([0, *(len(c[0]) for c in counts)])
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        flat = [np.concatenate([c[k] for c in counts]) for k in (0, 1)]
        kinds = (ids_type[0], pa.int64(), pa.int32(), pa.int32(), pa.int64())
        values = (ids, words, ends, flat[0], flat[1])
        return pa.RecordBatch.from_arrays([one(v, k) for v, k in zip(values, kinds, strict=True)], names=schema.names)

    ids_type: list[pa.DataType] = [pa.null()]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, counts, held = [], [], [], 0
        for batch in batches:
            ids_type[0] = batch.column(0).type
            for doc, raw in zip(batch.column(0), batch.column(1), strict=True):
                seen, columns, n = feature_buckets(raw.as_py() or b"", longest, buckets)
                ids.append(doc.as_py())
                words.append(seen)
                counts.append((columns, n))
                held += len(n)
                if held >= BLOCK_FEATURES or len(ids) >= BLOCK_ROWS:
                    yield block(ids, words, counts)
                    ids, words, counts, held = [], [], [], 0
        if ids:
            yield block(ids, words, counts)

    spark = docs.sparkSession
    folder = f"{scratch_folder(spark, 'matrix-')}/matrix-{uuid.uuid4().hex}"
    docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("raw")).mapInArrow(blocks, schema).write.option("maxRecordsPerFile", FILE_BLOCKS).parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts by bucket over all rows of the matrix: ``buckets`` numbers."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            indices, data = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            np.add.at(total, indices, data)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in matrix.select("indices", "data").mapInArrow(sums, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the logarithm of the target's smoothed share over the source's, floored."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (float(s_all) + n) / ((float(s) + 1) * (float(t_all) + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc: object, seed: int) -> int:
    """A thousand times a Gumbel variable that hangs on the id alone, floored; a null id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(matrix: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of each row: the floored mean gain of its features (0 without any), and that with noise added."""
    id_type = matrix.schema["ids"].dataType.elementType.simpleString()

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, words, indptr, indices, data = (batch.column(c)[k].values for c in range(5))
                at, counts = indptr.to_numpy(zero_copy_only=False), data.to_numpy(zero_copy_only=False)
                n, gained = (np.diff(np.concatenate([[0], np.cumsum(v)])[at]) for v in (counts, counts * gain[indices.to_numpy(zero_copy_only=False)]))
                weight = np.where(n > 0, gained // np.maximum(n, 1), 0)
                score = weight + np.fromiter((noise(d, seed) for d in ids.to_pylist()), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays([ids, words, *(pa.array(v, pa.int64()) for v in (n, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return matrix.mapInArrow(product, f"doc_id {id_type}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Draw the documents that look most like ``target``, by hashed features with noise.

    ``docs`` needs ``doc_id`` and ``text``, ``target`` needs ``text``; other columns
    are ignored. Returns a row per row of ``docs``: ``doc_id, n_words, n_features,
    weight, score, rank``. Of the documents with at least ``least_words`` words the
    given percent, floored, with the highest scores are drawn and ranked from 1;
    ties go to the smaller id (null last), then to fewer features; rows equal in all
    of it are ranked in any order. Null and empty texts have no features, weight 0
    and no rank. An empty target or empty ``docs`` is a sum of zeros.

    The counts are persisted once, as CSR blocks; the columns' sums, ``buckets``
    numbers, are all that the driver gets of the corpus, with the counts of equal
    scores: the noise spreads scores, whose number is bounded by the gains' range.
    Only rows that may be drawn are sorted, by ranges.
    """
    matrix = count_matrix(docs, longest, buckets)
    goal = count_matrix(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), longest, buckets)
    scored = materialise(weights(matrix, gains(column_sums(matrix, buckets), column_sums(goal, buckets)), seed))
    held = F.col("n_words") >= least_words
    by_score = sorted(((r["score"], r["n"]) for r in scored.where(held).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    left = drawn = sum(n for _, n in by_score) * percent // 100
    bar = None  # the least score that is drawn
    for score, n in by_score:
        if left <= 0:
            break
        bar, left = score, left - n
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    if bar is None:
        return none
    may = held & (F.col("score") >= bar)
    ranked = numbered(scored.where(may), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return none.where(~may).unionByName(ranked)
