"""From raw documents to packed sequences: five stages, each written as Parquet before the next one reads it."""

from __future__ import annotations

import uuid
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm import decontam, langid, packing, quality, simhash
from sleuthframe.llm.queries_score import document_evidence
from sleuthframe.plans.lineage import materialise, scratch_folder
from sleuthframe.sources.tables import table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the boosted trees, learned from all labels of ``docs``, give at least quality.KEEP.

    Null and empty texts are scored as texts without words; repeated rows stay or
    go together; without labels of both classes the labels' share decides for all.
    """
    trees = quality.fit(quality.labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True)))
    return quality.score(docs, trees, "_quality").where(F.col("_quality") >= quality.KEEP).drop("_quality")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is sure and whose text has a letter; null and empty texts go, repeated rows stay or go together."""
    whole = docs.withColumn("_row", F.struct(*docs.columns))  # so that no column of the documents meets one of the operator's
    return langid.identify(document_evidence(whole.select("_row", "text", "lang", "source"))).where("kept").select("_row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id.

    Documents are told apart by id and text. Of a component's rows without an id
    one stays if none has one; of texts with the same smallest id that with the
    least hash, of rows with the same id and text that with the least other
    columns. So the result doesn't depend on the order of the rows.
    """
    found = materialise(simhash.near_duplicates(docs).select("doc_id", "mark", "part"))
    first = found.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "mark")).alias("r")).select("r.doc_id", "r.mark")
    marked = docs.withColumn("_row", F.struct(*docs.columns)).select("_row", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_mark"))
    same = lambda few: marked["_id"].eqNullSafe(few["doc_id"]) & (marked["_mark"] == few["mark"])
    first = decontam.small(first)
    kept = marked.join(first, same(first), "left_semi")
    repeated = found.groupBy("doc_id", "mark").count().where("count > 1").select("doc_id", "mark")
    if repeated.isEmpty():
        return kept.select("_row.*")
    repeated = decontam.small(repeated)
    once = kept.join(repeated, same(repeated), "left_semi").groupBy("_id", "_mark").agg(F.min("_row").alias("_row"))
    return kept.join(repeated, same(repeated), "left_anti").select("_row.*").unionByName(once.select("_row.*"))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated with benchmark windows."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    bad = decontam.small(found.select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct())
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_mark"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences; null and empty texts are an end id each, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: Models, fingerprint components and packing have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``."""
    folder = f"{scratch_folder(spark, 'pipeline-')}/pipeline-{uuid.uuid4().hex}"

    def step(docs: DataFrame, stage: tuple) -> DataFrame:
        name, function = stage
        path = f"{folder}/{name.replace(' ', '-')}"
        function(spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return reduce(step, STAGES, table(spark, sf_dir, "documents"))
