"""Queries of the classifiers (6, 7, 10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sleuthframe.llm import html, langid, quality, toxicity
from sleuthframe.sources.tables import table

#: Labels of the rows with this remainder of crc32(doc_id) are never learned: (divisor, remainder).
QUALITY_FOLD, TOXIC_FOLD = (3, 1), (4, 2)
#: From this toxicity score on a document is predicted toxic.
TOXIC_AT = toxicity.THRESHOLD


def held_out(fold: tuple[int, int]) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold[0] == fold[1], F.lit(False))


def quality_trees(spark: SparkSession, folder: str) -> quality.Trees:
    """Trees learned from the labels outside the held-out fold."""
    sample = quality.labelled_texts(table(spark, folder, "documents"), table(spark, folder, "labels"), "quality", ~held_out(QUALITY_FOLD))
    return quality.fit(sample)


def op6_quality_gbdt(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality.score(table(spark, folder, "documents").select("doc_id", "text"), quality_trees(spark, folder))
    return scored.select("doc_id", held_out(QUALITY_FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_toxicity_fst(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, folder, "labels"), ~held_out(TOXIC_FOLD)))
    return toxicity.score(docs, model).select("doc_id", held_out(TOXIC_FOLD).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as language identification reads them: ``lang`` is the declared language, ``source`` the host, and the suffix is that of the first address in the text."""
    return docs.withColumns({"declared": F.col("lang"), "suffix": langid.address_suffix(F.col("text")), "host": F.col("source"), "domain": F.lit(None).cast("string")})


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    return langid.identify(document_evidence(docs)).select("doc_id", "language", "probability", "text_language", "kept")


def llm_page_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of the pages' main texts, by text, markup, address and host."""
    pages = table(spark, folder, "pages").select("page_id", "url", langid.declared_language(F.col("html")).alias("declared"), "html")
    host, domain, suffix = langid.host_domain_suffix(F.col("url"))

    @F.pandas_udf("string")
    def main(batch: pd.Series) -> pd.Series:
        return batch.map(lambda h: html.main_text(h if isinstance(h, str) else None))

    read = pages.select("page_id", "declared", host.alias("host"), domain.alias("domain"), suffix.alias("suffix"), main("html").alias("text"))
    return langid.identify(read).select("page_id", "language", "probability", "text_language", "declared", "kept")


QUERIES = {f.__name__: f for f in (op6_quality_gbdt, op7_toxicity_fst, op10_language_id, llm_page_language)}
ORACLES: dict[str, str] = {}
