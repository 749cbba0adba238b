"""Language identification: Bayesian fusion of text, declared language, address suffix and host."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.llm.decontam import small
from sleuthframe.llm.quality import hash_bound
from sleuthframe.plans.lineage import materialise

#: Different texts of each declared language that the text model is fitted on, at most about.
MAX_TEXTS = 3_000
#: Hashed character trigrams, and how much a trigram's evidence counts: neighbouring ones say nearly the same.
BUCKETS, TEMPER = 1 << 14, 0.4
#: Rows that a parent's distribution counts for in its child's; weight of the overall share of a declared language or suffix.
PRIOR_ROWS, SMOOTHING = 20.0, 1.0
#: The share of rows by which a host's or a declaration's word may be wrong, whatever the counts say.
DOUBT = 0.002
#: Trigrams of the mean language that each language's counts are mixed with.
POOLED = 100.0
#: A document is kept if its language has at least this probability and its text has a letter.
KEEP = 0.5

_SPACE = np.full(256, ord(" "), np.uint8)
_SPACE[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SPACE[128:] = np.arange(128, 256)


def trigrams(text: str | None) -> np.ndarray:
    """How often each bucket of trigrams occurs in the letters of a whole text."""
    data = _SPACE[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)]
    data = data[np.insert((data[1:] != 32) | (data[:-1] != 32), 0, True)].astype(np.int64)
    if len(data) < 3:
        return np.zeros(BUCKETS, np.int64)
    return np.bincount((data[:-2] * 7919 + data[1:-1] * 331 + data[2:] * 17) & (BUCKETS - 1), minlength=BUCKETS)


@dataclass
class TextModel:
    """Languages and, by bucket and language, log probability relative to the mean language."""

    languages: list[str]
    weights: np.ndarray

    def evidence(self, text: str | None) -> np.ndarray:
        """Log likelihood of each language up to a constant; a trigram's repeats count by their logarithm."""
        return TEMPER * (np.log1p(trigrams(text)) @ self.weights)


def fit_text(docs: DataFrame) -> TextModel:
    """A naive Bayes model of trigrams of every declared language, from rows ``text, declared``.

    Of each language at most about MAX_TEXTS different texts are read, those with
    the least hashes, so that copies and frequent languages don't crowd out rare
    ones. A language with few texts stays close to the mean one. The model has
    BUCKETS numbers of four bytes a language.
    """
    declared = docs.where("declared is not null")
    seen = declared.groupBy("declared").agg(F.approx_count_distinct(F.xxhash64("text")).alias("n")).orderBy(F.desc("n"), "declared").collect()  # a row a language
    names = [r["declared"] for r in seen]
    bounds = docs.sparkSession.createDataFrame([(r["declared"], hash_bound(MAX_TEXTS, r["n"])) for r in seen], "declared string, bound long")
    sample = declared.join(small(bounds, "declared"), "declared").where(F.xxhash64("text") <= F.col("bound")).select("declared", "text").distinct()

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, name in zip(frame["text"], frame["declared"], strict=True):
                sums[name] = sums.get(name, 0) + np.log1p(trigrams(text if isinstance(text, str) else None))
        for name, values in sums.items():
            at = np.flatnonzero(values)
            yield pd.DataFrame({"declared": name, "bucket": at.astype(np.int32), "n": values[at]})

    counts = sample.mapInPandas(count, "declared string, bucket int, n double").groupBy("declared", "bucket").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS x languages at most
    table = np.zeros((BUCKETS, len(names)))
    if len(counts):
        np.add.at(table, (counts["bucket"].to_numpy(), counts["declared"].map({n: i for i, n in enumerate(names)}).to_numpy()), counts["n"].to_numpy())
    if not names:
        return TextModel(names, table)
    pooled = (table.sum(1, keepdims=True) + 0.5) / (table.sum() + 0.5 * BUCKETS)
    logs = np.log((table + POOLED * pooled) / (table.sum(0, keepdims=True) + POOLED))
    return TextModel(names, (logs - logs.mean(1, keepdims=True)).astype(np.float32))


def with_evidence(docs: DataFrame, model: TextModel) -> DataFrame:
    """``docs`` with ``evidence``: an array of log likelihoods in the model's order of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shared.value.evidence(t if isinstance(t, str) else None) for t in batch], dtype=object)

    return docs.withColumn("evidence", weigh("text"))


def with_probabilities(df: DataFrame, logs: str, name: str = "p") -> DataFrame:
    """``df`` with probabilities from log weights; an empty array from one. Step by step, so that no sum is made anew for each element."""
    df = df.withColumn("_peak", F.array_max(logs)).withColumn("_raised", F.transform(logs, lambda x: F.exp(x - F.col("_peak"))))
    df = df.withColumn("_sum", F.aggregate("_raised", F.lit(0.0), lambda a, x: a + x))
    return df.withColumn(name, F.transform("_raised", lambda x: x / F.col("_sum"))).drop("_peak", "_raised", "_sum")


def shares(rows: DataFrame, key: str, n: int, parent: DataFrame | None = None, parent_key: str | None = None, weight: float = PRIOR_ROWS) -> DataFrame:
    """By ``key``, the distribution over languages of its rows' probabilities ``p``.

    A key's counts are mixed with its parent's distribution, which counts for
    ``weight`` rows; without a parent, with an even one.
    """
    columns = [key] if parent_key is None else [key, parent_key]
    each = rows.where(F.col(key).isNotNull()).select(*columns, F.posexplode("p").alias("i", "x")).groupBy(*columns, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("rows"))
    sums = each.groupBy(*columns).agg(F.max("rows").alias("rows"), F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda e: e["s"]).alias("sums"))  # a number a language
    if parent is None:
        sums = sums.withColumn("above", F.array_repeat(F.lit(1 / n), n))
    else:
        sums = sums.join(parent.select(F.col(parent_key), F.col("share").alias("above")), parent_key)
    mixed = F.zip_with("sums", "above", lambda s, above: (s + weight * above) / (F.col("rows") + weight))
    return sums.select(key, mixed.alias("share"), "rows")


@dataclass
class Fusion:
    """What all rows say: distributions by host, by declared language and by suffix."""

    model: TextModel
    hosts: DataFrame
    declared: DataFrame
    suffixes: DataFrame


def fit(docs: DataFrame) -> Fusion:
    """Text model and grouped statistics of ``docs`` (``text, declared, suffix, host, domain``, all but text nullable).

    All rows are counted, by partial sums of their text's probabilities. Hosts
    lean on their domain, domains on all rows.
    """
    model = fit_text(docs)
    n = len(model.languages)
    rows = with_evidence(docs, model).select("declared", "suffix", "host", F.coalesce("domain", "host").alias("domain"), F.lit("").alias("all"), "evidence")
    rows = materialise(with_probabilities(rows, "evidence").drop("evidence"))
    if not n:
        rows = rows.where(F.lit(False))
    everything = shares(rows, "all", n) if n else rows.select("all", F.col("p").alias("share"))
    make = lambda key, parent, parent_key: shares(rows, key, n, parent, parent_key) if n else rows.select(F.col(key), F.col("p").alias("share"))
    domains = make("domain", everything, "all")
    hosts = make("host", domains, "domain")
    # a host that stands in two domains has a row for each; the one with more rows is taken
    hosts = hosts.groupBy("host").agg(F.max_by("share", "rows").alias("share")) if n else hosts
    return Fusion(model, materialise(hosts), materialise(make("declared", everything, "all").select("declared", "share")), materialise(make("suffix", everything, "all").select("suffix", "share")))


#: Columns that identification adds.
ADDED = ("language", "probability", "text_language", "kept")


def fuse(docs: DataFrame, fusion: Fusion) -> DataFrame:
    """``docs`` with ``language``, ``probability`` and ``text_language`` in place of any it has.

    The host's distribution is the prior; declared language and suffix add what
    their distributions say beyond the overall one; the text adds its
    likelihood. Whatever is null or unknown adds nothing. Hosts are broadcast as
    long as their table is small, which is counted; beyond, they are joined.
    """
    names = F.array(*[F.lit(x) for x in fusion.model.languages]).cast("array<string>")
    own = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(F.struct(*own).alias("_row"), "text", "declared", "suffix", "host")  # so that no column of docs meets one made here
    rows = with_evidence(rows, fusion.model)
    for table, key in ((fusion.declared, "declared"), (fusion.suffixes, "suffix"), (fusion.hosts, "host")):
        known = table.select(F.col(key).alias(f"{key}_"), F.transform("share", lambda x: F.log(x * (1 - DOUBT) + DOUBT)).alias(f"{key}_log"))
        rows = rows.join(small(known.withColumn("size", F.col(f"{key}_")), f"{key}_").drop("size"), F.col(key) == F.col(f"{key}_"), "left").drop(f"{key}_")
    total = F.col("evidence")
    for key in ("declared", "suffix", "host"):
        total = F.when(F.col(f"{key}_log").isNull(), total).otherwise(F.zip_with(total, f"{key}_log", lambda a, b: a + b))
    rows = with_probabilities(rows.withColumn("total", total), "total").withColumn("most", F.array_max("p"))
    at, text_at = F.array_position("p", F.col("most")).cast("int"), F.array_position("evidence", F.array_max("evidence")).cast("int")
    pick = lambda at: F.when(at > 0, F.get(names, at - 1))
    return rows.select("_row.*", pick(at).alias("language"), F.coalesce("most", F.lit(0.0)).alias("probability"), pick(text_at).alias("text_language"))


def accepted() -> Column:
    """Whether a fused row is kept: a sure language, and text that has a letter."""
    return F.coalesce((F.col("probability") >= KEEP) & F.col("text").rlike(r"\p{L}"), F.lit(False))


def host_domain_suffix(url: Column) -> tuple[Column, Column, Column]:
    """Host, its last two labels and its last label; nulls where there is no host."""
    host = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"(?s)^.*?://([^/?#:]+)", 1)
    host = F.when(host != "", host)
    return host, F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def address_suffix(text: Column) -> Column:
    """The last label of the first web or mail address in a text; null if there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?:://|@)[A-Za-z0-9.-]*\.([A-Za-z]{2,24})\b", 1))
    return F.when(found != "", found)


def declared_language(html: Column) -> Column:
    """The two or three letters of the ``lang`` that a page's markup declares; null if it declares none."""
    found = F.lower(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1))
    return F.when(found != "", found)


def identify(docs: DataFrame) -> DataFrame:
    """Languages of ``docs``: its columns, then ``language, probability, text_language, kept`` in place of any it has.

    ``docs`` needs ``text, declared, suffix, host, domain`` and may have more.
    Null and empty texts add no evidence and aren't kept; ties go to the more
    frequent language; repeated rows get equal results. If no row declares a
    language, none is known and ``language`` is null. An empty table gives an
    empty table.
    """
    found = fuse(docs, fit(docs.select("text", "declared", "suffix", "host", "domain")))
    return found.withColumn("kept", accepted())
