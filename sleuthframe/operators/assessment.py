"""Explainable scores: signals that fire, don't fire or can't be evaluated, and what their evidence covers."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Signals with their weight and family, by subject type.
SIGNALS = {
    "Person": {"funds_cycle": (5, "financial_flow"), "transaction_burst": (4, "financial_flow"), "communication_burst": (4, "communication"), "offshore_banking": (1, "financial_structure"), "directorship_spread": (2, "corporate")},
    "Organization": {"funds_cycle": (5, "financial_flow"), "transaction_burst": (4, "financial_flow"), "offshore_banking": (1, "financial_structure")},
    "Account": {"funds_cycle": (5, "financial_flow"), "transaction_burst": (4, "financial_flow"), "offshore_banking": (1, "financial_structure")},
    "Shipment": {"manifest_discrepancy": (4, "logistics"), "route_detour": (3, "logistics"), "rare_corridor": (2, "logistics")},
}
#: Weight that makes a full score, least coverage to say anything and to call a subject elevated, and scores of the bands.
FULL_WEIGHT, LEAST_COVERAGE, ELEVATED_COVERAGE, ELEVATED, NOTABLE = 5.0, 0.25, 0.40, 60.0, 30.0


def ramp(value: Column, trigger: float, full: float) -> Column:
    """0 up to ``trigger``, 1 from ``full`` on, straight between; null stays null."""
    return F.when(value < trigger, 0.0).when(value >= full, 1.0).otherwise((value - trigger) / (full - trigger))


def funds_cycle(subjects: DataFrame, accounts: DataFrame, cycles: DataFrame, transfers: DataFrame) -> DataFrame:
    """``subject, magnitude``: the subject's strongest cycle by hops, then total; null without any account.

    ``accounts`` has ``subject, ref``, ``cycles`` has ``cycle`` (transfer ids), ``hops, total``.
    """
    members = cycles.select("hops", "total", F.explode("cycle").alias("edge_id")).join(transfers.select("edge_id", F.col("src").alias("ref")), "edge_id")
    best = accounts.join(members, "ref").groupBy("subject").agg(F.max(F.struct("hops", "total")).alias("best"))
    held = accounts.select("subject").distinct().withColumn("_has", F.lit(True))
    found = F.when(F.col("_has"), F.when(F.col("best").isNull(), 0.0).otherwise(F.greatest(ramp(F.col("best.hops"), 3, 6), F.lit(0.5))))
    return subjects.join(held, "subject", "left").join(best, "subject", "left").select("subject", found.alias("magnitude"))


def transaction_burst(subjects: DataFrame, accounts: DataFrame, profiles: DataFrame) -> DataFrame:
    """The burst of the account with the greatest ratio, then peak; needs five transfers on one account.

    ``profiles`` has ``ref, n, peak, ratio`` over six hours. It fires from a peak of 8 and a ratio of 5.
    """
    able = accounts.join(profiles.where("n >= 5"), "ref").groupBy("subject").agg(F.max(F.struct("ratio", "peak")).alias("best"))
    fired = F.when(F.col("best.peak").isNotNull(), F.when((F.col("best.peak") >= 8) & (F.col("best.ratio") >= 5), ramp(F.col("best.ratio"), 5, 20)).otherwise(0.0))
    return subjects.join(able, "subject", "left").select("subject", fired.alias("magnitude"))


def communication_burst(subjects: DataFrame, profiles: DataFrame) -> DataFrame:
    """Contacts of 48 hours: ``profiles`` has ``subject, n, peak, ratio``; needs four contacts, fires from a peak of 5."""
    fired = F.when(F.col("n") >= 4, F.when(F.col("peak") >= 5, ramp(F.col("ratio"), 5, 20)).otherwise(0.0))
    return subjects.join(profiles, "subject", "left").select("subject", fired.alias("magnitude"))


def offshore_share(subjects: DataFrame, accounts: DataFrame) -> DataFrame:
    """The share of a subject's accounts that are offshore; null without accounts."""
    share = accounts.groupBy("subject").agg(F.avg(F.col("offshore").cast("double")).alias("magnitude"))
    return subjects.join(share, "subject", "left").select("subject", "magnitude")


def directorship_spread(subjects: DataFrame, directs: DataFrame) -> DataFrame:
    """3 to 6 directorships; no directorship is a zero, not a gap."""
    counts = directs.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))
    return subjects.join(counts, "subject", "left").select("subject", ramp(F.coalesce("n", F.lit(0)), 3, 6).alias("magnitude"))


def manifest_discrepancy(manifest: Column, declared: Column) -> Column:
    """1 if the two lists differ; null if either is missing."""
    return F.when(manifest.isNotNull() & declared.isNotNull(), (~manifest.eqNullSafe(declared)).cast("double"))


def route_detour(ratio: Column) -> Column:
    return ramp(ratio, 1.25, 2.5)


def rare_corridor(share: Column) -> Column:
    """Rarer than one shipment in 200."""
    return F.when(share >= 0.005, 0.0).otherwise(ramp(0.005 - share, 0.0, 0.004))


def signals_long(kind: str, **found: DataFrame) -> DataFrame:
    """``kind, subject, signal, family, weight, magnitude`` from a frame (``subject, magnitude``) for each signal of the type."""
    out = None
    for name, (weight, family) in SIGNALS[kind].items():
        rows = found[name].select(F.lit(kind).alias("kind"), "subject", F.lit(name).alias("signal"), F.lit(family).alias("family"), F.lit(float(weight)).alias("weight"), F.col("magnitude").cast("double").alias("magnitude"))
        out = rows if out is None else out.unionByName(rows)
    return out


def signals_of_rows(kind: str, rows: DataFrame) -> DataFrame:
    """As ``signals_long``, from a row a subject with a magnitude in a column for each signal of the type."""
    told = lambda name, weight, family: F.struct(F.lit(name).alias("signal"), F.lit(family).alias("family"), F.lit(float(weight)).alias("weight"), F.col(name).cast("double").alias("magnitude"))
    return rows.select(F.lit(kind).alias("kind"), "subject", F.inline(F.array(*[told(name, *rest) for name, rest in SIGNALS[kind].items()])))


def row_scores(kind: str, rows: DataFrame) -> DataFrame:
    """``subject, coverage, raw, score, band`` as ``scores``, where a subject is one row with all of its magnitudes: nothing is gathered."""
    signals = [(F.col(name).cast("double"), float(weight)) for name, (weight, _) in SIGNALS[kind].items()]
    earned = reduce(Column.__add__, [F.coalesce(weight * m, F.lit(0.0)) for m, weight in signals])
    able = reduce(Column.__add__, [F.when(m.isNotNull(), weight).otherwise(0.0) for m, weight in signals])
    found = rows.select("subject", (able / sum(weight for _, weight in signals)).alias("coverage"), F.least(F.lit(100.0), earned / FULL_WEIGHT * 100).alias("raw"))
    found = found.withColumn("band", band(F.col("raw"), F.col("coverage")))
    return found.select("subject", "coverage", "raw", F.when(F.col("band") != "insufficient", F.col("raw")).alias("score"), "band")


def scores(signals: DataFrame) -> DataFrame:
    """By subject: ``coverage, raw, score, band, n_fired, families, reliability, credibility``.

    Coverage is the evaluable share of the weight; below LEAST_COVERAGE there is
    no score. Reliability is always F (unknown); two families that fired make
    the result probable (2), else possible (3); without a score it can't be judged (6).
    """
    able, fired = F.col("magnitude").isNotNull(), F.col("magnitude") > 0
    sums = signals.groupBy("kind", "subject").agg(
        F.coalesce(F.sum(F.col("weight") * F.col("magnitude")), F.lit(0.0)).alias("earned"),
        (F.coalesce(F.sum(F.when(able, F.col("weight"))), F.lit(0.0)) / F.sum("weight")).alias("coverage"),
        F.count_if(fired).alias("n_fired"),
        F.sort_array(F.collect_set(F.when(fired, F.col("family")))).alias("families"),
    )
    raw = F.least(F.lit(100.0), F.col("earned") / FULL_WEIGHT * 100)
    return sums.withColumn("raw", raw).withColumn("band", band(F.col("raw"), F.col("coverage"))).select(
        "kind", "subject", "coverage", "raw", F.when(F.col("band") != "insufficient", F.col("raw")).alias("score"), "band", "n_fired", "families", F.lit("F").alias("reliability"),
        F.when(F.col("band") == "insufficient", "6").when(F.size("families") >= 2, "2").otherwise("3").alias("credibility"),
    )


def band(raw: Column, coverage: Column) -> Column:
    return F.when(coverage < LEAST_COVERAGE, "insufficient").when((raw >= ELEVATED) & (coverage >= ELEVATED_COVERAGE), "elevated").when(raw >= NOTABLE, "notable").otherwise("routine")


def fingerprint(model: object) -> str:
    """Digest of a model's parameters, whatever their order."""
    return hashlib.sha256(json.dumps(model, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def published(current: DataFrame, before: DataFrame) -> DataFrame:
    """What a run says to the ledger: ``subject, action, band``; elevated and notable are published, a fall from them is retracted."""
    shown = lambda df: df.where(F.col("band").isin("elevated", "notable"))
    new = shown(current).select("subject", F.lit("publish").alias("action"), "band")
    gone = shown(before).select("subject", "band").join(shown(current).select("subject"), "subject", "left_anti")
    return new.unionByName(gone.select("subject", F.lit("retract").alias("action"), "band"))


def precision_recall(found: DataFrame, truth: DataFrame, *keys: str) -> DataFrame:
    """Against labelled subjects: ``n_found, n_true, n_hit, precision, recall``; a rate without a denominator is null."""
    hit = truth.select("subject").distinct().withColumn("_hit", F.lit(True))
    n_true = truth.agg(F.countDistinct("subject").alias("n_true"))
    sums = found.join(hit, "subject", "left").groupBy(*keys).agg(F.count(F.lit(1)).alias("n_found"), F.count("_hit").alias("n_hit"))
    return sums.join(F.broadcast(n_true)).select(*keys, "n_found", "n_true", "n_hit", F.try_divide("n_hit", "n_found").alias("precision"), F.try_divide("n_hit", "n_true").alias("recall"))  # one row
