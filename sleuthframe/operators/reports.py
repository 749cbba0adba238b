"""How right assessments and alerts are, against subjects that are known to take part in planted storylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.evaluation import rate

# Storylines that leave no trace an analysis may read. They are reported, but no rule can be blamed for them.
OUT_OF_REACH = ("document_forgery_ring", "identity_overlap")


def labelled_subjects(labels: DataFrame) -> DataFrame:
    """``subject, in_story``: each labelled subject (``subject, storyline``; null: planted without a storyline) once."""
    return labels.groupBy("subject").agg(F.bool_or(F.col("storyline").isNotNull()).alias("in_story"))


def assessment_rates(current: DataFrame, labels: DataFrame, most: int = 50) -> DataFrame:
    """``measure, selected, true_positives, labelled, precision, recall`` of current assessments (``subject, band, score``).

    ``elevated`` and ``notable_or_better`` are held against all labelled subjects
    that were assessed, ``elevated_storyline_only`` against those in a storyline,
    ``top`` are the ``most`` highest scores (ties by subject; those without a score
    aren't ranked). Nobody who wasn't assessed is a miss.
    """
    told = current.select("subject", "band", "score").join(labelled_subjects(labels), "subject", "left")
    known, story = F.col("in_story").isNotNull(), F.coalesce("in_story", F.lit(False))
    high = F.col("band") == "elevated"
    better = F.col("band").isin("elevated", "notable")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    sums = told.agg(n(high).alias("high"), n(better).alias("better"), n(high & known).alias("high_known"), n(better & known).alias("better_known"), n(high & story).alias("high_story"), n(known).alias("known"), n(story).alias("story"))
    top = told.where("score is not null").orderBy(F.desc("score"), "subject").limit(most).agg(F.count(F.lit(1)).alias("top"), n(known).alias("top_known"))
    whole = sums.join(F.broadcast(top))  # one row each
    row = lambda name, selected, hit, labelled: F.struct(F.lit(name).alias("measure"), F.col(selected).alias("selected"), F.col(hit).alias("true_positives"), F.col(labelled).alias("labelled"))
    rows = whole.select(F.explode(F.array(row("elevated", "high", "high_known", "known"), row("notable_or_better", "better", "better_known", "known"), row("elevated_storyline_only", "high", "high_story", "story"), row("top", "top", "top_known", "known"))).alias("r")).select("r.*")
    return rows.select("*", rate(F.col("true_positives"), F.col("selected")).alias("precision"), rate(F.col("true_positives"), F.col("labelled")).alias("recall"))


def assessment_storylines(current: DataFrame, labels: DataFrame, out_of_reach: tuple[str, ...] = OUT_OF_REACH) -> DataFrame:
    """``storyline, planted, n_elevated, n_notable, n_insufficient, recall, detectable``: how far each storyline's assessed subjects got.

    ``n_notable`` are notable or better. Storylines out of reach are listed even
    where nobody assessed takes part in them.
    """
    own = labels.where("storyline is not null").select("subject", "storyline").distinct().join(current.select("subject", "band"), "subject")
    n = lambda *bands: F.count_if(F.coalesce(F.col("band").isin(*bands), F.lit(False)))
    sums = own.groupBy("storyline").agg(F.count(F.lit(1)).alias("planted"), n("elevated").alias("n_elevated"), n("elevated", "notable").alias("n_notable"), n("insufficient").alias("n_insufficient"))
    beyond = current.sparkSession.createDataFrame([(name,) for name in out_of_reach], "storyline string")
    out = sums.join(beyond, "storyline", "full_outer").fillna(0)
    return out.select("*", rate(F.col("n_notable"), F.col("planted")).alias("recall"), (~F.col("storyline").isin(*out_of_reach)).alias("detectable"))


def signal_rates(signals: DataFrame, labels: DataFrame) -> DataFrame:
    """``signal, evaluable, not_evaluable, fired, fired_on_labelled, fire_rate, precision`` of signals (``signal, subject, magnitude``; null: not evaluable)."""
    told = signals.select("signal", "subject", "magnitude").join(labelled_subjects(labels), "subject", "left")
    fired = F.coalesce(F.col("magnitude") > 0, F.lit(False))
    sums = told.groupBy("signal").agg(F.count("magnitude").alias("evaluable"), F.count_if(F.col("magnitude").isNull()).alias("not_evaluable"), F.count_if(fired).alias("fired"), F.count_if(fired & F.col("in_story").isNotNull()).alias("fired_on_labelled"))
    return sums.select("*", rate(F.col("fired"), F.col("evaluable")).alias("fire_rate"), rate(F.col("fired_on_labelled"), F.col("fired")).alias("precision"))


def _reached(scopes: DataFrame) -> DataFrame:
    """Each subject that an alert is about once."""
    return scopes.select("subject").distinct().withColumn("_alerted", F.lit(True))


def alert_rates(scopes: DataFrame, planted: DataFrame, out_of_reach: tuple[str, ...] = OUT_OF_REACH) -> DataFrame:
    """One row: ``alerts, subjects, labelled, reachable, reached, precision, recall, unlabelled``.

    ``scopes`` has ``key, rule, subject``, a row a subject an alert is about,
    ``planted`` ``story, kind, subject``. Precision is over all subjects alerted;
    recall over planted ones of which at least one story isn't out of reach.
    ``unlabelled`` is the share of subjects alerted that nothing is known of, which
    isn't the share of false ones.
    """
    own = planted.groupBy("subject").agg(F.bool_or(~F.col("kind").isin(*out_of_reach)).alias("_reachable"))
    told = _reached(scopes).join(own, "subject", "full_outer")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    alerted, known, reachable = F.col("_alerted"), F.col("_reachable").isNotNull(), F.col("_reachable")
    sums = told.agg(n(alerted).alias("subjects"), n(alerted & known).alias("labelled"), n(reachable).alias("reachable"), n(alerted & reachable).alias("reached"))
    out = scopes.agg(F.count_distinct("key").alias("alerts")).join(F.broadcast(sums))  # one row each
    return out.select("*", rate(F.col("labelled"), F.col("subjects")).alias("precision"), rate(F.col("reached"), F.col("reachable")).alias("recall"), F.round(1 - F.try_divide("labelled", "subjects"), 4).alias("unlabelled"))


def alert_rules(scopes: DataFrame, planted: DataFrame) -> DataFrame:
    """``rule, alerts, subjects, labelled, precision``: by rule, different alerts, subjects and planted subjects among them."""
    known = planted.select("subject").distinct().withColumn("_known", F.lit(True))
    alerts = scopes.groupBy("rule").agg(F.count_distinct("key").alias("alerts"))
    sums = scopes.select("rule", "subject").distinct().join(known, "subject", "left").groupBy("rule").agg(F.count(F.lit(1)).alias("subjects"), F.count("_known").alias("labelled"))
    return alerts.join(sums, "rule").select("*", rate(F.col("labelled"), F.col("subjects")).alias("precision"))


def alert_storylines(scopes: DataFrame, planted: DataFrame, out_of_reach: tuple[str, ...] = OUT_OF_REACH) -> DataFrame:
    """``kind, members, alerted, recall, rules, reachable`` by kind of storyline: members of its stories, those alerted, and the rules that reach any.

    A subject of two stories of a kind is a member of each. Where a kind has no
    member that could be alerted, recall is null: nothing was there to be found.
    """
    own = planted.select("kind", "story", "subject").distinct()
    members = own.join(_reached(scopes), "subject", "left").groupBy("kind").agg(F.count("subject").alias("members"), F.count("_alerted").alias("alerted"))
    rules = own.select("kind", "subject").distinct().join(scopes.select("subject", "rule").distinct(), "subject").groupBy("kind").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    beyond = planted.sparkSession.createDataFrame([(name,) for name in out_of_reach], "kind string")
    out = members.join(beyond, "kind", "full_outer").fillna(0).join(rules, "kind", "left")
    return out.select("kind", "members", "alerted", rate(F.col("alerted"), F.col("members")).alias("recall"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"), (~F.col("kind").isin(*out_of_reach)).alias("reachable"))
