"""One run of the alert rules: what fires, about whom, how urgent it is, and what it does to the queue.

Whom a firing is about are rows of their own, so that a cluster of any size is
never gathered into one row; all that is known of a subject is joined to them by
subject, and each firing is summed up from its rows before they are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators.alerting import BAND_ORDER, HIGH, MEDIUM
from sleuthframe.operators.rollups import latest_per
from sleuthframe.operators.sequences import decay, previous_of

# The rules with how many methods that share no input concur in each, and the bands that count as assessed.
METHODS = {"assessment.elevated": 1, "correlation.established_pair": 1, "convergence.assessed_cluster": 2, "assessment.escalated": 1}
ASSESSED = ("elevated", "notable")
#: Worth of a firing in which two methods concur, against one's.
CONCURRING = 1.5
#: Added before a priority is compared or rounded, so that borders don't hang on the order of a mean's sum.
TIE = 1e-9


def set_mark(subject: Column) -> Column:
    """An aggregate that names a set of different subjects whatever their order: their number and the sum of their 60-bit hashes."""
    return F.concat_ws(":", F.count(subject).cast("string"), F.sum(F.conv(F.substring(F.md5(subject.cast("string")), 1, 15), 16, 10).cast("decimal(38,0)")).cast("string"))


def current_findings(ledger: DataFrame) -> DataFrame:
    """The newest row of each subject (``subject, band, score, coverage, computed_at, id``) with ``previous``, its band at the time before."""
    return latest_per(previous_of(ledger, "subject", "band", "computed_at", "id"), "subject")


def firings(current: DataFrame, links: DataFrame, members: DataFrame) -> DataFrame:
    """``rule, ref, subject, magnitude, confidence``: what fires, a row a subject it is about.

    ``current`` is ``current_findings``, ``links`` has ``a, b, tier, strength,
    coverage``, ``members`` has ``cluster, subject``. Elevated subjects fire, as do
    those that rose into an assessed band from a lower one that has a rank, pairs
    whose link is established, and clusters of which two members or more are
    assessed: about all their members, not only those. Of repeated links the
    strongest counts, repeated members once. ``ref`` tells firings of a rule apart. Null bands, scores and coverages don't fire or count as 0.
    """
    part = lambda rows, rule, ref, subject, magnitude, confidence: rows.select(F.lit(rule).alias("rule"), ref.cast("string").alias("ref"), subject.cast("string").alias("subject"), F.coalesce(magnitude, F.lit(0.0)).alias("magnitude"), F.coalesce(confidence, F.lit(0.0)).alias("confidence"))
    ranks = F.create_map(*[F.lit(x) for pair in BAND_ORDER.items() for x in pair])
    rise = ranks[F.col("band")] - ranks[F.col("previous")]
    subject, coverage = F.col("subject"), F.col("coverage")
    high = part(current.where("band = 'elevated'"), "assessment.elevated", subject, subject, F.least(F.lit(1.0), F.col("score") / 100), coverage)
    risen = part(current.where(F.col("band").isin(*ASSESSED) & (rise > 0)), "assessment.escalated", subject, subject, F.least(F.lit(1.0), rise / (len(BAND_ORDER) - 1)), coverage)
    links = links.where("tier = 'established'").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.struct("strength", "coverage")).alias("r")).select("a", "b", "r.*")
    members = members.select("cluster", "subject").distinct()
    pairs = links.select("*", F.explode(F.array("a", "b")).alias("subject"))
    linked = part(pairs, "correlation.established_pair", F.concat_ws("|", F.col("a").cast("string"), F.col("b").cast("string")), subject, F.col("strength"), coverage)
    told = members.join(current.where(F.col("band").isin(*ASSESSED)).select("subject", F.coalesce("coverage", F.lit(0.0)).alias("coverage")), "subject", "left")
    sums = told.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.count("coverage").alias("n"), F.avg("coverage").alias("coverage")).where("n >= 2")
    meeting = part(members.join(sums, "cluster"), "convergence.assessed_cluster", F.col("cluster"), subject, F.col("n") / F.col("size"), coverage)
    return reduce(DataFrame.unionByName, [high, risen, linked, meeting])


def active_suppressions(suppressions: DataFrame, now: Column) -> DataFrame:
    """Those of ``id, rule, subject, expires_at, revoked`` that hold now and name a rule or a subject."""
    return suppressions.where(~F.coalesce("revoked", F.lit(False)) & (F.col("expires_at") > now)).where("rule is not null or subject is not null")


def raised(fired: DataFrame, current: DataFrame, members: DataFrame, suppressions: DataFrame, now: Column) -> DataFrame:
    """Alerts of a run, one a key: ``key, rule, ref, n_firings, n_subjects, magnitude, confidence, evidence_at, priority, level, group_key, suppressed_by``.

    The key is made of the rule and the set of subjects; of firings with equal keys
    the first counts. Evidence is as old as the newest assessment of anybody it is
    about, or new where there is none. An alert is of the least cluster that any of
    its subjects is in, else of those with the same subjects. The narrowest active
    suppression is told: one that names rule and subject before one that names
    either, then the least id. A suppressed alert is an alert all the same.
    """
    assessed = current.where(F.col("band").isin(*ASSESSED)).select(F.col("subject").cast("string").alias("subject"), "computed_at")
    cluster = members.groupBy(F.col("subject").cast("string").alias("subject")).agg(F.min(F.col("cluster").cast("string")).alias("cluster"))
    active = active_suppressions(suppressions, now)
    of_rule = lambda rule: F.when(F.col("rule") == rule, F.col("id"))
    narrow = F.map_from_arrays(F.array(*[F.lit(r) for r in METHODS]), F.array(*[F.min(of_rule(r)) for r in METHODS]))
    quiet = active.where("subject is not null").groupBy(F.col("subject").cast("string").alias("subject")).agg(F.min(F.when(F.col("rule").isNull(), F.col("id"))).alias("_alone"), narrow.alias("_both"))
    about = fired.join(assessed, "subject", "left").join(cluster, "subject", "left").join(quiet, "subject", "left")
    seen = F.max("computed_at").alias("evidence_at")
    sums = about.groupBy("rule", "ref").agg(
        set_mark(F.col("subject")).alias("_mark"), F.count(F.lit(1)).alias("n_subjects"), F.max("magnitude").alias("magnitude"), F.max("confidence").alias("confidence"), seen, F.min("cluster").alias("cluster"),
        F.min(F.col("_both")[F.col("rule")]).alias("_both"), F.min("_alone").alias("_alone"),
    )
    by_rule = active.where("subject is null").groupBy("rule").agg(F.min("id").alias("_rule"))
    key = F.substring(F.sha2(F.concat("rule", F.lit("@1::"), "_mark"), 256), 1, 32)
    once = sums.join(by_rule, "rule", "left").withColumn("key", key)
    once = once.groupBy("key").agg(F.min_by(F.struct(*[c for c in once.columns if c != "key"]), "ref").alias("r"), F.count(F.lit(1)).alias("n_firings")).select("key", "n_firings", "r.*")
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col(c)))
    at = F.coalesce(F.col("evidence_at").cast("timestamp"), now.cast("timestamp"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at)) / 86_400_000_000
    methods = F.create_map(*[F.lit(x) for pair in METHODS.items() for x in pair])[F.col("rule")]
    priority = F.least(F.lit(1.0), F.when(methods > 1, CONCURRING).otherwise(1.0) * unit("confidence") * unit("magnitude") * decay(age))
    basis = F.when(F.col("cluster").isNotNull(), F.concat(F.lit("cluster:"), "cluster")).otherwise(F.concat(F.lit("scope:"), "_mark"))
    out = once.withColumns({"priority": priority, "group_key": F.substring(F.sha2(basis, 256), 1, 32), "suppressed_by": F.coalesce("_both", F.least("_alone", "_rule")), "evidence_at": at.cast("timestamp_ntz")})
    level = F.when(F.col("priority") + TIE >= HIGH, "high").when(F.col("priority") + TIE >= MEDIUM, "medium").otherwise("low")
    return out.select("key", "rule", "ref", "n_firings", "n_subjects", "magnitude", "confidence", "evidence_at", "priority", level.alias("level"), "group_key", "suppressed_by")


#: What a repeated firing renews in the queue; state, assignee, first run and the number of runs are the queue's own.
RENEWED = ("rule", "priority", "level", "group_key", "suppressed_by")


def brought_in(queue: DataFrame | None, alerts: DataFrame, run: Column) -> DataFrame:
    """The queue after a run: ``key, rule, priority, level, group_key, suppressed_by, state, assignee, occurrences, first_run, last_run, change``.

    A new key opens an alert. One that is there is renewed, but keeps what
    analysts made of it, and counts one more, once a run: a run brought in twice
    changes nothing. Alerts that didn't fire stay as they were.
    """
    fresh = alerts.select("key", *RENEWED, run.alias("_run"))
    if queue is None:
        return fresh.select("key", *RENEWED, F.lit("open").alias("state"), F.lit(None).cast("string").alias("assignee"), F.lit(1).cast("long").alias("occurrences"), F.col("_run").alias("first_run"), F.col("_run").alias("last_run"), F.lit("created").alias("change"))
    q, f = queue.alias("q"), fresh.alias("f")
    joined = q.join(f, "key", "full_outer")
    hit, old = F.col("f._run").isNotNull(), F.col("q.occurrences").isNotNull()
    again = hit & old & (F.col("q.last_run") < F.col("f._run"))
    change = F.when(again, "repeated").when(old, "unchanged").otherwise("created")
    return joined.select(
        "key", *[F.when(hit, F.col(f"f.{c}")).otherwise(F.col(f"q.{c}")).alias(c) for c in RENEWED], F.coalesce("q.state", F.lit("open")).alias("state"), F.col("q.assignee").alias("assignee"),
        (F.coalesce("q.occurrences", F.lit(0)) + F.when(again | ~old, 1).otherwise(0)).alias("occurrences"), F.coalesce("q.first_run", "f._run").alias("first_run"), F.greatest("q.last_run", "f._run").alias("last_run"), change.alias("change"),
    )


def run_report(alerts: DataFrame, after: DataFrame) -> DataFrame:
    """One row of a run: ``n_firings, n_alerts, n_created, n_repeated, n_suppressed, n_groups``."""
    sums = alerts.join(after.select("key", "change"), "key").agg(
        F.coalesce(F.sum("n_firings"), F.lit(0)).alias("n_firings"), F.count(F.lit(1)).alias("n_alerts"), F.count_if(F.col("change") == "created").alias("n_created"), F.count_if(F.col("change") == "repeated").alias("n_repeated"),
        F.count("suppressed_by").alias("n_suppressed"), F.count_distinct("group_key").alias("n_groups"),
    )
    return sums


def openings(after: DataFrame) -> DataFrame:
    """First entries of the new alerts' histories: ``key, from_state, to_state, note``."""
    return after.where("change = 'created'").select("key", F.lit(None).cast("string").alias("from_state"), F.lit("open").alias("to_state"), F.concat(F.lit("raised by "), "rule").alias("note"))
