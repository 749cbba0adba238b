"""Order-dependent operators: bursts, baselines, replay, chains, false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.plans.lineage import materialise

#: Least number of events that a span's expectation counts as.
EXPECTED_FLOOR = 0.5


def bursts(rows: DataFrame, hours: int) -> DataFrame:
    """``rows`` (``ref, ts``) with ``in_span``: events of the ref within the closed span of ``hours`` that ends here.

    What has begun less what is over, each a running sum: a window that slides
    would add up all of its span again for every row.
    """
    return _spans(rows, hours).where("not over").drop("over", "at")


def _spans(rows: DataFrame, hours: int) -> DataFrame:
    """``rows`` twice, as they begin and when they are ``over``, ``hours`` later, by ``at``; with ``in_span`` (of those that begin here)."""
    span = F.expr(f"interval {hours} hours")
    marks = F.array(F.struct(F.lit(False).alias("over"), F.col("ts").alias("at")), F.struct(F.lit(True).alias("over"), (F.col("ts") + span).alias("at")))
    twice = rows.repartition("ref").select("*", F.inline(marks))
    # all that begin at one time count there, and what is over at that time still does
    so_far = Window.partitionBy("ref").orderBy(F.col("at").asc_nulls_first(), "over").rangeBetween(Window.unboundedPreceding, 0)
    return twice.withColumn("in_span", F.sum(F.when(F.col("over"), -1).otherwise(1)).over(so_far))


def burst_profile(rows: DataFrame, hours: int) -> DataFrame:
    """By ref with at least two events at different times: ``n, peak, peak_start, expected, ratio``.

    The peak is the most events in any closed span; ``peak_start`` is the first
    event of the first such span. ``ratio`` is the peak over what an even rate
    would put into a span, that being EXPECTED_FLOOR at least.
    """
    # the first event of a span is the next one that will be over
    later = Window.partitionBy("ref").orderBy(F.col("at").desc_nulls_last(), F.desc("over")).rowsBetween(Window.unboundedPreceding, 0)
    spans = _spans(rows.select("ref", "ts"), hours).withColumn("begins", F.when(F.col("ts").isNotNull(), F.last(F.when(F.col("over"), F.col("ts")), ignorenulls=True).over(later))).where("not over")
    best = spans.groupBy("ref").agg(
        F.count(F.lit(1)).alias("n"), F.max("in_span").alias("peak"), F.min_by("begins", F.struct(-F.col("in_span"), F.col("begins"))).alias("peak_start"),
        (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))).alias("micros"),
    )
    expected = F.col("n") * (hours * 3_600_000_000) / F.col("micros")
    kept = best.where("n >= 2 and micros > 0").withColumn("expected", expected)
    return kept.select("ref", "n", "peak", "peak_start", F.round("expected", 3).alias("expected"), F.round(F.col("peak") / F.greatest("expected", F.lit(EXPECTED_FLOOR)), 2).alias("ratio"))


def leave_one_out(series: DataFrame, key: str, value: str) -> DataFrame:
    """``series`` with ``expected``: the mean of the key's other values; null where it is alone."""
    sums = series.groupBy(key).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    return series.join(sums, key).withColumn("expected", F.try_divide(F.col("_sum") - F.col(value), F.col("_n") - 1)).drop("_sum", "_n")


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place, from 1, in an order over all of them.

    Rows are dealt to ranges of the order and counted there; each range goes on
    from the sum of those before it. Only the counts, one a range, meet in a task.
    """
    part = materialise(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"))
    base = sizes.withColumn("_base", F.coalesce(F.sum("_c").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")  # a row a range
    here = part.withColumn("_here", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return here.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + F.col("_here")).drop("_part", "_base", "_here")


def false_discovery(tests: DataFrame, p: str, ties: list[str], alpha: float = 0.05, keys: list[str] | None = None) -> DataFrame:
    """``tests`` with ``kept``: all ranks up to the greatest k with p <= alpha k / n, by keys. Nulls aren't tests."""
    if not keys:
        ranked = materialise(numbered(tests, [F.asc_nulls_last(p), *[F.col(t) for t in ties]], "_rank"))
        n = F.count(p).alias("_n")
        last = ranked.join(F.broadcast(ranked.agg(n))).agg(F.max(F.when(F.col(p) <= alpha * F.col("_rank") / F.col("_n"), F.col("_rank"))).alias("_last"))
        return ranked.join(F.broadcast(last)).withColumn("kept", F.coalesce((F.col("_rank") <= F.col("_last")) & F.col(p).isNotNull(), F.lit(False))).drop("_rank", "_last")  # one row
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(p), *ties)
    whole = Window.partitionBy(*keys)
    ranked = tests.withColumn("_rank", F.row_number().over(order)).withColumn("_n", F.count(p).over(whole))
    last = F.max(F.when(F.col(p) <= alpha * F.col("_rank") / F.col("_n"), F.col("_rank"))).over(whole)
    return ranked.withColumn("kept", F.coalesce((F.col("_rank") <= last) & F.col(p).isNotNull(), F.lit(False))).drop("_rank", "_n")


def recent_and_baseline(daily: DataFrame, recent: int, baseline: int) -> DataFrame:
    """By lane, sums of the last ``recent`` observed days and of the ``baseline`` days before them: ``recent_n, recent_days, baseline_n, baseline_days``.

    The windows hang on the last day seen in any lane.
    """
    last = daily.agg(F.max("day").alias("last"))
    dated = daily.join(F.broadcast(last)).withColumn("age", F.datediff("last", "day"))  # one row
    near, far = F.col("age") < recent, (F.col("age") >= recent) & (F.col("age") < recent + baseline)
    return dated.groupBy("lane").agg(F.sum(F.when(near, F.col("total")).otherwise(0)).alias("recent_n"), F.lit(recent).alias("recent_days"), F.sum(F.when(far, F.col("total")).otherwise(0)).alias("baseline_n"), F.lit(baseline).alias("baseline_days"))


def previous_of(ledger: DataFrame, key: str, value: str, time: str, tie: str) -> DataFrame:
    """``ledger`` with ``previous``: the key's value at the latest time strictly before the row's (ties: greater ``tie``)."""
    per_time = ledger.groupBy(key, time).agg(F.max_by(value, tie).alias("_at"))
    before = per_time.withColumn("previous", F.lag("_at").over(Window.partitionBy(key).orderBy(time))).drop("_at")
    return ledger.join(before, [key, time])


def decay(age_days: Column, half_life: float = 30.0, least: float = 0.25) -> Column:
    """Recency weight: halves every ``half_life`` days, never under ``least``; future ages count as 0."""
    return F.greatest(F.lit(least), F.pow(F.lit(0.5), F.greatest(age_days, F.lit(0)) / half_life))


def allocate(existing: DataFrame, new: DataFrame, prefix: str, order: list[str], width: int = 7) -> DataFrame:
    """``new`` with ``code``: prefix and padded numbers that go on from the greatest there is (``code`` of ``existing``)."""
    top = existing.agg(F.coalesce(F.max(F.regexp_extract("code", r"(\d+)$", 1).try_cast("bigint")), F.lit(0)).alias("_top"))
    rows = numbered(new, [F.col(c) for c in order], "_n")
    return rows.join(F.broadcast(top)).withColumn("code", F.concat(F.lit(prefix), F.lpad((F.col("_top") + F.col("_n")).cast("string"), width, "0"))).drop("_n", "_top")


def replayed(events: DataFrame, until: Column | None = None) -> DataFrame:
    """Event sourcing: ``entity, field, value``, the last ``new_value`` at or before ``until``; ties by ``event_id``."""
    seen = events if until is None else events.where(F.col("occurred_at") <= until)
    return seen.groupBy("entity", "field").agg(F.max_by("new_value", F.struct("occurred_at", "event_id")).alias("value"))


def replay_breaks(events: DataFrame) -> DataFrame:
    """By entity, the first event whose ``old_value`` isn't what replay has for its field (fields not seen before can't break)."""
    order = Window.partitionBy("entity", "field").orderBy("occurred_at", "event_id")
    seen = events.withColumn("_was", F.lag("new_value").over(order)).withColumn("_n", F.row_number().over(order))
    broken = seen.where((F.col("_n") > 1) & ~F.col("_was").eqNullSafe(F.col("old_value")))
    return broken.groupBy("entity").agg(F.min_by(F.struct("event_id", "field", F.col("_was").alias("expected"), "old_value"), F.struct("occurred_at", "event_id")).alias("e")).select("entity", "e.*")
