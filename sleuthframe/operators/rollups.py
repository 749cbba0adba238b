"""Rollups with their denominators: counts, corridors, calendars, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.operators import geo
from sleuthframe.plans.lineage import materialise

UNASSESSED = "unassessed"


def both_ways(edges: DataFrame) -> DataFrame:
    """Undirected reading of ``src, dst, ...``: each edge from either end, with ``outgoing``."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("ref"), F.col("dst").alias("other"), F.lit(True).alias("outgoing"), *rest)
    back = edges.select(F.col("dst").alias("ref"), F.col("src").alias("other"), F.lit(False).alias("outgoing"), *rest)
    return there.unionByName(back)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``ref, degree`` of every node, zero included; a self-edge counts at both of its ends."""
    counts = both_ways(edges.select("src", "dst")).groupBy("ref").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("ref").join(counts, "ref", "left").select("ref", F.coalesce("degree", F.lit(0)).alias("degree"))


def connections_by(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """``ref, label, n``: how many different neighbours of each label a node has."""
    other = nodes.select(F.col("ref").alias("other"), F.col(label).alias("label"))
    pairs = both_ways(edges.select("src", "dst")).select("ref", "other").distinct()
    return pairs.join(other, "other").groupBy("ref", "label").agg(F.count(F.lit(1)).alias("n"))


def region_rollup(nodes: DataFrame, routes: DataFrame) -> DataFrame:
    """By region: nodes, elevated and assessed ones, countries, and flagged routes that begin or end there."""
    counts = nodes.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("band") == "elevated").alias("n_elevated"), F.count("band").alias("n_assessed"), F.countDistinct("country").alias("n_countries")
    )
    ends = routes.where("flagged").select(F.explode(F.array_distinct(F.array("origin", "destination"))).alias("region"))
    flagged = ends.groupBy("region").agg(F.count(F.lit(1)).alias("n_flagged_routes"))
    return counts.join(flagged, "region", "left").withColumn("n_flagged_routes", F.coalesce("n_flagged_routes", F.lit(0)))


def country_rollup(nodes: DataFrame) -> DataFrame:
    """By country: counts and the spherical centre of all its located nodes."""
    counts = nodes.groupBy("country").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("band") == "elevated").alias("n_elevated"))
    return counts.join(geo.centroids(nodes, "country"), "country", "left")


def corridor_rollup(routes: DataFrame) -> DataFrame:
    """Undirected pairs of different regions: ``n, n_flagged, n_unassessed`` and the flagged share of the assessed (null if none)."""
    pairs = routes.where(F.col("origin") != F.col("destination")).groupBy(F.least("origin", "destination").alias("region_a"), F.greatest("origin", "destination").alias("region_b"))
    counts = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"), F.count_if(F.col("flagged").isNull()).alias("n_unassessed"))
    return counts.withColumn("flagged_rate", F.round(F.try_divide("n_flagged", F.col("n") - F.col("n_unassessed")), 3))


def corridor_shares(routes: DataFrame) -> DataFrame:
    """Each directed (origin, destination) and its share of all routes."""
    counts = routes.groupBy("origin", "destination").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("origin", "destination", "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def daily_counts(rows: DataFrame, elevated: Column) -> DataFrame:
    """``lane, day, total, elevated`` from ``lane, ts``; rows without a day are left out."""
    day = rows.withColumn("day", F.to_date("ts")).where("day is not null")
    return day.groupBy("lane", "day").agg(F.count(F.lit(1)).alias("total"), F.count_if(elevated).alias("elevated"))


def densified(daily: DataFrame) -> DataFrame:
    """Zero-filled calendar: every lane has every day from the first to the last of any lane."""
    span = daily.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null")
    days = span.select(F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    frame = daily.select("lane").distinct().join(F.broadcast(days))  # one row a day
    return frame.join(daily, ["lane", "day"], "left").select("lane", "day", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("elevated", F.lit(0)).alias("elevated"))


def band_distribution(nodes: DataFrame, domain: tuple[str, ...]) -> DataFrame:
    """``band, n`` over the whole domain, zeros and the unassessed included."""
    counts = nodes.groupBy(F.coalesce("band", F.lit(UNASSESSED)).alias("band")).agg(F.count(F.lit(1)).alias("n"))
    bands = nodes.sparkSession.createDataFrame([(b,) for b in domain], "band string")
    return bands.join(counts, "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("n"))


def latest_per(ledger: DataFrame, key: str, time: str = "computed_at", tie: str = "id") -> DataFrame:
    """The newest row of each key, ties by the greater ``tie``. Reduced before it is shuffled, so a hot key costs one row a task."""
    rest = [c for c in ledger.columns if c != key]
    best = ledger.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_row"))
    return best.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def volume_baseline(batches: DataFrame, key: str, last: int = 20) -> DataFrame:
    """Mean and population deviation of ``n`` over the last batches of each key (``finished_at``, ties by ``id``)."""
    order = Window.partitionBy(key).orderBy(F.desc_nulls_last("finished_at"), F.desc("id"))
    kept = batches.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= last)
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("samples"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("deviation"))


def nearest_rank(values: DataFrame, key: str, value: str, fractions: dict[str, float]) -> DataFrame:
    """By key, the smallest value with at least the fraction of values at or below it; nulls are left out."""
    parts = [F.expr(f"percentile_disc({f}) within group (order by {value})").alias(name) for name, f in fractions.items()]
    return values.where(F.col(value).isNotNull()).groupBy(key).agg(*parts)


def rank_of(values: DataFrame, value: str) -> DataFrame:
    """``values`` with ``rank``: the fraction of all values strictly below.

    Counts are taken by value first, and by ranges of values; only a sum a range
    meets in one task.
    """
    counts = materialise(values.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("_part").agg(F.sum("_n").alias("_sum"))
    base = base.select("_part", F.coalesce(F.sum("_sum").over(before().orderBy("_part")), F.lit(0)).alias("_base"), F.sum("_sum").over(Window.partitionBy()).alias("_total"))  # a row a range
    here = counts.withColumn("_here", F.coalesce(F.sum("_n").over(before("_part").orderBy(value)), F.lit(0))).join(F.broadcast(base), "_part")
    return values.join(here.select(value, ((F.col("_base") + F.col("_here")) / F.col("_total")).alias("rank")), value)


def nested(parent: DataFrame, child: DataFrame, key: str, order: list[Column], fields: list[str], name: str, most: int | None = None) -> DataFrame:
    """``parent`` with an ordered array of its child rows (empty if none), at most ``most`` of them."""
    if most is not None:  # before they are gathered
        child = child.withColumn("_at", F.row_number().over(Window.partitionBy(key).orderBy(*order, *fields))).where(F.col("_at") <= most).drop("_at")
    sort = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("v"))
    lists = child.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(sort)), lambda s: s["v"]).alias(name))
    joined = parent.join(lists, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))
