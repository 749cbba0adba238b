"""Everything that is asked of time and of space in one answer each, within stated limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sleuthframe.operators import geo, sequences, statistics
from sleuthframe.plans.lineage import written

# Days of the window and of the baseline before it, and the most of each; reach and members of a cluster, reach of a hot spot, and their limits.
WINDOW_DAYS, BASELINE_DAYS, MOST_WINDOW, MOST_BASELINE = 30, 90, 365, 730
EPS_KM, LEAST_SAMPLES, BAND_KM = 75.0, 5, 250.0
LIMITS = {"eps_km": (1.0, 2000.0), "min_samples": (2, 500), "band_km": (10.0, 5000.0)}
VALUES = ("elevated_count", "entity_count", "assessed_count")


def within(name: str, value: float, least: float, most: float) -> None:
    if not least <= value <= most:
        raise ValueError(f"{name} must be between {least} and {most}, not {value}")


def temporal_analysis(daily: DataFrame, window_days: int = WINDOW_DAYS, baseline_days: int = BASELINE_DAYS) -> tuple[DataFrame, DataFrame]:
    """Change, trend, change point and week of every lane (``lane, day, total, elevated``), and each of its days.

    The window ends at the last day of any lane, not today; days without a row
    count 0 in every lane, so each series has ``window_days`` and ``baseline_days``.
    The first table has a row a lane: ``recent_n, baseline_n, ratio, ratio_low,
    ratio_high, change_p, direction``; ``trend_s, trend_z, trend_p, slope``;
    ``split_day, split_statistic, split_p``; ``busiest, quietest, weekly_p``;
    ``n_unusual``; nulls where something can't be told. The second has ``lane, day,
    total, elevated, in_window, unusual, unusual_direction, expected, p_value``.
    Limits that are passed are an error; without any day both are empty.
    """
    within("window_days", window_days, 1, MOST_WINDOW)
    within("baseline_days", baseline_days, 1, MOST_BASELINE)
    seen = daily.groupBy("lane", F.to_date("day").alias("day")).agg(F.sum("total").cast("long").alias("total"), F.sum("elevated").cast("long").alias("elevated"))
    last = F.broadcast(seen.agg(F.max("day").alias("last")).where("last is not null"))  # one row
    span = F.sequence(F.date_sub("last", window_days + baseline_days - 1), F.col("last"))
    grid = seen.select("lane").distinct().join(last).select("lane", "last", F.explode(span).alias("day"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    full = written(grid.join(seen, ["lane", "day"], "left").select("lane", "day", zero("total"), zero("elevated"), (F.datediff("last", "day") < window_days).alias("in_window")))
    series = full.select("lane", "day", "total")

    unusual = statistics.unusual_days(series).select("lane", "day", "expected", "p_value", "kept", "direction")
    flagged = F.coalesce("kept", F.lit(False))
    days = written(full.join(unusual, ["lane", "day"], "left").select("lane", "day", "total", "elevated", "in_window", flagged.alias("unusual"), F.when(flagged, F.col("direction")).alias("unusual_direction"), "expected", "p_value"))

    change = statistics.compare_rates(sequences.recent_and_baseline(series, window_days, baseline_days)).select("lane", "recent_n", "baseline_n", "ratio", "ratio_low", "ratio_high", F.col("p_value").alias("change_p"), "direction")
    trend = statistics.trend(series).select("lane", F.col("s").alias("trend_s"), F.col("z").alias("trend_z"), F.col("p_value").alias("trend_p"), "slope")
    split = statistics.change_points(series).select("lane", "split_day", F.col("statistic").alias("split_statistic"), F.col("p_value").alias("split_p"))
    week = statistics.weekly_pattern(series).select("lane", "busiest", "quietest", F.col("p_value").alias("weekly_p"))
    lanes = change
    for part in (trend, split, week, days.groupBy("lane").agg(F.count(F.when(F.col("unusual"), 1)).alias("n_unusual"))):
        lanes = lanes.join(part, "lane", "left")
    return lanes, days


def spatial_analysis(points: DataFrame, eps_km: float = EPS_KM, min_samples: int = LEAST_SAMPLES, band_km: float = BAND_KM, value: str = "elevated_count") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Concentrations of located points (``ref, lat, lng, country, region, band``), hot spots among countries, and what belongs to neither.

    Clusters are ``statistics.region_summaries`` of density clusters. Hot spots have
    a row a country with a centre: ``country, region, lat, lng, entity_count,
    elevated_count, assessed_count, value, n_near, z, p_value, kind``, tested on the
    count that ``value`` names. The last table is one row: ``located_total,
    n_clusters, noise`` (points in no cluster are told, not dropped). Limits that
    are passed, and other values, are an error.
    """
    for name, given in (("eps_km", eps_km), ("min_samples", min_samples), ("band_km", band_km)):
        within(name, given, *LIMITS[name])
    if value not in VALUES:
        raise ValueError(f"value must be one of {', '.join(VALUES)}, not {value}")
    located = points.where("lat is not null and lng is not null")
    labels = written(statistics.dense_regions(located.select("ref", "lat", "lng"), eps_km, min_samples))
    clusters = statistics.region_summaries(located, labels)
    totals = labels.agg(F.count(F.lit(1)).alias("located_total"), F.countDistinct("cluster").alias("n_clusters"), F.count(F.when(F.col("cluster").isNull(), 1)).alias("noise"))
    counts = points.groupBy("country").agg(F.min("region").alias("region"), F.count(F.lit(1)).alias("entity_count"), F.count(F.when(F.col("band") == "elevated", 1)).alias("elevated_count"), F.count("band").alias("assessed_count"))
    places = written(counts.join(geo.centroids(points, "country").where("lat is not null").select("country", "lat", "lng"), "country"))
    hot = statistics.hot_spots(places.withColumn("ref", F.col("country")), value, band_km).withColumnRenamed("ref", "country")
    return clusters, places.join(hot, "country"), totals
