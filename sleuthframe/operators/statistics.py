"""Is it significant, where is it concentrated: tests over aggregated counts and located points.

Each test says with ``evaluable`` whether it could be made at all; a result that couldn't be is null, never zero.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sleuthframe.functions import distributions as dist
from sleuthframe.operators import geo
from sleuthframe.operators.components import connected_components
from sleuthframe.operators.sequences import false_discovery, leave_one_out
from sleuthframe.plans.lineage import materialise

ALPHA = 0.05
#: Shuffles of a change-point test, and their seed.
SHUFFLES, SEED = 2000, 42
#: Days a series needs for a trend or change point, and events for a weekly pattern.
LEAST_DAYS, LEAST_EVENTS = 12, 35


def compare_rates(counts: DataFrame) -> DataFrame:
    """Exact test of two Poisson rates: ``recent_n, recent_days, baseline_n, baseline_days`` get ``evaluable, ratio, ratio_low, ratio_high, p_value, direction``.

    Given their sum the recent count is binomial; its exact interval gives the
    ratio's. With no events at all nothing is evaluable; without any in the
    baseline the ratio is infinite.
    """

    @F.pandas_udf("p double, low double, high double")
    def test(k: pd.Series, days: pd.Series, k0: pd.Series, days0: pd.Series) -> pd.DataFrame:
        rows = []
        for a, d, b, d0 in zip(k, days, k0, days0, strict=True):
            if a + b == 0:
                rows.append((None, None, None))
                continue
            low, high = dist.clopper_pearson(int(a), int(a + b))
            odds = lambda p, d=d, d0=d0: float("inf") if p >= 1 else p / (1 - p) * d0 / d
            rows.append((dist.binomial_two_sided(int(a), int(a + b), d / (d + d0)), odds(low), odds(high)))
        return pd.DataFrame(rows, columns=["p", "low", "high"], dtype=float)

    tested = counts.withColumn("evaluable", F.col("recent_n") + F.col("baseline_n") > 0).withColumn("t", test("recent_n", "recent_days", "baseline_n", "baseline_days"))
    ratio = F.when(~F.col("evaluable"), None).when(F.col("baseline_n") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("recent_n") * F.col("baseline_days"), F.col("baseline_n") * F.col("recent_days")))
    tested = tested.withColumn("ratio", ratio).withColumns({"ratio_low": F.col("t.low"), "ratio_high": F.col("t.high"), "p_value": F.col("t.p")}).drop("t")
    return tested.withColumn("direction", F.when(~F.col("evaluable"), None).when(F.col("p_value") >= ALPHA, "unchanged").when(F.col("ratio") > 1, "increase").otherwise("decrease"))


def unusual_days(daily: DataFrame) -> DataFrame:
    """``lane, day, total, expected, p_value, kept, direction``: each day against the mean of the lane's others.

    Poisson tails, false discoveries held at ALPHA within the lane. Lanes of
    fewer than three days give no rows.
    """

    @F.pandas_udf("double")
    def tail(x: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([dist.poisson_two_sided(int(a), b) for a, b in zip(x, mean, strict=True)])

    long = daily.groupBy("lane").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select("lane")
    tested = leave_one_out(daily.join(long, "lane", "left_semi"), "lane", "total").withColumn("p_value", tail("total", "expected"))
    kept = false_discovery(tested, "p_value", ["day"], ALPHA, ["lane"])
    return kept.select("lane", "day", "total", "expected", "p_value", "kept", F.when(F.col("total") > F.col("expected"), "high").otherwise("low").alias("direction"))


def trend(daily: DataFrame) -> DataFrame:
    """Mann-Kendall and Sen by lane: ``lane, n, s, z, p_value, slope, evaluable``; needs LEAST_DAYS days that aren't all equal.

    Pairs are formed within a lane, whose length is a number of days.
    """
    at = daily.withColumn("i", F.row_number().over(Window.partitionBy("lane").orderBy("day"))).select("lane", "i", "total")
    pair = at.alias("a").join(at.alias("b"), (F.col("a.lane") == F.col("b.lane")) & (F.col("a.i") < F.col("b.i")))
    sums = pair.groupBy(F.col("a.lane").alias("lane")).agg(F.sum(F.signum(F.col("b.total") - F.col("a.total"))).cast("long").alias("s"), F.median((F.col("b.total") - F.col("a.total")) / (F.col("b.i") - F.col("a.i"))).alias("slope"))
    tied = at.groupBy("lane", "total").agg(F.count(F.lit(1)).alias("c")).groupBy("lane").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("c") * (F.col("c") - 1) * (2 * F.col("c") + 5)).alias("ties"))
    joined = tied.join(sums, "lane", "left").withColumn("evaluable", (F.col("n") >= LEAST_DAYS) & (F.col("kinds") > 1))
    spread = F.sqrt((F.col("n") * (F.col("n") - 1) * (2 * F.col("n") + 5) - F.col("ties")) / 18)
    z = F.when(F.col("evaluable"), (F.col("s") - F.signum("s")) / spread)

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(dist.normal_two_sided, na_action="ignore")

    slope = F.when(F.col("evaluable"), F.col("slope"))
    return joined.withColumn("z", z).select("lane", "n", F.when(F.col("evaluable"), F.col("s")).alias("s"), "z", tail("z").alias("p_value"), slope.alias("slope"), "evaluable")


def change_points(daily: DataFrame, edge: int = 3) -> DataFrame:
    """By lane the split with the greatest mean difference, weighted by both sides: ``lane, n, split_day, statistic, p_value, evaluable``.

    The first of equal splits counts. p: share of SHUFFLES seeded shuffles that
    split at least as well. A lane, one number a day, is one task's work.
    """

    def best(values: np.ndarray) -> np.ndarray:
        n = values.shape[-1]
        k = np.arange(edge, n - edge)
        left = np.cumsum(values, axis=-1)[..., k - 1]
        total = values.sum(-1, keepdims=True)
        return np.abs(left / k - (total - left) / (n - k)) * np.sqrt(k * (n - k) / n)

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day")
        x, lane = frame["total"].to_numpy(float), frame["lane"].iloc[0]
        if len(x) < LEAST_DAYS or x.std() == 0:
            return pd.DataFrame({"lane": [lane], "n": [len(x)], "split_day": [None], "statistic": [None], "p_value": [None], "evaluable": [False]})
        found = best(x)
        at = int(found.argmax())
        draw = np.random.default_rng(SEED)
        exceed = sum(best(draw.permutation(x)).max() >= found[at] for _ in range(SHUFFLES))
        return pd.DataFrame({"lane": [lane], "n": [len(x)], "split_day": [frame["day"].iloc[at + edge]], "statistic": [found[at]], "p_value": [(exceed + 1) / (SHUFFLES + 1)], "evaluable": [True]})

    return daily.select("lane", F.to_date("day").alias("day"), "total").groupBy("lane").applyInPandas(judge, "lane string, n long, split_day date, statistic double, p_value double, evaluable boolean")


def weekly_pattern(daily: DataFrame) -> DataFrame:
    """Chi-square of weekdays against evenness by lane: ``lane, n, statistic, p_value, busiest, quietest, evaluable`` (Monday 0)."""
    by_day = daily.groupBy("lane").agg(F.sum("total").alias("n"), *[F.sum(F.when(F.weekday("day") == k, F.col("total")).otherwise(0)).alias(f"d{k}") for k in range(7)])
    days = F.array(*[F.col(f"d{k}") for k in range(7)])
    squares = sum(F.pow(F.col(f"d{k}") - F.col("n") / 7, 2) for k in range(7)) / (F.col("n") / 7)
    evaluable = F.col("n") >= LEAST_EVENTS

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda x: dist.chi_square_tail(x, 6), na_action="ignore")

    found = by_day.withColumn("statistic", F.when(evaluable, squares)).withColumn("evaluable", evaluable)
    place = lambda f: F.when(evaluable, F.array_position(days, f(days)) - 1)
    return found.select("lane", "n", "statistic", tail("statistic").alias("p_value"), place(F.array_max).alias("busiest"), place(F.array_min).alias("quietest"), "evaluable")


def dense_regions(points: DataFrame, km: float = 75.0, least: int = 5) -> DataFrame:
    """Density clusters of located points (``ref, lat, lng``): ``ref, cluster, core``; noise has a null cluster.

    A point with ``least`` points within ``km``, itself included, is a core;
    cores within ``km`` of each other share a cluster, named after its least
    core; another point near a core joins the least such cluster. Neighbours are
    found by grid cell, clusters by contraction.
    """
    located = points.where("lat is not null and lng is not null").select("ref", "lat", "lng")
    places = materialise(located.groupBy("lat", "lng").agg(F.min("ref").alias("ref"), F.count(F.lit(1)).alias("n")))  # points in one place have the same neighbours
    near = materialise(geo.within_km(places, places, km).join(places.select(F.col("ref").alias("b"), "n"), "b"))
    core = materialise(near.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("a"))
    links = near.select("a", "b").join(core, "a", "left_semi")
    inner = links.join(core.select(F.col("a").alias("b")), "b", "left_semi")
    found = connected_components(inner)
    alone = core.join(found.select(F.col("node").alias("a")), "a", "left_anti").select(F.col("a").alias("node"), F.col("a").alias("component"))
    cores = materialise(found.unionByName(alone))
    border = links.join(cores.select(F.col("node").alias("a"), "component"), "a").groupBy(F.col("b").alias("ref")).agg(F.min("component").alias("near_cluster"))
    named = places.join(cores.select(F.col("node").alias("ref"), "component"), "ref", "left").join(border, "ref", "left")
    named = named.select("lat", "lng", F.coalesce("component", "near_cluster").alias("cluster"), F.col("component").isNotNull().alias("core"))
    return located.join(named, ["lat", "lng"]).select("ref", "cluster", "core")


def region_summaries(points: DataFrame, labels: DataFrame) -> DataFrame:
    """By cluster: size, centre, greatest and mean distance from it, countries, elevated and assessed, density per 1000 square km."""
    rows = points.join(labels.where("cluster is not null").select("ref", "cluster"), "ref")
    middle = geo.centroids(rows, "cluster").select("cluster", F.col("lat").alias("c_lat"), F.col("lng").alias("c_lng"))
    away = rows.join(middle, "cluster").withColumn("km", geo.haversine_km(F.col("lat"), F.col("lng"), F.col("c_lat"), F.col("c_lng")))
    sums = away.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("size"), F.first("c_lat").alias("lat"), F.first("c_lng").alias("lng"), F.max("km").alias("radius_km"), F.avg("km").alias("mean_km"),
        F.countDistinct("country").alias("n_countries"), F.count_if(F.col("band") == "elevated").alias("n_elevated"), F.count("band").alias("n_assessed"),
    )
    area = F.lit(np.pi) * F.pow(F.greatest("radius_km", F.lit(1.0)), 2) / 1000
    return sums.withColumns({"crosses_border": F.col("n_countries") > 1, "density": F.col("size") / area})


def hot_spots(points: DataFrame, value: str, km: float, least: int = 8) -> DataFrame:
    """Getis-Ord Gi* with binary weights: ``ref, value, n_near, z, p_value, kind``; kind is hot, cold, none, or null if not evaluable.

    Needs ``least`` located points whose values differ. False discoveries are held at ALPHA.
    """
    located = points.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col(value).isNotNull()).select("ref", "lat", "lng", F.col(value).cast("double").alias("value"))
    whole = located.agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("s"))
    places = materialise(located.groupBy("lat", "lng").agg(F.min("ref").alias("ref"), F.count(F.lit(1)).alias("c"), F.sum("value").alias("v")))  # points in one place have the same neighbours
    near = geo.within_km(places, places, km).join(places.select(F.col("ref").alias("b"), "c", "v"), "b")
    sums = near.groupBy(F.col("a").alias("ref")).agg(F.sum("c").alias("w"), F.sum("v").alias("wx")).join(places.select("ref", "lat", "lng"), "ref").drop("ref")
    rows = located.join(sums, ["lat", "lng"]).drop("lat", "lng").join(F.broadcast(whole))  # one row
    below = F.col("s") * F.sqrt(F.greatest(F.lit(1e-12), (F.col("n") * F.col("w") - F.col("w") * F.col("w")) / (F.col("n") - 1)))
    z = F.when((F.col("n") >= least) & (F.col("s") > 0), (F.col("wx") - F.col("mean") * F.col("w")) / below)

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(dist.normal_two_sided, na_action="ignore")

    tested = false_discovery(rows.withColumn("z", z).withColumn("p_value", tail("z")), "p_value", ["ref"], ALPHA)
    kind = F.when(F.col("z").isNull(), None).when(~F.col("kept"), "none").when(F.col("z") > 0, "hot").otherwise("cold")
    return tested.select("ref", "value", F.col("w").alias("n_near"), "z", "p_value", kind.alias("kind"))


def isolation_forest(sample: np.ndarray, trees: int = 200, size: int = 256, seed: int = SEED) -> list[list[tuple]]:
    """Random split trees over a bounded sample: nodes (feature, cut, left, right) or (-1, rows, 0, 0)."""
    draw, forest = np.random.default_rng(seed), []
    size = min(size, len(sample))
    limit = int(np.ceil(np.log2(max(2, size))))
    for _ in range(trees):
        nodes: list[tuple] = [()]
        todo = [(0, sample[draw.choice(len(sample), size, replace=False)], 0)]
        while todo:
            at, rows, depth = todo.pop()
            span = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) else []
            if depth >= limit or len(rows) <= 1 or not len(span):
                nodes[at] = (-1, float(len(rows)), 0, 0)
                continue
            feature = int(draw.choice(span))
            cut = float(draw.uniform(rows[:, feature].min(), rows[:, feature].max()))
            nodes[at] = (feature, cut, len(nodes), len(nodes) + 1)
            nodes += [(), ()]
            left = rows[:, feature] < cut
            todo += [(len(nodes) - 2, rows[left], depth + 1), (len(nodes) - 1, rows[~left], depth + 1)]
        forest.append(nodes)
    return forest


def _mean_path(n: float) -> float:
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else float(n > 1)


def anomalies(rows: DataFrame, features: list[str], least: int = 10, limit: float = 3.0, most: int = 20_000) -> DataFrame:
    """``ref, z, isolation, flagged``: outliers by both a z-score and an isolation forest.

    ``z`` is the greatest deviation of any feature from its mean over all rows
    (population sigma). The forest is grown on at most about ``most`` rows, as
    its trees take 256 each, and scores every row in tasks. Flagged: isolation
    over 0.5 and z of ``limit`` or more. Fewer than ``least`` rows give none.
    """
    moments = rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]).first()
    kind = rows.schema["ref"].dataType.simpleString()
    if moments["n"] < least:
        return rows.where(F.lit(False)).select("ref", F.lit(0.0).alias("z"), F.lit(0.0).alias("isolation"), F.lit(False).alias("flagged"))
    part = rows if moments["n"] <= most else rows.where(F.xxhash64("ref") <= F.lit((most << 64) // moments["n"] - (1 << 63)))  # a share of the 64-bit hashes
    sample = part.orderBy("ref").select(*features).toPandas().to_numpy(float)
    shared = rows.sparkSession.sparkContext.broadcast((isolation_forest(sample), _mean_path(min(256, len(sample)))))
    means = np.array([moments[f"m_{f}"] for f in features])
    spread = np.array([moments[f"s_{f}"] or np.inf for f in features])

    def judge(frames):
        forest, mean = shared.value
        for frame in frames:
            x = frame[features].to_numpy(float)
            depth = np.zeros(len(x))
            for nodes in forest:
                table = np.array(nodes)
                at, steps = np.zeros(len(x), np.int64), np.zeros(len(x))
                while (inner := table[at, 0] >= 0).any():
                    f = table[at, 0].astype(np.int64)
                    left = x[np.arange(len(x)), np.maximum(f, 0)] < table[at, 1]
                    at = np.where(inner, np.where(left, table[at, 2], table[at, 3]).astype(np.int64), at)
                    steps += inner
                depth += steps + np.array([_mean_path(n) for n in table[at, 1]])
            isolation = 2 ** (-depth / len(forest) / mean)
            z = (np.abs(x - means) / spread).max(1)
            yield pd.DataFrame({"ref": frame["ref"], "z": z, "isolation": isolation, "flagged": (isolation > 0.5) & (z >= limit)})

    return rows.select("ref", *features).mapInPandas(judge, f"ref {kind}, z double, isolation double, flagged boolean")
