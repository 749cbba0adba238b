"""Distances and centres on the sphere, as column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sleuthframe.plans.lineage import written

# Fixed value: mean radius of the Earth in km.
EARTH_KM = 6371.0088
#: Below this length the mean of unit vectors has no direction.
NO_DIRECTION = 1e-12
#: Points of a block on either side, how many of them are held against the others at a time, and tasks at most.
BLOCK, AT_A_TIME, MOST_TASKS = 2_048, 256, 4_096


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def centroids(points: DataFrame, *keys: str) -> DataFrame:
    """By ``keys``, the spherical mean of ``lat, lng``: ``n_located, lat, lng`` (nulls where opposite points cancel out)."""
    rad = points.where("lat is not null and lng is not null").withColumns({"_a": F.radians("lat"), "_b": F.radians("lng")})
    x, y, z = F.avg(F.cos("_a") * F.cos("_b")), F.avg(F.cos("_a") * F.sin("_b")), F.avg(F.sin("_a"))
    means = rad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_located"), x.alias("_x"), y.alias("_y"), z.alias("_z"))
    none = (F.abs("_x") < NO_DIRECTION) & (F.abs("_y") < NO_DIRECTION) & (F.abs("_z") < NO_DIRECTION)
    lat = F.when(~none, F.degrees(F.atan2("_z", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))))
    return means.select(*keys, "n_located", lat.alias("lat"), F.when(~none, F.degrees(F.atan2("_y", "_x"))).alias("lng"))


def cell(lat: Column, lng: Column, km: float) -> Column:
    """The grid cell of a point: rows of ``km`` height, split so that every cell is at least ``km`` wide.

    Columns follow the row's edge that is nearer to the pole, so two points
    within ``km`` are at most one row and (in the row's own columns) one column apart.
    """
    row = F.floor(F.radians(lat) * EARTH_KM / km)
    return F.struct(row.alias("row"), F.floor(lng / column_degrees(row, km)).alias("col"))


def column_degrees(row: Column, km: float) -> Column:
    """Degrees of longitude that are at least ``km`` anywhere in a grid row and the rows beside it."""
    edge = (F.greatest(F.abs(row), F.abs(row + 1)) + 1) * km / EARTH_KM
    return F.least(F.lit(360.0), F.degrees(F.lit(km / EARTH_KM)) / F.greatest(F.cos(F.least(edge, F.lit(1.5707))), F.lit(1e-4)) * 1.01)


def _near_block(km: float, ordered: bool, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """``a, b, km`` of a block of points (``ref, lat, lng``) and another that are at most ``km`` apart.

    The product of their unit vectors picks those that may be; their distance is worked out as by ``haversine_km``.
    """
    refs, others = left["ref"].to_numpy(), right["ref"].to_numpy()
    lat1, lng1, lat2, lng2 = (df[c].to_numpy() for df in (left, right) for c in ("lat", "lng"))
    unit = lambda lat, lng: (np.cos(np.radians(lat)) * np.cos(np.radians(lng)), np.cos(np.radians(lat)) * np.sin(np.radians(lng)), np.sin(np.radians(lat)))
    u, v, c1, c2 = unit(lat1, lng1), unit(lat2, lng2), np.cos(np.radians(lat1)), np.cos(np.radians(lat2))
    least, out = math.cos(min(math.pi, km / EARTH_KM)) - 1e-9, []
    for at in range(0, len(refs), AT_A_TIME):
        i, j = np.nonzero(sum(np.multiply.outer(x[at : at + AT_A_TIME], y) for x, y in zip(u, v)) >= least)
        i = i + at
        if ordered:
            first = refs[i] < others[j]
            i, j = i[first], j[first]
        x, y = np.sin(np.radians(lat2[j] - lat1[i]) / 2), np.sin(np.radians(lng2[j] - lng1[i]) / 2)
        far = 2 * EARTH_KM * np.arcsin(np.minimum(1.0, np.sqrt(x * x + c1[i] * c2[j] * (y * y))))
        near = far <= km
        out.append(pd.DataFrame({"a": refs[i[near]], "b": others[j[near]], "km": far[near]}))
    return pd.concat(out) if out else pd.DataFrame({"a": refs[:0], "b": others[:0], "km": np.empty(0)})


def within_km(left: DataFrame, right: DataFrame, km: float, ordered: bool = False) -> DataFrame:
    """Pairs of located rows (``ref, lat, lng``) at most ``km`` apart: ``a, b, km``; ``ordered``: only those with a < b.

    The right side is dealt to the three rows and three columns around, in each
    row by that row's own columns (and around the date line); the pairs then meet
    by cell, each in one, and are verified. No side is paired with all of the
    other, and a cell of many points is many blocks of BLOCK by BLOCK, of which a
    task holds one.
    """
    kinds = left.schema["ref"].dataType.simpleString(), right.schema["ref"].dataType.simpleString()
    packed = lambda row, col: row * 4294967296 + col
    place = cell(F.col("lat"), F.col("lng"), km)
    doubles = [F.col(c).cast("double").alias(c) for c in ("lat", "lng")]
    left = left.where("lat is not null and lng is not null").select("ref", *doubles).withColumn("cell", packed(place["row"], place["col"]))
    near = right.where("lat is not null and lng is not null").select("ref", *doubles, F.explode(F.sequence(F.lit(-1), F.lit(1))).alias("_dr"))
    near = near.withColumn("_row", F.floor(F.radians("lat") * EARTH_KM / km) + F.col("_dr"))
    width = column_degrees(F.col("_row"), km)
    turns = F.array(F.col("lng"), F.col("lng") - 360, F.col("lng") + 360)
    columns = F.flatten(F.transform(turns, lambda x: F.sequence(F.floor(x / width) - 1, F.floor(x / width) + 1)))
    last, first = F.floor(F.lit(180.0) / width), F.floor(F.lit(-180.0) / width)
    columns = F.array_distinct(F.filter(columns, lambda c: (c >= first) & (c <= last)))
    near = near.select("ref", "lat", "lng", "_row", F.explode(columns).alias("_col")).withColumn("cell", packed(F.col("_row"), F.col("_col"))).drop("_row", "_col")
    left, near = written(left), written(near)
    sizes = lambda df, n: df.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(n))
    cells = written(sizes(left, "down").join(sizes(near, "across"), "cell"))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, cells.agg(F.sum(F.col("down") * F.col("across"))).first()[0] or 0))
    own = lambda n: F.pmod(F.xxhash64("ref"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = left.join(cells, "cell").select("cell", own("down").alias("i"), every("across").alias("j"), "ref", "lat", "lng").repartition(tasks, "cell", "i", "j")
    others = near.join(cells, "cell").select("cell", every("down").alias("i"), own("across").alias("j"), "ref", "lat", "lng").repartition(tasks, "cell", "i", "j")
    block = lambda x, y: _near_block(km, ordered, x, y)
    return rows.groupBy("cell", "i", "j").cogroup(others.groupBy("cell", "i", "j")).applyInPandas(block, f"a {kinds[0]}, b {kinds[1]}, km double")
