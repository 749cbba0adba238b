"""Time and space in one answer: what is put together, limits, and nothing to analyse."""

import datetime
import math
import random

import pytest

from sleuthframe.operators import patterns

DAY = datetime.date(2024, 6, 30)


def lanes(spark):
    rng = random.Random(5)
    rows = [("calls", DAY - datetime.timedelta(k), 20 + rng.randrange(5) + (60 if k == 3 else 0), 1) for k in range(0, 120) if k % 7]
    rows += [("meets", DAY - datetime.timedelta(k), 2 + (k < 30) * 3, 0) for k in range(2, 200)] + [("quiet", DAY - datetime.timedelta(500), 9, 9), ("calls", DAY - datetime.timedelta(1), 5, 2)]
    return rows, spark.createDataFrame(rows, "lane string, day date, total long, elevated long")


def test_time_in_one_answer(spark):
    rows, table = lanes(spark)
    found, days = patterns.temporal_analysis(table)
    by_lane = {r["lane"]: r for r in found.collect()}
    last = max(d for _, d, _, _ in rows)
    series = {lane: [sum(t for x, d, t, _ in rows if x == lane and d == last - datetime.timedelta(k)) for k in range(119, -1, -1)] for lane in ("calls", "meets", "quiet")}
    for lane, values in series.items():
        assert (by_lane[lane]["recent_n"], by_lane[lane]["baseline_n"]) == (sum(values[90:]), sum(values[:90]))
        got = sorted((r["day"], r["total"], r["in_window"]) for r in days.where(f"lane = '{lane}'").collect())
        assert got == [(last - datetime.timedelta(119 - i), v, i >= 90) for i, v in enumerate(values)]
    assert by_lane["meets"]["direction"] == "increase" and by_lane["meets"]["trend_s"] > 0 and by_lane["meets"]["split_day"] == DAY - datetime.timedelta(29)
    unusual = [(r["lane"], r["day"], r["unusual_direction"]) for r in days.where("unusual").collect()]
    assert ("calls", DAY - datetime.timedelta(3), "high") in unusual and by_lane["calls"]["n_unusual"] == sum(x[0] == "calls" for x in unusual)
    assert by_lane["quiet"]["direction"] is None and by_lane["quiet"]["trend_s"] is None and by_lane["quiet"]["busiest"] is None  # nothing in the window at all


def test_space_in_one_answer(spark):
    rng = random.Random(6)
    rows = [(i, 10 * (i % 10) + rng.random() / 10, 5.0 * (i % 10), f"C{i % 10}", f"R{i % 2}", "elevated" if i % 10 < 2 or rng.random() < 0.1 else ("routine" if i % 3 else None)) for i in range(200)]
    rows += [(900, -80.0, 170.0, "C0", "R0", None), (901, None, None, "C1", "R1", "elevated")]
    table = spark.createDataFrame(rows, "ref long, lat double, lng double, country string, region string, band string")
    clusters, hot, totals = patterns.spatial_analysis(table, 50.0, 5, 1500.0)
    assert tuple(totals.first()) == (201, 10, 1) and clusters.count() == 10 and sum(r["size"] for r in clusters.collect()) == 200
    rows_hot = {r["country"]: r for r in hot.collect()}
    for c in range(10):
        own = [r for r in rows if r[3] == f"C{c}"]
        assert (rows_hot[f"C{c}"]["entity_count"], rows_hot[f"C{c}"]["elevated_count"], rows_hot[f"C{c}"]["assessed_count"]) == (len(own), sum(r[5] == "elevated" for r in own), sum(r[5] is not None for r in own))
    values = [rows_hot[f"C{c}"]["elevated_count"] for c in range(10)]
    mean, sd = sum(values) / 10, math.sqrt(sum(v * v for v in values) / 10 - (sum(values) / 10) ** 2)
    near = (4, 5, 6)  # about 1,200 km apart
    r, n_near = rows_hot["C5"], len(near)
    assert r["n_near"] == n_near and r["z"] == pytest.approx((sum(values[c] for c in near) - mean * n_near) / (sd * math.sqrt((10 * n_near - n_near**2) / 9)), rel=1e-6)


@pytest.mark.parametrize("limits", [{"window_days": 0}, {"window_days": 366}, {"baseline_days": 731}])
def test_limits_of_time(spark, limits):
    with pytest.raises(ValueError, match=next(iter(limits))):
        patterns.temporal_analysis(lanes(spark)[1], **limits)


@pytest.mark.parametrize("limits", [{"eps_km": 0.5}, {"min_samples": 1}, {"band_km": 5001.0}, {"value": "balance"}])
def test_limits_of_space(spark, limits):
    none = spark.createDataFrame([], "ref long, lat double, lng double, country string, region string, band string")
    with pytest.raises(ValueError, match=next(iter(limits))):
        patterns.spatial_analysis(none, **limits)


def test_nothing_to_analyse(spark):
    found, days = patterns.temporal_analysis(spark.createDataFrame([], "lane string, day date, total long, elevated long"))
    assert found.count() == 0 and days.count() == 0
