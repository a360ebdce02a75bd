"""Interpolation by ranges of the key's values, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnlight.operators import geometry
from firnlight.operators.along import in_ranges
from tests.test_queries import SF, windows_of


def by_hand(points, fixes, extrapolate):
    """{(key, id): value} of points (key, id, t) and fixes (key, t, v)."""
    out = {}
    for key, i, t in points:
        mine = sorted({f[1]: f[2] for f in fixes if f[0] == key and f[1] is not None and f[2] is not None}.items())
        if t is None or not mine:
            out[key, i] = None
            continue
        ts, vs = np.array(mine, float).T
        if t in ts:
            out[key, i] = vs[list(ts).index(t)]
        elif ts[0] < t < ts[-1]:
            out[key, i] = np.interp(t, ts, vs)
        elif not extrapolate or len(ts) < 2:
            out[key, i] = None
        else:
            (a, b), (c, d) = ((ts[0], vs[0]), (ts[1], vs[1])) if t < ts[0] else ((ts[-2], vs[-2]), (ts[-1], vs[-1]))
            out[key, i] = b + (d - b) * (t - a) / (c - a)
    return out


@pytest.mark.parametrize("size", [1, 5, 4096])
@pytest.mark.parametrize("extrapolate", [False, True])
def test_interpolation_equals_brute_force(spark, size, extrapolate):
    """Keys long and short, clusters in time, gaps of many ranges without a fix, ties, nulls, one fix and none."""
    rng = np.random.default_rng(size)
    points = [("long", i, float(t)) for i, t in enumerate(np.r_[rng.uniform(0, 1, 60), rng.uniform(90, 100, 40), 5.0, 5.0, 50.0])]
    fixes = [("long", float(t), float(rng.normal())) for t in np.r_[rng.uniform(0, 1, 10), rng.uniform(95, 98, 10), 5.0]]
    points += [("one", 0, 3.0), ("one", 1, 4.0), ("none", 0, 1.0), ("two", 0, -1.0), ("two", 1, None), ("two", 2, 9.0)]
    fixes += [("one", 4.0, 7.0), ("two", 0.0, 1.0), ("two", 0.0, 1.0), ("two", 2.0, 5.0), ("two", None, 8.0), ("other", 1.0, 1.0)]
    p = spark.createDataFrame(points, "k string, i int, t double").repartition(3)
    f = spark.createDataFrame(fixes, "k string, t double, v double")
    got = geometry.interpolate(p, f, "k", "t", ["v"], extrapolate, size=size).collect()
    want = by_hand(points, fixes, extrapolate)
    assert len(got) == len(points)
    for r in got:
        assert (r.v is None) == (want[r.k, r.i] is None) and (r.v is None or r.v == pytest.approx(want[r.k, r.i], abs=1e-9)), r


@pytest.mark.parametrize("size", [2, 4096])
def test_gaps_of_several_columns_are_filled_in_one_pass(spark, size):
    """Each column by its own fixes; the samples are joined once."""
    rows = [("p", i, 1.0 * i if i % 3 else None, 100.0 - i if i in (4, 11) else None, None) for i in range(20)]
    traces = spark.createDataFrame(rows, "profile_id string, trace_idx int, lat double, long double, elev double")
    got = geometry.interpolate(traces.select("profile_id", "trace_idx"), traces, "profile_id", "trace_idx", ["lat", "long", "elev"], True, each=True, size=size)
    for r in got.collect():
        assert r.lat == pytest.approx(r.trace_idx) and r.long == pytest.approx(100 - r.trace_idx) and r.elev is None
    clean = geometry.clean_gps(traces.withColumn("samples", F.array(F.lit(1.0))), ["lat", "long"])
    assert clean.count() == 20 and clean.where("abs(lat - trace_idx) > 1e-9 or abs(long + trace_idx - 100) > 1e-9").count() == 0
    assert clean._jdf.queryExecution().optimizedPlan().toString().count("Window") <= 8


def test_no_window_over_points_is_keyed_by_the_profile_alone(spark):
    """Those that are have one row a range: they carry the ends of ranges, named before and after."""
    from firnlight import catalog

    for name in ("gps_interp", "gps_extrapolated", "clean_gps"):
        waiting = [catalog.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan()]
        seen = 0
        while waiting:
            node = waiting.pop()
            if node.nodeName() == "Window" and node.partitionSpec().size() == 1:
                assert "before_" in node.toString().split("\n")[0] or "after_" in node.toString().split("\n")[0], name
                seen += 1
            waiting += [node.children().apply(i) for i in range(node.children().size())]
        assert seen <= 2


def test_ranges_grow_with_their_values_and_hold_few_rows(spark):
    rows = spark.range(10_000).select(F.lit("k").alias("k"), (F.col("id") * 0.5 - 3).alias("t"))
    cut = in_ranges(rows, "k", "t", 100).groupBy("range__").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("range__").collect()
    assert max(r.n for r in cut) <= 101 and all(a.high < b.low for a, b in zip(cut, cut[1:]))
    assert windows_of(rows._jdf.queryExecution().optimizedPlan()) == []
