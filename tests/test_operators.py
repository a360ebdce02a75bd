"""Operators on small tables, sources and sinks through Spark, and a stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnlight.functions import filters as N
from firnlight.operators import along, analysis, apres, filters, geometry, migration, shape, windows
from firnlight.operators import picks as P
from firnlight.plans.profile import Profile, process
from firnlight.sources import binary, sinks, text
from firnlight.streaming import stacks
from tests.whole_matrix import phase_shift_matrix, stolt_matrix


@pytest.fixture(scope="module")
def small(spark):
    rows = [("p", i, float(i) * 0.01, 3.0 * i, 4.0 * i, -80.0 + i, 10.0 * (i % 2), i % 3, [float(10 * i + k) for k in range(8)]) for i in range(12)]
    return spark.createDataFrame(rows, "profile_id string, trace_idx int, dist double, x_coord double, y_coord double, lat double, elev double, trig int, samples array<double>")


TIMES = tuple(0.01 * k for k in range(8))


def arrays(df):
    return {r.trace_idx: r.samples for r in df.collect()}


def test_crops(small):
    assert arrays(shape.crop(small, 2, 5))[1] == [12, 13, 14]
    assert arrays(shape.crop_time(small, list(TIMES), 0.035))[0] == [4, 5, 6, 7]
    assert arrays(shape.crop_pretrigger(small))[2] == [22, 23, 24, 25, 26, 27, None, None]
    with pytest.raises(ValueError):
        shape.crop_time(small, list(TIMES), 9.0)
    assert sorted(arrays(shape.hcrop(small, 4))) == list(range(9)) and sorted(arrays(shape.hcrop(small, 4, "right"))) == [0, 1, 2]
    with pytest.raises(ValueError):
        shape.hcrop(small, 1)


def test_crop_reaches_the_scan(spark, small, tmp_path):
    small.write.parquet(f"{tmp_path}/t")
    plan = shape.hcrop(spark.read.parquet(f"{tmp_path}/t"), 4, "right")._jdf.queryExecution().toString()
    assert "LessThan(trace_idx,3)" in plan


def test_restack_and_reverse(small):
    out = arrays(shape.restack(small, 4))
    assert len(out) == 2 and out[0] == [20 + k for k in range(8)]
    assert arrays(shape.reverse(small))[0] == [110 + k for k in range(8)]
    gap = small.withColumn("samples", F.when(F.col("trace_idx") == 1, F.array(*[F.lit(None).cast("double")] * 8)).otherwise(F.col("samples")))
    assert arrays(shape.restack(gap, 3))[0] == [None] * 8


def test_mean_trace_removal_of_ones(spark):
    ones = spark.createDataFrame([("p", i, [1.0] * 8) for i in range(6)], "profile_id string, trace_idx int, samples array<double>")
    out = arrays(windows.remove_mean_trace(ones, list(TIMES), 0, 6))[3]
    assert out == pytest.approx([1 - np.exp(-0.05 * t) for t in TIMES])


def test_constant_spacing_and_distance(small):
    d = {r.trace_idx: r.dist for r in geometry.cumulative_distance(small).collect()}
    assert d[11] == pytest.approx(0.055)
    out = {r.trace_idx: r for r in geometry.constant_spacing(small, 5.0, ["lat"]).collect()}
    assert len(out) == 22 and out[1].lat == pytest.approx(-79.5) and out[1].samples == pytest.approx([5 + k for k in range(8)])


def test_interpolation_edges(spark):
    fixes = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 100.0), ("a", 20.0, 0.0), ("b", 1.0, 7.0)], "profile_id string, t double, v double")
    points = spark.createDataFrame([("a", -5.0), ("a", 5.0), ("a", 10.0), ("a", 25.0), ("a", None), ("b", 1.0), ("b", 2.0), ("c", 1.0)], "profile_id string, t double")
    inside = {(r.profile_id, r.t): r.v for r in geometry.interpolate(points, fixes, "profile_id", "t", ["v"]).collect()}
    assert inside == {("a", -5.0): None, ("a", 5.0): 50, ("a", 10.0): 100, ("a", 25.0): None, ("a", None): None, ("b", 1.0): 7, ("b", 2.0): None, ("c", 1.0): None}
    beyond = {(r.profile_id, r.t): r.v for r in geometry.interpolate(points, fixes, "profile_id", "t", ["v"], True).collect()}
    assert beyond["a", -5.0] == -50 and beyond["a", 25.0] == -50 and beyond["a", 10.0] == 100


def test_offset_search(spark):
    own = spark.createDataFrame([("p", 0.001 * i, np.sin(i * 0.05).item(), np.cos(i * 0.03).item()) for i in range(200)], "profile_id string, decday double, lat double, long double")
    fixes = own.withColumn("decday", F.col("decday") - 0.02)
    assert geometry.search_offset(own, fixes, passes=2, points=41) == pytest.approx(0.02, abs=1e-3)


def test_elevation_and_layers(spark, small):
    out = arrays(shape.elevation_correct(small, 1e-8, 1e9))
    assert out[0] == [None, None, *range(8)] and out[1] == [*range(10, 18), None, None]
    picks = spark.createDataFrame([("p", 1, i, None if i == 5 else float(i % 3 + 2), 1.0) for i in range(12)], "profile_id string, picknum int, trace_idx int, samp2 double, power double")
    assert {r.picknum: (r.tnum, r.snum) for r in P.last_traces(picks).collect()} == {1: (11, 4.0)}
    with pytest.raises(ValueError):
        P.add_pick(picks, small, 1)
    assert P.add_pick(picks, small, 2).count() == 24
    assert P.delete_right(picks, 1, 3).where("samp2 is not null").count() == 3


def test_process_order_and_validation(small):
    p = Profile(small, TIMES, 1e-8)
    out = process(p, crop=(2, 6), hcrop=4, rev=True)
    assert arrays(out.traces)[0] == [112, 113, 114, 115] and out.snum == 4 and out.travel_time[0] == 0
    assert out.validate() == [] and p.snum == 8 and p.flags == {}
    assert Profile(small, TIMES[:3], 1e-8).validate()
    with pytest.raises(ValueError):
        process(p, nonsense=1)
    moved = p.moveout(0.0)
    assert moved.depth[1] == pytest.approx(0.01 / 2 * 1.69e8 * 1e-6)


def test_migration_names(small):
    with pytest.raises(ValueError):
        migration.migrate(small, "sumigtk", list(TIMES), 1.0)
    assert migration.migrate(small, "stolt", list(TIMES), 1.0, across=1, down=1).count() == 96


def test_vertical_filter_needs_no_shuffle(small):
    out = filters.map_samples(small, lambda x: 2 * x)
    assert arrays(out)[1] == [20 + 2 * k for k in range(8)]
    assert "Exchange" not in out._jdf.queryExecution().toString()


def test_sources_and_sinks(spark, small, tmp_path):
    data = np.arange(24, dtype="<u2").reshape(4, 6)
    head = bytearray(32768 * 2)
    struct.pack_into("<HHh", head, 4, 6, 16, 3)
    struct.pack_into("<f", head, 26, 60.0)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/line.DZT").write_bytes(bytes(head) + data.tobytes())
    (tmp_path / "in/broken.DZT").write_bytes(b"x")
    with pytest.raises(Exception, match="unpack_from"):  # a damaged file raises
        binary.load(spark, "gssi", f"file://{tmp_path}/in").count()
    got = binary.load(spark, "gssi", f"file://{tmp_path}/in", strict=False)
    assert got.count() == 4 and got.first().profile_id == "line"
    with pytest.raises(ImportError):
        binary.load(spark, "gprMax", "x")
    (tmp_path / "g.DZG").write_text("$GSSIS,12,1\n$GPGGA,120000,7930.0,S,17015.0,W,1,08,0.9,1000,M,-5.5,M,,*47\n$GSSIS,20,1\n$GPGGA,bad\n")
    fixes = text.dzg(spark, f"file://{tmp_path}/g.DZG").orderBy("trace_num").collect()
    assert fixes[0].trace_num == 12 and fixes[0].lat == pytest.approx(-79.5) and fixes[0].long == pytest.approx(-170.25) and fixes[0].geoid == -5.5
    assert fixes[1].lat is None
    (tmp_path / "v.txt").write_text("# v z\n1.6e8 0\n 1.7e8   50\n")
    assert [tuple(r) for r in text.table(spark, f"file://{tmp_path}/v.txt", ["v", "z"]).collect()] == [(1.6e8, 0.0), (1.7e8, 50.0)]
    sinks.save(f"file://{tmp_path}/out", small)
    assert spark.read.parquet(f"file://{tmp_path}/out/traces").count() == 12
    sinks.write_segy_files(small, f"{tmp_path}/segy", 10)
    assert binary.load(spark, "segy", f"{tmp_path}/segy").count() == 12
    sinks.write_points(f"file://{tmp_path}/points", small.select("lat", F.col("x_coord").alias("long"), "trace_idx"))
    assert '"coordinates":[0.0,-80.0]' in spark.read.text(f"file://{tmp_path}/points").orderBy("value").toPandas().value.str.cat()
    with pytest.raises(ValueError):
        sinks.target("nonsense", None, list(TIMES))


def test_stream_of_traces(spark, tmp_path):
    rows = [("p", f"2024-01-01 00:00:{s:02d}", [float(s), 1.0]) for s in range(0, 60, 10)]
    spark.createDataFrame(rows, "profile_id string, ts string, samples array<double>").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("profile_id string, ts timestamp, samples array<double>").parquet(f"{tmp_path}/in")
    q = stacks.stack_by_time(stream, "30 seconds", "1 minute").writeStream.outputMode("complete").format("memory").queryName("stacks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(str(r.start)[-8:], r.sample_idx): (r.v, r.traces) for r in spark.table("stacks").collect()}
    assert got["00:00:00", 0] == (10.0, 3) and got["00:00:30", 0] == (40.0, 3)


def test_command_line(spark, small, tmp_path):
    from firnlight import cli

    small.write.parquet(f"{tmp_path}/t")
    cli.main(["proc", f"{tmp_path}/t", f"{tmp_path}/out", "--dt", "1e-8", "--crop", "2", "6", "--hcrop", "4", "--rev"], spark)
    assert arrays(spark.read.parquet(f"{tmp_path}/out"))[0] == [112, 113, 114, 115]


def test_zip_refuses_different_ranges(spark):
    from firnlight.operators import apres

    a = spark.createDataFrame([(1, 0, 0.0, 1.0, 1.0), (1, 1, 1.0, 1.0, 1.0)], "site int, sample_idx int, range double, re double, im double")
    assert apres.zip_acquisitions({"x": a, "y": a.withColumn("re", F.col("re") + 1)}, ["site", "sample_idx"]).count() == 2
    with pytest.raises(Exception, match="differ"):
        apres.zip_acquisitions({"x": a, "y": a.where("sample_idx = 0")}, ["site", "sample_idx"]).collect()


def test_adaptive_filter_of_ones(spark):
    ones = spark.createDataFrame([("p", i, [1.0] * 40) for i in range(30)], "profile_id string, trace_idx int, samples array<double>")
    times = [0.01 * k for k in range(40)]
    out = arrays(windows.adaptive_filter(ones, times, 10))
    assert out[3] == pytest.approx([1 - np.exp(-0.05 * t) for t in times]) and out[29] == pytest.approx(out[3])
    with pytest.raises(ValueError):
        windows.horizontal_filter(ones, "other", times)


def test_kirchhoff_query_covers_all_profiles_and_traces(spark):
    from firnlight import catalog

    sf = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").count().collect()
    got = catalog.queries()["kirchhoff"](spark, sf).groupBy("profile_id").count().collect()
    assert {r.profile_id: r["count"] for r in got} == {str(r.label): r["count"] * 64 for r in want}


def test_kirchhoff_equals_brute_force(spark):
    """Two profiles, the longer one wider than the distance that the last sample hears."""
    rng, times, spacing, v = np.random.default_rng(1), [0.01 * k for k in range(16)], 4.0, 1.69e8
    data = {"a": rng.normal(size=(12, 16)), "b": rng.normal(size=(3, 16))}
    rows = [(p, i, a.tolist()) for p, x in data.items() for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "profile_id string, trace_idx int, samples array<double>")
    got = {(r.profile_id, r.trace_idx, r.sample_idx): r.v for r in migration.kirchhoff(df, times, spacing, v).collect()}
    assert len(got) == 15 * 16
    for p, x in data.items():
        slope = np.gradient(x, 0.01 * 1e-6, axis=1)
        for o in range(len(x)):
            for z, t in enumerate(times):
                depth, total = v * t * 1e-6 / 2, 0.0
                for i in range(len(x)):
                    r = np.hypot((i - o) * spacing, depth)
                    if 2 * r / v * 1e6 <= times[-1]:
                        total += slope[i, round(2 * r / v * 1e6 / 0.01)] * (depth / r if r > 0 else 0) / v  # no angle at the surface itself
                assert got[p, o, z] == pytest.approx(total / (2 * np.pi), rel=1e-9, abs=1e-9)


def test_values_along_profiles_in_segments(spark):
    rng = np.random.default_rng(0)
    rows = [(p, i, float(rng.normal())) for p, n in (("a", 50), ("b", 1), ("c", 23)) for i in range(n) if rng.random() < 0.8 or i == 0]
    df = spark.createDataFrame(rows, "profile_id string, trace_idx int, v double").repartition(3)
    out = along.with_neighbour(along.with_neighbour(df, "before", ["v"], segment=7), "after", ["trace_idx", "v"], ahead=True, segment=5)
    out = along.with_running(out, segment=6, total=F.col("v"), n=F.lit(1))
    got = {(r.profile_id, r.trace_idx): r for r in out.collect()}
    assert len(got) == len(rows)
    for p in "abc":
        own = [r for r in rows if r[0] == p]
        total = 0.0
        for k, (_, i, v) in enumerate(own):
            r, total = got[p, i], total + v
            assert (r.before.v if r.before else None) == (own[k - 1][2] if k else None)
            assert (r.after.trace_idx if r.after else None) == (own[k + 1][1] if k + 1 < len(own) else None)
            assert r.total == pytest.approx(total) and r.n == k + 1
    again = along.renumbered(df, segment=4)
    assert sorted((r.profile_id, r.trace_idx) for r in again.collect()) == sorted((p, k) for p in "abc" for k in range(sum(r[0] == p for r in rows)))


def test_windows_reach_over_the_edges_of_segments(spark):
    n = along.SEGMENT + 300
    df = spark.range(n).select(F.lit("p").alias("profile_id"), F.col("id").cast("int").alias("trace_idx"), (F.sin("id") * 5 + F.col("id") % 7).alias("height"))
    got = {r.trace_idx: r.rms for r in analysis.roughness(df, 20, 50.0).where(f"trace_idx > {n - 400}").collect()}
    h = np.sin(np.arange(n)) * 5 + np.arange(n) % 7
    for i in range(n - 399, n):
        x = np.arange(max(i - 20, 0), min(i + 20, n))
        line = np.polyval(np.polyfit(x - i, h[x], 1), x - i)
        assert got[i] == pytest.approx(np.sqrt(((h[x] - line) ** 2).sum() / (len(x) - 1)), rel=1e-6)


def test_constant_spacing_over_many_segments(spark):
    n = 3 * along.SEGMENT
    df = spark.range(n).select(F.lit("p").alias("profile_id"), F.col("id").cast("int").alias("trace_idx"), (F.col("id") * 0.001).alias("dist"), F.array(F.col("id").cast("double")).alias("samples"))
    out = geometry.constant_spacing(df, 2.5, []).orderBy("trace_idx").collect()
    assert [r.trace_idx for r in out] == list(range(len(out))) and len(out) == int((n - 1) / 2.5) + 1
    assert all(r.samples[0] == pytest.approx(2.5 * r.trace_idx, abs=1e-6) for r in out)


def matrix_of(spark, x, profile="p"):
    return spark.createDataFrame([(profile, i, [float(v) for v in x[:, i]]) for i in range(x.shape[1])], "profile_id string, trace_idx int, samples array<double>")


def as_matrix(flat, shape):
    out = np.full(shape, np.nan)
    for r in flat.collect():
        out[r.sample_idx, r.trace_idx] = r.v
    return out


def test_migrations_by_columns_equal_whole_matrices(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(24, 17)), rng.normal(size=(24, 8))
    t = [0.01 * k for k in range(24)]
    both = matrix_of(spark, x).union(matrix_of(spark, y, "q"))
    speed = np.linspace(1.6e8, 2e8, 24)
    for kind, whole, v in (("stolt", stolt_matrix, 1.68e8), ("phsh", phase_shift_matrix, 1.68e8), ("phsh", phase_shift_matrix, speed)):
        out = migration.migrate(both, kind, t, 0.5, v, 4, 3)
        for p, data in (("p", x), ("q", y)):
            assert as_matrix(out.where(F.col("profile_id") == p), data.shape) == pytest.approx(whole(data, 1e-8, 0.5, v, 4, 3), abs=1e-9)


@pytest.mark.parametrize("nearfield", [False, True])
def test_kirchhoff_equals_the_sum_over_hyperbolas(spark, nearfield):
    x = np.random.default_rng(2).normal(size=(12, 9))
    t, v, dx = np.arange(12) * 1e-8, 1.69e8, 0.4
    grad, out = np.gradient(x, t, axis=0), np.zeros_like(x)
    for i in range(9):
        for k in range(12):
            for j in range(9):
                r = np.hypot((j - i) * dx, v * t[k] / 2)
                if r > 0 and 2 * r / v <= t[-1]:
                    at = int(np.abs(t - 2 * r / v).argmin())
                    cos = v * t[k] / 2 / r
                    out[k, i] += grad[at, j] * cos / v + (x[at, j] * cos / r**2 if nearfield else 0)
    got = migration.migrate(matrix_of(spark, x), "kirch", (t * 1e6).tolist(), dx, v, nearfield=nearfield)
    assert as_matrix(got, x.shape) == pytest.approx(out / (2 * np.pi), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize(("vertical", "horizontal"), [(1, 10), (3, 4), (4, 5)])
def test_denoising_over_traces_and_samples(spark, vertical, horizontal):
    x = np.random.default_rng(3).normal(size=(9, 13))
    df = matrix_of(spark, x)
    mean, square, mid = (np.zeros_like(x) for _ in range(3))
    for k in range(9):
        for i in range(13):
            ks, js = (np.arange(c - s // 2, c + s - s // 2) for c, s in ((k, vertical), (i, horizontal)))
            box = np.array([[x[a, b] if 0 <= a < 9 and 0 <= b < 13 else 0.0 for b in js] for a in ks])
            mean[k, i], square[k, i] = box.mean(), (box**2).mean()
            mirror = lambda a, n: -a - 1 if a < 0 else 2 * n - 1 - a if a >= n else a
            mid[k, i] = sorted(x[mirror(a, 9), mirror(b, 13)] for a in ks for b in js)[vertical * horizontal // 2]
    var = square - mean**2
    for noise in (None, 0.7):
        level = var.mean() if noise is None else noise
        want = np.where(var < level, mean, mean + (1 - level / var) * (x - mean))
        assert as_matrix(windows.wiener(df, vertical, horizontal, noise), x.shape) == pytest.approx(want)
    assert as_matrix(windows.median_filter(df, horizontal, vertical), x.shape) == pytest.approx(mid)


def test_horizontal_filters_follow_every_sample(spark):
    x = np.random.default_rng(4).normal(size=(3, 120)).cumsum(1)
    df = matrix_of(spark, x).repartition(5)
    for out, corners, order, kind in (
        (filters.high_pass(df, 50.0, 2.0), [2 / 25], 5, "high"), (filters.low_pass(df, 50.0, 2.0), [2 / 25], 3, "low"),
        (filters.horizontal_band_pass(df, 20.0, 100.0, 2.0), [2 / 50, 2 / 10], 5, "bandpass")):
        whole = N.zero_phase(N.sections(order, corners, kind), x.T, N.padding_of(order, kind)).T
        assert as_matrix(out, x.shape) == pytest.approx(whole, abs=1e-8)


def test_picks_followed_and_smoothed_query_wide(spark):
    x = np.random.default_rng(5).normal(size=(64, 90))
    window = P.PickWindow.of(10.0, 1e-8, 64)
    got = {(r.picknum, r.trace_idx): (r.samp1, r.samp2, r.samp3) for r in P.auto_pick(matrix_of(spark, x), window, [(1, 30, 25), (2, 0, 40)]).collect()}
    half = window.length // 2 + 1
    for number, seed, start in ((1, 30, 25), (2, 0, 40)):
        for way in (1, -1):
            mid = start
            for i in range(seed, 90) if way > 0 else range(seed, -1, -1):
                top, centre, bottom, _ = P.pick_one(x[:, i], window, mid)
                assert got[number, i] == (top, centre, bottom)
                mid = min(max((top + bottom) // 2, half), max(64 - half, half))
    layer = [(("p"), 1, i, None if i in (40, 41, 50) else float(20.0 + 5 * np.sin(i))) for i in range(90)]
    picks = spark.createDataFrame([(p, n, i, s, s, s) for p, n, i, s in layer], "profile_id string, picknum int, trace_idx int, samp1 double, samp2 double, samp3 double")
    smooth = {r.trace_idx: r.samp2 for r in P.smooth_picks(picks, 6).collect()}
    pad = N.padding_of(3, "low")
    for low, high in ((0, 40), (42, 50), (51, 90)):
        run = np.array([layer[i][3] for i in range(low, high)])
        want = np.round(N.zero_phase(N.sections(3, [2 / 6], "low"), run[:, None], pad)[:, 0]) if len(run) > pad else run
        assert [smooth[i] for i in range(low, high)] == pytest.approx(want.tolist())
    assert smooth[40] is None and smooth[50] is None


def test_low_pass_along_range_takes_many_series_at_a_time(spark):
    """Missing values are left out, short series stay, other columns stay with their rows; no Python call for each series."""
    rng = np.random.default_rng(11)
    series = {(site, theta): rng.normal(size=6 if theta == 2 else 30) for site in (1, None) for theta in range(3)}
    rows = [(site, 5 * j, theta, None if theta == 1 and j in (3, 4) else float("nan") if theta == 1 and j == 9 else float(v), f"r{j}") for (site, theta), x in series.items() for j, v in enumerate(x)]
    images = spark.createDataFrame(rows, "site int, sample_idx int, theta_idx int, anomaly double, name string").repartition(5)
    out = apres.low_pass_range(images, "anomaly", 0.1, 1.0)
    assert out.schema == images.schema and "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    got = {(r.site, r.theta_idx, r.sample_idx): (r.anomaly, r.name) for r in out.collect()}
    assert len(got) == len(rows)
    pad = N.padding_of(3, "low")
    for (site, theta), x in series.items():
        there = [j for j in range(len(x)) if theta != 1 or j not in (3, 4, 9)]
        want = N.zero_phase(N.sections(3, [0.2], "low"), x[there][:, None], pad)[:, 0] if len(there) > pad else x[there]
        assert [got[site, theta, 5 * j][0] for j in there] == pytest.approx(want.tolist())
        assert all(got[site, theta, 5 * j][1] == f"r{j}" and (j in there or got[site, theta, 5 * j][0] is None) for j in range(len(x)))


def test_attenuation_needs_uncorrected_correlation(spark):
    rng = np.random.default_rng(6)
    z = np.tile(np.linspace(0.1, 0.5, 20), 20)
    rows = [("p", n, i, float(z[i]), float(db[i])) for n, db in ((1, -2 * 10 * z + rng.normal(size=400) * 0.05), (2, rng.normal(size=400))) for i in range(400)]
    layers = spark.createDataFrame(rows, "profile_id string, picknum int, trace_idx int, z double, db double")
    out = analysis.attenuation_growing(layers, [float(k) for k in range(30)], 5.0, 0.3).where("trace_idx between 60 and 340").collect()
    assert all(r.attenuation == 10.0 for r in out if r.picknum == 1) and all(r.attenuation is None for r in out if r.picknum == 2)


def test_wheel_records(spark):
    rec = b"".join(struct.pack("<fHhffHH", 10.5 + k, 2 * k, 7 + k, 0.5, 2e-9, 1, 5) + np.array([512, 512, 520, 612, 512], "<u2").tobytes() for k in range(3))
    tek = binary.parse_wheel()("x.DAT", rec)
    assert tek.dt[0] == pytest.approx(2e-9) and tek.pressure.tolist() == [0, 1, 2] and tek.decday.tolist() == [10.5, 11.5, 12.5]
    assert tek.trig[0] == 2 and tek.trace_int.tolist() == pytest.approx([np.pi] * 3)  # slopes 0, 4, 50, -4, -100; the level is 10


def test_headers_are_read_whole(spark, tmp_path):
    (tmp_path / "h.hd").write_text("\n".join(f"K{i} = {i}" for i in range(3000)))
    keys = text.header(spark, f"file://{tmp_path}/h.hd")
    assert len(keys) == 3000 and keys["K2999"] == "2999"


def test_coordinates_on_load(spark, small, tmp_path):
    small.withColumn("lat", F.lit(-75.0) + F.col("trace_idx") * 0.01).withColumn("long", F.lit(10.0)).write.parquet(f"file://{tmp_path}/t")
    plane = binary.load(spark, "parquet", f"file://{tmp_path}/t", t_srs="EPSG:32732")
    r = plane.orderBy("trace_idx").first()
    assert 3e5 < r.x_coord < 7e5 and 1e6 < r.y_coord < 2e6
    plane.drop("lat", "long").write.parquet(f"file://{tmp_path}/u")
    back = binary.load(spark, "parquet", f"file://{tmp_path}/u", s_srs="EPSG:32732", t_srs="EPSG:3031").orderBy("trace_idx").first()
    assert (back.lat, back.long) == (pytest.approx(-75.0), pytest.approx(10.0)) and back.y_coord > 1e6
    with pytest.raises(ValueError):
        binary.load(spark, "parquet", f"file://{tmp_path}/t", t_srs="EPSG:1")


def test_steps_of_the_command_line(spark, small, tmp_path):
    from firnlight import cli

    at = f"file://{tmp_path}"
    small.withColumn("decday", F.col("trace_idx").cast("double")).write.parquet(f"{at}/in")
    for name, args in (("agc", ["4"]), ("rgain", ["2.5"]), ("elev", []), ("rev", []), ("denoise", ["1", "3"]), ("ahfilt", ["4"])):
        cli.main(["step", name, f"{at}/in", f"{at}/{name}", "--dt", "1e-8", "--args", *args], spark)
        assert spark.read.parquet(f"{at}/{name}").count() == 12
    cli.main(["proc", f"{at}/in", f"{at}/proc", "--dt", "1e-8", "--ahfilt", "4", "--denoise", "1", "3", "--crop", "1", "5"], spark)
    assert spark.read.parquet(f"{at}/proc").selectExpr("max(size(samples)) AS n").first().n == 4
    cli.main(["cat", f"{at}/in", f"{at}/rev", f"{at}/cat"], spark)
    assert spark.read.parquet(f"{at}/cat").count() == 24
    (tmp_path / "gps.txt").write_text("".join(f"{k} {k * 2.0} {-80 + k} 100\n" for k in range(12)))
    cli.main(["geolocate", f"{at}/in", f"{at}/geo", "--gps", f"{at}/gps.txt", "--offset", "0.5"], spark)
    geo = {r.trace_idx: r for r in spark.read.parquet(f"{at}/geo").collect()}
    assert geo[4].lat == pytest.approx(-76.5) and len(geo[4].samples) == 8


def test_files_and_migrations_of_the_command_line(spark, small, tmp_path):
    from firnlight import cli

    at = f"file://{tmp_path}"
    small.write.parquet(f"{at}/in")
    (tmp_path / "v.txt").write_text("# v z\n1.7e8 0\n1.6e8 20\n")
    for kind, more in (("stolt", []), ("phsh", ["--table", f"{at}/v.txt"]), ("ffd", ["--table", f"{at}/v.txt"]), ("kirch", []), ("tk", ["--taper", "1", "1"])):
        cli.main(["migrate", f"{at}/in", f"{at}/{kind}", "--kind", kind, "--dt", "1e-8", "--spacing", "1.5", *more], spark)
        moved = spark.read.parquet(f"{at}/{kind}")
        assert moved.count() == 12 and moved.columns == small.columns and moved.first().samples is not None
    (tmp_path / "raw").mkdir()
    body = np.arange(24, dtype="<u2").reshape(4, 6)
    head = bytearray(65536)
    struct.pack_into("<HHh", head, 4, 6, 16, 3)
    struct.pack_into("<f", head, 26, 60.0)
    (tmp_path / "raw/line.DZT").write_bytes(bytes(head) + body.tobytes())
    for to in ("segy", "csv", "parquet", "points"):
        cli.main(["convert", "gssi", f"{at}/raw", f"{tmp_path}/{to}", "--to", to], spark)
    back = binary.load(spark, "segy", f"{tmp_path}/segy").orderBy("trace_idx").collect()
    assert [r.samples for r in back] == [r.samples for r in spark.read.parquet(f"{tmp_path}/parquet").orderBy("trace_idx").collect()] and back[0].dt == pytest.approx(1e-8)
    assert spark.read.csv(f"{tmp_path}/csv", header=True).count() == 4
    (tmp_path / "bursts").mkdir()
    tone = (np.cos(2 * np.pi * 9 * np.arange(200) / 200) * 9000 + 32768).astype("<u2")
    (tmp_path / "bursts/a.DAT").write_bytes(b"N_ADC_SAMPLES=200\r\nNSubBursts=3\r\n*** End Header ***\r\n" + np.tile(tone, 3).tobytes())
    cli.main(["apres", f"{at}/bursts", f"{at}/profile", "--bandwidth", "2e8", "--centre", "3e8", "--rate", "2e8", "--bed", "20"], spark)
    profile = spark.read.parquet(f"{at}/profile").orderBy(F.desc("db")).collect()
    assert profile[0].acq_id == "a" and profile[0].sample_idx == 18 and abs(profile[0].uncertainty) < 0.01  # padded twice


def test_stationary_traces_go_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(geometry, "SEGMENT", 7)
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for p in ("a", "b"):
        dist, lost, number = 0.0, 0.0, 0
        for i in range(60):
            step = float(rng.choice([0.0, 2e-6, 0.5]) if i not in (7, 14) else 0.0) if i else 0.0
            dist += step
            rows.append((p, i, dist, [float(i)]))
            if i and step * 1000 < 1e-2:
                lost += step
                continue
            want[p, number] = (dist - lost, float(i))
            number += 1
    df = spark.createDataFrame(rows, "profile_id string, trace_idx int, dist double, samples array<double>").repartition(3)
    got = {(r.profile_id, r.trace_idx): (r.dist, r.samples[0]) for r in geometry.cull_stationary(df).collect()}
    assert set(got) == set(want) and all(got[k] == (pytest.approx(want[k][0], abs=1e-9), want[k][1]) for k in want)


def test_restack_of_gaps_and_short_traces(spark):
    rows = [("p", i, [float(i), None if i == 4 else 1.0, 2.0][: 2 if i == 7 else 3]) for i in range(11)] + [("q", i, None if i == 1 else [1.0]) for i in range(3)]
    df = spark.createDataFrame(rows, "profile_id string, trace_idx int, samples array<double>")
    got = {(r.profile_id, r.trace_idx): r.samples for r in shape.restack(df, 3).collect()}
    assert got == {("p", 0): [1.0, 1.0, 2.0], ("p", 1): [4.0, None, 2.0], ("p", 2): [7.0, 1.0], ("q", 0): []}


def test_files_of_a_folder_become_one_profile_in_the_order_of_time(spark):
    rows = [("a", f"d/line_{f}.gtd", i, i + 1, day + i) for f, day, n in (("1", 20.0, 2), ("2", 10.0, 3)) for i in range(n)]
    out = binary.in_one_profile(spark.createDataFrame(rows, "profile_id string, fn string, trace_idx int, trace_num int, decday double"), "x").orderBy("trace_idx").collect()
    assert [(r.profile_id, r.trace_idx, r.trace_num, r.decday) for r in out] == [("line_", k, k + 1, t) for k, t in enumerate([10.0, 11.0, 12.0, 20.0, 21.0])]
