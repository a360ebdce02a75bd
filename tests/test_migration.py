"""Tiles and the migration with lateral velocities, against whole matrices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnlight import catalog
from firnlight.operators import migration
from firnlight.operators.tiles import turn
from tests.whole_matrix import lateral_matrix, phase_shift_matrix, stolt_matrix

SF = "/root/testdata/sf0.001"
DT, DX = 1e-8, 0.5


def profiles(spark, *shapes, seed=0):
    """Matrices (samples x traces) and the same as traces in any order."""
    rng = np.random.default_rng(seed)
    data = {f"p{i}": rng.normal(size=s) for i, s in enumerate(shapes)}
    speed = {p: 1.6e8 + 2e7 * rng.random(x.shape) for p, x in data.items()}
    rows = [(p, j, x[:, j].tolist(), speed[p][:, j].tolist()) for p, x in data.items() for j in range(x.shape[1])]
    rng.shuffle(rows)
    rows = [(p, int(j), list(map(float, a)), list(map(float, b))) for p, j, a, b in rows]
    return data, speed, spark.createDataFrame(rows, "profile_id string, trace_idx int, samples array<double>, velocity array<double>").repartition(3)


def matrix(df, profile, shape):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("profile_id") == profile).collect():
        out[r.sample_idx, r.trace_idx] = r.v
    return out


@pytest.mark.parametrize("tile", [1, 50, 1 << 18])
def test_turned_rows_are_the_transpose(spark, tile):
    data, _, traces = profiles(spark, (7, 30), (12, 5))
    rows = turn(migration.numbered(traces), ["samples"], lambda at, m, x: (x, x * at[:, None] + m), ["a", "b"], tile).collect()
    for p, x in data.items():
        mine = {r.place: r for r in rows if r.profile_id == p}
        assert sorted(mine) == list(range(x.shape[0])) and {r.n for r in mine.values()} == {x.shape[0]}
        assert np.array([mine[k].a for k in sorted(mine)]) == pytest.approx(x)
        assert np.array([mine[k].b for k in sorted(mine)]) == pytest.approx(x * np.arange(x.shape[0])[:, None] + x.shape[0])


def test_turning_refuses_arrays_of_different_lengths(spark):
    rows = spark.createDataFrame([("p", 0, [1.0, 2.0]), ("p", 1, [1.0])], "profile_id string, trace_idx int, samples array<double>")
    with pytest.raises(Exception, match="different lengths"):
        turn(migration.numbered(rows), ["samples"], lambda at, m, x: (x,), ["a"]).count()


@pytest.mark.parametrize("tile", [40, 1 << 18])
def test_migrations_by_tiles_equal_whole_matrices(spark, tile):
    data, _, traces = profiles(spark, (32, 21), (32, 40))
    speed = np.linspace(1.6e8, 1.9e8, 32)
    for work, whole in ((lambda z, kx: migration.stolt_columns(z, kx, DT, 1.7e8), lambda x: stolt_matrix(x, DT, DX, 1.7e8)),
                        (lambda z, kx: migration.phase_shift_columns(z, kx, DT, speed), lambda x: phase_shift_matrix(x, DT, DX, speed))):
        got = migration.by_wavenumber(traces, work, DX, 10, 10, tile)
        for p, x in data.items():
            assert matrix(got, p, x.shape) == pytest.approx(whole(x), abs=1e-9)


def test_no_samples_are_rows_between_tiles(spark):
    _, _, traces = profiles(spark, (8, 6))
    plan = migration.migrate(traces, "stolt", [0.01 * k for k in range(8)], DX)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "collect_list" not in plan  # the long rows of the result


@pytest.mark.parametrize("steps, tile", [(64, 1 << 18), (7, 100)])
def test_lateral_migration_equals_dense_systems(spark, steps, tile):
    """In one stage and in several, over few and many groups."""
    data, speed, traces = profiles(spark, (20, 24), (20, 9), seed=3)
    got = migration.lateral(traces, DT, DX, steps=steps, tile=tile)
    for p, x in data.items():
        assert matrix(got, p, x.shape) == pytest.approx(lateral_matrix(x, DT, DX, speed[p]), abs=1e-9)


def test_lateral_migration_at_one_velocity_is_a_phase_shift(spark):
    data, _, traces = profiles(spark, (16, 20))
    got = migration.migrate(traces, "ffd", [0.01 * k for k in range(16)], DX, 1.7e8)
    assert matrix(got, "p0", (16, 20)) == pytest.approx(phase_shift_matrix(data["p0"], DT, DX, 1.7e8), abs=1e-9)


def test_lateral_velocities_focus_a_point():
    """A point under a profile whose velocity rises by 15 % along it: with the right velocities it comes out brighter than with their mean."""
    n, m, dx, z0, x0 = 128, 96, 0.5, 40, 48
    speed = np.broadcast_to(np.linspace(1.6e8, 1.85e8, m), (n, m))
    data = np.zeros((n, m))
    depth = z0 * DT * speed.min() / 2
    for j in range(m):  # straight rays through the mean slowness between the point and the trace
        path = speed[0, min(j, x0) : max(j, x0) + 1]
        t = 2 * math.hypot(depth, (j - x0) * dx) * np.mean(1 / path) / DT
        k = int(t)
        if k + 1 < n:
            data[k, j], data[k + 1, j] = 1 - (t - k), t - k

    def image(velocity):
        long = 1 << (2 * n - 1).bit_length()
        k = np.arange(1, long // 2)
        field = np.fft.fft(data * migration.edge_taper(m, 10)[None, :] * migration.edge_taper(n, 10)[:, None], long, axis=0)[k]
        return migration.lateral_steps(field, 2 * np.pi * k / (long * DT), velocity, DT, dx)[1].real.sum(1) * 2 / long

    right, wrong = image(speed), image(np.full((n, m), speed.mean()))
    at = np.unravel_index(np.abs(right).argmax(), right.shape)
    assert abs(at[0] - z0) <= 2 and abs(at[1] - x0) <= 2
    assert np.abs(right).max() > np.abs(wrong).max()


def test_tridiagonal_systems():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 33):
        low, high, right = (rng.normal(size=(4, n)) + 1j * rng.normal(size=(4, n)) for _ in range(3))
        low[:, 0] = high[:, -1] = 0
        diagonal = 3 + np.abs(low) + np.abs(high) + 0j
        got = migration.tridiagonal(low, diagonal, high, right)
        for r in range(4):
            dense = np.diag(diagonal[r]) + np.diag(low[r, 1:], -1) + np.diag(high[r, :-1], 1)
            assert got[r] == pytest.approx(np.linalg.solve(dense, right[r]), abs=1e-12)


def test_ffd_query_equals_dense_systems(spark):
    from firnlight.operators.queries_signal import _small

    traces = _small(spark, SF).collect()
    got = catalog.queries()["ffd"](spark, SF)
    profile = min(r.profile_id for r in traces)
    mine = sorted((r for r in traces if r.profile_id == profile), key=lambda r: r.trace_idx)
    data = np.array([r.samples for r in mine]).T
    speed = np.array([[1.6e8 + 3e6 * (r.trace_idx % 4) + 1e5 * k for r in mine] for k in range(len(data))])
    places = {r.trace_idx: i for i, r in enumerate(mine)}
    out = np.full(data.shape, np.nan)
    for r in got.where(F.col("profile_id") == profile).collect():
        out[r.sample_idx, places[r.trace_idx]] = r.v
    assert out == pytest.approx(lateral_matrix(data, DT, DX, speed), abs=2e-6)


def test_lateral_migration_of_an_empty_table(spark):
    _, _, traces = profiles(spark, (4, 3))
    assert migration.lateral(traces.limit(0), DT, DX).count() == 0


def test_kirchhoff_terms_are_not_shuffled(spark, monkeypatch):
    """Traces are dealt to segments of outputs once, also where these are short; sums by output need no shuffle of terms."""
    rng = np.random.default_rng(12)
    x, times, spacing = rng.normal(size=(23, 16)), [0.01 * k for k in range(16)], 2.5
    rows = [(p, i, [float(v) for v in r]) for p, part in (("a", x), ("b", x[:5])) for i, r in enumerate(part)]
    df = spark.createDataFrame(rows, "profile_id string, trace_idx int, samples array<double>").repartition(4)
    got = []
    for segment in (512, 2, 1):
        monkeypatch.setattr(migration, "KIRCHHOFF_SEGMENT", segment)
        out = migration.kirchhoff(df, times, spacing, nearfield=True)
        assert not [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line and "out__" in line]
        got.append({(r.profile_id, r.trace_idx, r.sample_idx): r.v for r in out.collect()})
    assert len(got[0]) == 28 * 16 and got[1] == pytest.approx(got[0]) and got[2] == pytest.approx(got[0])


@pytest.mark.parametrize("name", ["kirchhoff", "kirchhoff_small"])
def test_kirchhoff_queries_shuffle_traces_only(spark, name):
    """In the far field as well: no exchange of the queries carries outputs or their samples, and terms are no rows to aggregate."""
    plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString().splitlines()
    moved = [line for line in plan if "Exchange hashpartitioning" in line]
    assert moved and not [line for line in moved if "out__" in line or "sample_idx" in line]
    assert not [line for line in plan if "Aggregate" in line and "sample_idx" in line]


def test_lateral_steps_hold_one_row_for_a_level():
    """With weights the sums are those of the fields, in memory for a row a level instead of all frequencies."""
    import tracemalloc

    rng = np.random.default_rng(13)
    field = rng.normal(size=(16, 2048)) + 1j * rng.normal(size=(16, 2048))
    omega, velocity, weights = 2e6 * np.arange(16), 1.6e8 + 1e6 * rng.random((32, 2048)), rng.random(16)
    below, above = migration.lateral_steps(field, omega, velocity, 1e-8, 0.5)
    tracemalloc.start()
    again, image = migration.lateral_steps(field, omega, velocity, 1e-8, 0.5, weights)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert image.shape == (32, 2048) and np.array_equal(again, below)
    assert image == pytest.approx((above.real * weights[None, :, None]).sum(1)) and peak < above.nbytes
