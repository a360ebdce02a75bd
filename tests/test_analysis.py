"""Exact quantiles, growing attenuation windows and bed medians, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnlight.functions.filters import median_filter
from firnlight.operators import analysis
from firnlight.operators.quantiles import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.987, 1.0]


@pytest.mark.parametrize("ranges, few", [(1024, 4096), (4, 3)])
def test_quantiles_equal_numpy(spark, ranges, few):
    """Clusters, ties, outliers, one value, infinitesimal steps, and a group that is all null."""
    rng = np.random.default_rng(0)
    groups = {"normal": rng.normal(size=301), "ties": rng.integers(0, 4, 200), "far": np.r_[rng.normal(size=50), 1e300, -1e300], "one": [7.5], "same": [2.0] * 40,
              "fine": 1 + np.arange(60) * 2.0**-50, "two": [1.0, 4.0]}
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("void", None)]
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", SHARES, ranges, few).collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        assert got[k].n == len(x)
        assert got[k].quantiles == pytest.approx(np.quantile(np.array(x, float), SHARES), rel=1e-12), k


def test_quantiles_of_all_rows_and_of_none(spark):
    rows = spark.range(1001).select(F.col("id").alias("v"))
    assert [tuple(r) for r in quantiles(rows, [], "v", [0.1, 0.5]).collect()] == [(1001, [100.0, 500.0])]
    assert quantiles(rows.limit(0), [], "v", [0.5]).count() == 0
    with pytest.raises(ValueError):
        quantiles(rows, [], "v", [1.5])


def growing_by_hand(z, p, rates, target, width, initial, step):
    """(rate, window) of each place, by whole windows."""
    out = []
    for t in range(len(z)):
        hit = (None, None)
        w = initial
        while initial // 2 <= t < len(z) - initial // 2 and w // 2 <= t and w // 2 <= len(z) - t:
            a, b = z[t - w // 2 : t + w // 2], p[t - w // 2 : t + w // 2]
            c = np.array([abs(np.corrcoef(a, b + 2 * a * r)[0, 1]) for r in rates])
            near = np.array(rates)[c < width]
            if len(near) and c[0] > width and near.max() - near.min() <= target:
                hit = (rates[int(c.argmin())], float(w))
                break
            w += step
        out.append(hit)
    return out


def test_windows_grow_to_the_ends_of_the_profile(spark):
    """Rates that only long windows resolve, in a layer with gaps and one of noise; batches of windows change nothing."""
    rng = np.random.default_rng(3)
    rates = [float(k) for k in range(30)]
    rows, want = [], {}
    for layer, slope, noise in ((1, 9.0, 0.3), (2, 12.0, 1.5), (3, 0.0, 1.0)):
        places = np.flatnonzero(rng.random(260) < 0.9)
        z = 0.3 + 0.2 * np.sin(places / 40) + rng.normal(size=len(places)) * 0.01
        p = -2 * slope * z + rng.normal(size=len(places)) * noise
        rows += [("p", layer, int(i), float(a), float(b)) for i, a, b in zip(places, z, p)] + [("p", layer, 300, None, 1.0)]
        want |= {(layer, int(i)): v for i, v in zip(places, growing_by_hand(z, p, rates, 4.0, 0.2, 20, 20))}
    layers = spark.createDataFrame(rows, "profile_id string, picknum int, trace_idx int, z double, db double").repartition(3)
    got = {(r.picknum, r.trace_idx): (r.attenuation, r.window) for r in analysis.attenuation_growing(layers, rates, 4.0, 0.2, 20, 20, batch=1).collect()}
    assert got == want | {(n, 300): (None, None) for n in (1, 2, 3)}
    windows = {w for _, w in got.values() if w}
    assert len(windows) > 4 and max(windows) > 100


def test_wide_windows_are_judged_by_cells(spark):
    """With a reach of 12 traces nearly all windows are tried in cells; rates that long windows resolve, and noise that none does."""
    rng = np.random.default_rng(8)
    rates, rows, want = [float(k) for k in range(30)], [], {}
    for layer, slope, noise, n in ((1, 9.0, 0.3, 200), (2, 12.0, 1.5, 260), (3, 0.0, 1.0, 160)):
        z = 0.3 + 0.001 * np.arange(n) + rng.normal(size=n) * 0.01
        p = -2 * slope * z + rng.normal(size=n) * noise
        rows += [("p", layer, i, float(a), float(b)) for i, (a, b) in enumerate(zip(z, p))]
        want |= {(layer, i): v for i, v in enumerate(growing_by_hand(z, p, rates, 4.0, 0.2, 20, 12))}
    layers = spark.createDataFrame(rows, "profile_id string, picknum int, trace_idx int, z double, db double").repartition(3)
    got = {(r.picknum, r.trace_idx): (r.attenuation, r.window) for r in analysis.attenuation_growing(layers, rates, 4.0, 0.2, 20, 12, reach=12).collect()}
    assert got == want
    windows = {w for _, w in got.values() if w}
    assert max(windows) > 80 and any(w is None for _, w in got.values())


def test_cells_that_are_left_out_resolve_nothing():
    """Against every window of a cell, for layers of which some windows resolve a rate."""
    rng = np.random.default_rng(9)
    rates, left_out, tried = np.arange(30.0), 0, 0
    for slope, noise in ((9.0, 0.5), (9.0, 4.0), (0.0, 1.0), (60.0, 1.0)):
        z = 0.3 + 0.001 * np.arange(1200) + rng.normal(size=1200) * 0.01
        p = -2 * slope * z + rng.normal(size=1200) * noise
        a, b = z - z.mean(), p - p.mean()
        upto = np.vstack([np.zeros(6), np.cumsum(np.stack([np.ones(1200), a, b, a * a, b * b, a * b], 1), 0)])
        for t0, h1, h2 in ((500, 100, 110), (600, 300, 310), (400, 40, 50), (600, 500, 590)):
            cell = upto[[t0 + h1]] - upto[[t0 + 3 - h1]], upto[[t0 + 3 + h2]] - upto[[t0 - h2]]
            windows = np.array([upto[t + h] - upto[t - h] for t in range(t0, t0 + 4) for h in range(h1, h2 + 1)])
            if analysis.unresolved(*cell, rates, 5.0, 0.2)[0]:
                left_out += 1
                assert np.isnan(analysis.trial_rates(windows, rates, 5.0, 0.2)).all()
            tried += 1
    assert 4 < left_out < tried


def test_growing_windows_of_noise_take_no_time_that_is_quadratic(spark):
    """No window of 6,000 traces of noise resolves a rate; tried one by one there are 900,000."""
    import time

    layers = spark.range(6000).selectExpr("'p' AS profile_id", "1 AS picknum", "cast(id AS int) AS trace_idx", "0.3 + 0.001 * id AS z", "pmod(id * 7919, 1009) / 100.0 AS db")
    began = time.time()
    got = analysis.attenuation_growing(layers, [float(k) for k in range(30)], 5.0, 0.2, 20, 20, reach=512).where("attenuation is not null and window > 600").count()
    assert got == 0 and time.time() - began < 90


def test_depth_windows_grow_between_the_ends(spark):
    rng = np.random.default_rng(4)
    z = rng.uniform(0.1, 0.9, 400)
    p = -2 * 8 * z + rng.normal(size=400)
    layers = spark.createDataFrame([("p", 1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(z, p))], "profile_id string, picknum int, trace_idx int, z double, db double")
    rates, depths = [float(k) for k in range(30)], [0.12, 0.3, 0.5, 0.77]
    got = {r.depth: (r.attenuation, r.window) for r in analysis.attenuation_growing_depths(layers, depths, rates, 0.04, 0.02, 3.0, 0.2).collect()}
    for d in depths:
        hit, w = (None, None), 0.04
        k = 0
        while d - w / 2 >= z.min() and d + w / 2 <= z.max():
            near = np.abs(z - d) < w / 2
            if near.sum() >= 3:
                c = np.array([abs(np.corrcoef(z[near], p[near] + 2 * z[near] * r)[0, 1]) for r in rates])
                good = np.array(rates)[c < 0.2]
                if len(good) and c[0] > 0.2 and (good.max() - good.min()) / 2 <= 3.0:
                    hit = (rates[int(c.argmin())], pytest.approx(w))
                    break
            k += 1
            w = 0.04 + k * 0.02
        assert got[d] == hit
    assert any(v[0] is not None for v in got.values())


def test_bed_medians_over_segments(spark, monkeypatch):
    rng = np.random.default_rng(5)
    h = rng.normal(size=50) + 3
    bed = spark.createDataFrame([("p", 2 * i, float(v)) for i, v in enumerate(h)] + [("q", 0, 1.0)], "profile_id string, trace_idx int, height double")
    for width in (1, 7, 31):
        got = analysis.smoothed_bed(bed, width).orderBy("profile_id", "trace_idx").collect()
        assert [r.height for r in got][:-1] == pytest.approx(median_filter(h, width).tolist()) and got[0].trace_idx == 0 and got[49].trace_idx == 98
        assert got[-1].height == (1.0 if width == 1 else 0.0)


def test_peaks_of_arrays_equal_the_numpy_ones(spark):
    """Plateaus, ties, ends, walls, and arrays of some chunks."""
    from firnlight.functions.filters import peaks
    from firnlight.functions.peaks import with_peaks

    rng = np.random.default_rng(7)
    arrays = [[], [1.0], [1.0, 2.0], [1, 2, 1.0], [1, 2, 2, 1.0], [2, 2, 1, 3, 3, 3, 1, 3, 0.0], [1.0] * 9, list(range(9)), list(range(9, 0, -1))]
    arrays += [rng.integers(0, 5, n).astype(float).tolist() for n in (10, 40, 90)] + [np.cumsum(rng.normal(size=n)).tolist() for n in (30, 200)]
    df = spark.createDataFrame([(i, [float(v) for v in a]) for i, a in enumerate(arrays)] + [(99, None)], "id int, x array<double>")
    for prominence, width in ((0.0, 0.0), (1.0, 0.0), (2.0, 2.5)):
        got = {r.id: r.at for r in with_peaks(df, "x", "at", prominence, width, chunk=16).collect()}
        assert got.pop(99) is None
        assert got == {i: peaks(np.array(a, float), prominence, width).tolist() for i, a in enumerate(arrays)}


def test_bed_picks_of_pairs(spark):
    """A clear bed, beds too far apart, no peak, a bed without coherence, and a pair without differences."""
    from firnlight.operators.apres import bed_pick

    def profile(at, n=80):
        x = np.full(n, 0.001)
        if at is not None:
            x[at - 4 : at + 5] = 1.0
        return x

    rows, co = [], []
    for pair, (a, b, c) in enumerate(((40, 42, 0.95), (20, 60, 0.95), (None, 30, 0.95), (40, 40, 0.5), (50, 50, None))):
        rows += [(pair, s, 5.0 * s, float(x), 0.0, float(y), 0.0) for s, (x, y) in enumerate(zip(profile(a), profile(b)))]
        co += [(pair, 10.0 * k, c, 0.0) for k in range(40)] if c else []
    pairs = spark.createDataFrame(rows, "pair_id int, sample_idx int, range double, re1 double, im1 double, re2 double, im2 double").repartition(3)
    differences = spark.createDataFrame(co, "pair_id int, range double, co_re double, co_im double")
    got = {r.pair_id: r for r in bed_pick(pairs, differences, kernel=3, prominence=10.0, width=3.0, most_apart=20, least_coherence=0.9).collect()}
    assert (got[0].sample_idx, got[0].range, got[0].fault) == (41, 205.0, None) and got[0].coherence == pytest.approx(0.95) and got[0].power == pytest.approx(0.0)
    assert [got[k].fault for k in (1, 2, 3, 4)] == ["picks too far apart", "no peak", "coherence too low", "coherence too low"]
    assert got[1].sample_idx is None and got[3].sample_idx == 40 and got[4].coherence == 0.0
