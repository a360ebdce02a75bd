"""Phase-sensitive radar: range conversion, differences, polarisation and spectra.

Complex values are pairs of columns re, im.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.arrays import doubles
from ..functions.peaks import with_peaks
from ..plans.tables import samples as long_samples
from ..sources.shared import stored
from .batches import map_arrays
from .quantiles import quantiles
from .windows import coherence_over, gradient, to_arrays

WINDOWS = {"blackman": np.blackman, "bartlett": np.bartlett, "hamming": np.hamming, "hanning": np.hanning}


def range_convert(chirps: DataFrame, bandwidth: float, centre: float, rate: float, speed: float, pad: int = 2, max_range: float = 4000.0,
                  window: str = "blackman", beta: float | None = None, snum: int = 64) -> DataFrame:
    """Complex range profile of each chirp, a row per range bin: sample_idx, range, re, im, fine.

    Row-local; all bins are kept where no range exceeds ``max_range``.
    """
    if window == "kaiser":
        if beta is None:
            raise ValueError("a Kaiser window needs beta")
        weights = np.kaiser(snum, beta)
    else:
        weights = WINDOWS[window](snum)
    bins = pad * snum // 2
    delay = np.arange(bins) / (bandwidth * pad)
    ranges = delay * speed / 2
    keep = int((ranges <= max_range).sum())
    phase = 2 * np.pi * centre * delay - rate * delay**2 / 2
    scale = math.sqrt(2 * pad) / snum / math.sqrt(np.mean(weights**2))
    turn = np.exp(-1j * phase[:keep]) * scale

    def work(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.fft.rfft((x - x.mean(1, keepdims=True)) * weights, pad * snum)[:, :keep] * turn
        return z.real, z.imag

    bins = F.posexplode(F.arrays_zip("re", "im"))
    flat = map_arrays(chirps, ["samples"], work, re="double", im="double").select(*[c for c in chirps.columns if c != "samples"], bins.alias("sample_idx", "z"))
    out = flat.withColumn("re", F.col("z.re")).withColumn("im", F.col("z.im")).drop("z")
    out = out.withColumn("range", F.col("sample_idx") * F.lit(float(ranges[1])))
    wavelength = speed / centre
    return out.withColumn("fine", F.atan2("im", "re") / (4 * math.pi / wavelength - 4 * F.col("range") * rate / speed**2))


def stack_chirps(chirps: DataFrame, count: int | None = None) -> DataFrame:
    """Mean of the first ``count`` chirps (all, if not given) in order of burst and chirp; long samples."""
    rows = chirps
    if count is not None:
        place = F.row_number().over(Window.partitionBy("acq_id").orderBy("burst", "chirp"))
        rows = chirps.withColumn("n__", place).where(F.col("n__") <= count).drop("n__")
    flat = rows.select("acq_id", F.posexplode("samples").alias("sample_idx", "v"))
    return flat.groupBy("acq_id", "sample_idx").agg(F.avg("v").alias("v"))


def phase_difference(pair: DataFrame, win: int, step: int) -> DataFrame:
    """Moving coherence of two profiles (re1, im1, re2, im2) at every ``step`` th centre: co_re, co_im per pair_id."""
    keys = ["pair_id"]
    re, im = coherence_over(keys, "sample_idx", win)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = pair.withColumn("co_re", re).withColumn("co_im", im).withColumn("n__", n)
    at = F.col("sample_idx") - win // 2
    return out.where((at >= 0) & (F.col("sample_idx") < F.col("n__") - win // 2) & (at % step == 0)).withColumn("ds_idx", (at / step).cast("int")).drop("n__")


def unwrap(co: DataFrame, win: int = 10, threshold: float = 0.9) -> DataFrame:
    """Add phi, unwrapped where some coherence nearby reaches the threshold.

    A jump depends on corrected phases only through their difference, which the
    correction leaves alone; so all corrections are one running sum.
    """
    along = Window.partitionBy("pair_id").orderBy("ds_idx")
    raw = F.atan2("co_im", "co_re")
    near = F.max(F.hypot("co_re", "co_im")).over(along.rowsBetween(-win, win - 1))
    base = co.withColumn("raw__", raw).withColumn("near__", near)
    jump = F.col("raw__") - F.lag("raw__").over(along)
    # A jump's size counts after the corrections so far, which are equal for both sides.
    turn = F.when(F.col("near__") < threshold, 0.0).when(jump > math.pi, -2 * math.pi).when(jump < -math.pi, 2 * math.pi).otherwise(0.0)
    return base.withColumn("turn__", turn).withColumn("phi", F.col("raw__") + F.sum("turn__").over(along)).drop("raw__", "near__", "turn__")


def range_difference(phases: DataFrame, wavelength: float, rate: float, speed: float, win: int) -> DataFrame:
    """Add w (displacement) and its Cramer-Rao error from the coherence."""
    co = F.hypot("co_re", "co_im")
    w = F.col("phi") / (4 * math.pi / wavelength - 4 * F.col("range") * rate / speed**2)
    error = F.try_divide(F.sqrt(F.greatest(1 - co * co, F.lit(0.0)) / (2 * win)), co) * wavelength / (4 * math.pi)
    return phases.withColumn("w", w).withColumn("w_err", error)


def strain_rate(differences: DataFrame, low: float, high: float, surface: float = 0.0) -> DataFrame:
    """Slope, intercept and r2 of w over range within the open window, per pair."""
    inside = differences.where((F.col("range") > low) & (F.col("range") < high))
    fit = inside.groupBy("pair_id").agg(F.regr_slope("w", "range").alias("strain"), F.regr_intercept("w", "range").alias("w0"), F.regr_r2("w", "range").alias("r2"))
    return fit.withColumn("shift", F.lit(surface) - F.col("w0"))


def rotate(site: DataFrame, thetas: list[float]) -> DataFrame:
    """Quad-polarised profiles turned to each azimuth: hh, hv, vh, vv (re, im) per site, sample and theta_idx.

    ``site`` has columns shh_re, shh_im, ... svv_im; the azimuths are a literal array.
    """
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(math.cos(t)).alias("c"), F.lit(math.sin(t)).alias("s")) for i, t in enumerate(thetas)])
    out = site.withColumn("t__", F.explode(table))
    c, s = F.col("t__")["c"], F.col("t__")["s"]
    new = {"theta_idx": F.col("t__")["i"]}
    for p in ("re", "im"):
        hh, hv, vh, vv = (F.col(f"s{x}_{p}") for x in ("hh", "hv", "vh", "vv"))
        new |= {f"hh_{p}": hh * c * c + (vh + hv) * s * c + vv * s * s, f"hv_{p}": hv * c * c + (vv - hh) * s * c - vh * s * s,
                f"vh_{p}": vh * c * c + (vv - hh) * s * c - hv * s * s, f"vv_{p}": vv * c * c - (vh + hv) * s * c + hh * s * s}
    keys = [x for x in site.columns if not x.startswith("s") or x in ("site", "sample_idx")]
    return out.select(*keys, *[v.alias(k) for k, v in new.items()])


def coherence_2d(images: DataFrame, n_theta: int, n_range: int) -> DataFrame:
    """Coherence of hh and vv over [i - n_theta, i + n_theta) azimuths and [j - n_range, j + n_range) ranges, wrapped in azimuth.

    Sums over azimuth and then over range are two frames of one dimension, so the
    cost grows with the window's sides, not its area. The last range bin never counts.
    """
    a, b, c, d = map(F.col, ("hh_re", "hh_im", "vv_re", "vv_im"))
    parts = images.select("site", "sample_idx", "theta_idx", (a * c + b * d).alias("x"), (b * c - a * d).alias("y"), (a * a + b * b).alias("p"), (c * c + d * d).alias("q"))
    n = F.max("theta_idx").over(Window.partitionBy("site")) + 1
    last = F.max("sample_idx").over(Window.partitionBy("site"))
    sized = parts.withColumn("n__", n).withColumn("last__", last)
    names = ("x", "y", "p", "q")
    wrapped = sized.withColumn("t__", F.explode(F.filter(
        F.array(F.col("theta_idx"), F.col("theta_idx") - F.col("n__"), F.col("theta_idx") + F.col("n__")), lambda t: (t >= -n_theta) & (t < F.col("n__") + n_theta))))
    across = Window.partitionBy("site", "sample_idx").orderBy("t__").rowsBetween(-n_theta, n_theta - 1)
    once = wrapped.withColumns({f"{k}1": F.sum(k).over(across) for k in names}).where((F.col("t__") >= 0) & (F.col("t__") < F.col("n__")))
    down = Window.partitionBy("site", "theta_idx").orderBy("sample_idx").rowsBetween(-n_range, n_range - 1)
    twice = once.withColumns({f"{k}2": F.sum(F.when(F.col("sample_idx") < F.col("last__"), F.col(f"{k}1"))).over(down) for k in names})
    root = F.sqrt(F.col("p2") * F.col("q2"))
    return twice.select("site", "sample_idx", "theta_idx", F.try_divide("x2", root).alias("co_re"), F.try_divide("y2", root).alias("co_im"))


def phase_gradient(co: DataFrame, ranges: Column) -> DataFrame:
    """Derivative of the phase of co over range: (R I' - I R') / (R^2 + I^2)."""
    along = Window.partitionBy("site", "theta_idx").orderBy("sample_idx")
    r, i = F.col("co_re"), F.col("co_im")
    dr, di = gradient(r, ranges, along), gradient(i, ranges, along)
    return co.withColumn("dphi", F.try_divide(r * di - i * dr, r * r + i * i))


def power_anomaly(images: DataFrame, name: str = "hv") -> DataFrame:
    """20 log10 of the amplitude less its mean over azimuths, for each range."""
    level = 10 * F.log10(F.col(f"{name}_re") * F.col(f"{name}_re") + F.col(f"{name}_im") * F.col(f"{name}_im"))
    return images.withColumn("db__", level).withColumn("anomaly", F.col("db__") - F.avg("db__").over(Window.partitionBy("site", "sample_idx"))).drop("db__")


def extinction_axis(anomalies: DataFrame, first: int, last: int) -> DataFrame:
    """For each range the azimuth index in [first, last) with the least anomaly, ties to the first."""
    inside = anomalies.where((F.col("theta_idx") >= first) & (F.col("theta_idx") < last))
    return inside.groupBy("site", "sample_idx").agg(F.min(F.struct("anomaly", "theta_idx"))["theta_idx"].alias("cpe_idx"))


def fabric_strength(dphi: Column, centre: float, speed: float = 3e8, delta_eps: float = 0.035, eps: float = 3.12) -> Column:
    return speed / (4 * math.pi * centre) * (2 * math.sqrt(eps) / delta_eps) * dphi


def phase_by_place(profile: DataFrame, seed: int) -> Column:
    """A phase in [0, 2 pi) for each sample, mixed from its place and the seed in 32 bits, so that it is the same at every reading.

    The place is what there is of acq_id, burst, chirp and sample_idx, whole numbers or texts.
    """
    def whole(name: str) -> Column:
        kind = profile.schema[name].dataType
        return F.col(name).cast("long") if isinstance(kind, T.IntegralType) else F.crc32(F.col(name).cast("string"))

    place = [F.pmod(F.coalesce(whole(c), F.lit(-1)), F.lit(1 << 32)) for c in ("acq_id", "burst", "chirp", "sample_idx") if c in profile.columns]

    def mixed(h: Column, c: Column) -> Column:
        x = h.bitwiseXOR(c)
        y = (x.bitwiseXOR(F.shiftright(x, 16)) * 0x45D9F3B) % (1 << 32)
        return y.bitwiseXOR(F.shiftright(y, 15))

    return F.aggregate(F.array(*place), F.lit(seed % (1 << 32)).cast("long"), mixed) * (2 * math.pi / (1 << 32))


def phase_uncertainty(profile: DataFrame, bed_range: float, seed: int = 0) -> DataFrame:
    """Phase error from a noise phasor of the median magnitude below the bed and a seeded phase (see :func:`phase_by_place`); null without samples below the bed."""
    size = F.hypot("re", "im")
    below = stored(profile.where(F.col("range") > bed_range).select("acq_id", size.alias("size")), "noise")
    noise = quantiles(below, ["acq_id"], "size", [0.5]).select("acq_id", F.col("quantiles")[0].alias("noise"))
    ratio = F.abs(F.col("noise") * F.sin(phase_by_place(profile, seed) - F.atan2("im", "re"))) / size
    return profile.join(noise, "acq_id", "left").withColumn("uncertainty", F.when(ratio <= 1, F.asin(ratio)))


def vertical_spectrum(traces: DataFrame, dt: float, snum: int) -> DataFrame:
    """Mean power of each frequency (MHz) over all traces of a profile; rows are transformed where they are."""
    power = map_arrays(traces.select("profile_id", "samples"), ["samples"], lambda x: (np.abs(np.fft.rfft(x, snum)[:, : snum // 2]) ** 2,), power="double")
    flat = power.select("profile_id", F.posexplode("power").alias("bin", "p"))
    return flat.groupBy("profile_id", "bin").agg(F.avg("p").alias("power")).withColumn("mhz", F.col("bin") / (snum * dt) / 1e6)


def periodogram(traces: DataFrame, dt: float, snum: int, scaling: str = "spectrum") -> DataFrame:
    """One-sided periodogram of each trace less its mean, boxcar window."""
    twice = np.full(snum // 2 + 1, 2.0)
    twice[0] = 1.0
    if snum % 2 == 0:
        twice[-1] = 1.0
    scale = twice * (1 / snum**2 if scaling == "spectrum" else dt / snum)
    power = map_arrays(traces.select("profile_id", "trace_idx", "samples"), ["samples"], lambda x: (np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), snum)) ** 2 * scale,), power="double")
    flat = power.select("profile_id", "trace_idx", F.posexplode("power").alias("bin", "power"))
    return flat.withColumn("hz", F.col("bin") / (snum * dt))


def horizontal_spectrum(traces: DataFrame, spacing: float) -> DataFrame:
    """Mean power over samples of every frequency along the traces from 0 on, with its wavelength.

    A group holds one number a trace: the traces of one sample. Their powers are
    averaged over samples in partial sums.
    """
    rows = to_arrays(long_samples(traces, "profile_id", "trace_idx").select("profile_id", F.col("sample_idx").alias("row"), F.col("trace_idx").alias("sample_idx"), "v"), "profile_id", "row")
    power = map_arrays(rows.withColumn("n", F.size("samples")), ["samples"], lambda x: (np.abs(np.fft.fft(x)[:, : (x.shape[1] + 1) // 2]) ** 2,), power="double")
    powers = power.select("profile_id", "n", F.posexplode("power").alias("bin", "power"))
    wavelength = F.when(F.col("bin") > 0, F.lit(spacing) * F.max("n") / F.col("bin"))
    return powers.groupBy("profile_id", "bin").agg(F.avg("power").alias("power"), wavelength.alias("wavelength"))


def chirp_header(header: Column, clock: float = 1e9, eps: float = 3.18) -> dict[str, Column]:
    """Chirp parameters from a header's register lines such as Reg0B="6666666633333333".

    Frequencies are 32-bit tuning words of the clock: Reg0B stop and start, Reg0C
    down and up steps, Reg0D down and up times in units of four clock ticks.
    """
    def word(register: str, first: int, count: int) -> Column:
        digits = F.regexp_extract(header, f'Reg{register}="([0-9A-Fa-f]+)"', 1)
        return F.conv(F.nullif(digits.substr(first, count), F.lit("")), 16, 10).cast("double")

    tune = clock / 2**32
    start, stop, step = word("0B", 9, 8) * tune, word("0B", 1, 8) * tune, word("0C", 9, 8) * tune
    tick = word("0D", 5, 4) * 4 / clock
    count = F.rint(F.abs((stop - start) / step))
    speed = 3e8 / math.sqrt(eps)
    length = count * tick
    rate = 2 * math.pi * step / tick
    band = rate / (2 * math.pi) * length
    centre = start + band / 2
    return {"f_start": start, "f_stop": stop, "steps": count, "chirp_length": length, "rate": rate, "bandwidth": band, "centre": centre,
            "wavelength": speed / centre, "samples": F.regexp_extract(header, r"N_ADC_SAMPLES=(\d+)", 1).try_cast("int")}


def zip_acquisitions(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """Join complex profiles (re, im, range) on key and sample; columns <name>_re and <name>_im.

    Refuses acquisitions that differ in their samples or ranges.
    """
    names = list(parts)
    cut = [df.select(*keys, F.col("range").alias(f"{n}_range"), F.col("re").alias(f"{n}_re"), F.col("im").alias(f"{n}_im")) for n, df in parts.items()]
    out = cut[0]
    for df in cut[1:]:
        out = out.join(df, keys, "full")
    first = F.col(f"{names[0]}_range")
    differ = F.lit(False)
    for n in names[1:]:
        differ = differ | ~first.eqNullSafe(F.col(f"{n}_range"))
    checked = F.when(differ, F.raise_error(F.lit("acquisitions differ in samples or ranges")).cast("double")).otherwise(first)
    return out.select(*keys, checked.alias("range"), *[F.col(f"{n}_{p}") for n in names for p in ("re", "im")])


def coherence_of(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Complex coherence of two columns of complex numbers (re1, im1, re2, im2) over each group."""
    a, b, c, d = map(F.col, ("re1", "im1", "re2", "im2"))
    root = F.sqrt(F.sum(a * a + b * b) * F.sum(c * c + d * d))
    return pairs.groupBy(*keys).agg(F.try_divide(F.sum(a * c + b * d), root).alias("co_re"), F.try_divide(F.sum(b * c - a * d), root).alias("co_im"))


def azimuth_rotation(images: DataFrame, thetas: list[float], azimuth: float) -> DataFrame:
    """Shift the azimuths of an image so that a known antenna orientation comes first."""
    if azimuth == 0:
        return images
    limit = 0.0 if azimuth < 0 else math.pi
    first = next((i for i, t in enumerate(thetas) if t + azimuth > limit), None)
    if first is None:
        raise ValueError("no azimuth lies beyond the orientation")
    return images.withColumn("theta_idx", F.pmod(F.col("theta_idx") - first, F.lit(len(thetas))).cast("int"))


def low_pass_range(images: DataFrame, column: str, cutoff: float, rate: float, order: int = 3) -> DataFrame:
    """Zero-phase low-pass of a column along range for each site and azimuth; missing values are left out.

    A series is one array, and many are filtered at a time.
    """
    from ..functions.filters import padding_of, sections, zero_phase

    sos, padding = sections(order, [2 * cutoff / rate], "low"), padding_of(order, "low")
    keys = ["site", "theta_idx"]
    there = F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))

    def work(x: np.ndarray) -> tuple[np.ndarray]:
        return (zero_phase(sos, x.T, padding).T if x.shape[1] > padding else x,)

    rest = [F.col(c) for c in images.columns if c not in (*keys, column)]
    row = F.struct(F.col("sample_idx").alias("at__"), F.when(there, F.col(column).cast("double")).alias("x__"), F.struct(*rest).alias("rest__"))
    series = images.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("rows__"))
    known = F.filter("rows__", lambda r: r["x__"].isNotNull())
    passed = map_arrays(series.select(*keys, "rows__", F.transform(known, lambda r: r["x__"]).alias("known__")), ["known__"], work, passed__="double")
    # Values come first and then what is missing, so that the filtered ones meet their rows by place.
    ordered = F.concat(known, F.filter("rows__", lambda r: r["x__"].isNull()))
    rows = passed.select(*keys, "passed__", F.posexplode(ordered).alias("place__", "r__"))
    value = F.get("passed__", F.col("place__")).cast(images.schema[column].dataType)
    return rows.select(*[value.alias(c) if c == column else F.col(c) if c in keys else F.col("r__")["rest__"][c].alias(c) for c in images.columns])


def bed_pick(pair: DataFrame, differences: DataFrame, kernel: int = 201, prominence: float = 10.0, width: float = 300.0, most_apart: int = 50, least_coherence: float = 0.9) -> DataFrame:
    """The bed of each pair: last wide peak of the smoothed power of both profiles, with its coherence.

    A profile is one array down the samples. Without a peak, too far apart or too
    little coherent, the reason is in ``fault``; in the first two cases the rest is null.
    """
    half = kernel // 2
    down = Window.partitionBy("pair_id").orderBy("sample_idx")
    near = down.rowsBetween(-half, half)

    def smooth(re: str, im: str) -> Column:
        """Running median of dB, zeros beyond the ends."""
        power = 10 * F.log10(F.greatest(F.col(re) * F.col(re) + F.col(im) * F.col(im), F.lit(1e-300)))
        zeros = F.array_repeat(F.lit(0.0), (kernel - F.count(F.lit(1)).over(near)).cast("int"))
        return F.get(F.sort_array(F.concat(F.collect_list(power).over(near), zeros)), F.lit(half))

    rows = pair.withColumns({"x1": smooth("re1", "im1"), "x2": smooth("re2", "im2")})
    arrays = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("sample_idx", "x1", "x2", "range"))).alias("p"))
    arrays = arrays.select("pair_id", F.col("p.x1").alias("x1"), F.col("p.x2").alias("x2"), F.col("p.range").alias("ranges"))
    found = with_peaks(with_peaks(arrays, "x1", "at1", prominence, width), "x2", "at2", prominence, width)
    found = found.select("pair_id", "ranges", "x1", "x2", F.array_max("at1").alias("p1"), F.array_max("at2").alias("p2"))
    size = F.hypot("co_re", "co_im")
    co = differences.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("range", size.alias("size")))).alias("c"))
    both = found.join(co, "pair_id", "full")
    fault = F.when(F.col("p1").isNull() | F.col("p2").isNull(), "no peak").when(F.abs(F.col("p1") - F.col("p2")) >= most_apart, "picks too far apart")
    picked = both.withColumn("fault", fault).withColumn("sample", F.when(F.col("fault").isNull(), F.floor((F.col("p1") + F.col("p2")) / 2).cast("int")))
    picked = picked.withColumn("range", F.get("ranges", F.col("sample")))
    away = F.transform("c", lambda r: F.abs(r["range"] - F.col("range")))
    picked = picked.withColumn("near__", F.array_position(away, F.array_min(away)).cast("int") - 1)
    first = F.greatest(F.col("near__") - 10, F.lit(0))
    part = F.sort_array(F.filter(F.transform(F.slice("c", first + 1, F.col("near__") + 10 - first), lambda r: r["size"]), lambda v: v.isNotNull()))
    picked = picked.withColumn("part__", part).withColumn("m__", F.size("part__"))
    middle = (F.get("part__", F.floor((F.col("m__") - 1) / 2).cast("int")) + F.get("part__", F.floor(F.col("m__") / 2).cast("int"))) / 2
    there = F.col("sample").isNotNull()
    out = picked.withColumn("coherence", F.when(there, F.coalesce(F.when(F.col("m__") > 0, middle), F.lit(0.0))))
    level = (F.get("x1", F.col("p1")) + F.get("x2", F.col("p2"))) / 2
    fault = F.coalesce(F.col("fault"), F.when(F.col("coherence") <= least_coherence, "coherence too low"))
    return out.select("pair_id", F.col("sample").alias("sample_idx"), "range", "coherence", F.when(there, level).alias("power"), fault.alias("fault"))


def noise_error(values: DataFrame, win: int, column: str = "uncertainty") -> DataFrame:
    """Mean of a phase uncertainty over [i - win // 2, i + win // 2) samples."""
    near = Window.partitionBy("pair_id").orderBy("sample_idx").rowsBetween(-(win // 2), win // 2 - 1)
    return values.withColumn("error", F.avg(column).over(near))


def single_chain(chirps: DataFrame, bed_range: float, count: int | None = None, seed: int = 0, **conversion) -> DataFrame:
    """Range conversion, stacking of complex profiles and phase uncertainty of single acquisitions."""
    profile = range_convert(chirps, **conversion)
    if count is not None:
        place = F.dense_rank().over(Window.partitionBy("acq_id").orderBy("burst", "chirp"))
        profile = profile.withColumn("n__", place).where(F.col("n__") <= count).drop("n__")
    stacked = profile.groupBy("acq_id", "sample_idx").agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.first("range").alias("range"))
    return phase_uncertainty(stacked, bed_range, seed)


class Differences(NamedTuple):
    """What a chain of time pairs gives; nothing is computed that is not used."""

    differences: DataFrame
    strain: DataFrame
    bed: DataFrame


def difference_chain(pair: DataFrame, win: int, step: int, wavelength: float, rate: float, speed: float, low: float, high: float, **bed) -> Differences:
    """Coherence, unwrapped phase and displacement of time pairs with a range column, their strain rates, and beds (options of :func:`bed_pick`)."""
    co = phase_difference(pair, win, step)
    differences = range_difference(unwrap(co), wavelength, rate, speed, win)
    return Differences(differences, strain_rate(differences, low, high), bed_pick(pair, differences, **bed))


def polarised_chain(site: DataFrame, thetas: list[float], first: int, last: int, n_theta: int, n_range: int) -> DataFrame:
    """Rotation, extinction axis and coherence along it, per site and range."""
    images = rotate(site, thetas)
    axis = extinction_axis(power_anomaly(images), first, last)
    co = coherence_2d(images, n_theta, n_range)
    return co.join(axis, ["site", "sample_idx"]).where(F.col("theta_idx") == F.col("cpe_idx")).drop("theta_idx")
