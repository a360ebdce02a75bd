"""Operators over neighbouring traces or samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import doubles
from ..plans.tables import samples as long_samples

ALONG = ("profile_id", "sample_idx")


def taper(travel_time: list[float]) -> Column:
    """exp(-0.05 t), 1 at the first sample; t in microseconds."""
    t = doubles(travel_time)
    return F.transform(t, lambda x: F.exp(F.lit(-0.05) * x) / F.exp(F.lit(-0.05 * travel_time[0])))


def to_arrays(flat: DataFrame, *keep: str) -> DataFrame:
    """Long samples back to one array per trace."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "v"))), lambda x: x["v"])
    return flat.groupBy(*keep).agg(rows.alias("samples"))


def mean_trace(traces: DataFrame, first: int, last: int) -> DataFrame:
    """The mean of traces [first, last) of each profile, as an array; bounds are clipped to the profile."""
    sizes = traces.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n__"))
    low = F.greatest(F.lit(0), F.least(F.lit(first), F.col("n__") - 1))
    high = F.greatest(low + 1, F.least(F.lit(last), F.col("n__")))
    inside = traces.join(sizes, "profile_id").where((F.col("trace_idx") >= low) & (F.col("trace_idx") < high))
    means = long_samples(inside, "profile_id").groupBy("profile_id", "sample_idx").agg(F.avg("v").alias("v"))
    return to_arrays(means, "profile_id").withColumnRenamed("samples", "mean")


def remove_mean_trace(traces: DataFrame, travel_time: list[float], first: int, last: int) -> DataFrame:
    """Subtract the tapered mean of some traces from all; only partial sums are shuffled, one array per profile joined back."""
    mean = mean_trace(traces, first, last).withColumn("mean", F.zip_with("mean", taper(travel_time), lambda m, w: m * w))
    joined = traces.join(mean, "profile_id")
    return joined.withColumn("samples", F.zip_with("samples", "mean", lambda v, m: v - m)).drop("mean")


def window_average(traces: DataFrame, travel_time: list[float], width: int, shape: str = "full") -> DataFrame:
    """Subtract the mean of the traces around each: [i - h, i + h), h half of the odd width less one.

    ``shape``: full subtracts all of it, pexp a share that grows with depth.
    Returns long samples (profile_id, trace_idx, sample_idx, v).
    """
    width += width % 2 == 0
    half = (width - 1) // 2
    near = Window.partitionBy(*ALONG).orderBy("trace_idx").rowsBetween(-half, half - 1)
    flat = long_samples(traces, "profile_id", "trace_idx")
    mean = F.avg("v").over(near)
    if shape == "full":
        weight = F.lit(1.0)
    elif shape == "pexp":
        import math

        e = [math.exp(-0.05 * t) / math.exp(-0.05 * travel_time[0]) for t in travel_time]
        p = [x - e[-1] for x in e]
        top = max(p)
        weight = F.get(doubles([x / top for x in p]), F.col("sample_idx"))
    else:
        raise ValueError(f"unknown taper {shape}")
    return flat.withColumn("v", F.col("v") - mean * weight)


def adaptive_means(traces: DataFrame, width: int) -> DataFrame:
    """Long samples with ``mean``: of the first traces near the start, the last near the end, and around elsewhere."""
    half = width // 2
    along = Window.partitionBy(*ALONG).orderBy("trace_idx")
    size = F.count(F.lit(1)).over(Window.partitionBy(*ALONG))
    flat = long_samples(traces, "profile_id", "trace_idx")
    start = F.avg("v").over(along.rowsBetween(Window.unboundedPreceding, half - 1))
    middle = F.avg("v").over(along.rowsBetween(1 - half, half - 1))
    backwards = Window.partitionBy(*ALONG).orderBy(F.desc("trace_idx"))
    end = F.max(F.when(F.col("back__") == 1, F.col("last__"))).over(Window.partitionBy(*ALONG))
    return (
        flat.withColumn("n__", size)
        .withColumn("back__", F.row_number().over(backwards))
        .withColumn("last__", F.avg("v").over(along.rowsBetween(1 - width, 0)))
        .withColumn("mean", F.when(F.col("trace_idx") <= half, start).when(F.col("trace_idx") >= F.col("n__") - half, end).otherwise(middle))
        .drop("n__", "back__", "last__")
    )


def agc(traces: DataFrame, window: int = 50, scale: float = 50.0) -> DataFrame:
    """Divide by the largest amplitude of all traces within the window of samples, times ``scale``."""
    peaks = long_samples(traces, "profile_id").groupBy("profile_id", "sample_idx").agg(F.max(F.abs("v")).alias("peak"))
    near = Window.partitionBy("profile_id").orderBy("sample_idx").rowsBetween(-(window // 2), window // 2 - 1)
    most = F.coalesce(F.max("peak").over(near), F.lit(0.0))
    gain = peaks.withColumn("v", F.lit(scale) / F.when(most == 0, F.lit(1e-6)).otherwise(most))
    gains = to_arrays(gain, "profile_id").withColumnRenamed("samples", "gain")
    return traces.join(gains, "profile_id").withColumn("samples", F.zip_with("samples", "gain", lambda v, g: v * g)).drop("gain")


def range_gain(traces: DataFrame, travel_time: list[float], slope: float) -> DataFrame:
    """Samples after the trigger times travel time times slope; row-local."""
    t = doubles(travel_time)
    gained = F.transform("samples", lambda v, j: F.when(j > F.col("trig"), v * F.get(t, j) * slope).otherwise(v))
    return traces.withColumn("samples", gained)


def around(column: str, size: int, value) -> Column:
    """For each sample an array of ``value`` over ``size`` samples, from size // 2 before it on; row-local."""
    steps = F.sequence(F.lit(-(size // 2)), F.lit(size - 1 - size // 2))
    return F.transform(column, lambda v, k: F.transform(steps, lambda d: value(k + d)))


def wiener(traces: DataFrame, vertical: int = 1, horizontal: int = 10, noise: float | None = None) -> DataFrame:
    """Wiener denoising over a window of traces and samples; beyond the edges counts as zero.

    Sums over samples are made within each trace, and those over traces by a window
    of one number a trace. ``noise``: power of the noise, by default the mean of
    the local variances of the profile. Returns long samples.
    """
    left, right = -(horizontal // 2), horizontal - 1 - horizontal // 2
    near = Window.partitionBy(*ALONG).orderBy("trace_idx").rowsBetween(left, right)
    if vertical == 1:
        flat = long_samples(traces, "profile_id", "trace_idx").withColumn("s__", F.col("v")).withColumn("q__", F.col("v") * F.col("v"))
    else:
        def there(k: Column) -> Column:
            return F.when(k >= 0, F.coalesce(F.get("samples", k), F.lit(0.0))).otherwise(0.0)

        sums = F.transform(around("samples", vertical, there), lambda a: F.struct(
            F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v).alias("s"), F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v * v).alias("q")))
        rows = F.posexplode(F.arrays_zip(F.col("samples").alias("v"), sums.alias("z"))).alias("sample_idx", "x")
        flat = traces.select("profile_id", "trace_idx", rows).select("profile_id", "trace_idx", "sample_idx", F.col("x.v").alias("v"), F.col("x.z.s").alias("s__"), F.col("x.z.q").alias("q__"))
    size = vertical * horizontal
    stats = (
        flat.withColumn("m__", F.sum("s__").over(near) / size)
        .withColumn("q__", F.sum("q__").over(near) / size - F.col("m__") * F.col("m__"))
    )
    if noise is None:
        level = stats.groupBy("profile_id").agg(F.avg("q__").alias("noise__"))
        joined = stats.join(level, "profile_id")
    else:
        joined = stats.withColumn("noise__", F.lit(float(noise)))
    out = F.when(F.col("q__") < F.col("noise__"), F.col("m__")).otherwise(F.col("m__") + (1 - F.col("noise__") / F.col("q__")) * (F.col("v") - F.col("m__")))
    return joined.select("profile_id", "trace_idx", "sample_idx", out.alias("v"))


def median_filter(traces: DataFrame, width: int, height: int = 1) -> DataFrame:
    """Median over neighbouring traces and samples, the edges mirrored; long samples.

    The frame is collected and sorted, for medians take no moving frames; it holds
    ``width`` times ``height`` values.
    """
    whole = Window.partitionBy(*ALONG)
    last = F.size("samples") - 1

    def mirrored(k: Column) -> Column:
        return F.get("samples", F.when(k < 0, -k - 1).when(k > last, 2 * last + 1 - k).otherwise(k))

    columns = traces.select("profile_id", "trace_idx", F.posexplode(around("samples", height, mirrored)).alias("sample_idx", "a"))
    flat = columns.withColumn("n__", F.count(F.lit(1)).over(whole))
    near = F.collect_list(F.struct("trace_idx", "a")).over(whole.orderBy("trace_idx").rowsBetween(-width, width))
    framed = flat.withColumn("f__", near)

    def values(step: int) -> Column:
        at = F.col("trace_idx") + step
        there = F.when(at < 0, -at - 1).when(at >= F.col("n__"), 2 * F.col("n__") - 1 - at).otherwise(at)
        return F.filter("f__", lambda x: x["trace_idx"] == there)[0]["a"]

    every = F.sort_array(F.flatten(F.array(*[values(s) for s in range(-(width // 2), width - width // 2)])))
    return framed.select("profile_id", "trace_idx", "sample_idx", every[width * height // 2].alias("v"))


def gradient(value: Column, along: Column, window) -> Column:
    """Central differences over a window's order, one-sided at its ends; spacing may vary."""
    v0, v1 = F.lag(value).over(window), F.lead(value).over(window)
    x0, x1 = F.lag(along).over(window), F.lead(along).over(window)
    a, b = along - x0, x1 - along
    inner = (a * a * v1 - b * b * v0 + (b * b - a * a) * value) / (a * b * (a + b))
    return F.when(v0.isNull(), (v1 - value) / b).when(v1.isNull(), (value - v0) / a).otherwise(inner)


def coherence_over(keys: list[str], order: str, width: int, re1: str = "re1", im1: str = "im1", re2: str = "re2", im2: str = "im2") -> tuple[Column, Column]:
    """Real and imaginary part of the moving coherence of two complex columns over [i - w//2, i + w//2)."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width // 2), width // 2 - 1)
    a, b, c, d = map(F.col, (re1, im1, re2, im2))
    root = F.sqrt(F.sum(a * a + b * b).over(near) * F.sum(c * c + d * d).over(near))
    return F.try_divide(F.sum(a * c + b * d).over(near), root), F.try_divide(F.sum(b * c - a * d).over(near), root)




def smooth_samples(x: np.ndarray) -> np.ndarray:
    """Four equal weights along the rows of (samples x traces), forwards and backwards, edges continued by point reflection."""
    pad = min(12, len(x) - 1)
    wide = np.vstack([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    for _ in range(2):  # a moving mean whose past is the first value, then the same backwards
        past = np.vstack([np.repeat(wide[:1], 3, 0), wide])
        wide = (sum(past[k : k + len(wide)] for k in range(4)) / 4)[::-1]
    return wide[pad : pad + len(x)]


def adaptive_filter(traces: DataFrame, travel_time: list[float], width: int) -> DataFrame:
    """Subtract an adaptive mean: smoothed along samples by four equal weights, forwards and backwards, and tapered.

    Returns traces with arrays; the smoothing is row-local on the arrays of means.
    """
    from .filters import map_samples

    means = to_arrays(adaptive_means(traces, width).select("profile_id", "trace_idx", "sample_idx", F.col("mean").alias("v")), "profile_id", "trace_idx")
    smoothed = map_samples(means, smooth_samples).withColumnRenamed("samples", "mean__")
    joined = traces.join(smoothed, ["profile_id", "trace_idx"])
    tapered = F.zip_with("mean__", taper(travel_time), lambda m, w: m * w)
    return joined.withColumn("samples", F.zip_with("samples", tapered, lambda v, m: v - m)).drop("mean__")


def horizontal_filter(traces: DataFrame, kind: str, travel_time: list[float], bounds: tuple[int, int] | None = None, width: int | None = None) -> DataFrame:
    """Dispatch by name: hfilt (mean of some traces) or adaptive."""
    if kind == "hfilt" and bounds:
        return remove_mean_trace(traces, travel_time, *bounds)
    if kind == "adaptive" and width:
        return adaptive_filter(traces, travel_time, width)
    raise ValueError(f"{kind} is no filter or lacks its bounds or width")


def trigger_sample(traces: DataFrame, share: float = 0.5) -> DataFrame:
    """For each profile the first sample whose mean absolute amplitude exceeds a share of the largest."""
    means = long_samples(traces, "profile_id").groupBy("profile_id", "sample_idx").agg(F.avg(F.abs("v")).alias("m"))
    most = F.max("m").over(Window.partitionBy("profile_id"))
    return means.withColumn("most__", most).where(F.col("m") > share * F.col("most__")).groupBy("profile_id").agg(F.min("sample_idx").alias("trig"))
