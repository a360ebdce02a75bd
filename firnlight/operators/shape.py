"""Operators that select, reorder and stack traces.

``traces`` has a row per trace: profile_id, trace_idx (from 0), samples (array
of double, null where missing) and geometry columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import first_at_least
from .along import renumbered, with_profile

GEOMETRY = ("dist", "lat", "long", "elev", "decday", "x_coord", "y_coord", "pressure", "trig")


def crop(traces: DataFrame, start: int | Column = 0, stop: int | Column | None = None) -> DataFrame:
    """Keep samples [start, stop) of every trace."""
    start = F.lit(start) if isinstance(start, int) else start
    stop = F.size("samples") if stop is None else F.lit(stop) if isinstance(stop, int) else stop
    return traces.withColumn("samples", F.slice("samples", start + 1, F.greatest(stop - start, F.lit(0))))


def crop_time(traces: DataFrame, travel_time: list[float], limit: float, side: str = "top") -> DataFrame:
    """Crop where the travel time first reaches ``limit``; top keeps from there, bottom up to there."""
    at = first_at_least(travel_time, limit)
    return crop(traces, at) if side == "top" else crop(traces, 0, at)


def crop_pretrigger(traces: DataFrame) -> DataFrame:
    """Shift every trace up by its own trigger; the shared height shrinks by the least trigger of the profile."""
    traces = with_profile(traces, least__=F.min("trig"))
    height = (F.size("samples") - F.col("least__")).cast("int")
    moved = F.transform(F.sequence(F.lit(0), height - 1), lambda j: F.get("samples", (F.col("trig") + j).cast("int")))
    return traces.withColumn("samples", F.when(height > 0, moved).otherwise(F.array().cast("array<double>"))).withColumn("trig", F.lit(0)).drop("least__")


def crop_picks(picks: DataFrame, start: int, height: int) -> DataFrame:
    """Picks after a crop of the top: moved up, and null outside the new height."""
    out = picks
    for c in ("samp1", "samp2", "samp3"):
        moved = F.col(c) - start
        out = out.withColumn(c, F.when((moved >= 0) & (moved < height), moved))
    return out


def _renumber(traces: DataFrame, first: Column) -> DataFrame:
    out = traces.withColumn("trace_idx", (F.col("trace_idx") - first).cast("int"))
    return out.withColumn("trace_num", F.col("trace_idx") + 1) if "trace_num" in traces.columns else out


def hcrop(traces: DataFrame, trace_num: int, side: str = "left") -> DataFrame:
    """Keep the traces from number ``trace_num`` on (left), or those before it (right); numbers start at 1.

    Distances and numbers start anew. The predicate is on a plain column, so it reaches the scan.
    """
    if trace_num < 2:
        raise ValueError("a crop at trace 0 or 1 leaves everything or nothing")
    if side == "right":
        return traces.where(F.col("trace_idx") < trace_num - 1)
    kept = traces.where(F.col("trace_idx") >= trace_num - 1)
    rebased = with_profile(kept, start__=F.min("dist")).withColumn("dist", F.col("dist") - F.col("start__")).drop("start__")
    return _renumber(rebased, F.lit(trace_num - 1))


def hcrop_distance(traces: DataFrame, limit: float, side: str = "left") -> DataFrame:
    """As :func:`hcrop` at the first trace of each profile whose distance reaches ``limit``."""
    marked = with_profile(traces, at__=F.min(F.when(F.col("dist") >= limit, F.col("trace_idx"))))
    if side == "right":
        return marked.where(F.col("trace_idx") < F.col("at__")).drop("at__")
    kept = marked.where(F.col("trace_idx") >= F.col("at__"))
    rebased = with_profile(kept, start__=F.min("dist")).withColumn("dist", F.col("dist") - F.col("start__"))
    return _renumber(rebased, F.col("at__")).drop("at__", "start__")


def restack(traces: DataFrame, count: int) -> DataFrame:
    """Mean of every ``count`` traces (made odd); an incomplete last stack is left out.

    A sample that is missing in one trace of a stack is missing in the stack. The
    arrays of a stack meet in one row, which holds ``count`` traces.
    """
    n = count + 1 if count % 2 == 0 else count
    stack = F.floor(F.col("trace_idx") / n).cast("int")
    geometry = [c for c in GEOMETRY if c in traces.columns]
    base = traces.withColumn("stack", stack)
    rows = F.array_sort(F.collect_list(F.struct("trace_idx", F.coalesce("samples", F.array().cast("array<double>")).alias("a"))))
    stacks = base.groupBy("profile_id", "stack").agg(*[F.avg(c).alias(c) for c in geometry], rows.alias("rows__")).where(F.size("rows__") == n)
    height = F.array_min(F.transform("rows__", lambda r: F.size(r["a"])))
    mean = F.transform(F.sequence(F.lit(0), height - 1), lambda k: F.aggregate("rows__", F.lit(0.0), lambda acc, r: acc + F.get(r["a"], k)) / n)
    out = stacks.withColumn("samples", F.when(height > 0, mean).otherwise(F.array().cast("array<double>"))).drop("rows__")
    return out.withColumnRenamed("stack", "trace_idx").withColumn("trace_num", F.col("trace_idx") + 1)


def restack_picks(picks: DataFrame, count: int, snum: int) -> DataFrame:
    """Picks of stacked traces: means of what is there, sample numbers cut to integers within the profile."""
    n = count + 1 if count % 2 == 0 else count
    grouped = picks.withColumn("stack", F.floor(F.col("trace_idx") / n).cast("int")).groupBy("profile_id", "picknum", "stack")
    means = grouped.agg(F.count(F.lit(1)).alias("n__"), *[F.avg(c).alias(c) for c in ("samp1", "samp2", "samp3", "power")]).where(F.col("n__") == n).drop("n__")
    for c in ("samp1", "samp2", "samp3"):
        whole = F.col(c).cast("int").cast("double")
        means = means.withColumn(c, F.when((whole >= 0) & (whole < snum), whole))
    return means.withColumnRenamed("stack", "trace_idx")


def reverse(traces: DataFrame) -> DataFrame:
    """Turn every profile around; distances are measured from the new start."""
    ends = {"last__": F.max("trace_idx")} | ({"far__": F.max("dist")} if "dist" in traces.columns else {})
    out = with_profile(traces, **ends)
    out = out.withColumn("trace_idx", (F.col("last__") - F.col("trace_idx")).cast("int"))
    if "dist" in traces.columns:
        out = out.withColumn("dist", F.col("far__") - F.col("dist"))
    out = out.drop(*ends)
    return out.withColumn("trace_num", F.col("trace_idx") + 1) if "trace_num" in traces.columns else out


def concat(traces: DataFrame, order: str = "profile_id", name: str = "cat") -> DataFrame:
    """Profiles one after the other: indices and distances go on where the last ended.

    Offsets come from one row per profile, so no window sees all traces.
    """
    ends = traces.groupBy("profile_id").agg(
        F.count(F.lit(1)).alias("n__"), F.min("trace_idx").alias("first__"), F.max("dist").alias("d__"),
        *([F.first(order).alias("o__")] if order != "profile_id" else []))
    before = Window.orderBy("o__" if order != "profile_id" else "profile_id").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ends.select("profile_id", "first__", F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("n0__"), F.coalesce(F.sum("d__").over(before), F.lit(0.0)).alias("d0__"))
    joined = traces.join(shifts, "profile_id")
    return (
        renumbered(joined).withColumn("trace_idx", (F.col("trace_idx") + F.col("n0__")).cast("int"))
        .withColumn("dist", F.col("dist") + F.col("d0__")).withColumn("profile_id", F.lit(name))
        .drop("first__", "n0__", "d0__")
    )


def concat_picks(picks: DataFrame, traces: DataFrame) -> DataFrame:
    """Picks of all layers on all traces of the concatenated profiles; null where a profile lacks the layer."""
    # Layers are a handful of numbers: one array that every trace explodes, and no join without a key.
    layers = picks.agg(F.collect_set("picknum").alias("layers__"))
    every = traces.select("profile_id", "trace_idx").crossJoin(layers).select("profile_id", "trace_idx", F.explode("layers__").alias("picknum"))
    return every.join(picks, ["profile_id", "trace_idx", "picknum"], "left")


def elevation_correct(traces: DataFrame, dt: float, velocity: float = 1.69e8) -> DataFrame:
    """Shift each trace down by its elevation below the highest; missing samples are null."""
    dz = dt * velocity / 2
    ends = with_profile(traces, top__=F.max("elev"), low__=F.min("elev"))
    marked = ends.withColumn("down__", ((F.col("top__") - F.col("elev")) / dz).cast("int"))
    deepest = ((F.col("top__") - F.col("low__")) / dz).cast("int")
    none = F.lit(None).cast("double")
    padded = F.concat(F.array_repeat(none, F.col("down__")), F.col("samples"), F.array_repeat(none, F.col("deepest__") - F.col("down__")))
    return marked.withColumn("deepest__", deepest).withColumn("samples", padded).drop("down__", "deepest__", "top__", "low__")
