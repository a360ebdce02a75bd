"""Layer picking."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import argmax, argmin
from ..functions.filters import padding_of, sections, zero_phase
from .along import with_profile


@dataclass(frozen=True)
class PickWindow:
    """Samples of the packet, of its half wave, and of the margin before the search for the centre."""

    length: int
    half_wave: int
    margin: int
    polarity: int = 1

    @classmethod
    def of(cls, mhz: float, dt: float, snum: int, polarity: int = 1) -> PickWindow:
        period = 1 / (mhz * 1e6 * dt)
        length = max(2 * round(period) - 1, 3)
        half = round(2 / 3 * period)
        half += half % 2 == 0
        margin = (length - half) // 2
        if length > snum >= 3:
            length, half = snum, snum // 2
            half += half % 2 == 0
        return cls(length, half, margin, polarity)

    def check(self) -> None:
        if self.length < self.margin + self.half_wave:
            raise ValueError("the frequency is so high that the window is shorter than a sample")


def pick_packets(traces: DataFrame, window: PickWindow, midpoint: Column) -> DataFrame:
    """Add samp1, samp2, samp3 and power: the strongest return around ``midpoint`` and the opposite ones beside it.

    Row-local array expressions: every trace is picked on its own.
    """
    window.check()
    w, pol = window, F.lit(float(window.polarity))
    start = F.floor(midpoint - w.length / 2).cast("int")
    out = traces.withColumn("start__", start).withColumn("packet__", F.slice("samples", F.col("start__") + 1, F.lit(w.length)))
    out = out.withColumn("signed__", F.transform("packet__", lambda v: v * pol))
    centre = argmax(F.slice("signed__", w.margin + 2, w.half_wave)) + w.margin + 1
    out = out.withColumn("centre__", centre)
    first = F.greatest(F.col("centre__") - w.half_wave, F.lit(0))
    above = F.slice("signed__", first + 1, F.greatest(F.col("centre__") - first, F.lit(0)))
    top = F.when(F.col("centre__") <= 1, F.lit(0)).otherwise(first + argmin(above))
    below = F.slice("signed__", F.col("centre__") + 2, F.lit(w.half_wave))
    bottom = F.when(F.col("centre__") >= w.length - 1, F.lit(w.length - 1)).otherwise(F.col("centre__") + 1 + argmin(below))
    out = out.withColumn("top__", top).withColumn("bottom__", bottom)
    inside = F.slice("packet__", F.col("top__") + 1, F.col("bottom__") - F.col("top__") + 1)
    power = F.aggregate(inside, F.lit(0.0), lambda acc, v: acc + v * v) / (F.col("bottom__") - F.col("top__") + 1)
    names = {"samp1": "top__", "samp2": "centre__", "samp3": "bottom__"}
    out = out.withColumns({k: (F.col(v) + F.col("start__")).cast("double") for k, v in names.items()} | {"power": power})
    return out.drop("start__", "packet__", "signed__", "centre__", "top__", "bottom__")


def guided_pick(traces: DataFrame, window: PickWindow, start: int, end: int) -> DataFrame:
    """Pick along a straight line from sample ``start`` at the first trace to ``end`` at the last; -9999 as start means end."""
    start = end if start == -9999 else start
    counted = with_profile(traces, n__=F.count(F.lit(1)))
    marked = counted.withColumn("mid__", F.rint(F.col("trace_idx") * F.lit(float(end - start)) / F.col("n__")) + start)
    return pick_packets(marked, window, F.col("mid__")).drop("mid__", "n__")


def pick_one(trace: np.ndarray, window: PickWindow, midpoint: float) -> tuple[int, int, int, float]:
    """The same pick on a numpy trace."""
    start = int(np.floor(midpoint - window.length / 2))
    packet = trace[max(start, 0) : start + window.length]
    signed = packet * window.polarity
    a = window.margin + 1
    c = int(np.argmax(signed[a : a + window.half_wave])) + a
    first = max(c - window.half_wave, 0)
    top = 0 if c <= 1 else first + int(np.argmin(signed[first:c]))
    bottom = len(packet) - 1 if c >= len(packet) - 1 else c + 1 + int(np.argmin(signed[c + 1 : c + 1 + window.half_wave]))
    return top + start, c + start, bottom + start, float(np.mean(packet[top : bottom + 1] ** 2))


def auto_pick(traces: DataFrame, window: PickWindow, seeds: list[tuple[int, int, int]]) -> DataFrame:
    """Follow layers from seeds (picknum, trace, sample) to both ends of each profile.

    A pick needs the one before it, so each direction of each pick is one ordered
    stream of traces; a task keeps only the last pick of a stream, never a profile.
    """
    spark = traces.sparkSession
    table = F.broadcast(spark.createDataFrame(seeds, "picknum int, seed int, mid int"))  # a literal list
    both = traces.select("profile_id", "trace_idx", "samples").join(table).withColumn(
        "way", F.explode(F.when(F.col("trace_idx") == F.col("seed"), F.array(F.lit(-1), F.lit(1))).otherwise(F.array(F.signum(F.col("trace_idx") - F.col("seed")).cast("int")))))
    streams = both.withColumn("far", F.abs(F.col("trace_idx") - F.col("seed"))).repartition("profile_id", "picknum", "way").sortWithinPartitions("profile_id", "picknum", "way", "far")

    def run(frames):
        now, mid = None, 0
        for pdf in frames:
            rows = []
            for r in pdf.itertuples(index=False):
                stream = (r.profile_id, r.picknum, r.way)
                if stream != now:
                    now, mid = stream, r.mid
                top, centre, bottom, power = pick_one(np.asarray(r.samples, float), window, mid)
                half = window.length // 2 + 1
                mid = min(max((top + bottom) // 2, half), max(len(r.samples) - half, half))  # the window stays on the trace
                if r.far or r.way < 0:
                    rows.append((r.profile_id, r.picknum, r.trace_idx, float(top), float(centre), float(bottom), power))
            yield pd.DataFrame(rows, columns=["profile_id", "picknum", "trace_idx", "samp1", "samp2", "samp3", "power"])

    return streams.mapInPandas(run, "profile_id string, picknum int, trace_idx int, samp1 double, samp2 double, samp3 double, power double")


def smooth_picks(picks: DataFrame, traces_count: int) -> DataFrame:
    """Zero-phase low-pass of samp1-3 along each unbroken run of a layer; runs under 12 traces stay as they are."""
    if traces_count <= 2:
        raise ValueError("a wavelength of two traces or fewer cannot be filtered")
    along = Window.partitionBy("profile_id", "picknum").orderBy("trace_idx")
    runs = picks.withColumn("run", F.sum(F.col("samp2").isNull().cast("int")).over(along))
    sos = sections(3, [2 / traces_count], "low")
    names = ["samp1", "samp2", "samp3"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace_idx").reset_index(drop=True)
        there = pdf["samp2"].notna().to_numpy()
        if there.sum() > padding_of(3, "low"):
            x = pdf.loc[there, names].to_numpy(float)
            pdf.loc[there, names] = np.round(zero_phase(sos, x, padding_of(3, "low")))
        return pdf

    return runs.groupBy("profile_id", "picknum", "run").applyInPandas(run, runs.schema).drop("run")


def add_pick(picks: DataFrame, traces: DataFrame, picknum: int) -> DataFrame:
    """An empty layer on every trace; refuses a number that is taken."""
    if picks.where(F.col("picknum") == picknum).limit(1).count():
        raise ValueError(f"layer {picknum} exists")
    new = traces.select("profile_id", F.lit(picknum).alias("picknum"), "trace_idx")
    return picks.unionByName(new, allowMissingColumns=True)


def update_pick(picks: DataFrame, new: DataFrame, picknum: int) -> DataFrame:
    """Replace a layer's rows; ``new`` has a row per trace."""
    if not picks.where(F.col("picknum") == picknum).limit(1).count():
        raise ValueError(f"no layer {picknum}")
    return picks.where(F.col("picknum") != picknum).unionByName(new.withColumn("picknum", F.lit(picknum)), allowMissingColumns=True)


def delete_right(picks: DataFrame, picknum: int, trace_idx: int) -> DataFrame:
    """Clear a layer from a trace on."""
    gone = (F.col("picknum") == picknum) & (F.col("trace_idx") >= trace_idx)
    return picks.withColumns({c: F.when(~gone, F.col(c)) for c in ("samp1", "samp2", "samp3", "power") if c in picks.columns})


def last_traces(picks: DataFrame) -> DataFrame:
    """The last picked trace of each layer and its sample."""
    there = picks.where(F.col("samp2").isNotNull())
    return there.groupBy("profile_id", "picknum").agg(F.max("trace_idx").alias("tnum"), F.max_by("samp2", "trace_idx").alias("snum"))


def flatten_layer(traces: DataFrame, picks: DataFrame, picknum: int) -> DataFrame:
    """Shift every trace so that the layer lies flat; missing samples are null. Long samples."""
    layer = picks.where(F.col("picknum") == picknum).select("profile_id", "trace_idx", "samp2")
    level = layer.groupBy("profile_id").agg(F.avg("samp2").cast("int").alias("level__"))
    joined = traces.join(layer, ["profile_id", "trace_idx"]).join(level, "profile_id")
    shift = (F.col("level__") - F.col("samp2")).cast("int")
    moved = F.transform("samples", lambda v, j: F.when((j - shift >= 0) & (j - shift < F.size("samples")), F.get("samples", j - shift)))
    return joined.select("profile_id", "trace_idx", F.posexplode(moved).alias("sample_idx", "v"))


def pick_power_map(picks: DataFrame, traces: DataFrame, picknum: int, x: str = "x_coord", y: str = "y_coord") -> DataFrame:
    """Power of a layer in dB at each trace's position."""
    layer = picks.where(F.col("picknum") == picknum).select("profile_id", "trace_idx", "power")
    return layer.join(traces.select("profile_id", "trace_idx", x, y), ["profile_id", "trace_idx"]).withColumn(
        "db", F.when(F.col("power") > 0, 10 * F.log10("power")))


def export_table(picks: DataFrame, traces: DataFrame, layers: list[int], target: Column, name: str) -> DataFrame:
    """One row per trace with a column per layer, for csv: ``target`` turns a pick's samp2 into the wanted quantity."""
    wide = picks.select("profile_id", "trace_idx", "picknum", target.alias("q")).groupBy("profile_id", "trace_idx").pivot("picknum", layers).agg(F.first("q"))
    wide = wide.withColumnsRenamed({str(n): f"layer_{n}_{name}" for n in layers})
    return traces.select("profile_id", "trace_idx", "lat", "long", (F.col("trace_idx") + 1).alias("tnum")).join(wide, ["profile_id", "trace_idx"], "left")
