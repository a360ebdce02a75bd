"""Traces as a stream (an extension: the batch operators have no stream of their own).

Operators that work on one trace at a time (crops, vertical filters, gains, packet
picks) take a streaming DataFrame as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stack_by_time(traces: DataFrame, window: str, late: str, time: str = "ts") -> DataFrame:
    """Mean traces of each profile in tumbling windows; traces later than ``late`` are not waited for."""
    flat = traces.withWatermark(time, late).select("profile_id", time, F.posexplode("samples").alias("sample_idx", "v"))
    return flat.groupBy("profile_id", F.window(time, window).alias("w"), "sample_idx").agg(F.avg("v").alias("v"), F.count(F.lit(1)).alias("traces")).select(
        "profile_id", F.col("w")["start"].alias("start"), "sample_idx", "v", "traces")


def position_by_time(traces: DataFrame, fixes: DataFrame, within: str, time: str = "ts") -> DataFrame:
    """Each trace with the GPS fixes of its profile from the time before it; both sides with watermarks."""
    t = traces.withWatermark(time, within).alias("t")
    f = fixes.select(F.col("profile_id").alias("fix_profile"), F.col(time).alias("fix_ts"), "lat", "long").withWatermark("fix_ts", within)
    near = (F.col("profile_id") == F.col("fix_profile")) & (F.col("fix_ts") <= F.col(time)) & (F.col("fix_ts") > F.col(time) - F.expr(f"interval {within}"))
    return t.join(f, near).drop("fix_profile")
