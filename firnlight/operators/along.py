"""Values of a whole profile, and of neighbours along it, without a profile in one task.

A profile may hold a third of all traces. What is one number for a profile is
aggregated in partial sums and joined back. Neighbours and running sums are taken
in segments of trace numbers: a window sees one segment, and what a segment needs
of those before it comes from a table with one row for each.

``profile_id`` and ``trace_idx`` are never null; within a profile ``trace_idx``
names a trace.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Trace numbers of a segment.
SEGMENT = 4096


def with_profile(traces: DataFrame, **values: Column) -> DataFrame:
    """Add aggregates over each profile to its traces; one row a profile is joined back."""
    per = traces.groupBy("profile_id").agg(*[v.alias(k) for k, v in values.items()])
    return traces.join(per, "profile_id")


def inside(order: str = "trace_idx"):
    return Window.partitionBy("profile_id", "segment__").orderBy(order)


def with_neighbour(traces: DataFrame, name: str, columns: list[str], ahead: bool = False, segment: int = SEGMENT) -> DataFrame:
    """Add ``name``, a struct of ``columns`` of the trace before (or after) in the profile; null at its end."""
    base = traces.withColumn("segment__", F.floor(F.col("trace_idx") / segment))
    own = F.struct(*columns)
    pick, order = (F.min_by, F.desc("segment__")) if ahead else (F.max_by, F.col("segment__"))
    ends = base.groupBy("profile_id", "segment__").agg(pick(own, "trace_idx").alias("end__"))
    edge = F.lag("end__").over(Window.partitionBy("profile_id").orderBy(order))
    joined = base.join(ends.select("profile_id", "segment__", edge.alias("edge__")), ["profile_id", "segment__"])
    beside = (F.lead if ahead else F.lag)(own).over(inside())
    return joined.withColumn(name, F.coalesce(beside, F.col("edge__"))).drop("segment__", "edge__")


def with_running(traces: DataFrame, segment: int = SEGMENT, **values: Column) -> DataFrame:
    """Add running sums along each profile, each trace's own value included."""
    base = traces.withColumn("segment__", F.floor(F.col("trace_idx") / segment)).withColumns({f"{k}__own": v for k, v in values.items()})
    before = Window.partitionBy("profile_id").orderBy("segment__").rowsBetween(Window.unboundedPreceding, -1)
    sums = base.groupBy("profile_id", "segment__").agg(*[F.sum(f"{k}__own").alias(k) for k in values])
    starts = sums.select("profile_id", "segment__", *[F.sum(k).over(before).alias(f"{k}__start") for k in values])
    joined = base.join(starts, ["profile_id", "segment__"])
    added = {k: F.coalesce(F.col(f"{k}__start"), F.lit(0)) + F.coalesce(F.sum(f"{k}__own").over(inside()), F.lit(0)) for k in values}
    return joined.withColumns(added).drop("segment__", *[f"{k}__{x}" for k in values for x in ("own", "start")])


def renumbered(traces: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Number the traces of each profile anew from 0, in their order."""
    return with_running(traces, segment, n__=F.lit(1)).withColumn("trace_idx", (F.col("n__") - 1).cast("int")).drop("n__")


def with_halo(traces: DataFrame, before: int, after: int, segment: int = SEGMENT) -> DataFrame:
    """Deal each trace to the segments whose traces have it within ``before`` back or ``after`` on.

    Adds ``segment__`` and ``owned__``; a window over (profile_id, segment__) that
    looks no further sees what it needs, and rows not owned are then left out.
    """
    first, last = (F.floor((F.col("trace_idx") + d) / segment) for d in (-after, before))
    own = F.floor(F.col("trace_idx") / segment)
    return traces.withColumn("segment__", F.explode(F.sequence(first, last))).withColumn("owned__", F.col("segment__") == own)


def in_ranges(rows: DataFrame, key: str, at: str, size: int = SEGMENT, counted: DataFrame | None = None) -> DataFrame:
    """Add ``range__``, which grows with ``at``, so that a key of many rows has about ``size`` of them in each.

    Ranges have one width for all keys, the least that any key of over ``size`` rows
    asks for; it is one number, from one aggregation of keys and ``at`` alone. Where
    values crowd, a range has more rows, which are sorted with spilling and never
    collected. ``at`` must not be null. ``counted``: rows to count instead, cheaper to
    make and as many at least.
    """
    per = (rows if counted is None else counted).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("low"), F.max(at).alias("high"))
    asked = F.when((F.col("n") > size) & (F.col("high") > F.col("low")), (F.col("high") - F.col("low")) / F.ceil(F.col("n") / size))
    width = per.agg(F.min(asked).alias("width")).first()["width"]
    return rows.withColumn("range__", F.floor(F.col(at) / F.lit(float(width) if width else 1e300)))
