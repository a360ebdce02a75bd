"""Positions: distances, GPS interpolation, resampling and intersections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .along import SEGMENT, in_ranges, inside, renumbered, with_neighbour, with_profile, with_running


def cumulative_distance(traces: DataFrame) -> DataFrame:
    """``dist`` in km along each profile from projected coordinates."""
    after = with_neighbour(traces, "prev__", ["x_coord", "y_coord"])
    dx, dy = (F.col(c) - F.col("prev__")[c] for c in ("x_coord", "y_coord"))
    step = F.coalesce(F.sqrt(dx * dx + dy * dy), F.lit(0.0)) / 1000
    return with_running(after, d__=step).withColumn("dist", F.col("d__")).drop("prev__", "d__")


def cull_stationary(traces: DataFrame, min_movement: float = 1e-2) -> DataFrame:
    """Leave out traces that moved less than ``min_movement`` metres, and take their steps off later distances."""
    def still(step: Column) -> Column:
        return F.coalesce(step * 1000 < min_movement, F.lit(False))

    # Steps within a segment first; of a segment's first trace the step follows once the ends of segments are in one table.
    base = traces.withColumn("segment__", F.floor(F.col("trace_idx") / SEGMENT))
    base = base.withColumn("step__", F.col("dist") - F.lag("dist").over(inside())).withColumn("first__", F.row_number().over(inside()) == 1)
    kept = (~still(F.col("step__")) & ~F.col("first__")).cast("int")
    lost = F.when(still(F.col("step__")), F.col("step__")).otherwise(0.0)
    ends = base.groupBy("profile_id", "segment__").agg(
        F.min_by("dist", "trace_idx").alias("low__"), F.max_by("dist", "trace_idx").alias("high__"), F.sum(lost).alias("lost__"), F.sum(kept).alias("kept__"))
    along = Window.partitionBy("profile_id").orderBy("segment__")
    edge = F.col("low__") - F.lag("high__").over(along)
    ends = ends.withColumn("edge__", edge).withColumns({"lost0__": F.when(still(F.col("edge__")), F.col("edge__")).otherwise(0.0), "kept0__": (~still(F.col("edge__"))).cast("int")})
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("profile_id", "segment__", "edge__", *[
        (F.coalesce(F.sum(F.col(f"{c}__") + F.col(f"{c}0__")).over(before), F.lit(0)) + F.col(f"{c}0__")).alias(f"{c}__") for c in ("lost", "kept")])
    out = base.join(starts, ["profile_id", "segment__"]).withColumn("still__", still(F.when(F.col("first__"), F.col("edge__")).otherwise(F.col("step__"))))
    out = out.withColumns({"lost__": F.col("lost__") + F.sum(lost).over(inside()), "kept__": F.col("kept__") + F.sum(kept).over(inside())})
    out = out.where(~F.col("still__")).withColumns({"dist": F.col("dist") - F.col("lost__"), "trace_idx": (F.col("kept__") - 1).cast("int")})
    return out.select(*traces.columns)


def interpolate(points: DataFrame, fixes: DataFrame, key: str, at: str, values: list[str], extrapolate: bool = False,
                each: bool = False, size: int = SEGMENT) -> DataFrame:
    """Linear interpolation of ``values`` of ``fixes`` at the ``at`` of ``points``, per ``key``.

    Points and fixes are dealt to ranges of ``at`` of about ``size`` rows, so a key of
    any length is many tasks. Within a range each point takes the last fix before and
    the first after it, in two sorts; where a range has none, it takes those of the
    nearest ranges that do, from a table with one row a range. Beyond all fixes the
    outermost two are carried on, or the result is null. With ``each`` a fix holds for
    those of its values that are not null. Rows without ``at`` stay, with null values;
    equal fixes count once.
    """
    known = fixes.where(F.col(at).isNotNull()).groupBy(key, at).agg(*[(F.min(v) if each else F.first(v)).alias(v) for v in values])
    shared = [c for c in points.columns if c not in values]
    # One fix for all values, or one for each of them.
    held = {f"fix{i}__": part for i, part in enumerate([[v] for v in values] if each else [values])}

    def fix(part: list[str]) -> Column:
        whole = F.struct(F.col(at).cast("double").alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(part)])
        return F.when(F.col(part[0]).isNotNull(), whole) if each else whole

    known = known.select(key, at, *[fix(part).alias(c) for c, part in held.items()])
    timed = points.where(F.col(at).isNotNull()).select(*shared)
    every = in_ranges(timed.withColumn("is_fix__", F.lit(0)).unionByName(known.withColumn("is_fix__", F.lit(1)), allowMissingColumns=True), key, at, size,
                      points.select(key, at).union(fixes.select(key, at)))
    ends = every.groupBy(key, "range__").agg(*[f(c).alias(f"{n}_{c}") for c in held for n, f in (("low", F.min), ("high", F.max))])
    up, down = (Window.partitionBy(key).orderBy(o("range__")).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc, F.desc))
    edges = ends.select(key, "range__", *[F.last(f"high_{c}", ignorenulls=True).over(up).alias(f"before_{c}") for c in held],
                        *[F.last(f"low_{c}", ignorenulls=True).over(down).alias(f"after_{c}") for c in held])
    # The next fix is the last one in the opposite order: a frame that runs to the end would be read anew for every row.
    there, back = (Window.partitionBy(key, "range__").orderBy(o(at), F.desc("is_fix__")).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc, F.desc))
    seen = every.withColumns({f"a_{c}": F.last(c, ignorenulls=True).over(there) for c in held} | {f"b_{c}": F.last(c, ignorenulls=True).over(back) for c in held})
    seen = seen.where("is_fix__ = 0").join(edges, [key, "range__"], "left")
    if extrapolate:
        outer = known.groupBy(key).agg(*[f(c).alias(f"{n}_{c}") for c in held for n, f in (("first", F.min), ("last", F.max))])
        inner = known.join(outer, key).groupBy(key).agg(*[F.first(f"{n}_{c}").alias(f"{n}_{c}") for c in held for n in ("first", "last")],
                                                        *[F.min(F.when(F.col(c)["t"] > F.col(f"first_{c}")["t"], F.col(c))).alias(f"second_{c}") for c in held],
                                                        *[F.max(F.when(F.col(c)["t"] < F.col(f"last_{c}")["t"], F.col(c))).alias(f"but_{c}") for c in held])
        seen = seen.join(inner, key, "left")
    t = F.col(at)

    def value(c: str, place: int, v: str) -> Column:
        a, b = F.coalesce(f"a_{c}", f"before_{c}"), F.coalesce(f"b_{c}", f"after_{c}")
        low, high = a, b
        if extrapolate:
            low = F.when(a.isNull(), F.col(f"first_{c}")).when(b.isNull(), F.col(f"but_{c}")).otherwise(a)
            high = F.when(a.isNull(), F.col(f"second_{c}")).when(b.isNull(), F.col(f"last_{c}")).otherwise(b)
        t0, t1 = low["t"], high["t"]
        x, y = low[f"v{place}"], high[f"v{place}"]
        line = F.when(t0 == t1, x).otherwise(x + (y - x) * F.try_divide(t - t0, t1 - t0))
        return F.coalesce(F.when(a["t"] == t, a[f"v{place}"]), line).alias(v)

    found = seen.select(*shared, *[value(c, i, v) for c, part in held.items() for i, v in enumerate(part)])
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in found.schema.fields if f.name in values]
    return found.unionByName(points.where(F.col(at).isNull()).select(*shared, *none))


def gps_control(traces: DataFrame, fixes: DataFrame, offset: float = 0.0, extrapolate: bool = False) -> DataFrame:
    """Positions of the traces from GPS fixes at their time; longitudes in [0, 360).

    Fixes without a profile_id are of all profiles: then time alone is the key, and
    neither side is copied.
    """
    values = ["lat", "long", "elev"]
    moved = fixes.select(*["profile_id"] * ("profile_id" in fixes.columns), (F.col("decday") + offset).alias("decday"), "lat", F.pmod("long", F.lit(360.0)).alias("long"), "elev")
    if "profile_id" in fixes.columns:
        return placed(traces, moved, "decday", values, extrapolate)
    clock = F.lit(0).alias("clock__")
    found = interpolate(traces.select("profile_id", "trace_idx", "decday", clock), moved.select(clock, "*"), "clock__", "decday", values, extrapolate)
    return traces.drop(*values).join(found.select("profile_id", "trace_idx", *values), ["profile_id", "trace_idx"])


def placed(traces: DataFrame, fixes: DataFrame, at: str, values: list[str], extrapolate: bool, each: bool = False) -> DataFrame:
    """Traces with interpolated values; their samples stay out of the sort along the profile and are joined back."""
    names = ["profile_id", "trace_idx", *[at] * (at != "trace_idx")]
    found = interpolate(traces.select(*names), fixes, "profile_id", at, values, extrapolate, each).select("profile_id", "trace_idx", *values)
    return traces.drop(*values).join(found, ["profile_id", "trace_idx"])


def offset_scores(traces: DataFrame, fixes: DataFrame, offsets: list[float]) -> DataFrame:
    """(offset, score): how well positions at each clock offset match those the traces have.

    The grid of offsets is a bounded literal table; every offset is one more key of
    the interpolation, so offsets run in parallel.
    """
    spark = traces.sparkSession
    grid = spark.createDataFrame([(float(o),) for o in offsets], "offset double")

    def keyed(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(grid)).withColumn("key__", F.concat_ws("/", "profile_id", F.col("offset").cast("string")))

    moved = keyed(fixes.select("profile_id", "decday", "lat", F.pmod("long", F.lit(360.0)).alias("long")))
    moved = moved.withColumn("decday", F.col("decday") + F.col("offset"))
    own = keyed(traces.select("profile_id", "decday", F.col("lat").alias("own_lat"), F.pmod("long", F.lit(360.0)).alias("own_long")))
    met = interpolate(own, moved.select("key__", "decday", "lat", "long"), "key__", "decday", ["lat", "long"])
    both = F.corr("own_lat", "lat") + F.corr("own_long", "long")
    return met.where("lat is not null").groupBy("offset").agg(both.alias("score"))


def search_offset(traces: DataFrame, fixes: DataFrame, start: float = 0.0, passes: int = 5, points: int = 1001) -> float:
    """The clock offset of the best score, refined pass by pass; only one number a pass reaches the driver."""
    best, width = start, 0.1
    for _ in range(passes):
        grid = [best + width * (2 * k / (points - 1) - 1) for k in range(points)]
        row = offset_scores(traces, fixes, grid).agg(F.max_by("offset", "score").alias("o")).first()
        if row is None or row["o"] is None:
            raise ValueError("the positions of traces and fixes do not overlap")
        best, width = row["o"], width / 10
    return best


def clean_gps(traces: DataFrame, values: list[str]) -> DataFrame:
    """Fill missing positions linearly along trace numbers, carried on beyond the ends; all columns in one pass."""
    return placed(traces, traces.select("profile_id", "trace_idx", *values), "trace_idx", values, extrapolate=True, each=True)


def constant_spacing(traces: DataFrame, spacing: float, values: list[str], min_movement: float = 1e-2) -> DataFrame:
    """Traces resampled to a constant spacing in metres along the profile; samples and ``values`` linear.

    A grid point lies in exactly one segment between two neighbouring traces, so each
    trace makes its own points: one window over segments, then row-local work.
    """
    moving = cull_stationary(traces, min_movement)
    step = spacing / 1000
    base = with_profile(with_neighbour(moving, "next__", ["dist", "samples", *values], ahead=True), d0__=F.min("dist"))
    low = F.ceil((F.col("dist") - F.col("d0__")) / step - 1e-9)
    high = F.ceil((F.col("next__")["dist"] - F.col("d0__")) / step - 1e-9) - 1
    points = F.when(high >= low, F.sequence(low.cast("int"), high.cast("int")))
    grid = base.where(F.col("next__").isNotNull()).withColumn("point__", F.explode(points))
    at = F.col("d0__") + F.col("point__") * step
    w = (at - F.col("dist")) / (F.col("next__")["dist"] - F.col("dist"))
    grid = grid.withColumn("w__", w).withColumn("at__", at)
    cols = [F.zip_with("samples", F.col("next__")["samples"], lambda a, b: a * (1 - F.col("w__")) + b * F.col("w__")).alias("samples")]
    cols += [(F.col(v) + (F.col("next__")[v] - F.col(v)) * F.col("w__")).alias(v) for v in values]
    return grid.select("profile_id", F.col("point__").alias("trace_idx"), F.col("at__").alias("dist"), *cols)


def intersections(main: DataFrame, cross: DataFrame, cutoff: float = 10.0) -> DataFrame:
    """For each cross trace with a main trace within ``cutoff``: the nearest, its distance; ties to the lower index.

    Traces meet in cells of the cutoff's size; each main trace is dealt to the nine
    cells around it, so only neighbours are ever compared.
    """
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / cutoff).cast("long")

    around = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = (
        main.select(F.col("trace_idx").alias("main_idx"), F.col("x_coord").alias("mx"), F.col("y_coord").alias("my"), cell("x_coord").alias("cx"), cell("y_coord").alias("cy"))
        .withColumn("ox", F.explode(around)).withColumn("oy", F.explode(around))
        .select("main_idx", "mx", "my", (F.col("cx") + F.col("ox")).alias("cx"), (F.col("cy") + F.col("oy")).alias("cy"))
    )
    seen = cross.select(F.col("trace_idx").alias("cross_idx"), "x_coord", "y_coord", cell("x_coord").alias("cx"), cell("y_coord").alias("cy"))
    dx, dy = F.col("x_coord") - F.col("mx"), F.col("y_coord") - F.col("my")
    met = seen.join(near, ["cx", "cy"]).withColumn("d2", dx * dx + dy * dy).where(F.col("d2") < cutoff * cutoff)
    best = met.groupBy("cross_idx").agg(F.min(F.struct("d2", "main_idx")).alias("b"))
    return best.select("cross_idx", F.col("b")["main_idx"].alias("main_idx"), F.sqrt(F.col("b")["d2"]).alias("distance"))


def nearest_velocity(traces: DataFrame, depths: list[float], velocities: list[float], at: str) -> DataFrame:
    """The velocity of the table's depth nearest to ``at``; a small literal table, ties to the first."""
    table = F.array(*[F.struct(F.lit(float(z)).alias("z"), F.lit(float(v)).alias("v")) for z, v in zip(depths, velocities)])
    best = F.array_min(F.transform(table, lambda x, i: F.struct(F.abs(x["z"] - F.col(at)).alias("d"), i.alias("i"), x["v"].alias("v"))))
    return traces.withColumn("velocity", best["v"])


def drop_without_position(traces: DataFrame, column: str = "decday") -> DataFrame:
    """Leave out traces without a fix and number the rest anew."""
    return renumbered(traces.where(F.col(column).isNotNull()))


def project(traces: DataFrame) -> DataFrame:
    """UTM coordinates in the zone of each profile's mean position, and distances from them."""
    from ..functions.scalars import utm, utm_zone

    zoned = with_profile(traces, mean__=F.avg("long")).withColumn("zone", utm_zone(F.col("mean__"))).drop("mean__")
    x, y, _ = utm(F.col("lat"), F.col("long"), F.col("zone"))
    return cumulative_distance(zoned.withColumn("x_coord", x).withColumn("y_coord", y))


def nearest_grid(points: DataFrame, nodes: list[tuple[float, float, float]], x: str, z: str) -> DataFrame:
    """The velocity of the node (velocity, z, x) nearest to each point; a literal table, ties to the first."""
    table = F.array(*[F.struct(F.lit(float(b)).alias("z"), F.lit(float(c)).alias("x"), F.lit(float(a)).alias("v")) for a, b, c in nodes])
    best = F.array_min(F.transform(table, lambda n, i: F.struct(
        ((n["x"] - F.col(x)) * (n["x"] - F.col(x)) + (n["z"] - F.col(z)) * (n["z"] - F.col(z))).alias("d"), i.alias("i"), n["v"].alias("v"))))
    return points.withColumn("velocity", best["v"])


def control_and_respace(traces: DataFrame, fixes: DataFrame, spacing: float, offset: float = 0.0) -> DataFrame:
    """GPS positions, projection, and a constant spacing, in this order."""
    placed = project(gps_control(traces, fixes, offset))
    return constant_spacing(placed, spacing, ["lat", "long", "elev", "x_coord", "y_coord"])
