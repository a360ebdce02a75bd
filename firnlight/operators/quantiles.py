"""Exact quantiles by refining histograms.

The values of a group are counted in ranges between their least and largest; only
the ranges that hold a wanted rank go on, and are counted again between their own
ends, until they hold few values or only equal ones. Buffers have one row a range,
whatever the number of distinct values, and no task sees a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored

#: Ranges of a histogram, and values that are sorted together.
RANGES, FEW = 1024, 4096


def quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], ranges: int = RANGES, few: int = FEW) -> DataFrame:
    """(keys, n, quantiles): for each group the values at ``shares`` of its ranks, linear between neighbours.

    Nulls do not count; a group without values gives no row. ``quantiles`` is an
    array in the order of ``shares``.
    """
    if any(not 0 <= s <= 1 for s in shares):
        raise ValueError("shares lie between 0 and 1")
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))
    per = stored(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "quantile-groups")
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("share")) for i, s in enumerate(shares)]))
    asked = per.select("g", "n", at.alias("a")).select("g", "n", F.col("a.i").alias("i"), ((F.col("n") - 1) * F.col("a.share")).alias("h"))
    asked = asked.withColumns({"under": F.floor("h"), "over": F.ceil("h")})
    wanted = asked.select("g", F.explode(F.array("under", "over")).alias("rank")).distinct().withColumn("node", F.lit(""))
    nodes = per.select("g", F.lit("").alias("node"), F.lit(0).cast("long").alias("before"), "low", "high")
    rows = rows.withColumn("node", F.lit(""))
    found, small = [], []
    while True:
        place = F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")) * ranges
        cells = rows.join(nodes, ["g", "node"]).withColumn("cell", F.coalesce(F.least(F.floor(place), F.lit(ranges - 1)), F.lit(0)).cast("int"))
        counts = cells.groupBy("g", "node", "cell").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.first("before").alias("start"))
        along = Window.partitionBy("g", "node").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(along), F.lit(0)))
        held = counts.join(wanted, ["g", "node"]).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
        held = stored(held.select("g", "rank", "node", "cell", "n", "before", "low", "high", F.concat_ws("/", "node", F.col("cell").cast("string")).alias("next")), "quantile-ranges")
        found.append(held.where("low = high").select("g", "rank", F.col("low").alias("v")))
        on = held.where("low < high")
        if on.isEmpty():
            break
        kept = on.select("g", "node", "cell", "next", "n").distinct()
        rows = stored(cells.select("g", "node", "cell", "v").join(kept, ["g", "node", "cell"]).select("g", F.col("next").alias("node"), "n", "v"), "quantile-rows")
        small.append((rows.where(F.col("n") <= few), on.where(F.col("n") <= few)))
        large = on.where(F.col("n") > few)
        if large.isEmpty():
            break
        rows = rows.where(F.col("n") > few).select("g", "node", "v")
        wanted = large.select("g", "rank", F.col("next").alias("node"))
        nodes = large.select("g", F.col("next").alias("node"), "before", "low", "high").distinct()
    for few_rows, on in small:
        order = F.row_number().over(Window.partitionBy("g", "node").orderBy("v")) - 1
        sorted_rows = few_rows.select("g", F.col("node").alias("next"), "v", order.alias("place"))
        found.append(sorted_rows.join(on.select("g", "rank", "next", "before"), ["g", "next"]).where(F.col("before") + F.col("place") == F.col("rank")).select("g", "rank", "v"))
    values = found[0]
    for more in found[1:]:
        values = values.unionByName(more)
    values = stored(values, "quantile-values")
    under, over = (values.select("g", F.col("rank").alias(c), F.col("v").alias(f"{c}_v")) for c in ("under", "over"))
    met = asked.join(under, ["g", "under"]).join(over, ["g", "over"])
    line = F.col("under_v") + (F.col("over_v") - F.col("under_v")) * (F.col("h") - F.col("under"))
    out = met.groupBy("g", "n").agg(F.array_sort(F.collect_list(F.struct("i", line.alias("v")))).alias("q"))
    return out.select(*[F.col("g")[k].alias(k) for k in keys], "n", F.col("q.v").alias("quantiles"))
