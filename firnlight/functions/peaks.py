"""Peaks of arrays with prominence and width, as array functions.

A fold carries a stack of the values that have nothing greater after them, each
with the least value since the one below it. So every element learns the last
greater one before it and the least value in between, which give its prominence,
in one pass each way. The fold goes by chunks, as each step copies what it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 256
_START = """named_struct('stack', cast(array() as array<struct<v: double, i: int, m: double>>), 'out', cast(array() as array<struct<m: double, g: int, s: int>>),
    'last', cast(null as double), 'first', -1)"""


def outlook(x: Column, chunk: int = CHUNK) -> Column:
    """For each element: m, the least value back to the last greater one; g, the place of that one or -1; s, where its run of equal values begins."""
    items = F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i")))
    parts = F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / chunk).cast("int") - 1), lambda k: F.slice(items, k * chunk + 1, F.lit(chunk))))

    def step(acc: Column, e: Column) -> Column:
        greater = F.filter(acc["stack"], lambda y: y["v"] > e["v"])
        least = F.least(e["v"], F.array_min(F.transform(F.filter(acc["stack"], lambda y: y["v"] <= e["v"]), lambda y: y["m"])))
        first = F.when(acc["last"] == e["v"], acc["first"]).otherwise(e["i"])
        seen = F.struct(least.alias("m"), F.coalesce(F.try_element_at(greater, F.lit(-1))["i"], F.lit(-1)).alias("g"), first.alias("s"))
        return F.struct(F.concat(greater, F.array(F.struct(e["v"].alias("v"), e["i"].alias("i"), least.alias("m")))).alias("stack"),
                        F.concat(acc["out"], F.array(seen)).alias("out"), e["v"].alias("last"), first.alias("first"))

    def part(acc: Column, some: Column) -> Column:
        empty = F.struct(acc["stack"].alias("stack"), F.slice(acc["out"], 1, 0).alias("out"), acc["last"].alias("last"), acc["first"].alias("first"))
        done = F.aggregate(some, empty, step)
        return F.struct(done["stack"].alias("stack"), F.concat(acc["out"], done["out"]).alias("out"), done["last"].alias("last"), done["first"].alias("first"))

    return F.aggregate(parts, F.expr(_START), part, lambda acc: acc["out"])


def with_peaks(df: DataFrame, column: str, name: str, prominence: float, width: float, chunk: int = CHUNK) -> DataFrame:
    """Add ``name``: the places of the local maxima of an array of doubles that rise by ``prominence`` and are ``width`` samples wide at half of it.

    A flat top counts once, in its middle; the array's ends are no maxima. Null for
    a null array; elements must not be null.
    """
    x = F.col(column)
    n = F.size(x)
    out = df.withColumns({"back__": outlook(x, chunk), "ahead__": F.reverse(outlook(F.reverse(x), chunk))})

    def is_peak(p: Column) -> Column:
        back, ahead = F.get("back__", p), F.get("ahead__", p)
        top, first, last = F.get(x, p), back["s"], n - 1 - ahead["s"]
        rise = top - F.greatest(back["m"], ahead["m"])
        level = top - rise / 2
        left, right = back["g"] + 1, n - 2 - ahead["g"]
        a = F.greatest(left, F.coalesce(F.array_max(F.filter(F.sequence(left, p), lambda j: F.get(x, j) <= level)), left))
        b = F.least(right, F.coalesce(F.array_min(F.filter(F.sequence(p, right), lambda j: F.get(x, j) <= level)), right))
        low, high = F.get(x, a), F.get(x, b)
        lo = F.when(low < level, a + (level - low) / (F.get(x, a + 1) - low)).otherwise(a)
        hi = F.when(high < level, b - (level - high) / (F.get(x, b - 1) - high)).otherwise(b)
        steep = (first >= 1) & (last <= n - 2) & (F.get(x, first - 1) < top) & (F.get(x, last + 1) < top) & (F.floor((first + last) / 2) == p)
        return steep & (rise >= prominence) & (hi - lo >= width)

    places = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), is_peak)).when(n == 0, F.expr("cast(array() as array<int>)"))
    return out.withColumn(name, places).drop("back__", "ahead__")
