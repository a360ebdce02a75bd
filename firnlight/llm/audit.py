"""How filters interact: joint failures of all their subsets, and what follows from them.

Five filters give every document five flags. One aggregation sums, for each of the
32 subsets S of filters, the product of the flags in S, so J(S) is the number of
documents that fail all of S (and among them those of good quality and the toxic
ones). Everything else is arithmetic on these 32 numbers of a part:

* documents that fail none of P: the Möbius inverse, sum over S in P of (-1)^|S| J(S);
* removed by the last filter of an order's beginning: survivors before less survivors after;
* failures of f alone: sum over S with f of (-1)^(|S|-1) J(S);
* redundant: J({f}) less what f removes;
* Shapley value of f in the game of removed documents, whose Harsanyi dividends are
  (-1)^(|S|-1) J(S): each dividend is shared evenly by its members. The sum over
  all 120 orders is 120 times that, a whole number.

Documents of equal text agree in four flags, so they are summed up by text before
anything is looked up; the fifth flag asks for the least id of a text only. Texts
are told apart by their SHA-256.

Edge cases: null texts are empty, null parts are the part of the empty string; of
repeated ids with a text none is smaller than the other, so the least one fails
E in no row; a null id is smaller than no other and fails E if its text has
any id; a document is good (toxic) if any of its labels says so; without documents
there are no rows. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, read

NAMES = "ABCDE"


def text_flags(text: Column) -> dict[str, Column]:
    """The filters that look at a text alone; true where it fails."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def joint_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, n, good, toxic): three arrays of 32 counts for each part, at the place of a subset's bits.

    ``docs``: doc_id, text, lang. Bit i stands for the filter ``NAMES[i]``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    flagged = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("same"),
                          *[v.cast("int").alias(k) for k, v in text_flags(text).items()])
    rows = flagged.groupBy("same", "part", "doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.max(c).alias(c) for c in "ABCD"])
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        *[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    # Null ids meet no label; a hash of the text deals them out.
    rows = rows.withColumn("deal", F.when(F.col("doc_id").isNull(), F.xxhash64("same")).otherwise(0))
    rows = rows.join(known.withColumn("deal", F.lit(0).cast("long")), ["doc_id", "deal"], "left").fillna(0, ["good", "toxic"])
    # A row for each text, part and labels; the copies with the least id of these are counted apart.
    kinds = rows.groupBy("same", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.coalesce(F.min_by("n", "doc_id"), F.sum("n")).alias("firsts"), *[F.max(c).alias(c) for c in "ABCD"])
    least = F.min("first").over(Window.partitionBy("same"))
    kinds = kinds.withColumn("E", F.col("n") - F.when(F.col("first").eqNullSafe(least), F.col("firsts")).otherwise(0))

    def product(s: int) -> Column:
        out = F.col("E") if s >> 4 & 1 else F.col("n")
        for i in range(4):
            if s >> i & 1:
                out = out * F.col(NAMES[i])
        return out

    sums = [F.array(*[F.sum(product(s) * w) for s in range(32)]).alias(name) for name, w in (("n", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
    return kinds.groupBy("part").agg(*sums)


def _inverse(counts: str, which: str, times: str = "1") -> Column:
    """The sum over the subsets s that satisfy ``which`` of (-1)^|s| counts[s], each taken ``times``."""
    return F.expr(f"aggregate(filter(sequence(0, 31), s -> {which}), 0L, (sum, s) -> sum + if(bit_count(s) % 2 = 0, 1, -1) * {counts}[s] * ({times}))")


def audit(joint: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step of the order."""
    orders = ["".join(p) for p in permutations(NAMES)]
    each = joint.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders]))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    bit = "(instr('ABCDE', substr(filter_order, {k}, 1)) - 1)"
    before = " + ".join(f"if({k} < step, shiftleft(1, {bit.format(k=k)}), 0)" for k in range(1, 6))
    each = each.withColumn("mine", F.expr(f"shiftleft(1, {bit.format(k='step')})")).withColumn("before", F.expr(before)).withColumn("after", F.expr("before | mine"))
    mine = "(s & mine) != 0"

    def survivors(counts: str, mask: str) -> Column:
        return _inverse(counts, f"(s & ~{mask}) = 0")

    def lost(counts: str) -> Column:
        return survivors(counts, "before") - survivors(counts, "after")

    return each.select(
        "part", "filter_order", "step", survivors("n", "after").alias("kept"), lost("n").alias("removed"),
        (F.expr("n[mine]") - lost("n")).alias("redundant"), (-_inverse("n", mine)).alias("unique_fails"),
        lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), (-_inverse("n", mine, "120 div bit_count(s)")).alias("shapley"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(joint_failures(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d),
f AS (SELECT doc_id, part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words),
             100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t), regexp_matches(t, '[#$%&*|]'),
             doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails FROM w),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || g.c || h.c || i.c AS filter_order FROM letters a, letters b, letters g, letters h, letters i
           WHERE len(list_distinct([a.c, b.c, g.c, h.c, i.c])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
places AS (SELECT filter_order, step, instr('ABCDE', filter_order[step])::INT AS me,
              list_transform(range(1, step), lambda k: instr('ABCDE', filter_order[k])) AS earlier FROM steps),
kinds AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY part, fails),
seen AS (SELECT part, filter_order, step, me, fails, n, good, toxic, fails[me] AS failed,
                len(list_filter(earlier, lambda k: fails[k])) > 0 AS gone FROM kinds, places),
r AS (SELECT part, filter_order, step, me, sum(CASE WHEN NOT gone AND NOT failed THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN NOT gone AND failed THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND failed THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN failed AND len(list_filter(fails, lambda b: b)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN NOT gone AND failed THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN NOT gone AND failed THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM seen GROUP BY part, filter_order, step, me)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, me))::BIGINT AS shapley FROM r
"""
