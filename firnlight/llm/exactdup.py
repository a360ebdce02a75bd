"""Exact duplicates by distributed most-significant-digit radix partitioning.

Texts are equal if they are the same bytes after every run of white space has
become one space. All documents start in one group for each length in bytes; a
round splits every group by the next digit of its texts, the next ``width`` bytes
themselves. A group that is down to one text is done, and so is one whose bytes
have ended: its texts are equal. Nothing is hashed to decide equality.

A round is one aggregation (count and least member of each group and digit, summed
up before the shuffle) and one join that tells the members, which adaptive
execution can split where a group is hot. Digits grow from ``first`` bytes by
``growth`` up to ``widest``, so the number of rounds is logarithmic in a text's
length up to there. Only members of groups of two and more are carried on, with
what is left of their texts, and every round ends in a stored table.

Edge cases: null texts are empty, and equal to empty ones; a null id comes after
all others, and of equal ids one row stays; very long texts are never held in one
value twice; an empty table gives no rows; columns of any other name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, read, stored

#: Bytes of the first digit, factor from one digit to the next, bytes of a digit at most.
FIRST, GROWTH, WIDEST = 16, 16, 1 << 20


def one_spaced(text: Column) -> Column:
    """The text with every run of white space as one space; empty for null."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _split(live: DataFrame, width: int) -> DataFrame:
    """One round: the members of groups of two and more, in the groups that the next ``width`` bytes make."""
    dealt = live.withColumn("digit", F.substring("rest", 1, width))
    groups = dealt.groupBy("group", "digit").agg(
        F.count(F.lit(1)).alias("members"), F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("least")).where("members > 1")
    # A hash beside the key makes the join shuffle anew, which adaptive execution can split; see common.splittable_join.
    dealt, groups = (df.withColumn("deal", F.xxhash64("group", "digit")) for df in (dealt, groups))
    ended = F.octet_length("rest") <= width
    return dealt.join(groups, ["group", "digit", "deal"]).select(
        "row", "id", F.col("least.row").alias("group"), ended.alias("ended"),
        F.when(~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        F.col("least.id").alias("keep"), "members")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (),
                 first: int = FIRST, growth: int = GROWTH, widest: int = WIDEST) -> DataFrame:
    """Every row of ``docs``: its key, the columns ``keep``, keep_id, group_size, kept and text_sha256.

    keep_id is the least key among equal texts, whose row stays (the first of such
    rows, if the key repeats); text_sha256 is that of the normalised text, for the
    reader, and takes no part in the comparison.
    """
    if first < 1 or growth < 1 or widest < first:
        raise ValueError("digits need a byte at least, and must not shrink")
    body = one_spaced(F.col(f"`{text}`")).cast("binary")
    extra = fresh(docs.select(*[F.col(f"`{c}`") for c in keep]), "row", "id", "sha", "size", "rest")
    row, id_, sha, size, rest = extra
    base = stored(docs.select(
        F.monotonically_increasing_id().alias(row), F.col(f"`{key}`").alias(id_), *[F.col(f"`{c}`") for c in keep], body.alias(rest))
        .withColumns({sha: F.sha2(F.col(rest), 256), size: F.octet_length(rest).cast("long")}), "exact-texts")
    live = base.select(F.col(row).alias("row"), F.col(id_).alias("id"), F.col(size).alias("group"), F.col(rest).alias("rest"))
    width, found = first, []
    while True:
        members = stored(_split(live, width), "exact-round")
        found.append(members.where("ended").select(
            F.col("row").alias("of_row"), F.col("keep").alias("of_keep"), F.col("members").alias("of_members"), (F.col("row") == F.col("group")).alias("of_kept")))
        live = members.where("not ended").select("row", "id", "group", "rest")
        if live.isEmpty():
            break
        width = min(width * growth, widest)
    equal = found[0]
    for more in found[1:]:
        equal = equal.unionByName(more)
    alone = F.col("of_row").isNull()
    return base.join(equal, F.col(row) == F.col("of_row"), "left").select(
        F.col(id_).alias(key), *[F.col(f"`{c}`") for c in keep],
        F.when(alone, F.col(id_)).otherwise(F.col("of_keep")).alias("keep_id"),
        F.coalesce("of_members", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("of_kept", F.lit(True)).alias("kept"), F.col(sha).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the least key."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    groups = exact_groups(plain, names[docs.columns.index(key)], names[docs.columns.index(text)], keep=tuple(n for n in names if n != names[docs.columns.index(key)]))
    return groups.where("kept").select(*names).toDF(*docs.columns)


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
