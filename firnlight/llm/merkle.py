"""A Merkle manifest of a dataset: a hash for every row, a proof for every hash, one root.

The leaves of a group, in the order of their keys, are the leaves of a tree of
``fanout``; the groups' roots, in the order of the groups, are those of the last
tree. A node is the hash of its children's hex digests; a last node with fewer
children, even one, is hashed like the others, and a single leaf is its own root.

**Ranks without a global sort.** Keys are texts of hexadecimal digits that sort as
the rows do. Histograms of their beginnings, fine ones counted from the rows and
coarse ones summed up from these, say how many rows of the group come before each
beginning: sums over the at most 4,913 siblings of a beginning, from coarse to fine.
Where a beginning still has more than ``BUCKET`` rows, only these are counted again
by their next digits, right after all that they share. Rows are numbered within
buckets.

**Tries of rank digits.** The digits of a rank in base ``fanout`` are the path from
the root to the leaf. Leaves that share all but the last ``TIER`` digits meet in one
row, which reduces the subtree of the longest prefixes first and holds its levels;
its root is a leaf of the tier above. Proofs are put together on the way down, from
tiers of at most fanout^TIER rows a key. All hashes are Spark's own ``sha2``.

Edge cases: a null key comes first, rows with equal keys follow each other by their
hashes, and rows that are equal altogether are leaves of their own; a null group is
a group of its own, before all others; null fields, empty and very long texts have
hashes of their own; an empty table gives no rows; columns that are neither key,
group, field nor asked for are not looked at, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import read, stored

#: Rows that are numbered together; characters of a key that one histogram adds; levels of a tree in one tier, so that it has 256 leaves or about as many.
BUCKET, DIGITS, TIER_LEAVES = 1024, 3, 256


def leaf_hash(*fields: Column) -> Column:
    """SHA-256 of fields, each as its length in bytes, a colon and its text; a dash for null."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(part, fields)), 256)


def sortable(c: Column, kind: T.DataType) -> Column:
    """A text that sorts as whole numbers or texts do, null first, and is no beginning of another one."""
    if isinstance(kind, T.IntegralType):
        digits = F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    else:
        digits = F.concat(F.hex(c.cast("string").cast("binary")), F.lit(" "))
    return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), digits))


def shared(a: str, b: str) -> Column:
    """The number of characters that the texts ``a`` and ``b`` begin with alike."""
    return F.expr(f"aggregate(sequence(1, greatest(length({a}), 1)), 0, (n, i) -> if(n = i - 1 and i <= length({a}) and substr({a}, i, 1) = substr({b}, i, 1), i, n))")


def _below(bins: DataFrame) -> DataFrame:
    """Add ``start``: the rows of the group before each bin, from its parent's ``start`` and its smaller siblings."""
    siblings = Window.partitionBy("grp", "parent").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    return bins.withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(siblings), F.lit(0)))


def _numbered(rows: DataFrame, bins: DataFrame) -> DataFrame:
    inside = Window.partitionBy("grp", "bin").orderBy("key")
    return rows.join(bins.select("grp", "bin", "start", "total"), ["grp", "bin"]).withColumn(
        "rank", F.col("start") + F.row_number().over(inside) - 1).drop("bin", "start", "key")


def _dealt(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join on (grp, bin) that adaptive execution can split; see common.splittable_join."""
    left, right = (df.withColumn("deal", F.xxhash64("grp", "bin")) for df in (left, right))
    return left.join(right, ["grp", "bin", "deal"], how).drop("deal")


def ranked(rows: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """Replace ``key`` by ``rank`` (from 0 in each ``grp``) and ``total`` (rows of the group); and the largest total.

    ``rows``: grp, key (unique in its group, the same at every reading) and other
    columns of any names but bin, parent, start, n, lo, hi, deal, until, rank and total.
    """
    whole = rows.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count(F.lit(1)).alias("n")).select(shared("lo", "hi").alias("at"), "n").first()
    if not whole["n"]:
        return rows.drop("key").withColumns({"rank": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}), 0
    at, depth = whole["at"], 1
    while bucket * 16**depth < 4 * whole["n"]:
        depth += 1
    dealt = rows.withColumn("bin", F.substring("key", 1, at + depth))
    sizes = dealt.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    lengths = [*range(at, at + depth, DIGITS), at + depth]
    levels = {lengths[-1]: sizes}
    for short in lengths[-2::-1]:
        levels[short] = levels[min(n for n in levels if n > short)].groupBy("grp", F.substring("bin", 1, short).alias("bin")).agg(F.sum("n").alias("n"))
    above = levels[lengths[0]].select("grp", F.col("bin").alias("parent"), F.lit(0).cast("long").alias("start"), F.col("n").alias("total"))
    for short, long in zip(lengths, lengths[1:]):
        bins = _below(levels[long].withColumn("parent", F.substring("bin", 1, short)).join(above, ["grp", "parent"]))
        above = bins.select("grp", F.col("bin").alias("parent"), "start", "total")
    out, largest = None, 0
    while True:
        bins = stored(bins, "merkle-bins")
        most = bins.agg(F.max("n").alias("n"), F.max("total").alias("total")).first()
        largest, some = max(largest, most["total"]), most["n"] > bucket
        large = bins.where(F.col("n") > bucket)
        done = _numbered(_dealt(dealt, large.select("grp", "bin"), "left_anti") if some else dealt, bins.where(F.col("n") <= bucket))
        out = done if out is None else out.unionByName(done)
        if not some:
            return out, largest
        # Only the rows of large bins go on, to bins that are longer by some digits than what all rows of a bin share.
        deeper = large.select("grp", "bin", "start", "total", (shared("lo", "hi") + DIGITS).alias("until"))
        dealt = stored(_dealt(dealt, deeper, "inner").withColumn("parent", F.col("bin")).withColumn("bin", F.expr("substr(key, 1, until)")), "merkle-rows")
        bins = _below(dealt.groupBy("grp", "parent", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.min("start").alias("start"), F.min("total").alias("total")))
        dealt = dealt.drop("parent", "start", "total", "until")


def _height(total: str, fanout: int) -> Column:
    """Levels above the leaves of a tree of so many leaves."""
    steps, n = F.lit(0), 1
    while n < 1 << 62:
        steps, n = steps + (F.col(total) > n).cast("int"), n * fanout
    return steps


def climb(nodes: DataFrame, fanout: int, digits: int, tiers: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add ``proof``, ``subroot`` and ``root`` to nodes (grp, rank, height, hash and others).

    ``height`` counts the levels from the nodes to the group's root. ``crown`` gives
    (grp, proof, root) for the groups' roots (grp, hash); it sees one row a group.
    """
    width = fanout**digits
    others = [c for c in nodes.columns if c not in ("grp", "rank", "height", "hash")]
    items = F.sort_array(F.collect_list(F.struct((F.col("rank") % width).cast("int").alias("at"), "hash", *others))).alias("items")
    chunks = nodes.groupBy("grp", F.expr(f"rank div {width}").alias("chunk")).agg(items, F.max("height").alias("height"))
    level = f"transform(sequence(0, cast(ceil(size(element_at(done, -1)) / {fanout}) as int) - 1), j -> sha2(array_join(slice(element_at(done, -1), j * {fanout} + 1, {fanout}), ''), 256))"
    chunks = chunks.withColumn("up", F.least("height", F.lit(digits))).withColumn("levels", F.expr(
        f"aggregate(if(up > 0, sequence(1, up), cast(array() as array<int>)), array(transform(items, x -> x.hash)), (done, i) -> concat(done, array({level})))"))
    chunks = stored(chunks.withColumn("top", F.expr("element_at(levels, -1)[0]")), "merkle-tier")
    tops = chunks.select("grp", F.col("chunk").alias("rank"), (F.col("height") - F.col("up")).alias("height"), F.col("top").alias("hash"))
    if tiers > 1:
        above = climb(tops, fanout, digits, tiers - 1, crown)
    else:
        above = tops.join(crown(tops.select("grp", "hash")), "grp").withColumn("subroot", F.col("hash"))
    above = above.select("grp", F.col("rank").alias("chunk"), F.col("proof").alias("above"), "subroot", "root")
    powers = "array(" + ", ".join(str(fanout**k) for k in range(digits + 1)) + ")"
    node = f"(x.at div {powers}[l])"
    own = f"""transform(if(up > 0, sequence(0, up - 1), cast(array() as array<int>)), l -> named_struct(
        'before', array_join(slice(levels[l], cast({node} div {fanout} * {fanout} as int) + 1, cast({node} % {fanout} as int)), ''),
        'after', array_join(slice(levels[l], cast({node} as int) + 2, {fanout} - 1 - cast({node} % {fanout} as int)), '')))"""
    named = ", ".join(f"'{c}', x.`{c}`" for c in others)
    out = F.expr(f"""inline(transform(items, x -> named_struct('rank', chunk * {width} + x.at, 'hash', x.hash, 'proof', concat({own}, above), 'subroot', subroot, 'root', root{', ' + named if named else ''})))""")
    return chunks.drop("top").join(above, ["grp", "chunk"]).select("grp", out)


def _tree(rows: DataFrame, fanout: int, bucket: int, crown: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``climb`` over rows (grp, key, hash and others), ranked by their keys."""
    digits = 1
    while fanout ** (digits + 1) <= TIER_LEAVES:
        digits += 1
    nodes, largest = ranked(rows, bucket)
    tiers = 1
    while fanout ** (digits * tiers) < largest:
        tiers += 1
    return climb(nodes.withColumn("height", _height("total", fanout)).drop("total"), fanout, digits, tiers, crown)


def manifest(rows: DataFrame, key: str, group: str, fields: list[str], fanout: int = 2, also: dict[str, Column] | None = None, bucket: int = BUCKET) -> DataFrame:
    """For every row its key, the columns ``also``, and leaf, subroot, root and proof.

    ``proof`` holds, level by level from the leaf to the root, the digests of the
    siblings before and after the node, joined. ``fields`` are hashed in their
    order. Keys are whole numbers or texts; groups are ordered by their bytes as texts.
    """
    if fanout < 2:
        raise ValueError("a tree needs a fanout of two at least")
    also = also or {}
    kind = rows.schema[key].dataType
    leaf = leaf_hash(*[F.col(f"`{f}`") for f in fields])
    names = [f"also{i}" for i in range(len(also))]
    leaves = rows.select(sortable(F.col(f"`{group}`"), T.StringType()).alias("grp"), F.col(f"`{key}`").alias("id"), leaf.alias("hash"),
                         *[v.alias(n) for n, v in zip(names, also.values())], F.monotonically_increasing_id().alias("row"))
    leaves = leaves.withColumn("key", F.concat(sortable(F.col("id"), kind), "hash", F.lpad(F.hex("row"), 16, "0"))).drop("row")

    def crown(roots: DataFrame) -> DataFrame:
        """The last tree, over the groups' roots: one group, keyed by the others."""
        top = roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("grp").alias("of"), "hash")

        def end(ends: DataFrame) -> DataFrame:
            return ends.select("grp", F.expr("cast(array() as array<struct<before: string, after: string>>)").alias("proof"), F.col("hash").alias("root"))

        return _tree(top, fanout, bucket, end).select(F.col("of").alias("grp"), "proof", "root")

    tree = _tree(stored(leaves, "merkle-leaves"), fanout, bucket, crown)
    return tree.select(F.col("id").alias(key), *[F.col(n).alias(c) for n, c in zip(names, also)], F.col("hash").alias("leaf"), "subroot", "root", "proof")


def folded(leaf: str, proof: str = "proof") -> Column:
    """The root that a leaf and the siblings of its proof give."""
    return F.expr(f"aggregate({proof}, {leaf}, (node, level) -> sha2(concat(level.before, node, level.after), 256))")


def proof_digest(proof: str = "proof") -> Column:
    """SHA-256 of all siblings of a proof, level by level, left to right."""
    return F.expr(f"sha2(array_join(transform({proof}, level -> concat(level.before, level.after)), ''), 256)")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = [F.when(chosen, F.col(f) + 1).otherwise(F.col(f)) if f == "n_chars" else F.col(f) for f in fields]
    tree = manifest(docs, "doc_id", "lang", fields, also={"tampered": leaf_hash(*changed)})
    return tree.select("doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), folded("tampered").alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, (coalesce(xor(list_reduce(list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda c: ascii(c)::BIGINT),
      lambda crc, c: list_reduce(range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), 4294967295::BIGINT), 4294967295::BIGINT) % 7 = 0, false))::INT AS more
  FROM documents),
field AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
    coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS b, coalesce(strlen((n_chars + more)::VARCHAR) || ':' || (n_chars + more), '-') AS c,
    coalesce(strlen(text) || ':' || text, '-') AS t FROM d),
leaves AS (SELECT doc_id, g, sha256(a || b || t) AS leaf, sha256(a || c || t) AS changed FROM field),
places AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree AS (
  SELECT g, 0 AS level, i AS idx, leaf AS h, n FROM places
  UNION ALL
  SELECT g, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, level, idx // 2),
subroots AS (SELECT g, level AS height, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS level, j AS idx, subroot AS h, m AS n FROM subroots
  UNION ALL
  SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), any_value(n + 1) // 2 FROM top WHERE n > 1 GROUP BY level, idx // 2),
root AS (SELECT h AS root, level AS height FROM top WHERE n = 1),
up AS (
  SELECT p.doc_id, p.leaf, p.changed, p.g, p.i, level, idx % 2 AS odd, t.h FROM places p JOIN tree t ON t.g = p.g AND t.idx = xor(p.i >> t.level, 1) AND t.n > 1
  UNION ALL
  SELECT p.doc_id, p.leaf, p.changed, p.g, p.i, s.height + level, idx % 2, t.h
  FROM places p JOIN subroots s USING (g) JOIN top t ON t.idx = xor(s.j >> t.level, 1) AND t.n > 1),
steps AS (
  SELECT p.g, p.i, k, coalesce(u.h, '') AS h, CASE WHEN u.odd = 0 THEN u.h || '|' ELSE '|' || coalesce(u.h, '') END AS sides
  FROM places p JOIN subroots s USING (g), root r, range(0, 64) l(k) LEFT JOIN up u ON u.g = p.g AND u.i = p.i AND u.level = k WHERE k < s.height + r.height),
proofs AS (SELECT g, i, string_agg(h, '' ORDER BY k) AS siblings, list(sides ORDER BY k) AS sides FROM steps GROUP BY g, i),
folded AS (
  SELECT p.*, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce([changed] || coalesce(sides, []), lambda a, s: sha256(split_part(s, '|', 1) || a || split_part(s, '|', 2))) AS folded_root
  FROM places p LEFT JOIN proofs USING (g, i))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded JOIN subroots USING (g), root
"""
