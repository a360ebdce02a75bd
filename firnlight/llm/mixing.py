"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of rows, in an order set by a hash. A source with
the share w of all target weights gets a window for each block i: it is released
at slot floor(i / w) and due by slot ceil((i + 1) / w), in exact fractions. Of the
released blocks the one with the earliest deadline runs. One processor that is
fully used meets all deadlines this way, so after every slot, however late, each
source that has rows left is within less than one block of its target.

The schedule holds the blocks that there are, not rows: a block has at least
``block_rows`` rows and so many that the schedule has no more than ``most_blocks``
and a block a source, which bounds the table that places all rows in parallel. A
source that runs out leaves its slots empty; every row is placed exactly once.

Of more sources than ``servers`` the largest have blocks of their own; the others
are pooled by a hash into sources whose weights are the sums of theirs. Within a
pool rows come at times h * n / w, with h a hash from 0 to 1, so that each member
comes at the rate of its weight, by chance and not by a bound.

Edge cases: a null source is a source of its own; null and repeated ids are told
apart by the rest of the row; equal rows keep separate places; an empty table
gives no rows; weights of zero are refused, for nothing may be left out.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import fresh, read, stored

#: Rows of a block at least, blocks that one schedule holds, sources with blocks of their own, rows that one task numbers together.
BLOCK_ROWS, MOST_BLOCKS, SERVERS, BUCKET_ROWS = 32, 1 << 18, 4096, 4096
#: Slots are 64-bit numbers.
LAST_SLOT = 1 << 62


def shares(weights: dict) -> dict:
    """The exact share of each weight in their sum."""
    if any(not w > 0 for w in weights.values()):
        raise ValueError("every source needs a weight above zero")
    exact = {s: Fraction(w) for s, w in weights.items()}
    total = sum(exact.values())
    return {s: w / total for s, w in exact.items()}


def schedule(weights: dict, blocks: dict) -> list[tuple]:
    """(source, block, slot) of so many ``blocks`` of each source: earliest deadline first among released blocks.

    Slots in which nothing is released, as sources have run out, stay empty.
    """
    apart = {s: 1 / w for s, w in shares(weights).items()}  # slots from one block to the next

    def window(s, i: int) -> tuple[int, int]:
        n, d = apart[s].numerator, apart[s].denominator
        return i * n // d, -(-(i + 1) * n // d)

    names = sorted((s for s in weights if blocks[s] > 0), key=lambda s: (s is None, str(s)))
    waiting = [(*window(s, 0), k, 0) for k, s in enumerate(names)]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple] = []
    out = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, due, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, k, i))
        if slot >= LAST_SLOT:
            raise ValueError("a weight is so small that its slots pass 64 bits")
        _, k, i = heapq.heappop(ready)
        out.append((names[k], i, slot))
        slot += 1
        if i + 1 < blocks[names[k]]:
            heapq.heappush(waiting, (*window(names[k], i + 1), k, i + 1))
    return out


def first_end(weights: dict, blocks: dict) -> int:
    """The slot up to which no source has run out."""
    return min((int(blocks[s] / w) for s, w in shares(weights).items()), default=0)


def tempered(counts: dict, alpha: float = 0.5) -> dict:
    """Weights that grow as a power of the sources' rows, so that large sources do not drown small ones."""
    return {s: n**alpha for s, n in counts.items()}


def pooled(counts: DataFrame, own: list, weights: dict | None, servers: int) -> DataFrame:
    """(src, n, w, server) of the sources without blocks of their own."""
    spark, kind = counts.sparkSession, counts.schema["src"].dataType
    named = T.StructType([T.StructField("own", kind)])
    few = F.broadcast(spark.createDataFrame([(s,) for s in own], named))  # half of ``servers`` rows
    rest = counts.join(few, F.col("src").eqNullSafe(F.col("own")), "left_anti")
    if weights is None:
        rest = rest.withColumn("w", F.sqrt("n"))
    else:
        table = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], T.StructType([T.StructField("of", kind), T.StructField("w", T.DoubleType())]))
        rest = rest.join(table, F.col("src").eqNullSafe(F.col("of")), "left").drop("of")
    return rest.withColumn("server", F.lit(len(own)) + F.pmod(F.xxhash64("src"), F.lit(servers - len(own))))


def mix(df: DataFrame, weights: dict | None = None, key: str = "doc_id", source: str = "source", block_rows: int = BLOCK_ROWS,
        most_blocks: int = MOST_BLOCKS, servers: int = SERVERS, bucket_rows: int = BUCKET_ROWS, seed: int = 7) -> DataFrame:
    """Add ``block``, ``slot``, ``place`` and ``in_mix`` to every row.

    (slot, place) orders the mixture; ``in_mix`` says that no source had run out
    before that slot, so that the target weights hold up to there. ``weights``
    names every source (a null source as None); by default they are tempered
    counts. Sources are numbered in buckets of about ``bucket_rows`` rows, with
    offsets from the buckets' counts, so no task sorts a whole source.
    """
    spark, long = df.sparkSession, T.LongType()
    kind = df.schema[source].dataType
    counts = df.groupBy(F.col(f"`{source}`").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "src").limit(servers + 1).collect()
    pool = len(top) > servers
    own = [r["src"] for r in top][: servers // 2 if pool else servers]
    n_own = {r["src"]: r["n"] for r in top[: len(own)]}
    if weights is not None and set(own) - set(weights):
        raise ValueError(f"no weight for {sorted(map(str, set(own) - set(weights)))}")
    w_own = tempered(n_own) if weights is None else {s: weights[s] for s in own}

    # Every server, a source or a pool, is known by its number from here on.
    rows_of, weight_of = dict(enumerate(n_own.values())), dict(enumerate(w_own[s] for s in own))
    fields = [T.StructField("src", kind), T.StructField("server", long), T.StructField("scale", T.DoubleType()), T.StructField("buckets", long)]
    sources = F.broadcast(spark.createDataFrame([(s, k, 1.0, max(1, -(-n_own[s] // bucket_rows))) for k, s in enumerate(own)], T.StructType(fields)))
    if pool:
        rest = stored(pooled(counts, own, weights, servers), "mixing-pools")
        if rest.where("w is null or not w > 0").limit(1).count():
            raise ValueError("every source needs a weight above zero")
        stats = rest.groupBy("server").agg(F.sum("n").alias("rows"), F.sum("w").alias("w"), F.max(F.col("n") / F.col("w")).alias("last"))
        for r in stats.collect():  # at most ``servers`` rows
            rows_of[r["server"]], weight_of[r["server"]] = r["rows"], r["w"]
        members = rest.join(F.broadcast(stats.select("server", "rows", "last")), "server").select(
            "src", F.col("server").cast("long"), (F.col("n") / F.col("w") / F.col("last")).alias("scale"), F.ceil(F.col("rows") / bucket_rows).alias("buckets"))
        sources = stored(members.unionByName(spark.createDataFrame([(s, k, 1.0, max(1, -(-n_own[s] // bucket_rows))) for k, s in enumerate(own)], T.StructType(fields))), "mixing-sources")
    block_rows = max(block_rows, -(-sum(rows_of.values()) // most_blocks))
    blocks = {k: -(-n // block_rows) for k, n in rows_of.items()}
    end = min(first_end(weight_of, blocks), LAST_SLOT) if blocks else 0

    server, at, tie, buckets, scale, bucket, start, idx, s2, b2, s3, b3, slot, src = fresh(
        df, *"server__ at__ tie__ buckets__ scale__ bucket__ start__ idx__ s2__ b2__ s3__ b3__ slot__ src__".split())
    # A row for each block and so bounded by ``most_blocks`` and ``servers``.
    table = spark.createDataFrame(schedule(weight_of, blocks) if blocks else [], T.StructType([T.StructField(c, long) for c in (s3, b3, slot)]))
    rest_of_row = [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, (T.AtomicType, T.NullType))]
    hashed = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(f"`{key}`"), *rest_of_row), 11) / F.lit(float(1 << 53))
    sources = sources.toDF(src, server, scale, buckets)
    rows = (
        df.join(sources, F.col(f"`{source}`").eqNullSafe(F.col(src)))
        .withColumn(at, hashed * F.col(scale)).withColumn(tie, F.xxhash64(F.lit(seed + 1), *rest_of_row))
        .withColumn(bucket, F.least(F.floor(F.col(at) * F.col(buckets)).cast("long"), F.col(buckets) - 1))
    )
    sizes = rows.groupBy(server, bucket).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(server).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col(server).alias(s2), F.col(bucket).alias(b2), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    inside = Window.partitionBy(server, bucket).orderBy(at, tie)
    numbered = rows.withColumn(idx, F.row_number().over(inside) - 1).join(
        offsets, (F.col(server) == F.col(s2)) & (F.col(bucket) == F.col(b2))).withColumn(idx, F.col(idx) + F.col(start))
    block = F.floor(F.col(idx) / block_rows).cast("long")
    placed = numbered.join(F.broadcast(table), (F.col(server) == F.col(s3)) & (block == F.col(b3)))
    added = {"block": block, "slot": F.col(slot), "place": F.pmod(F.col(idx), F.lit(block_rows)).cast("int"), "in_mix": F.col(slot) < end}
    return placed.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in added], *[v.alias(k) for k, v in added.items()])


def mixed_order(docs: DataFrame, weights: dict | None = None) -> DataFrame:
    """The documents, none left out, laid out in the order of the mixture.

    Written as files, part by part and row by row, they keep that order;
    :func:`written_order` reads it back.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # columns of their own named slot or place stay
    key, source = (names[docs.columns.index(c)] for c in ("doc_id", "source"))
    out = mix(docs.toDF(*names), weights, key, source)
    return out.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*names).toDF(*docs.columns)


def written_order(docs: DataFrame, part: str = "mix_part", row: str = "mix_row") -> DataFrame:
    """Add where each row lies in the files that ``docs`` was read from: the number of the part and of the row in it.

    Both are null where ``docs`` was not read from files.
    """
    try:
        file = docs.metadataColumn("_metadata")
        at = [F.regexp_extract(file["file_name"], r"part-(\d+)", 1).try_cast("int").alias(part), file["row_index"].alias(row)]
        return docs.select("*", *at)
    except AnalysisException:
        return docs.withColumns({part: F.lit(None).cast("int"), row: F.lit(None).cast("long")})


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")  # the last two tell repeated ids apart
    return mix(docs).drop("lang", "n_chars")
