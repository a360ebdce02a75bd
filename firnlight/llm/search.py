"""Exact top-k inner-product search by ball trees, shard by shard.

The vectors are dealt into shards of bounded size. In each a ball tree is built,
once a round, and blocks of queries stream through it, best nodes first: nodes
are ordered by the upper bound centre . q + radius * |q| and left out for every
query whose kth score so far lies above the bound. The kth scores are shared in
rounds: a query meets one shard, then some more, then all others, and before each
round learns the kth score that it has reached anywhere.

Scores are exact integers; ties go to the smaller id. A task holds one shard and
one block of queries, never more.

Edge cases: vectors that are null or hold null, NaN or infinite components take
no part; vectors of other lengths count as padded with zeros; of equal ids a
query passes over all; a repeated row is a candidate as often as it is there, and
rows of one query id, repeated or not, share one ranking, as in the SQL; fewer
than k candidates give fewer rows; an empty table gives none; components so large
that a product of two vectors may pass 2^53 are refused, as it would not be exact. Repeated rows are
folded before the search and no more than k of them go on, as no more can count.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read, stored

LEAF, SHARD_ROWS, QUERY_ROWS = 256, 8192, 2048
#: Shards that a query has met grow by this factor from round to round.
GROWTH = 8


class BallTree:
    """A binary tree of balls over integer vectors; leaves hold up to ``leaf`` of them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.x = ids, vectors
        self.centre, self.radius, self.rows, self.below = [], [], [], []
        waiting = [(np.arange(len(ids)), None)]
        while waiting:
            rows, parent = waiting.pop()
            part = self.x[rows]
            centre = part.mean(0)
            node = len(self.rows)
            self.centre.append(centre)
            self.radius.append(float(np.sqrt(((part - centre) ** 2).sum(1).max())))
            self.below.append([])
            if parent is not None:
                self.below[parent].append(node)
            if len(rows) <= leaf:
                self.rows.append(rows)
                continue
            self.rows.append(None)
            # Two far points set the direction; the middle of the projections parts the rows.
            a = part[((part - centre) ** 2).sum(1).argmax()]
            b = part[((part - a) ** 2).sum(1).argmax()]
            order = np.argsort(part @ (b - a), kind="stable")
            half = len(rows) // 2
            waiting += [(rows[order[:half]], node), (rows[order[half:]], node)]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, reached: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the best k of every query that may still count.

        ``reached``: scores that each query's kth best has reached elsewhere.
        """
        length = np.sqrt((queries**2).sum(1))[:, None]
        # Rounding errors go with the sizes of what is added up, not with the sum, which may cancel or be negative.
        slack = 1e-9 * length * (np.sqrt((self.centre**2).sum(1)) + self.radius)[None, :] + 1e-6
        bounds = queries @ self.centre.T + length * self.radius[None, :] + slack
        kth = reached.astype(float)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # query row, id, score
        frontier = [(-float(bounds[:, 0].max(initial=-np.inf)), 0)]
        while frontier:
            _, node = heapq.heappop(frontier)
            active = np.flatnonzero(bounds[:, node] >= kth)
            if not len(active):
                continue
            if self.rows[node] is None:
                for child in self.below[node]:
                    heapq.heappush(frontier, (-float(bounds[active, child].max()), child))
                continue
            rows = self.rows[node]
            scores = queries[active] @ self.x[rows].T
            hit = (scores >= kth[active, None]) & (self.ids[rows][None, :] != query_ids[active, None])
            q, c = np.nonzero(hit)
            if not len(q):
                continue
            merged = [np.r_[best[0], active[q]], np.r_[best[1], self.ids[rows[c]]], np.r_[best[2], scores[q, c]]]
            order = np.lexsort((merged[1], -merged[2], merged[0]))
            merged = [m[order] for m in merged]
            first = np.flatnonzero(np.r_[True, merged[0][1:] != merged[0][:-1]])
            rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
            best = [m[rank < k] for m in merged]
            last = merged[0][rank == k - 1]
            kth[last] = np.maximum(kth[last], merged[2][rank == k - 1])
        return tuple(best)


def matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros."""
    flat, ends = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
    sizes = np.diff(np.r_[0, ends]).astype(int)
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


FOUND = pa.schema([("query_id", pa.int64()), ("copies", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def search_stream(k: int, query_rows: int):
    """A function for mapInArrow over rows (shard, is_query, id, vector, reached, copies), sorted by the first two.

    It keeps the vectors of the shard at hand, its tree once a query comes, and no query.
    """

    def run(batches):
        now, ids, parts, tree = None, [], [], None
        for batch in batches:
            shard, is_query = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(is_query.astype(int)) != 0)) + 1
            for low, high in zip(np.r_[0, cuts], np.r_[cuts, batch.num_rows]):
                if low == high:
                    continue
                if shard[low] != now:
                    now, ids, parts, tree = shard[low], [], [], None
                rows = batch.slice(low, high - low)
                own = rows.column(2).to_numpy(zero_copy_only=False)
                if not is_query[low]:
                    ids.append(own)
                    parts.append(matrix(rows.column(3)))
                    continue
                if not parts:
                    continue
                if tree is None:
                    width = max(p.shape[1] for p in parts)
                    tree = BallTree(np.concatenate(ids), np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in parts]))
                for first in range(0, len(own), query_rows):
                    some = rows.slice(first, query_rows)
                    x, q = same_width(tree.x, matrix(some.column(3)))
                    if x.shape[1] > tree.x.shape[1]:
                        tree = BallTree(tree.ids, x)
                    if x.shape[1] * np.abs(x).max(initial=0) * np.abs(q).max(initial=0) >= 2**53:
                        raise ValueError("components too large for exact scores")
                    reached, copies = (some.column(i).to_numpy(zero_copy_only=False) for i in (4, 5))
                    at, vec, score = tree.search(own[first : first + query_rows], q, k, reached)
                    found = [own[first : first + query_rows][at], copies[at], vec, score.astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], schema=FOUND)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of ``vectors`` for each of ``queries``.

    ``vectors`` has ``vec_id`` and ``vector`` (array of long), ``queries`` has
    ``query_id`` and ``vector``; a vector with the query's own id is passed over.
    """

    def folded(df: DataFrame, key: str) -> DataFrame:
        return df.groupBy(F.col(key).alias("id"), "vector").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))

    shards = max(1, -(-vectors.count() // shard_rows))
    base = folded(vectors, "vec_id").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.pmod(F.xxhash64("id", "vector", F.lit(3)), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "id", "vector",
        F.lit(0.0).alias("reached"), F.lit(1).cast("long").alias("copies"))
    asked = folded(queries, "query_id").withColumn("home", F.pmod(F.xxhash64("id", "vector", F.lit(5)), F.lit(shards)).cast("int"))
    every = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def best(found: DataFrame) -> DataFrame:
        each = found.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("n")
        return each.withColumn("rank", F.row_number().over(every)).where(F.col("rank") <= k)

    found, low, high, number = None, 0, 1, 0
    while low < shards:
        told = asked.withColumn("reached", F.lit(-float(2**62)))
        if found is not None:
            kth = best(found).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("kth"))
            told = asked.join(kth, "id", "left").withColumn("reached", F.coalesce("kth", F.lit(-float(2**62))))
        turns = F.explode(F.sequence(F.lit(low), F.lit(min(high, shards) - 1))).alias("turn")
        met = told.select("*", turns).select(
            F.pmod(F.col("home") + F.col("turn"), F.lit(shards)).cast("int").alias("shard"), F.lit(True).alias("is_query"), "id", "vector", "reached", "copies")
        rows = base.union(met).repartition("shard").sortWithinPartitions("shard", "is_query")
        new = stored(rows.mapInArrow(search_stream(k, query_rows), "query_id long, copies long, vec_id long, score long"), f"topk-{number}")
        found = new if found is None else found.union(new)
        low, high, number = high, high * GROWTH, number + 1
    return best(found).select("query_id", "rank", "vec_id", "score")


def whole_vectors(df: DataFrame, key: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, vector) with components floor(scale * x); only vectors whose components are all finite."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(F.col(key).isNotNull() & F.col(embedding).isNotNull()).where(fine).select(
        F.col(key).alias("vec_id"), F.transform(embedding, lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_vectors(read(spark, sf_dir, "embeddings"))
    queries = vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return top_k(vectors, queries, 5)


ORACLE = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM fine q, fine c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
