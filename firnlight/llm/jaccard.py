"""Near-duplicate join on word n-grams, with Bayesian pruning of candidates.

Texts become sets of hashed five-word shingles. Equal sets form one class of
copies before anything else, so a group of copies goes on as one row. MinHash
bands name candidates; the groups that candidates connect are compared in pairs
of bounded blocks, so that no task holds a whole group and no list of all pairs
is ever made. Within two blocks the MinHash values of all pairs are compared
some at a time: from the matches so far follows the posterior probability that
the similarity reaches the threshold, and pairs below the tolerance are dropped.
This takes the values alone, half a kilobyte a text; only texts with a pair that
survives are shingled again, and their pairs are verified exactly on the sets.

Rows are told apart by a number that they are stored with, so ids may be null
or repeated.

Edge cases: a text of one to four words is one shingle of all its words; null,
empty and blank texts belong to no pair and stand alone, with their own id as
class; equal rows are copies of each other; ids that repeat name rows of any
class each; the class id is the least of the ids in a class, null if it has
none; a text of any length is one set, alone in its block if need be; an empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, pieces, read, splittable_join, stored
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of MinHash values: at the threshold a pair misses all with probability (1 - 0.8**7)**50 < 1e-5.
BANDS, ROWS = 50, 7
#: MinHash values compared at a time and in all, and the posterior probability that drops a pair.
STEP, VALUES, TOLERANCE = 32, 128, 1e-7
#: Texts in a block, and shingles of its texts unless a single text has more.
BLOCK, BLOCK_SHINGLES = 1024, 1_000_000
#: Terms of the columns of a product that counts shared shingles.
TERMS = 4096


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def seeds(n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(salt)
    return rng.integers(0, 2**63, n, np.uint64), rng.integers(0, 2**63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted text by text, and how many each has."""
    split = [t.encode().split() if t else [] for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    flat = np.empty(int(n_words.sum()), object)
    flat[:] = [w for s in split for w in s]
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    ids, names = pd.factorize(flat)
    word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names), np.uint64, len(names))[ids]
    owner = np.repeat(np.arange(len(texts)), n_words)
    ends = np.cumsum(n_words)
    left = np.minimum(np.repeat(ends, n_words) - np.arange(len(word)), size)  # words from here on, at most a shingle
    place = np.arange(len(word)) - np.repeat(ends - n_words, n_words)
    total = np.zeros(len(word), np.uint64)
    for k in range(size):
        factor = mix(np.array([k + 1], np.uint64))[0] | np.uint64(1)
        total[: len(word) - k] += np.where(left[: len(word) - k] > k, word[k:], np.uint64(0)) * factor
    whole = (left == size) | (place == 0)
    hashes, owner = mix(total[whole] ^ left[whole].astype(np.uint64)), owner[whole]
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.r_[True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])]
    return hashes[first], np.bincount(owner[first], minlength=len(texts))


def minhash(hashes: np.ndarray, sizes: np.ndarray, n: int, salt: int) -> np.ndarray:
    """``n`` MinHash values of each set, 32 bits each; empty sets have zeros."""
    out = np.zeros((len(sizes), n), np.uint32)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        xor, times = seeds(n, salt)
        for i in range(n):
            values = (((hashes ^ xor[i]) * times[i]) >> np.uint64(32)).astype(np.uint32)
            out[some, i] = np.minimum.reduceat(values, starts)
    return out


def set_ids(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes | None]:
    """16 bytes that name each set, whatever the order of its members; None for empty sets."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros((len(sizes), 2), np.uint64)
    np.add.at(sums[:, 0], owner, mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)))
    np.add.at(sums[:, 1], owner, mix(hashes + np.uint64(0xD1B54A32D192ED03)))
    sums += sizes.astype(np.uint64)[:, None]
    return [sums[i].astype(">u8").tobytes() if n else None for i, n in enumerate(sizes)]


def band_keys(values: np.ndarray, bands: int = BANDS) -> list[bytes]:
    """One 64-bit key for each band of MinHash values, as bytes, by row."""
    grouped = values.reshape(len(values), bands, -1).astype(np.uint64)
    key = np.full(grouped.shape[:2], 0, np.uint64)
    for k in range(grouped.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, k] + np.uint64(k + 1))
    key ^= mix(np.arange(1, bands + 1, dtype=np.uint64))[None, :]
    return [row.astype(">u8").tobytes() for row in key]


@lru_cache
def least_matches(threshold: float, values: int, step: int, tolerance: float) -> tuple[tuple[int, int], ...]:
    """For 32, 64, ... compared values, the matches below which a pair is dropped.

    With a uniform prior the similarity after m matches of n has a Beta(m + 1,
    n - m + 1) posterior; its mass from the threshold on is the probability of at
    most m successes in n + 1 trials at the threshold.
    """
    out = []
    for n in range(step, values + 1, step):
        mass, m = 0.0, 0
        while m <= n:
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if mass >= tolerance:
                break
            m += 1
        out.append((n, m))
    return tuple(out)


def surviving_pairs(left: np.ndarray, right: np.ndarray, within: bool, limits) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose MinHash values leave the threshold possible.

    All pairs are one matrix until few are left, and then a list.
    """
    alive = np.ones((len(left), len(right)), bool)
    if within:
        alive = np.triu(alive, 1)
    matches = np.zeros(alive.shape, np.int16)
    rows, columns = np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)
    start, a, b = 0, None, None
    for end, least in limits:
        if a is None:
            for i in range(start, end):
                matches += rows[i][:, None] == columns[i][None, :]
            alive &= matches >= least
            if alive.sum() * 8 < alive.size:
                a, b = np.nonzero(alive)
                matches = matches[a, b]
        else:
            matches = matches + (left[a, start:end] == right[b, start:end]).sum(1)
            keep = matches >= least
            a, b, matches = a[keep], b[keep], matches[keep]
        start = end
        if a is not None and not len(a):
            break
    return (a, b) if a is not None else np.nonzero(alive)


def shared_counts(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The size of the intersection of the sets of each pair."""
    rows, cols = np.unique(a), np.unique(b)
    if len(a) < 8 * (len(rows) + len(cols)):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    used = np.unique(np.r_[rows, cols])
    terms, code = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True)
    where = dict(zip(used.tolist(), np.split(code, np.cumsum([len(sets[i]) for i in used])[:-1])))  # ascending, as sets are
    total = np.zeros((len(rows), len(cols)), np.float32)
    for low in range(0, len(terms), TERMS):  # counts stay exact below 2**24 shingles
        def dense(some):
            out = np.zeros((len(some), min(TERMS, len(terms) - low)), np.float32)
            for k, i in enumerate(some.tolist()):
                first, last = np.searchsorted(where[i], (low, low + TERMS))
                out[k, where[i][first:last] - low] = 1
            return out

        total += dense(rows) @ dense(cols).T
    return total[np.searchsorted(rows, a), np.searchsorted(cols, b)].astype(np.int64)


def least_linked(nodes: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the least node that the links (a, b) reach from it."""
    order = np.array(sorted(range(len(nodes)), key=nodes.__getitem__), np.int64)
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    x, y = place[a], place[b]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, x, least)
        np.minimum.at(now, y, least)
        now = now[now]
        if (now == root).all():
            return order[root[place]]
        root = now


def pairs_of_blocks(side: np.ndarray, values: np.ndarray, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """The surviving pairs of one block (all ``side`` 0) or between two."""
    limits = least_matches(threshold, values.shape[1], STEP, tolerance)
    first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    other = second if len(second) else first
    a, b = surviving_pairs(values[first], values[other], not len(second), limits)
    return first[a], other[b]


def join_blocks(nodes: list[bytes], copies: np.ndarray, side: np.ndarray, values: np.ndarray, sets: list[np.ndarray], threshold: float, tolerance: float):
    """Links of one pair of blocks: for each node with one, its linked copies and the least node it reaches here."""
    a, b = pairs_of_blocks(side, values, threshold, tolerance)
    sizes = np.array([len(s) for s in sets], np.int64)
    fits = np.minimum(sizes[a], sizes[b]) >= threshold * np.maximum(sizes[a], sizes[b]) - 1e-9
    a, b = a[fits], b[fits]
    if not len(a):
        return
    shared = shared_counts(sets, a, b)
    linked = shared >= threshold * (sizes[a] + sizes[b] - shared) - 1e-9
    a, b = a[linked], b[linked]
    links = np.bincount(a, copies[b], len(nodes)) + np.bincount(b, copies[a], len(nodes))
    root = least_linked(nodes, a, b)
    for i in np.unique(np.r_[a, b]).tolist():
        yield nodes[i], int(links[i]), nodes[root[i]]


def group_by_group(keys: tuple[str, ...], work, schema: pa.Schema, rows_at_once: int = 5000):
    """A function for mapInArrow: ``work`` turns the rows of each group of sorted batches into tuples of ``schema``."""

    def flush(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done)) or [[] for _ in schema]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def run(batches):
        now, waiting, done = None, [], []
        for batch in batches:
            for part in pieces(batch, batch.num_columns - 1, 16_000_000):
                for r in part.to_pylist():
                    at = tuple(r[k] for k in keys)
                    if at != now:
                        done += work(waiting) if waiting else []
                        waiting, now = [], at
                    waiting.append(r)
                    if len(done) > rows_at_once:
                        yield flush(done)
                        done = []
        done += work(waiting) if waiting else []
        yield flush(done)

    return run


BLOCK_PAIR = ("root", "i", "j")


def in_groups(df: DataFrame) -> DataFrame:
    return df.repartition(*BLOCK_PAIR).sortWithinPartitions(*BLOCK_PAIR)


def numbered(rows: DataFrame, text: str) -> DataFrame:
    """The rows, stored with a number of their own (``rid``), the id of their shingle set, its bands, MinHash values and size.

    The set is null where a text has no words.
    """

    def digest():
        def work(texts):
            hashes, sizes = shingle_sets(texts)
            values = minhash(hashes, sizes, BANDS * ROWS, 1)
            ids = set_ids(hashes, sizes)
            return {"set_id": ids, "bands": [None if i is None else b for i, b in zip(ids, band_keys(values))],
                    "shingles": sizes, "hashes": [None if i is None else v.tobytes() for i, v in zip(ids, values[:, :VALUES])]}

        return work

    counted = rows.withColumn("rid", F.monotonically_increasing_id())
    return stored(map_texts(counted, text, counted.columns, "set_id binary, bands binary, shingles long, hashes binary", digest), "jaccard-rows")


def linked_sets(rows: DataFrame, text: str, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(set_id, links, head) of sets in ``rows``, as :func:`numbered` gives them: links counted in copies, and a linked set that is less or the same."""
    sets = rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(
        F.min("rid").alias("rid"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"),
        F.first("shingles").alias("shingles"), F.first("hashes").alias("hashes"))
    each = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.col("bands").substr(i * 8 + 1, F.lit(8)))
    bands = sets.select("set_id", F.explode(each).alias("band"))
    meet = bands.groupBy("band").agg(F.min("set_id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    candidates = components(splittable_join(bands, meet, "band"), "set_id", "head", "jaccard-candidates")
    candidates = stored(candidates.withColumnRenamed("node", "set_id"), "jaccard-groups")

    members = sets.select("set_id", "rid", "copies", "shingles", "hashes").join(candidates, "set_id")
    parts = F.greatest(F.count(F.lit(1)) / block, F.sum("shingles") / BLOCK_SHINGLES)
    n_blocks = sets.select("set_id", "shingles").join(candidates, "set_id").groupBy("root").agg(F.ceil(parts).cast("int").alias("blocks"))
    members = splittable_join(members, n_blocks, "root").withColumn("own", F.pmod(F.hash("set_id"), F.col("blocks")))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    paired = members.select("*", other).select(
        "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "set_id", "rid", "copies", "hashes")

    def values_of(found: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["side"] for r in found]), np.stack([np.frombuffer(r["hashes"], np.uint32) for r in found])

    def prune(found: list[dict]) -> list[tuple]:
        a, b = pairs_of_blocks(*values_of(found), threshold, tolerance) if len(found) > 1 else ((), ())
        return [tuple(found[i].values()) for i in np.unique(np.r_[a, b].astype(np.int64)).tolist()]

    narrow = pa.schema([("root", pa.binary()), ("i", pa.int32()), ("j", pa.int32()), ("side", pa.int32()), ("set_id", pa.binary()),
                        ("rid", pa.int64()), ("copies", pa.int64()), ("hashes", pa.binary())])
    survivors = stored(in_groups(paired).mapInArrow(
        group_by_group(BLOCK_PAIR, prune, narrow), "root binary, i int, j int, side int, set_id binary, rid long, copies long, hashes binary"), "jaccard-survivors")

    def full():
        def work(found):
            hashes, sizes = shingle_sets(found)
            return {"members": [x.tobytes() for x in np.split(hashes, np.cumsum(sizes)[:-1])]}

        return work

    wanted = rows.select("rid", F.col(text).alias("text__")).join(survivors.select("rid", "set_id").distinct(), "rid")
    shingled = map_texts(wanted, "text__", ["set_id"], "members binary", full)
    verified = splittable_join(survivors, shingled, "set_id").select(*BLOCK_PAIR, "side", "set_id", "copies", "hashes", "members")

    def compare(found: list[dict]) -> list[tuple]:
        if len(found) < 2:
            return []
        return list(join_blocks([r["set_id"] for r in found], np.array([r["copies"] for r in found], np.int64), *values_of(found),
                                [np.frombuffer(r["members"], np.uint64) for r in found], threshold, tolerance))

    links = pa.schema([("set_id", pa.binary()), ("links", pa.int64()), ("head", pa.binary())])
    return stored(in_groups(verified).mapInArrow(group_by_group(BLOCK_PAIR, compare, links), "set_id binary, links long, head binary"), "jaccard-links")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD,
                    tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """(key, class_id, n_links) of every row.

    ``class_id`` is the least key of the texts that links connect; ``n_links`` the
    number of other rows whose shingle sets have a Jaccard similarity of at least
    ``threshold``, copies counted each.
    """
    rows = numbered(docs.select(F.col(f"`{key}`").alias("key__"), F.col(f"`{text}`").alias("body__")), "body__")
    linked = linked_sets(rows, "body__", threshold, tolerance, block)
    roots = components(linked, "set_id", "head", "jaccard-classes").withColumnRenamed("node", "set_id")
    counts = linked.groupBy("set_id").agg(F.sum("links").alias("links"))
    sets = rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("key__").alias("least"), F.count(F.lit(1)).alias("copies"))
    named = sets.join(roots, "set_id", "left").join(counts, "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    heads = named.groupBy("root").agg(F.min("least").alias("class_id"))
    known = splittable_join(named, heads, "root").select("set_id", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return splittable_join(rows.select("key__", "set_id"), known, "set_id", "left").select(
        F.col("key__").alias(key), F.when(F.col("set_id").isNull(), F.col("key__")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without near duplicates: of each class one row stays, and every text without words.

    It is a row with the least id of the class, and of several such rows the one
    whose text has the least hash; a null id comes last.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of the documents can clash with a new one
    body, own = (names[docs.columns.index(c)] for c in (text, key))
    rows = numbered(docs.toDF(*names), body)
    roots = components(linked_sets(rows, body), "set_id", "head", "jaccard-classes").withColumnRenamed("node", "set_id")
    order = F.struct(F.col(own).isNull(), F.col(own), F.xxhash64(body), F.col("rid"))
    firsts = rows.where(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min(order).alias("first"))
    heads = firsts.join(roots, "set_id", "left").groupBy(F.coalesce("root", "set_id").alias("root")).agg(F.min("first").alias("first"))
    kept = rows.where(F.col("set_id").isNotNull()).select(*names, "rid").join(heads.select(F.col("first.rid").alias("rid")), "rid", "left_semi")
    return kept.select(*names).union(rows.where(F.col("set_id").isNull()).select(*names)).toDF(*docs.columns)


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
