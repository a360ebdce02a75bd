"""Operators on whole tables, against brute force, and the pipeline."""

import collections
import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from firnlight.llm import jaccard, mixing, registry, search
from firnlight.llm.components import components

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = (text or "").encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_near(rows):
    sets = [shingles(t) for _, t in rows]
    where = collections.defaultdict(set)
    for i, s in enumerate(sets):
        for g in s:
            where[g].add(i)
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j, k in collections.Counter(j for g in s for j in where[g]).items():
            if j != i and k >= 0.8 * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((rows[i][0], min(least[find(i)]), links[i]) for i in range(len(rows)))


def test_near_duplicates_equal_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = max((t for _, t in docs), key=lambda t: -abs(len(t.split()) - 200)).split()
    rng = random.Random(1)
    extra = []
    for k in range(150):  # a large group of near copies, over several blocks
        w = list(base)
        w[rng.randrange(len(w))] = f"x{k}"
        extra.append((5000 + k, " ".join(w)))
    extra += [(6000, None), (6001, ""), (6002, " \n"), (6003, "a b"), (6004, "a b"), (6005, "a b c d e"), (6006, "a b c d"), docs[1], docs[1]]
    rows = docs + extra
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("set_id", F.lit("clash")).repartition(3)
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df, block=32).collect())
    want = brute_near(rows)
    assert got == want
    kept = sorted(r.doc_id for r in jaccard.keep_one_of_each(df).collect())
    assert kept == sorted({c for _, c, _ in want})


def test_near_duplicates_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.near_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(nulls).collect()}
    assert got == {(None, 1, 1), (1, 1, 1), (2, 2, 0)}


def varied(words, rng, name):
    w = list(words)
    w[rng.randrange(len(w))] = name
    return " ".join(w)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    rng = random.Random(8)
    a, b, c = ([f"{x}{i}" for i in range(200)] for x in "abc")
    base = {x[0][0]: " ".join(x) for x in (a, b, c)}
    near_a = varied(a, rng, "zz")
    rows = [(None, base["a"]), (1, near_a), (3, base["b"]), (5, base["b"]), (5, base["c"]), (None, None), (None, "")]
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 1, 1), (1, 1, 1), (3, 3, 1), (5, 3, 1), (5, 5, 0), (None, None, 0), (None, None, 0)], key=str)
    for rows, want in (
        ([(3, base["b"]), (5, base["b"]), (5, base["a"])], [(3, base["b"]), (5, base["a"])]),
        ([(5, base["a"]), (5, base["c"])], [(5, base["a"]), (5, base["c"])]),
        ([(None, base["a"])] * 40 + [(None, near_a), (None, base["c"])], 2),
        ([(None, base["a"]), (9, near_a)], [(9, near_a)]),
        ([(7, base["a"])] * 30, [(7, base["a"])]),
    ):
        kept = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
        assert len(kept) == want if isinstance(want, int) else sorted(kept) == sorted(want)


def test_near_duplicates_random_ids_and_long_texts(spark):
    """Random groups with null and repeated ids, and texts larger than a block, against brute force."""
    rng = random.Random(21)
    bases = [[f"g{g}w{i}" for i in range(rng.choice([8, 60, 300]))] for g in range(12)]
    rows = []
    for k in range(300):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((rng.choice([None, rng.randrange(60), 1000 + k]), " ".join(w)))
    long = [f"l{i}" for i in range(60_000)]
    rows += [(2000, " ".join(long)), (2001, varied(long, rng, "y")), (2002, " ".join(long[:100]))]
    numbers = [(i, t) for i, (_, t) in enumerate(rows)]
    want = brute_near(numbers)  # by row
    least = collections.defaultdict(list)
    for i, c, _ in want:
        least[c].append(rows[i][0])
    least = {c: min((x for x in ids if x is not None), default=None) for c, ids in least.items()}
    expected = sorted(((rows[i][0], least[c], n) for i, c, n in want), key=str)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard.near_duplicates(df, block=16).collect()), key=str)
    assert got == expected
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(df).collect()]
    group = {(d, t): c for (d, t), (_, c, _) in zip(rows, want)}
    assert sorted(group[x] for x in kept) == sorted({c for _, c, _ in want})


def test_surviving_pairs_and_links_of_dense_blocks():
    rng = np.random.default_rng(5)
    values = rng.integers(0, 3, (60, 128)).astype(np.uint32)
    values[:30] = values[0]
    limits = jaccard.least_matches(0.8, 128, 32, 1e-7)
    a, b = jaccard.surviving_pairs(values, values, True, limits)
    assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i in range(30) for j in range(i + 1, 30)}
    names = [bytes([x]) for x in rng.permutation(60)]
    root = jaccard.least_linked(names, np.arange(0, 19), np.arange(1, 20))
    assert all(names[root[i]] == min(names[:20]) for i in range(20)) and all(root[i] == i for i in range(20, 60))


def test_posterior_limits():
    for n, least in jaccard.least_matches(0.8, 128, 32, 1e-7):
        assert 0 < least < 0.8 * n


def test_minhash_estimates_similarity():
    a = [f"w{i} " for i in range(1000)]
    hashes, sizes = jaccard.shingle_sets(["".join(a), "".join(a[:900])])
    v = jaccard.minhash(hashes, sizes, 512, 9)
    assert abs((v[0] == v[1]).mean() - sizes[1] / sizes[0]) < 0.06
    assert len(set(jaccard.set_ids(hashes, sizes))) == 2


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 180), rng.randrange(100, 180)) for _ in range(70)] + [(300, k) for k in range(301, 380)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in list(root)}


def brute_schedule(weights, blocks):
    """Slot by slot: of the sources that may run, the one whose next block is due first."""
    total, done, out, t = sum(map(Fraction, weights.values())), dict.fromkeys(weights, 0), [], 0
    share = {s: Fraction(w) / total for s, w in weights.items()}
    while any(done[s] < blocks[s] for s in weights):
        may = [s for s in weights if done[s] < blocks[s] and done[s] <= share[s] * (t + 1) and math.floor(done[s] / share[s]) <= t]
        if may:
            s = min(may, key=lambda s: (math.ceil((done[s] + 1) / share[s]), s is None, str(s)))
            out.append((s, done[s], t))
            done[s] += 1
        t += 1
    return out


@pytest.mark.parametrize("seed", range(20))
def test_schedule_equals_brute_force(seed):
    rng = random.Random(seed)
    w = {i: rng.choice([rng.random() ** 3 + 1e-3, rng.randint(1, 20), 2**0.5]) for i in range(rng.randint(1, 9))}
    blocks = {i: rng.randint(0, 30) for i in w}
    assert mixing.schedule(w, blocks) == brute_schedule(w, blocks)


@pytest.mark.parametrize("weights", [{"a": 1000, "b": 3.3, "c": 17.7, "d": 500}, {"a": 2**0.5, "b": 3**0.5, "c": 0.001, None: 7**0.5}, {"a": 1}, {"a": 0.1, "b": 0.2, "c": 0.7}])
def test_schedule_stays_within_a_block_of_the_given_weights(weights):
    n = 4096 * 100
    total = sum(map(Fraction, weights.values()))
    share = {s: Fraction(w) / total for s, w in weights.items()}
    out = mixing.schedule(weights, {s: math.ceil(n * x) for s, x in share.items()})
    got, ends = dict.fromkeys(weights, 0), {s: x.limit_denominator(10**12) for s, x in share.items()}
    for t, (s, i, slot) in enumerate(out[:n]):
        assert slot == t and i == got[s]
        got[s] += 1
        if t % 997 == 0 or t > n - 50:
            assert all(abs(got[q] - ends[q] * (t + 1)) < 1 for q in got)


def deviation(out, weights, end):
    """The most that any source is off its target, in blocks, over the slots before ``end``; ``out``: a source for each slot."""
    total = sum(weights.values())
    got, most = dict.fromkeys(weights, 0), 0.0
    for t in range(end):
        if t in out:
            got[out[t]] += 1
        most = max([most, *(abs(got[q] - w / total * (t + 1)) for q, w in weights.items())])
    return most


@pytest.mark.parametrize("weights", [None, {"s0": 1000, "s1": 3.3, "s2": 17.7, "s3": 500, "s4": 1, None: 0.5}])
def test_mix_places_every_row(spark, weights):
    rows = [(i, None if i % 11 == 0 else f"s{min(i % 7, 4)}", "c") for i in range(2000)] + [(5, "s4", "c")] * 3 + [(None, "s1", str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, source string, s2__ string").withColumn("slot__", F.lit("own"))
    out = mixing.mix(df, weights, block_rows=4, bucket_rows=100).toPandas().sort_values(["slot", "place"])
    assert len(out) == len(rows) and not out.duplicated(["slot", "place"]).any() and (out.slot__ == "own").all()
    blocks = out.groupby("slot").agg(s=("source", "first"), n=("source", lambda x: x.fillna("-").nunique()), rows=("place", "count"))
    assert (blocks.n == 1).all() and blocks.rows.max() == 4
    target = weights or {s: n**0.5 for s, n in collections.Counter(r[1] for r in rows).items()}
    in_slot = {int(t): s if isinstance(s, str) else None for t, s in zip(blocks.index, blocks.s)}
    assert out.in_mix.any() and deviation(in_slot, target, int(out[out.in_mix].slot.max()) + 1) < 1
    counted = collections.Counter((None if r[0] is None else r[0], r[1]) for r in rows)
    assert collections.Counter((None if d != d else int(d), s if isinstance(s, str) else None) for d, s in zip(out.doc_id, out.source)) == counted
    assert mixing.mix(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"s1": 1.0})
    with pytest.raises(ValueError):
        mixing.mix(df, dict.fromkeys(["s0", "s1", "s2", "s3", "s4", None], 0.0))


def test_mix_spreads_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, "s", f"text {i}") for i in range(4000)], "doc_id long, source string, text string")
    out = mixing.mix(df, block_rows=4, bucket_rows=100)
    sizes = [r["count"] for r in out.groupBy((F.col("block") / 50).cast("int")).count().collect()]
    assert sum(sizes) == 4000 and out.select("slot", "place").distinct().count() == 4000
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in tree
    hashes = df.select(F.xxhash64(F.lit(7), "doc_id", "doc_id", "source", "text")).distinct().count()
    assert hashes == 4000


def test_mix_with_large_blocks_and_more_sources_than_servers(spark):
    """Blocks grow with the rows, and small sources share pools; no row is lost and pools keep their weight."""
    rng = random.Random(2)
    rows = [(i, f"d{rng.randrange(300)}" if i % 3 else f"big{i % 2}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    for weights in (None, {s: 1.0 + len(s) for s in {r[1] for r in rows}}):
        out = mixing.mix(df, weights, block_rows=4, most_blocks=500, servers=16, bucket_rows=200).toPandas()
        assert sorted(out.doc_id) == list(range(6000)) and not out.duplicated(["slot", "place"]).any()
        assert out.groupby("slot").doc_id.count().max() == 12 and out.slot.nunique() <= 500 + 16
        assert out[out.in_mix].shape[0] > 0
        own = out[out.source == "big0"].sort_values(["slot", "place"])
        assert sorted(own.block.unique()) == list(range(own.block.nunique()))
    with pytest.raises(ValueError):
        mixing.mix(df, {s: 1.0 for s in {r[1] for r in rows} - {"d5"}}, servers=16)


def test_mixed_order_is_read_back_from_files(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", f"s{i % 3 if i % 5 else 0}", "own") for i in range(5000)], "doc_id long, text string, source string, slot string")
    placed = {r.doc_id: (r.slot, r.place) for r in mixing.mix(docs.drop("slot")).collect()}
    mixing.mixed_order(docs).write.parquet(f"{tmp_path}/mixed")
    back = mixing.written_order(spark.read.parquet(f"{tmp_path}/mixed"))
    assert back.columns == [*docs.columns, "mix_part", "mix_row"]
    in_files = [r for r in back.orderBy("mix_part", "mix_row").collect()]
    source, target = collections.Counter(), {}
    counts = collections.Counter(r.source for r in in_files)
    target = {s: n**0.5 / sum(m**0.5 for m in counts.values()) for s, n in counts.items()}
    for t, r in enumerate(in_files[:1500]):
        source[r.source] += 1
        assert all(abs(source[s] - target[s] * (t + 1)) < 2 * mixing.BLOCK_ROWS for s in target)
    assert len(placed) == 5000 and mixing.written_order(docs).where("mix_row is not null").count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * 3
    x = np.floor(256 * (centres[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 16)) * 0.3)).astype(int)
    x[100:200] = x[0]  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, vector array<long>")
    q = df.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(df, q, 5, shard_rows=400, query_rows=10).collect())
    want = []
    for i in range(0, 1500, 50):
        s = x @ x[i]
        best = [j for j in np.lexsort((np.arange(1500), -s)) if j != i][:5]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate(best)]
    assert got == want


def test_top_k_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, -0.1]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (50, [1.0, 1.0])]
    v = search.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert {r.vec_id: r.vector for r in v.collect()} == {0: [256, 512], 1: [128, -26], 50: [256, 256]}
    got = search.top_k(v, v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")).collect()
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == {(0, 1, 50), (0, 2, 1), (50, 1, 0), (50, 2, 1)}
    assert search.top_k(v.limit(0), v.limit(0).withColumnRenamed("vec_id", "query_id")).count() == 0


def test_top_k_counts_repeated_rows_as_the_sql_does(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    rows += [(7, [9.0] * 8)] * 5 + [(8, [8.0] * 8)] * 2 + [rows[50]] + [(100, rng.normal(size=8).tolist())]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = search.whole_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet"))
    q = v.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(db.execute(search.ORACLE).fetchall())
    assert len(want) == 30
    for rows_of_shard in (60, 8192):
        got = search.top_k(v, q, 5, shard_rows=rows_of_shard, query_rows=3).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert sorted(map(tuple, search.op5_exact_topk(spark, str(tmp_path)).collect())) == want


@pytest.mark.parametrize("scale", [1, -1, 1000, -1000, 2**22, -(2**22)])
def test_ball_trees_keep_ties_of_any_sign_and_size(scale):
    """Equal vectors over several leaves, and queries that see them as good, bad or near the largest exact score."""
    rng = np.random.default_rng(6)
    ids = rng.permutation(3000)
    x = np.full((3000, 64), 256.0)
    x[2000:2500, 3] = 255
    x[2500:] = rng.integers(-300, 300, (500, 64))
    tree = search.BallTree(ids, x, leaf=64)
    queries = np.vstack([np.full((1, 64), -256.0), np.full((1, 64), 256.0), rng.integers(-9, 9, (20, 64))]) * scale / (1 if abs(scale) < 2**20 else 8)
    queries = np.trunc(queries)
    at, vec, score = tree.search(np.full(len(queries), -1), queries, 5, np.full(len(queries), -float(2**62)))
    for q in range(len(queries)):
        all_scores = queries[q] @ x.T
        best = np.lexsort((ids, -all_scores))[:5]
        mine = sorted(zip(-score[at == q], vec[at == q]))
        assert mine == [(-all_scores[j], ids[j]) for j in best]


def test_top_k_of_negative_ties_over_shards(spark):
    rows = [(i, [256] * 8) for i in range(400)] + [(1000, [-256] * 8), (1050, [-255] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(4)
    q = df.where("vec_id >= 1000").withColumnRenamed("vec_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(df, q, 5, shard_rows=40, query_rows=4).collect())
    one = 8 * 256 * 255
    assert got == [(1000, 1, 1050, one), *[(1000, k + 2, k, -8 * 65536) for k in range(4)], (1050, 1, 1000, one), *[(1050, k + 2, k, -one) for k in range(4)]]


def test_top_k_over_many_shards_and_rounds(spark):
    """Shards enough for four rounds, hot rows and vectors of several lengths."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-50, 50, 6 if i % 3 else 4).tolist()) for i in range(800)] + [(5, [9] * 6)] * 400 + [(None, [1])] * 0
    df = spark.createDataFrame(rows, "vec_id long, vector array<long>").repartition(5)
    q = df.where("vec_id % 40 = 0").withColumnRenamed("vec_id", "query_id")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in search.top_k(df, q, 3, shard_rows=10, query_rows=4).collect())
    want = []
    for i, v in rows:
        if i % 40 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i)[:3]
            want += [(i, n + 1, j, -x) for n, (x, j) in enumerate(scored)]
    assert got == sorted(want)


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard", "secret_scans", "source_mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("block", F.lit("clash"))
    clean = corpus_pipeline.toxicity(spark, docs, SF)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    one = corpus_pipeline.ngram_jaccard(spark, clean, SF)
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    assert kept == {c for _, c, _ in brute_near(rows)}
    masked = corpus_pipeline.secret_scans(spark, one, SF)
    assert masked.columns == docs.columns and masked.where("text rlike '[0-9a-f]{24,}'").count() == 0 and masked.count() == len(kept)
    mixed = corpus_pipeline.source_mixing(spark, masked, SF)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == kept
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == kept and all(r.n_tokens == len(r.ids) for r in out)
    counts = collections.Counter(r.source for r in one.collect())
    total = sum(n**0.5 for n in counts.values())
    source_of, got = {r.doc_id: r.source for r in one.collect()}, collections.Counter()
    for t, r in enumerate(sorted(out, key=lambda r: (r.mix_part, r.mix_row))[:64]):
        got[source_of[r.doc_id]] += 1
    assert all(abs(got[s] - 64 * n**0.5 / total) < 2 * mixing.BLOCK_ROWS for s, n in counts.items())


def test_pipeline_shares_a_ledger_of_secrets(spark, tmp_path):
    docs = spark.createDataFrame([(1, "token = abcdefgh"), (2, "clean")], "doc_id long, text string")
    spark.conf.set(corpus_pipeline.LEDGER, f"file://{tmp_path}/ledger")
    try:
        for more in ([], [(3, "new")]):
            got = corpus_pipeline.secret_scans(spark, docs.union(spark.createDataFrame(more, docs.schema)), SF).collect()
            assert {r.doc_id: r.text for r in got}[1] == "[assign]"
        ledger = spark.read.parquet(f"file://{tmp_path}/ledger")
        assert ledger.count() == ledger.select("blob_id").distinct().count() == 3
    finally:
        spark.conf.unset(corpus_pipeline.LEDGER)


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 14))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_rows(spark, stage):
    """Nulls in any column, repeated rows, clashing names and no rows at all."""
    name, f = corpus_pipeline.STAGES[stage]
    rows = [(None, None, None, None, None, "x"), (1, "a b c d e f", "en", "s1", 11, "x"), (1, "a b c d e f", "en", "s1", 11, "x"), (2, "", None, None, 0, "y"),
            (3, "token = abcdefghij é", "en", None, None, "z"), (4, "w " * 20000, "en", "s2", 40000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, findings string").withColumns(
        {c: F.lit("own") for c in ("p_toxic", "slot", "place", "set_id", "root", "blob_id", "body")})
    out = f(spark, docs, SF)
    got = out.collect()
    if name == "bpe":
        assert len(got) == len(rows)
    else:
        assert out.columns == docs.columns
        want = [None, 1, 2, 3, 4] if name == "ngram_jaccard" else [None, 1, 1, 2, 3, 4]
        assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == want
        assert all(r.p_toxic == "own" and r.body == "own" for r in got)
    assert f(spark, docs.limit(0), SF).count() == 0
