"""Toxicity by classifier chains of linear models.

Categories are predicted one after the other. Each has a logistic regression
over words and beginnings of words that tell it apart and a few shares of
characters; later models also see the probabilities of earlier categories. In
training those are out-of-fold predictions, so that a later model meets them as
uncertain as they will be. A word counts as present or not. A beginning, which
gathers inflected and compounded forms, counts by its share of the words, as a
long text holds most of them by chance.

The chain is fitted on a bounded sample of labelled rows, drawn by a hash of the
key. Features are counted and read out in the executors; the driver solves small
systems over the chosen ones. Then every whole text is scored where it lies,
without a shuffle.

Edge cases: null and empty texts have no words and are scored on that; very long
texts are scored whole; rows without a label, or with a null one, are not learned
from; of several labels of a key the largest counts, and of several documents of
a labelled key the least text is learned from, but each row is scored by itself;
a category whose sample has one class only gets that class's probability; without
labelled rows all probabilities are 0 and nothing is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, read, stored

WORDS = re.compile(r"[^\W\d_]+")
#: Letters of the beginnings of words, written with a hyphen, and the share of words from which one counts in full.
STEMS, FULL_SHARE = (4, 5, 6, 7), 0.01
SHARES = 4
FOLDS = 5
#: From the labels table: what counts as positive in each category, in the order of the chain.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def features_of(text: str, stems: frozenset[str] | None = None) -> tuple[dict[str, float], int]:
    """Values of the words and beginnings of a text, of these ``stems`` or all; and how many words are distinct."""
    counts = Counter(WORDS.findall(text.lower()))
    out: dict[str, float] = dict.fromkeys(counts, 1.0)
    if stems is None or stems:
        shares: Counter = Counter()
        for w, n in counts.items():
            for k in STEMS:
                if len(w) > k and (stems is None or w[:k] in stems):
                    shares[w[:k]] += n
        full = FULL_SHARE * sum(counts.values())
        out |= {f"{stem}-": min(n / full, 1.0) for stem, n in shares.items()}
    return out, len(counts)


def shares_of(text: str, distinct: int) -> list[float]:
    """Of a text's characters: symbols, capitals, digits; and how few of its words are distinct."""
    n = max(len(text), 1)
    symbols = sum(map(text.count, "#*$%&|<>!")) / n
    runs = text.count(" ") + text.count("\n") + 1
    return [min(10 * symbols, 3.0), min(3 * sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) / n, 3.0), min(10 * sum(map(text.count, "0123456789")) / n, 3.0), 1 - min(distinct / runs, 1.0)]


@dataclass
class Model:
    """One linear model: weights of words and beginnings, of the shares, of earlier categories, and a bias."""

    words: dict[str, float] = field(default_factory=dict)
    dense: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0

    def probability(self, values: dict[str, float], dense: list[float]) -> float:
        z = self.bias + sum(v * values[w] for w, v in self.words.items() if w in values) + float(np.dot(self.dense, dense))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


@dataclass
class Sample:
    """Chosen features of the labelled texts as flat codes with values, and the shares of each text."""

    places: dict[str, int]
    codes: np.ndarray
    values: np.ndarray
    owner: np.ndarray
    dense: np.ndarray

    def matrix(self, chosen: list[str]) -> np.ndarray:
        """A row for each text: its values of the chosen features, its dense columns, and 1."""
        place = np.full(len(self.places), -1, np.int32)
        place[[self.places[c] for c in chosen]] = np.arange(len(chosen))
        x = np.zeros((len(self.dense), len(chosen) + self.dense.shape[1] + 1))
        at = place[self.codes]
        x[self.owner[at >= 0], at[at >= 0]] = self.values[at >= 0]
        x[:, len(chosen) : -1] = self.dense
        x[:, -1] = 1
        return x


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, balance: float = 0.7, rounds: int = 15) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the rarer class weighs more, by a power of its share."""
    w = np.zeros(x.shape[1])
    if not len(y) or y.all() or not y.any():
        w[-1] = 40.0 if len(y) and y.all() else -40.0
        return w
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** balance
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Chain:
    """Models in the order of their categories."""

    names: list[str]
    models: list[Model]

    def __post_init__(self):
        self.stems = frozenset(w[:-1] for m in self.models for w in m.words if w.endswith("-"))

    def predict(self, text: str | None) -> list[float]:
        text = text or ""
        values, distinct = features_of(text, self.stems)
        dense, out = shares_of(text, distinct), []
        for m in self.models:
            out.append(m.probability(values, dense + out))
        return out


def telling(sample: DataFrame, groups: list, fits: list[tuple[int, int | None]], least_docs: int, most: int = 400, least_z: float = 3.0) -> dict:
    """For each fit the features whose mean value differs most between the classes, in standard errors of the difference.

    A fit is a category and the fold that it leaves out. The features are counted in
    the executors: each has its sums by fold and labels, a handful of numbers, and
    from those follow its means for every fit. At most ``most`` names a fit come back.
    """

    def make():
        def work(texts):
            found = [features_of(t or "")[0] for t in texts]
            return {"names": [list(x) for x in found], "values": [list(x.values()) for x in found]}

        return work

    labels = [c for c in sample.columns if c.startswith("y")]
    whose = F.lit(-1)
    for i, g in enumerate(groups):
        same = F.col("fold") == g["fold"]
        for c in labels:
            same = same & (F.col(c) == g[c])
        whose = F.when(same, i).otherwise(whose)
    flat = map_texts(sample.withColumn("whose", whose), "text__", ["whose"], "names array<string>, values array<double>", make)
    flat = flat.select("whose", F.explode(F.arrays_zip("names", "values")).alias("f")).select("whose", F.col("f.names").alias("name"), F.col("f.values").alias("v"))
    sums = {f"{part}{i}": F.sum(F.when(F.col("whose") == i, F.col("v") if part == "s" else F.col("v") * F.col("v")).otherwise(0.0))
            for i in range(len(groups)) for part in "sq"}
    stats = flat.groupBy("name").agg(F.count(F.lit(1)).alias("docs"), *[v.alias(k) for k, v in sums.items()]).where(F.col("docs") >= least_docs)

    def total(part: str, some: list[int]):
        return sum((F.col(f"{part}{i}") for i in some), F.lit(0.0))

    scores = []
    for k, out in fits:
        inside = [i for i, g in enumerate(groups) if g["fold"] != out]
        yes = [i for i in inside if groups[i][f"y{k}"]]
        n, a = sum(groups[i]["count"] for i in inside), sum(groups[i]["count"] for i in yes)
        b = n - a
        if not a or not b:
            scores.append(F.lit(0.0))
            continue
        pos, both, squares = total("s", yes), total("s", inside), total("q", inside)
        spread = F.greatest(squares / n - (both / n) * (both / n), F.lit(1e-9))
        scores.append(F.abs(pos / a - (both - pos) / b) / F.sqrt(spread * (1 / a + 1 / b)))
    ranked = Window.partitionBy("fit").orderBy(F.desc("z"), "name")
    best = stats.select("name", F.posexplode(F.array(*scores)).alias("fit", "z")).where(F.col("z") >= least_z)
    rows = best.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= most).select("fit", "n", "name").collect()
    chosen: dict = {fit: [] for fit in fits}
    for r in sorted(rows, key=lambda r: (r["fit"], r["n"])):
        chosen[fits[r["fit"]]].append(r["name"])
    return chosen


def gathered(sample: DataFrame, names: list[str]) -> tuple[Sample, list]:
    """The values of the named features in the sampled texts, made in the executors; and the rows' folds and labels."""
    places = {w: i for i, w in enumerate(names)}
    stems = frozenset(w[:-1] for w in names if w.endswith("-"))

    def make():
        def work(texts):
            out = {"codes": [], "values": [], "dense": []}
            for t in texts:
                values, distinct = features_of(t or "", stems)
                got = sorted((places[w], v) for w, v in values.items() if w in places)
                out["codes"].append(np.array([c for c, _ in got], np.int32).tobytes())
                out["values"].append(np.array([v for _, v in got], np.float32).tobytes())
                out["dense"].append(np.array(shares_of(t or "", distinct), np.float64).tobytes())
            return out

        return work

    keep = [c for c in sample.columns if c != "text__"]
    rows = map_texts(sample, "text__", keep, "codes binary, values binary, dense binary", make).collect()
    rows.sort(key=lambda r: r["key__"])
    codes = [np.frombuffer(r["codes"], np.int32) for r in rows]
    values = [np.frombuffer(r["values"], np.float32) for r in rows]
    dense = np.array([np.frombuffer(r["dense"]) for r in rows]).reshape(len(rows), SHARES)
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(c) for c in codes])
    none = np.zeros(0, np.int32)
    return Sample(places, np.concatenate(codes or [none]), np.concatenate(values or [none]), owner, dense), rows


def fit_sample(sample: DataFrame, names: list[str], least_docs: int = 2) -> Chain:
    """A chain over a bounded sample with a row for each text: key__, text__, y0, y1, ... and fold.

    It is read twice: once to choose features, once for their values. The driver
    holds a float for each chosen feature of each text, and no text.
    """
    labels = [f"y{k}" for k in range(len(names))]
    groups = sample.groupBy("fold", *labels).count().orderBy("fold", *labels).collect()
    groups = [r.asDict() for r in groups]
    folds = sorted({g["fold"] for g in groups})
    fits = [(k, out) for k in range(len(names)) for out in (None, *folds)]
    chosen = telling(sample, groups, fits, least_docs)
    found, rows = gathered(sample, sorted({w for some in chosen.values() for w in some}))
    fold = np.array([r["fold"] for r in rows])
    models = []
    for k in range(len(names)):
        y = np.array([r[labels[k]] for r in rows]).astype(bool)
        held = np.zeros(len(y))
        for out in (None, *folds):
            x, inside = found.matrix(chosen[k, out]), fold != out if out is not None else np.ones(len(y), bool)
            w = fit_weights(x[inside] if out is not None else x, y[inside])
            if out is None:
                words = chosen[k, out]
                models.append(Model({c: float(v) for c, v in zip(words, w)}, w[len(words) : -1], float(w[-1])))
            else:
                held[~inside] = sigmoid(x[~inside] @ w)
        found.dense = np.c_[found.dense, held]
    if not rows:
        models = [Model({}, np.zeros(SHARES + k), -40.0) for k in range(len(names))]
    return Chain(list(names), models)


def fit_chain(texts: list[str | None], labels: np.ndarray, folds: np.ndarray, names: list[str], least_docs: int = 2) -> Chain:
    """A chain from texts at hand: the columns of ``labels`` are the categories, ``folds`` numbers the fold of each row."""
    spark = SparkSession.builder.getOrCreate()
    rows = [(f"{i:09d}", t, *map(int, y), int(f)) for i, (t, y, f) in enumerate(zip(texts, labels, folds))]
    kinds = ", ".join(f"y{k} int" for k in range(len(names)))
    return fit_sample(spark.createDataFrame(rows, f"key__ string, text__ string, {kinds}, fold int"), names, least_docs)


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                    categories: dict[str, str] = CATEGORIES, sample_rows: int = 2000) -> DataFrame:
    """About ``sample_rows`` labelled keys of each combination of labels with a text each, drawn by a hash.

    Labels of a key are folded into their largest before they are counted and
    drawn, and documents of a key into one text, the least; so repeated labels and
    ids neither empty nor fill the sample. The drawn keys are few by that bound
    and so may be broadcast to the documents.
    """
    names = [f"y{i}" for i in range(len(categories))]
    flags = [F.expr(rule).cast("int").alias(n) for n, rule in zip(names, categories.values())]
    known = labels.select(F.col(key).alias("key__"), *flags).dropna().groupBy("key__").agg(*[F.max(n).alias(n) for n in names])
    place = F.pmod(F.xxhash64(F.lit(23), "key__"), F.lit(1 << 30))
    keep = F.lit(False)
    for row in known.groupBy(*names).count().collect():  # a row for each combination of labels
        same = F.lit(True)
        for n in names:
            same = same & (F.col(n) == row[n])
        keep = keep | (same & (place < int((1 << 30) * min(1.0, sample_rows / row["count"]))))
    body = docs.select(F.col(key).alias("key__"), F.col(text).cast("string").alias("text__"))
    drawn = body.join(F.broadcast(known.where(keep)), "key__").groupBy("key__", *names).agg(F.min("text__").alias("text__"))
    fold = (F.crc32(F.col("key__").cast("string").cast("binary")) % FOLDS).cast("int").alias("fold")
    return drawn.select(F.col("key__").cast("string").alias("key__"), "text__", *names, fold).repartition(32, "key__")


def fit_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                 categories: dict[str, str] = CATEGORIES, sample_rows: int = 2000) -> Chain:
    """Fit the chain on a bounded sample of labelled documents, stored once in the shared folder."""
    sample = stored(labelled_sample(docs, labels, key, text, categories, sample_rows), "toxicity-sample")
    return fit_sample(sample, list(categories))


def score_toxicity(df: DataFrame, chain: Chain, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``p_<category>`` for each category of the chain; whole texts, no row goes."""
    added = [f"p_{n}" for n in chain.names]
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]

    def make():
        def work(texts):
            found = np.array([chain.predict(t) for t in texts]).reshape(len(texts), len(added))
            return {n: found[:, i] for i, n in enumerate(added)}

        return work

    return map_texts(df, text, keep, ", ".join(f"{n} double" for n in added), make)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose toxicity lies below the threshold, as they are."""
    chain = fit_toxicity(docs, labels)
    names = [f"c{i}" for i in range(len(docs.columns))]  # no name of the documents can clash with a new one
    plain = docs.toDF(*names)
    marked = score_toxicity(plain.withColumn("body", F.col(names[docs.columns.index("text")])), chain, "body", keep=names)
    return marked.where(F.col("p_toxic") < threshold).select(*names).toDF(*docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chain = fit_toxicity(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, chain, keep=["doc_id"]).withColumn("toxic", F.col("p_toxic") >= 0.5)
