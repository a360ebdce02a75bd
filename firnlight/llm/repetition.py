"""Quality rules on repetition, by suffix arrays over words.

The words of many texts lie in one flat array, marked by text so that suffixes
of different texts never share a prefix. Prefix doubling sorts the suffixes in
numpy, each round only those that still share a rank; the ranks of all rounds
give the longest common prefix of neighbouring suffixes by descent through the
powers of two. A suffix's longest common prefix with its neighbours is the
longest repeat that starts there; those not extended to the left are the
maximal repeated substrings. Their spans are united, and a text fails where the
united spans cover too much of it or where one repeat is too long.

Edge cases: null and empty texts have no words and fail the word count; empty
tables give no rows; memory follows a chunk of texts or the longest text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import map_texts, read

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"


def suffix_repeats(words: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each position, the words of the longest repeat in its own text that starts there.

    ``words``: ids of all words, text after text; ``owner``: index of the text.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    key = owner.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    sizes = np.diff(np.r_[starts, n])
    rank = np.empty(n + 1, np.int32)
    rank[order] = np.repeat(starts, sizes)
    rank[n] = -1
    levels = [rank.copy()]
    slots = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of the suffix array not yet settled
    step = 1
    while len(slots):
        suffix = order[slots]
        ahead = np.minimum(suffix + step, n)
        same = ahead < n
        same[same] = owner[ahead[same]] == owner[suffix[same]]
        second = np.where(same, rank[ahead], -1).astype(np.int64)
        key = rank[suffix].astype(np.int64) * (n + 2) + second + 1
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[slots] = suffix
        starts = np.flatnonzero(np.r_[True, np.diff(key) != 0])
        sizes = np.diff(np.r_[starts, len(key)])
        rank[suffix] = np.repeat(slots[starts], sizes)
        levels.append(rank.copy())
        slots = slots[np.repeat(sizes > 1, sizes)]
        step *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n + 1, np.int64)
    lcp = common[1:n]
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b = a[live], b[live]
    for k in range(len(levels) - 1, -1, -1):
        equal = (levels[k][np.minimum(a, n)] == levels[k][np.minimum(b, n)]) & (a < n) & (b < n)
        add = np.where(equal, 1 << k, 0)
        lcp[live] += add
        a, b = a + add, b + add
    out = np.empty(n, np.int64)
    out[order] = np.maximum(common[:-1], common[1:])
    return out


def united(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places the union of the spans covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repetition_stats(texts: list[str | None], min_words: int = 16, max_covered: float = 0.3, max_longest: int = 50) -> dict[str, list]:
    """Counts and verdicts of whole texts.

    A repeat counts from ``min_words`` words on. A text is kept unless its base
    counts fail, the united repeats hold more than ``max_covered`` of the
    characters of its words, or one repeat has over ``max_longest`` words.
    """
    count = len(texts)
    texts = [t or "" for t in texts]
    split = [t.encode().split() for t in texts]
    n_words = np.array([len(s) for s in split], np.int64)
    owner = np.repeat(np.arange(count), n_words)
    flat = np.empty(len(owner), object)
    flat[:] = [w for s in split for w in s]
    ids, names = pd.factorize(flat)
    width = np.array([len(w.decode()) for w in names], np.int64)[ids] if len(flat) else np.zeros(0, np.int64)
    longest = suffix_repeats(ids.astype(np.int64), owner)

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, count).astype(np.int64) if len(owner) else np.zeros(count, np.int64)

    three = np.flatnonzero(longest >= 3)
    n_repeat = per_text(united(three, np.full(len(three), 3), len(owner)))
    inner = np.r_[False, (owner[1:] == owner[:-1]) & (longest[:-1] > longest[1:])] if len(owner) else np.zeros(0, bool)
    maximal = np.flatnonzero((longest >= min_words) & ~inner)
    covered = per_text(united(maximal, longest[maximal], len(owner)) * width)
    longest_repeat = np.zeros(count, np.int64)
    np.maximum.at(longest_repeat, owner[maximal], longest[maximal])
    word_chars = per_text(width)
    lines = [[x for x in t.split("\n") if x.strip(BLANKS)] for t in texts]
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    share = covered / np.maximum(word_chars, 1)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts],
        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (share <= max_covered) & (longest_repeat <= max_longest),
        "covered_share": share,
        "longest_repeat": longest_repeat,
    }


STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_share double, longest_repeat long"


def repetition_rules(df: DataFrame, text: str = "text", keep: list[str] | None = None, **limits) -> DataFrame:
    """Add the repetition counts and the verdict ``kept`` to every row; none goes."""
    added = {part.split()[0] for part in STATS.split(", ")}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    return map_texts(df, text, keep, STATS, lambda: lambda texts: repetition_stats(texts, **limits), limit=1_000_000)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(read(spark, sf_dir, "documents"), keep=["doc_id"])
