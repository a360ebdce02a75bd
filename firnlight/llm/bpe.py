"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary is a public ``tokenizers`` file of a BPE with word ends; its path
is a parameter. Texts go through the file's own steps: special tokens are cut
out, each rest is brought to NFC, lower case and single spaces, split by the
file's pattern and written as byte symbols, the last with the word end.

Merging works on many distinct words at once. Their symbols lie in one flat
array; in every round the keys of all neighbouring pairs are looked up by binary
search in the sorted pair keys, each word takes its lowest rank, and all its
non-overlapping occurrences of that pair merge. Words without a pair leave.

Edge cases: a null or empty text gives no tokens; a text of white space too.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read

#: Distinct words that a worker remembers; beyond it the memory starts anew.
CACHE_WORDS = 150_000

#: What str.split() takes for white space and the pattern does not.
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class BpeCodec:
    """Encoder and decoder of one vocabulary; one lives in each Python worker."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in chain(vocab.items(), self.special.items())}
        self.end = spec["model"]["end_of_word_suffix"] or ""
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"), regex.V0)
        self.spaces = regex.compile(r"\p{White_Space}+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        symbols = byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + self.end] for c in symbols], np.int64)
        self.size = max(self.tokens) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.cache: dict[str, tuple] = {}
        self.cache_words = cache_words

    # -- words -----------------------------------------------------------------
    def split(self, chunk: str) -> list:
        """The pre-tokens of a run without white space: words, or ids of special tokens."""
        out: list = []
        parts = self.cut.split(chunk) if self.cut and "<" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                if not part.isascii():
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out.extend(self.words.findall(part.lower()))
        return out

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of many distinct words, merged together in rounds."""
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(r) for r in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.inner[flat]
        ends = np.cumsum(sizes)
        sym[ends - 1] = self.last[flat[ends - 1]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_sym, done_word = [], []
        none = len(self.made)
        while len(sym):
            same = word[1:] == word[:-1]
            key = sym[:-1] * self.size + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(sym), none, np.int64)
            hit = same & (self.keys[at] == key)
            rank[:-1][hit] = self.ranks[at[hit]]
            starts = np.flatnonzero(np.r_[True, ~same])
            best = np.minimum.reduceat(rank, starts)
            counts = np.diff(np.r_[starts, len(sym)])
            over = np.repeat(best == none, counts)
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank = sym[~over], word[~over], rank[~over]
                best, counts = best[best != none], counts[best != none]
                if not len(sym):
                    break
            take = rank == np.repeat(best, counts)
            # Of overlapping occurrences (a, a, a) every second one merges, from the left.
            run = np.flatnonzero(take)
            first = np.r_[True, (np.diff(run) != 1) | (word[run[1:]] != word[run[:-1]])]
            head = np.repeat(run[first], np.diff(np.r_[np.flatnonzero(first), len(run)]))
            run = run[(run - head) % 2 == 0]
            sym[run] = self.made[rank[run]]
            keep = np.ones(len(sym), bool)
            keep[run + 1] = False
            sym, word = sym[keep], word[keep]
        sym, word = np.concatenate(done_sym or [sym]), np.concatenate(done_word or [word])
        order = np.argsort(word, kind="stable")
        return np.split(sym[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    # -- texts -----------------------------------------------------------------
    def runs(self, text: str) -> list[str]:
        return [r for r in self.spaces.split(text) if r] if ODD_SPACE.search(text) else text.split()

    def learn(self, chunks: set[str]) -> None:
        """Encode runs that are not remembered yet, all their words in one batch."""
        split = {c: self.split(c) for c in chunks}
        words = list({w for ws in split.values() for w in ws if isinstance(w, str)})
        ids = dict(zip(words, (tuple(a.tolist()) for a in self.merge(words)))) if words else {}
        for c, ws in split.items():
            got = tuple(chain.from_iterable((w,) if isinstance(w, int) else ids[w] for w in ws))
            self.cache[c] = (got, " ".join(map(str, got)), self.decode(got))

    def entries(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text, the entries (ids, ids as text, decoded) of its runs."""
        runs = [self.runs(t) if t else [] for t in texts]
        if len(self.cache) > self.cache_words:
            self.cache.clear()
        new = set(chain.from_iterable(runs)).difference(self.cache)
        if new:
            self.learn(new)
        get = self.cache.__getitem__
        return [[e for e in map(get, r) if e[0]] for r in runs]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [list(chain.from_iterable(e[0] for e in es)) for es in self.entries(texts)]

    def decode(self, ids) -> str:
        """The tokens of the ids with a space between, as the file names no decoder; unknown ids are left out."""
        get = self.tokens.get
        return " ".join(t for t in map(get, ids) if t is not None)


def encode_bpe(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of each whole text, without special tokens of its own.

    Null and empty texts get an empty array; other columns pass through.
    """
    keep = [c for c in df.columns if c != ids]

    def make():
        codec = BpeCodec(vocabulary)
        return lambda texts: {ids: codec.encode(texts)}

    return map_texts(df, text, keep, f"`{ids}` array<int>", make)


def decode_bpe(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the decoded ids; null ids give an empty text."""

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = BpeCodec(vocabulary)
        for batch in batches:
            yield batch.map(lambda x: "" if x is None else codec.decode(x))

    return df.withColumn(text, decoded(F.col(f"`{ids}`")))


def bpe_digests(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", with_ids: bool = False,
                keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode and decode whole texts and return counts and SHA-256 digests of both, and the ids on request; ``keep`` passes columns on."""

    def make():
        codec = BpeCodec(vocabulary)

        def work(texts):
            n, ids, back, tokens = [], [], [], []
            for es in codec.entries(texts):
                n.append(sum(len(e[0]) for e in es))
                ids.append(hashlib.sha256(" ".join([e[1] for e in es]).encode()).hexdigest())
                back.append(hashlib.sha256(" ".join([e[2] for e in es]).encode()).hexdigest())
                if with_ids:
                    tokens.append(np.fromiter(chain.from_iterable(e[0] for e in es), np.int32, n[-1]))
            return {"n_tokens": n, "ids_sha256": ids, "decoded_sha256": back, "ids": tokens}

        return work

    return map_texts(df, text, [key, *keep], "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, make)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read(spark, sf_dir, "documents"), default_vocabulary())
