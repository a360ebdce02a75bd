"""Language identification by compression.

For every language a raw-content dictionary for zstandard is cut from a bounded
sample of labelled texts. A text is compressed with each dictionary, in chunks,
so that all of it meets the dictionary and not only its first part; the language
with the smallest total is chosen. Where the best is hardly smaller than the
second, the prediction is marked as rejected.

Letters are lowered, everything else becomes one space, and every byte is
written four times, to dictionaries and texts alike: a match then pays from a
few letters on, so that short texts find their syllables in the dictionary.

Edge cases: a null text or one without a letter is ``und`` with score 0 and
rejected; ties go to the language with more labelled rows, then by name; without
any labelled row all is ``und``; with one language the score is 1; repeated rows
are predicted each, texts of any length whole, and own columns named as the new
ones give way to them; an empty table gives no rows. In the query a row without an id
is in no fold: it is predicted, not learned from, and its ``held_out`` is null.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_texts, read

WORDS = re.compile(r"[^\W\d_]+")
REPEAT = 4
#: Languages that a classifier tells apart at most: each worker holds a compressor of each.
MOST_LANGUAGES = 256


def plain(text: str) -> bytes:
    return f" {' '.join(WORDS.findall(text.lower()))} ".encode()


def repeated(letters: bytes) -> bytes:
    return np.repeat(np.frombuffer(letters, np.uint8), REPEAT).tobytes()


def normal(text: str) -> bytes:
    return repeated(plain(text))


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds


def fit_dictionaries(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                     sample_docs: int = 150, dictionary_bytes: int = 65_536) -> list[tuple[str, bytes]]:
    """A dictionary for each language, languages with more rows first.

    Fitted on a bounded sample: about ``sample_docs`` texts of a language, drawn
    by a hash of the key, of which ``dictionary_bytes`` of letters are kept. Rows
    with null language or text are not used. One scan counts the languages, one
    more draws the samples; letters are cut from them in the executors, so that
    at most twice the dictionaries reach the driver. More than
    ``MOST_LANGUAGES`` languages are refused.
    """
    rows = labelled.where(F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return []
    place = F.pmod(F.xxhash64(F.lit(17), F.col(f"`{key}`")), F.lit(1 << 30))
    keep = F.lit(False)
    for name, n in counts.items():
        keep = keep | ((F.col(lang) == name) & (place < int((1 << 30) * min(1.0, sample_docs / n))))
    drawn = rows.where(keep & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), place.alias("at"), F.col(text).alias("body"))
    letters = map_texts(drawn, "body", ["lang", "at"], "letters binary", lambda: lambda texts: {"letters": [plain(t)[:dictionary_bytes] for t in texts]})
    order = Window.partitionBy("lang").orderBy("at", "letters")
    before = F.sum(F.length("letters")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    samples: dict[str, list] = {name: [] for name in counts}
    for r in letters.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < dictionary_bytes).collect():
        samples[r["lang"]].append((r["before"], r["at"], r["letters"]))
    return [(name, b"".join(bytes(x) for _, _, x in sorted(samples[name]))[:dictionary_bytes]) for name in sorted(counts, key=lambda x: (-counts[x], x))]


class CompressionClassifier:
    """Compressors of all languages; one lives in each Python worker."""

    def __init__(self, dictionaries: list[tuple[str, bytes]], level: int = 3, chunk: int = 1024, margin: float = 0.02):
        import zstandard as zstd

        self.names = [n for n, _ in dictionaries]
        self.compress = []
        for _, content in dictionaries:
            d = zstd.ZstdCompressionDict(repeated(content), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=level)
            self.compress.append(zstd.ZstdCompressor(level=level, dict_data=d, write_content_size=False).compress)
        self.step, self.margin = chunk * REPEAT, margin

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score (share by which the best is smaller than the second) and rejection."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        data = normal(text)
        parts = [data[i : i + self.step] for i in range(0, len(data), self.step)]
        sizes = [sum(len(f(p)) for p in parts) for f in self.compress]
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.names[0], 1.0, False
        second = min(s for i, s in enumerate(sizes) if i != best)
        score = 1 - sizes[best] / second
        return self.names[best], score, score < self.margin


def identify_languages(df: DataFrame, dictionaries: list[tuple[str, bytes]], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``rejected`` from the whole texts alone."""
    added = ("lang_pred", "score", "rejected")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]

    def make():
        model = CompressionClassifier(dictionaries)

        def work(texts):
            return dict(zip(added, map(list, zip(*map(model.predict, texts)))))

        return work

    return map_texts(df, text, keep, "lang_pred string, score double, rejected boolean", make)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = fit_dictionaries(docs.where(fold() != 0))
    return identify_languages(docs.select("doc_id", (fold() == 0).alias("held_out"), "text"), learned, keep=["doc_id", "held_out"])
