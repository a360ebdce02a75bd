"""A training corpus from raw documents, stage by stage.

Every stage reads what its predecessor kept, as Parquet, and does the whole of
its work on it: toxic documents go, one document of each group of near
duplicates stays, secrets are masked, the rest is put in the order of the
mixture of sources, and at last encoded, with a check of the way back and with
the place in the mixture (mix_part, mix_row) of each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from firnlight.llm.bpe import bpe_digests, default_vocabulary
from firnlight.llm.common import read, shared_dir, stored
from firnlight.llm.jaccard import keep_one_of_each
from firnlight.llm.mixing import mixed_order, written_order
from firnlight.llm.secrets import redact_secrets
from firnlight.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not reject."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return keep_one_of_each(docs)


#: Setting of the session with the path of a ledger of secrets that runs share; each run has its own where it is unset.
LEDGER = "spark.firnlight.secretLedger"


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked; texts that the ledger knows are not scanned again."""
    ledger = spark.conf.get(LEDGER, None) or f"{shared_dir(spark)}/secret-ledger-{uuid.uuid4().hex}"
    return redact_secrets(docs, ledger)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixture."""
    return mixed_order(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text, and its place in the mixture."""
    placed = written_order(docs.select("doc_id", "text"))
    return bpe_digests(placed, default_vocabulary(), with_ids=True, keep=("mix_part", "mix_row"))


STAGES = [
    ("toxicity", toxicity),
    ("ngram_jaccard", ngram_jaccard),
    ("secret_scans", secret_scans),
    ("source_mixing", source_mixing),
    ("bpe", bpe),
]

#: SQL can express neither the classifier chain nor the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
