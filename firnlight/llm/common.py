"""Small helpers that the operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Characters of text that a Python worker handles at a time; bounds its memory.
CHUNK_CHARS = 1_000_000

#: The words of a text are its maximal runs of other characters than these.
WORD = "[^\x20\x09-\x0d]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see (``spark.checkpoint.dir``).

    Only where the session names none and all of it runs in one process, as in
    tests, a temporary one is set; on a cluster it must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='firnlight-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage so that a lost executor costs only the reading of files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def splittable_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join on ``key`` whose hot keys adaptive execution can split.

    Where one side comes from an aggregation by the key, Spark would join in the
    aggregation's own partitions, and such a join is never split. A second key,
    a hash of the first, makes both sides shuffle for the join itself.
    """
    (k,) = fresh(left, "join_hash__")
    both = [df.withColumn(k, F.xxhash64(F.col(f"`{key}`"))) for df in (left, right)]
    return both[0].join(both[1], [key, k], how).drop(k)


def pieces(batch: pa.RecordBatch, column: int, limit: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``limit`` bytes, a row at least."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, keep: list[str], schema: str,
              make: Callable[[], Callable[[list], dict]], limit: int = CHUNK_CHARS) -> DataFrame:
    """Add columns computed from whole texts, row by row, in Arrow batches.

    ``make`` runs once in a worker and returns a function from a list of texts
    (None for null) to a dict of column values; ``schema`` is the DDL of those
    columns. Columns in ``keep`` are passed through. Nothing is shuffled.
    """
    picked = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("text__"))
    added = StructType.fromDDL(schema)
    out = StructType([*picked.schema.fields[:-1], *added.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        names = [f.name for f in added.fields]
        work = make()
        k = len(keep)
        for batch in batches:
            for part in pieces(batch, k, limit):
                got = work(part.column(k).to_pylist())
                new = [pa.array(got[n], arrow.field(k + i).type) for i, n in enumerate(names)]
                yield pa.RecordBatch.from_arrays([*[part.column(i).cast(arrow.field(i).type) for i in range(k)], *new], schema=arrow)

    return picked.mapInArrow(run, out)
