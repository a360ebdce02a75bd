"""The adaptive mean of a stream against that of the same traces at rest."""

import random

import pytest
from pyspark.sql import functions as F

from firnlight.operators import windows
from firnlight.streaming import adaptive

SCHEMA = "profile_id string, trace_idx int, ts timestamp, samples array<double>"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def rows_of(profile, n, start=0):
    rng = random.Random(profile)
    return [(profile, i, 1_700_000_000 + start + i, [rng.random() for _ in range(3)]) for i in range(n)]


def put(spark, folder, rows, part):
    df = spark.createDataFrame(rows, "profile_id string, trace_idx int, s long, samples array<double>")
    df.select("profile_id", "trace_idx", F.timestamp_seconds("s").alias("ts"), "samples").coalesce(1).write.mode("append").parquet(f"{folder}/{part}")


def run(spark, tmp_path):
    """Take in what is there, from where the last run stopped."""
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = adaptive.adaptive_means(stream, 6, "10 seconds", "60 seconds")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(adaptive.OUT).parquet(f"{tmp_path}/out").collect()


def test_stream_equals_the_traces_at_rest(rocks, tmp_path):
    """Traces out of order, over several files and two runs from one checkpoint; late ones are left out."""
    spark = rocks
    rng = random.Random(1)
    long, short = rows_of("a", 40), rows_of("b", 4, 5)
    rows = sorted(long + short, key=lambda r: r[2] + rng.randrange(6))
    for k in range(0, 30, 10):
        put(spark, f"{tmp_path}/in", rows[k : k + 10], f"f{k:03}")
    first = run(spark, tmp_path)
    assert 0 < len(first) < 30  # the rest waits in the state for its neighbours
    put(spark, f"{tmp_path}/in", rows[30:], "f030")
    put(spark, f"{tmp_path}/in", [("a", 2, 1_700_000_002, [9.0, 9.0, 9.0])], "f040")  # long past
    put(spark, f"{tmp_path}/in", rows_of("z", 1, 500), "f050")  # moves the watermark past the ends
    put(spark, f"{tmp_path}/in", rows_of("z", 1, 501), "f060")
    got = {(r.profile_id, r.trace_idx): r for r in run(spark, tmp_path) if r.profile_id != "z"}
    rest = spark.createDataFrame(long + short, "profile_id string, trace_idx int, s long, samples array<double>")
    want = {}
    for r in windows.adaptive_means(rest, 6).collect():
        want.setdefault((r.profile_id, r.trace_idx), {})[r.sample_idx] = r["mean"]
    assert set(got) == set(want)
    for k, r in got.items():
        assert list(r["mean"]) == pytest.approx([want[k][s] for s in range(3)], abs=1e-12)
    assert [x for x in got["a", 7].samples] == long[7][3]
