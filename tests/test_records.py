"""Files of fixed-length records, by ranges: readers, broken files, writers."""

import os
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan
from pyspark.sql.types import StructType

from firnlight.sources import binary, records


def dzt(traces: int, snum: int = 8) -> bytes:
    head = bytearray(65536)
    struct.pack_into("<HHh", head, 4, snum, 16, 3)
    struct.pack_into("<f", head, 26, 80.0)
    return bytes(head) + np.arange(traces * snum, dtype="<u2").tobytes()


def burst(chirps: int, first: int = 0) -> bytes:
    return f"N_ADC_SAMPLES=4\r\nNSubBursts={chirps}\r\n*** End Header ***\r\n".encode() + (np.arange(first, first + 4 * chirps)).astype("<u2").tobytes()


def pulse(traces: int) -> bytes:
    return b"".join(struct.pack("<25f28x", k + 1, 2 * k, *[0.5] * 21, 7.0 + k, 0) + np.full(4, k, "<i2").tobytes() for k in range(traces))


def wheel(n: int) -> bytes:
    return b"".join(struct.pack("<fHhffHH", k, k, 1, 0.1, 1e-9, 1, 4) + np.full(4, 600, "<u2").tobytes() for k in range(n))


PE = {"NUMBER OF PTS/TRC": "4", "TOTAL TIME WINDOW": "40", "VERSION": "1.0"}
BROKEN = [
    ("gssi", {}, dzt(10), 2), ("pe", records.pe_options(PE), pulse(10), 5), ("ramac", {"samples": 4, "window_ns": 40}, np.arange(40, dtype="<i2").tobytes(), 3),
    ("segy", {}, binary.write_segy(np.ones((4, 10)), 10), 1), ("apres", {}, burst(4) + burst(6), 9),
]


@pytest.mark.parametrize("kind, options, raw, cut", BROKEN, ids=[b[0] for b in BROKEN])
def test_files_that_break_off_raise(spark, tmp_path, kind, options, raw, cut):
    """Whole in memory and by ranges; on request the whole traces are given."""
    assert len(binary.fixed(kind, options)("dir/x.bin", raw)) == 10
    with pytest.raises(ValueError, match="breaks off"):
        binary.fixed(kind, options)("dir/x.bin", raw[:-cut])
    left = len(binary.fixed(kind, options, strict=False)("dir/x.bin", raw[:-cut]))
    assert 8 <= left <= 9
    (tmp_path / "x.bin").write_bytes(raw[:-cut])
    with pytest.raises(Exception, match="breaks off"):
        records.read_ranges(spark, kind, str(tmp_path), **options).count()
    assert records.read_ranges(spark, kind, str(tmp_path), strict=False, **options).count() == left


def test_streams_that_break_off_raise():
    assert len(binary.parse_wheel()("x", wheel(10))) == 10
    for cut in (1, 9, 20):
        with pytest.raises(ValueError, match="breaks off"):
            binary.parse_wheel()("x", wheel(10)[:-cut])
        assert len(binary.parse_wheel(strict=False)("x", wheel(10)[:-cut])) == 9


@pytest.mark.parametrize("kind, options, raw, _", BROKEN, ids=[b[0] for b in BROKEN])
def test_ranges_equal_the_whole_file(spark, tmp_path, kind, options, raw, _):
    (tmp_path / "line.bin").write_bytes(raw)
    got = records.read_ranges(spark, kind, f"file://{tmp_path}/line.bin", rangeBytes=60, **options)
    assert got.rdd.getNumPartitions() > 1
    want = binary.fixed(kind, options)("line.bin", raw)
    rows = got.orderBy("trace_idx").collect()
    assert [list(r["samples"]) for r in rows] == [x.tolist() for x in want["samples"]]
    assert [r["trace_num"] for r in rows] == want["trace_num"].tolist() and {r["profile_id"] for r in rows} == {"line"}
    assert rows[0]["dt"] == want["dt"][0] and rows[0]["snum"] == want["snum"][0]


def test_filters_leave_out_ranges_and_files(spark, tmp_path):
    """Bytes of the ranges that a filter leaves: a reader opens no others."""
    for name in "ab":
        (tmp_path / f"{name}.bin").write_bytes(dzt(1000))

    def ranges(*filters):
        reader = records.RadarReader(None, {"kind": "gssi", "path": str(tmp_path), "rangeBytes": "160"})
        assert list(reader.pushFilters(list(filters))) == list(filters)  # Spark applies them as well
        return [(p.path[-5:], p.first, p.count) for p in reader.partitions()]

    assert len(ranges()) == 200
    assert sum(n for *_, n in ranges(GreaterThan(("trace_idx",), 20), LessThan(("trace_idx",), 45))) == 48
    assert ranges(EqualTo(("trace_idx",), 7), EqualTo(("fn",), f"{tmp_path}/b.bin")) == [("b.bin", 7, 1)]
    assert [x[1:] for x in ranges(In(("trace_idx",), (7, 9)), In(("fn",), (f"{tmp_path}/a.bin",)))] == [(7, 3)]
    assert ranges(GreaterThan(("trace_idx",), 5000)) == []
    some = records.read_ranges(spark, "gssi", str(tmp_path), rangeBytes=160).where("trace_idx >= 30 and trace_idx < 50")
    assert some.count() == 40 and some.rdd.getNumPartitions() <= 4


def test_ranges_of_few_records_grow_with_the_files(tmp_path):
    """200,000 traces of 16 bytes in ranges of 160 would be 20,000 tasks; a filter's few traces still have ranges of their own."""
    for name in "ab":
        (tmp_path / f"{name}.bin").write_bytes(dzt(100_000))

    def ranges(*filters):
        reader = records.RadarReader(None, {"kind": "gssi", "path": str(tmp_path), "rangeBytes": "160"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return sorted((p.path[-5:], p.first, p.count) for p in reader.partitions())

    got = ranges()
    assert 100 < len(got) < 300 and sum(n for *_, n in got) == 200_000
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(got, got[1:]))
    assert ranges(GreaterThan(("trace_idx",), 20), LessThan(("trace_idx",), 41), EqualTo(("fn",), f"{tmp_path}/b.bin")) == [("b.bin", 21, 10), ("b.bin", 31, 10)]


def test_ranges_of_pulse_radar_grow_and_keep_every_trace(spark, tmp_path):
    """20,000 traces of 136 bytes in ranges of 272 would be 10,000 tasks; heads and samples of all are read once."""
    (tmp_path / "line.bin").write_bytes(pulse(20_000))
    options = {"kind": "pe", "path": str(tmp_path), "rangeBytes": "272", **{k: str(v) for k, v in records.pe_options(PE).items()}}
    reader = records.RadarReader(StructType.fromDDL(records.TRACES), options)
    parts = reader.partitions()
    assert 100 < len(parts) < 300
    got = pa.Table.from_batches([batch for part in parts for batch in reader.read(part)])
    _, want = records.whole_file("pe", str(tmp_path / "line.bin"), pulse(20_000), records.pe_options(PE))
    for name in ("trace_idx", "trace_num", "dist"):
        assert np.array_equal(got[name].to_numpy(), want[name])
    assert np.array_equal(got["samples"].combine_chunks().flatten().to_numpy(), want["samples"].ravel())


@pytest.mark.parametrize("name", ["read_dt1", "read_dzt", "read_rd3", "read_bursts"])
def test_a_label_is_written_by_many_tasks(spark, tmp_path, monkeypatch, name):
    """All traces have one label, two numbers meet: no Python group or window holds the label, and its file equals that of one matrix."""
    from firnlight import catalog
    from firnlight.sources import queries_sources as q

    n, step, merge = 600, 100, "spark.sql.adaptive.coalescePartitions.enabled"
    rows = spark.range(n).selectExpr("if(id = 9, 8, id) as id").selectExpr(f"id * {step} as vec_id", "transform(sequence(0, 63), k -> float((id * 37 + k * 11) % 101 / 50 - 1)) as embedding", "7 as label")
    rows.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    written, held, kept = [], [], q.kept_records
    monkeypatch.setattr(q, "files_of", lambda *a, **b: pytest.fail("a label in one group"))

    def spy(rows, folder, head, encode):
        out = kept(rows, folder, head, encode).cache()
        written.append(out.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("n").alias("n")).collect())
        held.append((folder, head, encode, rows.collect()))
        return out

    monkeypatch.setattr(q, "kept_records", spy)
    spark.conf.set(merge, "false")
    try:
        got = catalog.queries()[name](spark, str(tmp_path)).groupBy("profile_id", "trace_idx").count().collect()
    finally:
        spark.conf.unset(merge)
    assert sorted(tuple(r) for r in got) == [("7", k, 64) for k in range(n)]
    (tasks,), ((folder, head, encode, rows),) = written, held
    assert sum(r["n"] for r in tasks) == n and max(r["n"] for r in tasks) < n / 2
    rows = sorted(rows, key=lambda r: r["trace_idx"])
    assert {(r["profile_id"], r["tnum"]) for r in rows} == {("7", n)} and [r["trace_idx"] for r in rows] == list(range(n))
    whole = head(n) + encode(np.array([r["samples"] for r in rows]), np.arange(n)).tobytes()
    assert open(f"{records.store(folder)[1]}/7.bin", "rb").read() == whole


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """No value grows with the file: its size is a hole's, and a filter reads five traces of it."""
    with open(tmp_path / "long.rd3", "wb") as f:
        f.truncate(3 << 30)
        f.seek(2_000_000_000)
        f.write(np.arange(512, dtype="<i2").tobytes())
    got = records.read_ranges(spark, "ramac", str(tmp_path), samples=512, window_ns=512.0).where("trace_idx between 1953123 and 1953127")
    rows = got.orderBy("trace_idx").collect()
    assert len(rows) == 5 and sum(sum(r["samples"]) for r in rows) == 511 * 256
    assert records.read_ranges(spark, "ramac", str(tmp_path), samples=512, window_ns=512.0).select("trace_idx").rdd.getNumPartitions() == 48


def test_heads_without_samples(spark, tmp_path):
    (tmp_path / "x.dt1").write_bytes(pulse(6))
    heads = records.read_ranges(spark, "pe", str(tmp_path), **records.pe_options(PE)).orderBy("trace_idx").collect()
    assert heads[3]["header"]["position"] == 6.0 and heads[3]["header"]["seconds_of_day"] == 10.0 and heads[3]["header"]["receiver_x"] == 0.5
    records.register(spark)
    reader = spark.read.format("radar").options(kind="pe", points="4", window_ns="40", version="1.0")
    few = reader.schema("trace_num int, dist double").load(str(tmp_path)).orderBy("trace_num").collect()
    assert [tuple(r) for r in few] == [(k + 1, 2 * k / 1000) for k in range(6)]


def test_unknown_kinds_missing_folders_and_strangers(spark, tmp_path):
    with pytest.raises(Exception, match="option kind"):
        records.read_ranges(spark, "nonsense", str(tmp_path)).count()
    with pytest.raises(Exception, match="nowhere"):
        records.read_ranges(spark, "gssi", f"{tmp_path}/nowhere").count()
    (tmp_path / "bad.DZT").write_bytes(b"x")
    (tmp_path / "good.DZT").write_bytes(dzt(3))
    with pytest.raises(Exception, match="unpack_from"):
        records.read_ranges(spark, "gssi", str(tmp_path)).count()
    assert records.read_ranges(spark, "gssi", str(tmp_path), strict=False).count() == 3


def test_positions_of_a_table_on_load(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/line1.rd3").write_bytes(np.arange(20, dtype="<i2").tobytes())
    (tmp_path / "line1.cor").write_text("1\t2020-01-01\t10:00:00\t10.0\tS\t20.0\tW\t100.0\tM\t1\n3\t2020-01-01\t10:00:02\t12.0\tS\t22.0\tW\t104.0\tM\t1\n")
    got = binary.load(spark, "ramac", f"{tmp_path}/in", samples=4, window_ns=40, positions=f"file://{tmp_path}/line1.cor").orderBy("trace_idx").collect()
    assert [(r["lat"], r["long"], r["elev"]) for r in got] == [(-10.0, -20.0, 100.0), (-11.0, -21.0, 102.0), (-12.0, -22.0, 104.0), (-13.0, -23.0, 106.0), (-14.0, -24.0, 108.0)]


# Writing


def profiles(spark, lengths):
    rows = [(p, i, 0.25 * i, 1 - 1.5 * i, [float(i), i + 0.5, None if i == 1 else -1.0]) for p, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "profile_id string, trace_idx int, x_coord double, y_coord double, samples array<double>").repartition(5)


def test_segy_files_of_many_tasks(spark, tmp_path):
    out = str(tmp_path / "out")
    traces = profiles(spark, {"a": 700, "b": 1})
    records.write_segy_files(traces, out, 10)
    assert sorted(os.listdir(out)) == ["a.sgy", "b.sgy"]
    assert os.path.getsize(f"{out}/a.sgy") == 3600 + 700 * (240 + 12)
    back = records.read_ranges(spark, "segy", out, rangeBytes=5000).select("profile_id", "trace_idx", "x_coord", "y_coord", "samples")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, traces.collect()))
    whole = binary.parse_segy("a.sgy", open(f"{out}/a.sgy", "rb").read())
    assert len(whole) == 700 and whole.dt[0] == pytest.approx(1e-8)
    with pytest.raises(Exception, match="there already"):
        records.write_segy_files(profiles(spark, {"a": 3}), out, 10)
    assert os.path.getsize(f"{out}/a.sgy") == 3600 + 700 * 252 and len(os.listdir(out)) == 2
    records.write_segy_files(profiles(spark, {"a": 3}), out, 10, mode="overwrite")
    assert os.path.getsize(f"{out}/a.sgy") == 3600 + 3 * 252


@pytest.mark.parametrize("bad, words", [
    (lambda t: t.where("trace_idx != 5"), "one after the other"), (lambda t: t.unionByName(t.where("trace_idx = 5")), "one after the other"),
    (lambda t: t.withColumn("samples", F.when(F.col("trace_idx") == 9, F.array(F.lit(1.0))).otherwise(F.col("samples"))), "different lengths|has 3 samples"),
    (lambda t: t.withColumn("samples", F.when(F.col("trace_idx") < 9, F.col("samples"))), "needs samples"), (lambda t: t.withColumn("profile_id", F.lit("a/b")), "name of a file"),
    (lambda t: t.withColumn("profile_id", F.raise_error(F.lit("a task fails")).cast("string")), "a task fails")])
def test_a_failed_job_leaves_nothing(spark, tmp_path, bad, words):
    out = tmp_path / "out"
    with pytest.raises(Exception, match=words):
        records.write_segy_files(bad(profiles(spark, {"a": 20})), str(out), 10)
    assert not out.exists() or os.listdir(out) == []


def test_a_long_file_of_unlike_records_is_given_in_parts(spark):
    """40,000 records: the wheel's 16-bit count turns over, and rows are made some at a time."""
    n = 40_000
    raw = b"".join(struct.pack("<fHhffHH", k, 2 * k % 65536, k % 5 + 3, 0.1, 2e-9, 1, 32) + np.full(32, 512 + k % 7, "<u2").tobytes() for k in range(n))
    parse = binary.parse_wheel()
    parts = list(binary.pieces(parse, "x.DAT", raw))
    assert len(parts) > 2 and max(map(len, parts)) <= (4 << 20) // (8 * 32)
    whole = parse("x.DAT", raw)
    assert [c.tolist() for c in pd.concat(parts)["samples"]] == [c.tolist() for c in whole["samples"]] and whole["data_dtype"][0] == "float64"
    for c in ("trace_idx", "trace_num", "dist", "pressure", "decday", "trace_int", "snum", "dt", "profile_id"):
        assert pd.concat(parts)[c].tolist() == whole[c].tolist()
    assert whole["dist"].to_numpy() == pytest.approx(np.pi * np.arange(n)) and whole["pressure"].tolist() == [k % 5 for k in range(n)]
    got = binary.parsed(spark.createDataFrame([("x.DAT", bytearray(raw))], "path string, content binary"), parse)
    assert got.selectExpr("count(*)", "sum(trace_idx)", "sum(samples[3])").first()[:] == (n, n * (n - 1) // 2, sum(k % 7 for k in range(n)))
