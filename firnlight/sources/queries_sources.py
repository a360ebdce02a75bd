"""Queries of the file readers: files are made from a table by formula, in the executors, and read by the same parsers.

Every label of the table is one file; a sample is read back if DuckDB finds it by
the formula.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables
from ..operators.along import SEGMENT, inside
from ..plans.registry import query
from ..plans.tables import SNUM, TR, r6, samples, traces
from . import binary, matlab, records, sinks, text
from .shared import shared_dir

#: The traces of each label, numbered from 0, and their samples.
X = TR + """, t AS (SELECT p, (row_number() OVER (PARTITION BY p ORDER BY i) - 1)::INT AS i, a FROM tr),
x AS (SELECT p, i, unnest(range(64))::INT AS k, unnest(a) AS v FROM t)"""


def labelled(spark, d) -> DataFrame:
    number = F.row_number().over(Window.partitionBy("profile_id").orderBy("trace_idx")) - 1
    return traces(spark, d, by_label=True).select("profile_id", number.cast("int").alias("trace_idx"), "samples")


def files_of(spark, d, encode: Callable[..., bytes], by_name: bool = False) -> DataFrame:
    """(path, content): one file a label, from its (samples x traces) matrix and on request the label."""
    def run(table: pa.Table) -> pa.Table:
        name, order = table.column("profile_id")[0].as_py(), np.argsort(table.column("trace_idx").to_numpy())
        flat = table.column("samples").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        data = flat.reshape(len(order), -1)[order].T
        return pa.table({"path": [f"dir/{name}.bin"], "content": pa.array([encode(data, *[name] * by_name)], pa.binary())})

    return labelled(spark, d).groupBy("profile_id").applyInArrow(run, "path string, content binary")


def read_back(spark, d, encode, parse, *more: str) -> DataFrame:
    out = binary.parsed(files_of(spark, d, encode), parse)
    return samples(out, "profile_id", "trace_idx", *more).withColumn("v", r6("v")).withColumns({c: r6(c) for c in more})


def select(value: str, more: str = "", x: str = "x") -> str:
    return f"WITH {X} SELECT p AS profile_id, i AS trace_idx, k AS sample_idx, round({value}, 6) + 0.0 AS v{more} FROM {x}"


def kept_files(files: DataFrame, ending: str) -> str:
    """A new folder of the shared one with these files (path, content), written by the executors."""
    folder = f"{shared_dir(files.sparkSession)}/files-{uuid.uuid4().hex}"

    def run(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                system, at = records.store(folder)
                system.create_dir(at)
                with system.open_output_stream(f"{at}/{path.rsplit('/', 1)[-1].rsplit('.', 1)[0]}.{ending}") as out:
                    out.write(content)
            yield frame[["path"]]

    files.mapInPandas(run, "path string").count()
    return folder


def numbered(spark, d) -> DataFrame:
    """The labels' traces numbered from 0 by segments, so that no task sees a whole label; ``tnum`` is the traces of the label."""
    base = traces(spark, d, by_label=True).select("profile_id", "trace_idx", "samples").na.fill({"profile_id": "", "trace_idx": 2**31 - 1})
    base = base.withColumn("segment__", F.floor(F.col("trace_idx") / SEGMENT))
    label = Window.partitionBy("profile_id")
    before = F.sum("n").over(label.orderBy("segment__").rowsBetween(Window.unboundedPreceding, -1))
    counts = base.groupBy("profile_id", "segment__").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("profile_id", "segment__", F.coalesce(before, F.lit(0)).alias("start"), F.sum("n").over(label).alias("tnum"))
    number = F.col("start") + F.row_number().over(inside()) - 1
    # A left join: Spark may broadcast the starts, never the samples, whose tasks would then be the labels.
    return base.join(starts, ["profile_id", "segment__"], "left").select("profile_id", number.cast("int").alias("trace_idx"), "samples", "tnum")


def kept_records(rows: DataFrame, folder: str, head: Callable[[int], bytes], encode: Callable[..., np.ndarray]) -> DataFrame:
    """Write one file a label, its records by all tasks at their places; a row for each run that was written.

    ``rows`` are those of ``numbered``. Tasks write into one file, which needs a shared POSIX folder.
    """
    at = records.store(folder)[1]

    def run(batches):
        os.makedirs(at, exist_ok=True)
        for batch in (x for x in batches if x.num_rows):
            names, numbers, tnum = np.asarray(batch.column("profile_id").to_pylist(), object), batch.column("trace_idx").to_numpy(), batch.column("tnum").to_numpy()
            data = batch.column("samples").flatten().to_numpy(zero_copy_only=False).reshape(len(numbers), -1)
            cuts = [0, *(1 + np.flatnonzero((names[1:] != names[:-1]) | (np.diff(numbers) != 1))), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if not names[a]:
                    raise ValueError("a trace without a label has no file")
                begin, content = head(int(tnum[a])), encode(data[a:b], numbers[a:b])
                with os.fdopen(os.open(f"{at}/{names[a]}.bin", os.O_WRONLY | os.O_CREAT, 0o644), "wb") as file:
                    if numbers[a] == 0:
                        file.write(begin)
                    file.seek(len(begin) + int(numbers[a]) * content.itemsize * content.shape[1])
                    file.write(content.tobytes())
            yield pa.record_batch({"profile_id": [names[a] for a in cuts[:-1]], "n": np.diff(cuts)}, schema=pa.schema({"profile_id": pa.string(), "n": pa.int64()}))

    return rows.mapInArrow(run, "profile_id string, n long")


def by_ranges(spark, d, encode: Callable[..., np.ndarray], kind: str, *more: str, head: Callable[[int], bytes] = lambda n: b"", **options) -> DataFrame:
    """Files made by formula, kept, and read by ranges of some traces.

    ``encode`` makes records of (traces x samples) and the traces' numbers, ``head`` what goes before them from the
    number of traces. In a store where nothing can be written at a place a file is one task's.
    """
    folder = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    if type(records.store(folder)[0]).__name__ == "LocalFileSystem":
        kept_records(numbered(spark, d), folder, head, encode).count()
    else:
        folder = kept_files(files_of(spark, d, lambda x: head(x.shape[1]) + encode(x.T, np.arange(x.shape[1])).tobytes()), "bin")
    out = records.read_ranges(spark, kind, folder, rangeBytes=2000, **options)
    return samples(out, "profile_id", "trace_idx", *more).withColumn("v", r6("v")).withColumns({c: r6(c) for c in more})


def segy_folder(spark, d) -> str:
    """The labels' traces as SEG-Y files, a file a label, each written by several tasks."""
    folder = f"{shared_dir(spark)}/segy-{uuid.uuid4().hex}"
    rows = traces(spark, d, by_label=True)
    number = F.row_number().over(Window.partitionBy("profile_id").orderBy("trace_idx")) - 1
    sinks.write_segy_files(rows.select("profile_id", number.cast("int").alias("trace_idx"), "x_coord", "y_coord", "samples"), folder, 10)
    return folder


@query("read_segy", select("v::FLOAT::DOUBLE"))
def read_segy(spark, d):
    return samples(records.read_ranges(spark, "segy", segy_folder(spark, d), rangeBytes=2000), "profile_id", "trace_idx").withColumn("v", r6("v"))


@query("read_segy_range", f"""WITH {TR}, t AS (SELECT *, (row_number() OVER (PARTITION BY p ORDER BY i) - 1)::INT AS n FROM tr)
SELECT p AS profile_id, n AS trace_idx, n + 1 AS trace_num, x AS x_coord, y AS y_coord FROM t WHERE n BETWEEN 3 AND 11""")
def read_segy_range(spark, d):
    """Positions of some traces of every file: of their ranges only the heads are read."""
    records.register(spark)
    heads = spark.read.format("radar").schema("profile_id string, trace_idx int, trace_num int, x_coord double, y_coord double").options(kind="segy", rangeBytes=2000)
    return heads.load(segy_folder(spark, d)).where("trace_idx >= 3 and trace_idx < 12")


def dzt_head(n: int) -> bytes:
    head = bytearray(65536)
    struct.pack_into("<HHh", head, 4, SNUM, 16, 3)
    struct.pack_into("<f", head, 26, 64.0)
    return bytes(head)


@query("read_dzt", f"WITH {X} SELECT p AS profile_id, i AS trace_idx, k AS sample_idx, floor(a[greatest(k, 2) + 1] * 100) + 30000 AS v, 3.0::DOUBLE AS trig FROM t, (SELECT unnest(range(64))::INT AS k)")
def read_dzt(spark, d):
    return by_ranges(spark, d, lambda x, _: (np.floor(x * 100) + 30000).astype("<u2"), "gssi", "trig", head=dzt_head)


def dt1(x: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    heads = np.zeros((len(x), 32), "<f4")
    heads[:, 0], heads[:, 1] = numbers + 1, 0.5 * numbers
    return np.hstack([heads.view(np.uint8), np.floor(x * 100).astype("<i2").view(np.uint8)])


@query("read_dt1", f"WITH {X}, q AS (SELECT *, floor(v * 100) AS q FROM x) SELECT p AS profile_id, i AS trace_idx, k AS sample_idx, round(q - avg(q) OVER (PARTITION BY p, i), 6) + 0.0 AS v, round(i * 0.5 / 1000, 6) + 0.0 AS dist FROM q")
def read_dt1(spark, d):
    return by_ranges(spark, d, dt1, "pe", "dist", points=SNUM, window_ns=640, version="1.0")


@query("read_rd3", select("floor(v * 100)", ", 36.0::DOUBLE AS trig"))
def read_rd3(spark, d):
    return by_ranges(spark, d, lambda x, _: np.floor(x * 100).astype("<i2"), "ramac", "trig", samples=SNUM, window_ns=640.0)


def wheel(x: np.ndarray) -> bytes:
    return b"".join(struct.pack("<fHhffHH", k, 2 * k % 65536, k % 5 + 3, 0.1, 2e-9, 1, SNUM) + (np.floor(c * 50) + 1512).astype("<u2").tobytes() for k, c in enumerate(x.T))


@query("read_wheel", select("floor(v * 50) + 1000", ", round(2 * i * pi() * 0.5, 6) + 0.0 AS dist, (i % 5)::DOUBLE AS pressure, i::DOUBLE AS decday"))
def read_wheel(spark, d):
    return read_back(spark, d, wheel, binary.parse_wheel(), "dist", "pressure", "decday")


def bursts_head(n: int) -> bytes:
    return f"N_ADC_SAMPLES={SNUM}\r\nNSubBursts={n}\r\nAverage=0\r\n*** End Header ***\r\n".encode()


@query("read_bursts", select("(floor(v * 1000) + 32768) * 2.5 / 65536"))
def read_bursts(spark, d):
    return by_ranges(spark, d, lambda x, _: (np.floor(x * 1000) + 32768).astype("<u2"), "apres", head=bursts_head)


@query("read_native", select("v", ", round(-80 + i * 0.001::DOUBLE, 6) + 0.0 AS lat"))
def read_native(spark, d):
    return read_back(spark, d, lambda x: matlab.write_mat({"data": x, "dt": 1e-8, "lat": -80 + 0.001 * np.arange(x.shape[1])}, packed=True), matlab.parse_native, "lat")


@query("read_sounder", select("10 * log10(exp(v))", ", round(i / 86400.0::DOUBLE + 719529, 6) + 0.0 AS decday"))
def read_sounder(spark, d):
    def encode(x: np.ndarray) -> bytes:
        n = np.arange(x.shape[1])
        return matlab.write_mat({"Data": np.exp(x), "Latitude": -80 + 0.001 * n, "Longitude": 0.002 * n, "GPS_time": 1.0 * n, "Time": 1e-8 * np.arange(SNUM)})

    return read_back(spark, d, encode, matlab.parse_sounder, "decday")


@query("read_simulation", select("round(v, 4)", "", "(SELECT p, i, (k - s)::INT AS k, v FROM x JOIN (SELECT p, min(k) AS s FROM (SELECT p, k, avg(abs(round(v, 4))) AS m, max(avg(abs(round(v, 4)))) OVER (PARTITION BY p) AS h FROM x GROUP BY p, k) WHERE m > 0.95 * h GROUP BY p) USING (p) WHERE k >= s)"))
def read_simulation(spark, d):
    def encode(x: np.ndarray) -> bytes:
        return "\n".join(" ".join(f"{v:.4f}" for v in row) for row in x.T).encode()

    return read_back(spark, d, encode, binary.parse_simulation(1e-8, 0.95))


def gecko(x: np.ndarray, label: str) -> bytes:
    """A recording of version 3.8 with one channel, a marker after each trace and times by the label."""
    head = bytearray(101)
    struct.pack_into("<H", head, 0, 380)
    struct.pack_into("<B", head, 76, 1)
    struct.pack_into("<HHH", head, 82, 100, 4, SNUM - 4)
    out = [bytes(head), struct.pack("<BHBB", 1, 500, 0, 0)]
    for k, column in enumerate(x.T):
        place = struct.pack("<idfHddff", k, int(label) + 0.001 * k, 1.0, 50, -80.0, 0.002 * k, 3.5, 0.1)
        out += [b"\0\0", place, np.floor(column * 100).astype("<i2").tobytes(), b"\1\0", place, bytes(38)]
    return b"".join(out)


@query("read_gecko", f"""WITH {X}, o AS (SELECT p, coalesce(sum(count(*)) OVER (ORDER BY p::INT ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM t GROUP BY p)
SELECT 'gecko' AS profile_id, (i + o)::INT AS trace_idx, k AS sample_idx, floor(v * 100) + 0.0 AS v, 4.0::DOUBLE AS trig, round(719529 + p::INT + 0.001::DOUBLE * i, 6) + 0.0 AS decday, round(0.002::DOUBLE * i, 6) + 0.0 AS long
FROM x JOIN o USING (p)""")
def read_gecko(spark, d):
    out = binary.in_one_profile(binary.parsed(files_of(spark, d, gecko, by_name=True), binary.parse_gecko()), "gecko")
    return samples(out, "profile_id", "trace_idx", "trig", "decday", "long").withColumns({c: r6(c) for c in ("v", "decday", "long")})


FIXES = f"WITH {X} SELECT p AS fn, i::DOUBLE AS trace_num, round(-(79 + (i % 60 + 0.5::DOUBLE) / 60), 8) + 0.0 AS lat, round(170 + (i % 60 + 0.25::DOUBLE) / 60, 8) + 0.0 AS long, i + 0.5::DOUBLE AS altitude FROM t"

for _name, _mark, _kind in (("read_dzg", "$GSSIS,%d,1.5", text.DZG), ("read_pulse_gps", "Trace #%d at position 2.5", text.PULSE)):

    @query(_name, FIXES)
    def read_fixes(spark, d, mark=_mark, kind=_kind):
        i = F.col("trace_idx")
        minutes = F.lpad((i % 60).cast("string"), 2, "0")
        line = F.concat(F.format_string(mark, i), F.lit("\r\n$GPGGA,120000,79"), minutes, F.lit(".5,S,170"), minutes, F.lit(".25,E,1,08,0.9,"), i.cast("string"), F.lit(".5,M,-5.5,M,,*47"))
        lines = labelled(spark, d).groupBy(F.col("profile_id").alias("fn")).agg(F.array_sort(F.collect_list(F.struct("trace_idx", line.alias("line")))).alias("rows"))
        fixes = text.fixes_of(lines.select("fn", F.array_join("rows.line", "\r\n").alias("value")), *kind)
        return fixes.select("fn", "trace_num", *[(F.round(c, 8) + F.lit(0.0)).alias(c) for c in ("lat", "long")], "altitude")


@query("sql_project_files", f"""WITH {X}, f AS (SELECT p, i, unnest(['hd', 'dt1']) AS e FROM t WHERE i % 3 < 2)
SELECT p AS profile_id, 'line' || i || '.' || e AS name, CASE e WHEN 'hd' THEN length('N=' || i) ELSE i % 9 + 1 END AS n_bytes FROM f""")
def sql_project_files(spark, d):
    """Project blobs made by formula, a blob a label, and taken apart in SQL."""
    tables.register(spark)
    i = F.col("trace_idx").cast("string")
    part = F.concat(F.lit("line"), i, F.lit(".hdN="), i, F.lit("line"), i, F.lit(".dt1"), F.repeat(F.lit("z"), F.col("trace_idx") % 9 + 1))
    blobs = labelled(spark, d).where("trace_idx % 3 < 2").groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("trace_idx", part.alias("part"))))["part"], "").alias("text"))
    return spark.sql("SELECT b.profile_id, f.name, octet_length(f.content) AS n_bytes FROM {blobs} b, LATERAL project_files(cast(concat('head', b.text) AS binary)) f", blobs=blobs)
