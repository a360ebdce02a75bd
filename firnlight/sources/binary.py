"""Readers of vendor files: whole files as bytes, parsed where they are read.

Every reader goes through Spark's ``binaryFile`` source, so paths are what Spark
can open, one file is one row, and files are parsed in parallel. A reader returns
one row per trace; what belongs to the file as a whole is repeated on its traces.
A file that cannot be parsed raises; only on request (``strict=False``) are such
files passed over.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import common_start
from .records import BATCH_BYTES, LAYOUTS, NAMES, TRACES, pe_options, read_ranges, segy_head, segy_records, whole_file

def traces_of(path: str, data: np.ndarray, dt: float, first: int = 0, last: int | None = None, **columns) -> pd.DataFrame:
    """Rows of a (samples x traces) matrix, or of its traces from ``first`` to before ``last``; missing columns are null."""
    snum, tnum = data.shape
    some = slice(first, tnum if last is None else min(last, tnum))
    number = np.arange(tnum, dtype="int32")[some]
    name = path.rsplit("/", 1)[-1]
    out = pd.DataFrame({"trace_idx": number})
    base = {"profile_id": name.rsplit(".", 1)[0], "fn": path, "trace_num": np.arange(1, tnum + 1), "snum": snum, "dt": dt,
            "data_dtype": str(data.dtype), "samples": list(data[:, some].T.astype(float))}
    for c in NAMES:
        if c != "trace_idx":
            value = (base | columns).get(c)
            if c != "samples" and isinstance(value, (np.ndarray, list)):
                value = value[some]
            out[c] = value if value is not None else None
    return out[NAMES]


def by_matrix(read: Callable[[str, bytes], tuple[np.ndarray, float, dict]]) -> Callable[[str, bytes], pd.DataFrame]:
    """A parser from a function that gives a file's (samples x traces) matrix, step and columns.

    The matrix keeps the file's kind of numbers; ``parsed`` makes rows of some traces at a time from it.
    """
    def parse(path: str, raw: bytes) -> pd.DataFrame:
        data, dt, columns = read(path, raw)
        return traces_of(path, data, dt, **columns)

    parse.read = read
    return parse


def pieces(parse: Callable[[str, bytes], pd.DataFrame], path: str, raw: bytes) -> Iterator[pd.DataFrame]:
    """A file's rows, where the parser can in frames of about ``BATCH_BYTES`` of samples."""
    if not hasattr(parse, "read"):
        yield parse(path, raw)
        return
    data, dt, columns = parse.read(path, raw)
    step = max(1, BATCH_BYTES // (8 * max(1, len(data))))
    for first in range(0, data.shape[1], step):
        yield traces_of(path, data, dt, first, first + step, **columns)


def read_files(spark: SparkSession, path: str, parse: Callable[[str, bytes], pd.DataFrame], strict: bool = True) -> DataFrame:
    """One row per trace of the files at ``path``; without ``strict`` files that do not parse are passed over."""
    return parsed(spark.read.format("binaryFile").load(path), parse, strict)


def parsed(files: DataFrame, parse: Callable[[str, bytes], pd.DataFrame], strict: bool = True) -> DataFrame:
    """One row per trace of files given as rows of path and content."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                try:
                    yield from pieces(parse, name, content if isinstance(content, bytes) else bytes(content))
                except (ValueError, IndexError, struct.error):
                    if strict:
                        raise

    return files.select("path", "content").mapInPandas(run, TRACES)


def fixed(kind: str, options: dict | None = None, strict: bool = True) -> Callable[[str, bytes], pd.DataFrame]:
    """The parser of files of fixed-length records of a kind, whole in memory; see :mod:`.records`.

    A file that ends within a record raises, or gives its whole records.
    """
    def parse(path: str, raw: bytes) -> pd.DataFrame:
        layout, columns = whole_file(kind, path, raw, options, strict)
        return traces_of(path, columns["samples"].T, columns["dt"], **{k: v for k, v in columns.items() if k in NAMES and k not in ("samples", "dt", "snum", "trace_idx")})

    return parse


parse_dzt, parse_segy, parse_bursts = fixed("gssi"), fixed("segy"), fixed("apres")


def parse_dt1(header: dict[str, str]) -> Callable[[str, bytes], pd.DataFrame]:
    """Traces with a header of 25 floats and 28 bytes each; ``header`` holds the text file's keys."""
    return fixed("pe", pe_options(header))


def parse_rd3(samples: int, window_ns: float, trig: float = 36.0) -> Callable[[str, bytes], pd.DataFrame]:
    """16-bit samples, trace after trace, with the text header's number of samples and time window."""
    return fixed("ramac", {"samples": samples, "window_ns": window_ns, "trig": trig})


def write_segy(samples: np.ndarray, interval: int) -> bytes:
    """A SEG-Y file (little endian, IEEE floats) of a (samples x traces) matrix."""
    return segy_head(interval, len(samples)) + segy_records(np.arange(samples.shape[1]), samples.T).tobytes()


def parse_wheel(magnets: int = 1, diameter: float = 0.5, level: float = 0.1, strict: bool = True) -> Callable[[str, bytes], pd.DataFrame]:
    """A stream of records f4, u2, i2, f4, f4, u2, u2 and so many u2 samples; distances from a wheel's counts.

    A record holds time, count, pressure, vertical and horizontal step, averages and
    length. The step is the median of the records', pressures are differences from
    the first, and the trigger is where the mean trace first rises by more than
    ``level`` of its largest amplitude in a sample (0 if it never does).
    """
    def read(path: str, raw: bytes) -> tuple[np.ndarray, float, dict]:
        at, times, counts, pressures, steps, rows = 0, [], [], [], [], []
        head = struct.Struct("<fHhffHH")
        while at + head.size <= len(raw):
            time, wheel, pressure, _, step, _, n = head.unpack_from(raw, at)
            at += head.size
            if at + 2 * n > len(raw):
                at -= head.size
                break
            rows.append(np.frombuffer(raw, "<u2", n, at))
            at += 2 * n
            times.append(time)
            counts.append(wheel)
            pressures.append(pressure)
            steps.append(step)
        if not rows:
            raise ValueError("no records")
        if strict and at < len(raw):
            raise ValueError(f"the file breaks off: {len(raw) - at} bytes after {len(rows)} whole records")
        data = np.stack(rows, 1).astype("<i4") - 512
        mean = data.mean(1)
        steep = np.flatnonzero(np.abs(np.gradient(mean)) > level * np.abs(mean).max())
        # The counter has 16 bits; a jump by more than half of its range is its turn.
        jumps = np.diff(np.array(counts, "int64"), prepend=counts[0])
        dist = (counts[0] + np.cumsum((jumps + 32768) % 65536 - 32768)) * np.pi * diameter / magnets
        return data, float(np.median(steps)), dict(data_dtype="float64", decday=np.array(times, float), dist=dist, trig=float(steep[0]) if len(steep) else 0.0,
                                                   pressure=np.array(pressures, float) - pressures[0], trace_int=np.gradient(dist) if len(dist) > 1 else np.zeros(1))

    return by_matrix(read)


def parse_simulation(dt: float, share: float = 0.5) -> Callable[[str, bytes], pd.DataFrame]:
    """A text matrix with a line per trace; samples before the mean amplitude first passes a share of its largest are cut."""
    def parse(path: str, raw: bytes) -> pd.DataFrame:
        lines = [line.replace(",", " ").split() for line in raw.decode("latin-1").splitlines() if line.strip()]
        if not lines or len({len(x) for x in lines}) != 1:
            raise ValueError("not a matrix")
        data = np.array(lines, float).T
        mean = np.abs(data).mean(1)
        start = int(np.flatnonzero(mean > share * mean.max())[0]) if mean.max() > 0 else 0
        return traces_of(path, data[start:], dt, dist=np.arange(data.shape[1], dtype=float), decday=np.arange(data.shape[1], dtype=float))

    return parse


#: Days from the epoch of decimal days to 1970.
EPOCH = 719529.0


def parse_gecko(channel: int = 1, strict: bool = True) -> Callable[[str, bytes], pd.DataFrame]:
    """One channel of a recording whose traces follow each other channel by channel.

    Versions (in hundredths) differ in the header's fields and padding, and in
    those of traces. Markers and comments give no trace; other channels are passed
    over. A file that ends within a record raises, or gives its whole records.
    """
    def read(path: str, raw: bytes) -> tuple[np.ndarray, float, dict]:
        version, channels = struct.unpack_from("<H", raw)[0], raw[76]
        mhz, pre, post = struct.unpack_from("<HHH", raw, 82)
        wide = 27 if version < 360 else 0
        at = 97 + (2 if version < 321 else 0) + (2 if version < 380 else 4) + wide
        if not 1 <= channel <= channels or not mhz:
            raise ValueError(f"no channel {channel} in this recording")
        for k in range(channels):
            if raw[at] != k + 1:
                raise ValueError("a damaged channel header")
            at += 5 + wide
        padding = 0 if version >= 360 else 14 if version >= 320 else 12
        head = struct.Struct(f"<Bxidf2x{'ff' if version < 321 else ''}ddff{padding}x")
        snum, rows, turn = pre + post, [], 0
        while at + head.size <= len(raw):
            begin = at
            kind, _, day, interval, *gauges, lat, long, elev, _ = head.unpack_from(raw, at)
            at += head.size + (38 if kind == 1 else 0)
            if kind:
                continue
            if at + 2 * snum > len(raw):
                at = begin
                break
            if turn % channels == channel - 1:
                rows.append((day + EPOCH, interval, lat, long, elev, gauges[1] if gauges else 0.0, np.frombuffer(raw, "<i2", snum, at)))
            turn += 1
            at += 2 * snum
        if not rows:
            raise ValueError("no traces")
        if strict and at < len(raw):
            raise ValueError(f"the file breaks off: {len(raw) - at} bytes after {turn} whole traces")
        *heads, body = zip(*rows)
        named = dict(zip(("decday", "trace_int", "lat", "long", "elev", "pressure"), map(np.array, heads)))
        return np.stack(body, 1), 1 / (mhz * 1e6), dict(chan=str(channel), trig=float(pre)) | named

    return by_matrix(read)


def in_one_profile(traces: DataFrame, name: str) -> DataFrame:
    """The files of a folder as one profile, file after file by their first times.

    It is called by what the files' names share, or ``name``. Only one row a file
    is ordered; the traces are numbered by a join.
    """
    files = traces.groupBy("fn").agg(F.min("decday").alias("first__"), F.count(F.lit(1)).alias("n__"))
    folder = Window.partitionBy(F.regexp_replace("fn", "[^/]*$", ""))
    before = folder.orderBy("first__", "fn").rowsBetween(Window.unboundedPreceding, -1)
    shared = F.regexp_extract(common_start(F.array(F.min("fn").over(folder), F.max("fn").over(folder))), "[^/]*$", 0)
    files = files.select("fn", F.coalesce(F.sum("n__").over(before), F.lit(0)).cast("int").alias("start__"), F.regexp_replace(shared, r"\.[^.]*$", "").alias("shared__"))
    place = F.col("trace_idx") + F.col("start__")
    called = F.when(F.col("shared__") == "", name).otherwise(F.col("shared__"))
    return traces.join(files, "fn").withColumns({"profile_id": called, "trace_num": place + 1, "trace_idx": place}).select(*traces.columns)


def split_project(blob: bytes) -> dict[str, bytes]:
    """The files within a project blob, by the names ``lineN.ext`` that come before their contents."""
    import re

    marks = list(re.finditer(rb"line\d+\.(?:hd|ini|dt1|gps)", blob, re.I))
    return {m.group().decode(): blob[m.end() : (marks[i + 1].start() if i + 1 < len(marks) else len(blob))] for i, m in enumerate(marks)}


GATED = {"gprMax": "h5py", "bsi": "h5py", "delores": "h5py", "UoA_h5": "h5py", "UoA_mat": "h5py", "mcords_nc": "netCDF4"}


def with_coordinates(traces: DataFrame, s_srs: str | None = None, t_srs: str | None = None) -> DataFrame:
    """Degrees from x_coord and y_coord in ``s_srs``, then x_coord and y_coord in ``t_srs`` from degrees.

    Systems: EPSG:326zz and EPSG:327zz (UTM), for ``t_srs`` also utm (the zone of
    each profile's mean), EPSG:3031, EPSG:3413 and EPSG:3995 (polar stereographic).
    """
    from ..functions.scalars import polar_stereographic, utm, utm_inverse
    from ..operators.geometry import project

    def zone_of(name: str) -> tuple[int, bool]:
        code = name.upper().removeprefix("EPSG:")
        if len(code) != 5 or code[:3] not in ("326", "327") or not 1 <= int(code[3:]) <= 60:
            raise ValueError(f"unknown coordinate system {name}")
        return int(code[3:]), code[:3] == "326"

    if s_srs is not None:
        zone, north = zone_of(s_srs)
        lat, long = utm_inverse(F.col("x_coord"), F.col("y_coord"), F.lit(zone), north)
        traces = traces.withColumns({"lat": lat, "long": long})
    if t_srs is None:
        return traces
    polar = {"EPSG:3031": (-71.0, 0.0), "EPSG:3413": (70.0, -45.0), "EPSG:3995": (71.0, 0.0)}.get(t_srs.upper())
    if polar:
        x, y = polar_stereographic(F.col("lat"), F.col("long"), *polar)
    elif t_srs.lower() == "utm":
        return project(traces)
    else:
        zone, north = zone_of(t_srs)
        x, y, _ = utm(F.col("lat"), F.col("long"), F.lit(zone))
        y = y - F.when(F.col("lat") < 0, 10_000_000.0).otherwise(0.0) + (0.0 if north else 10_000_000.0)
    return traces.withColumns({"x_coord": x, "y_coord": y})


def load(spark: SparkSession, kind: str, path: str, s_srs: str | None = None, t_srs: str | None = None, **options) -> DataFrame:
    """The traces of files of a kind, with coordinates from ``s_srs`` and in ``t_srs`` on request."""
    return with_coordinates(load_files(spark, kind, path, **options), s_srs, t_srs)


def with_positions(traces: DataFrame, fixes: DataFrame) -> DataFrame:
    """Latitudes, longitudes and elevations along trace numbers, from a table of positions with the name of its profile."""
    from ..operators.geometry import placed

    fixes = fixes.select("profile_id", F.col("trace_num").cast("double").alias("number__"), "lat", "long", "elev")
    numbered = traces.withColumn("number__", F.col("trace_num").cast("double"))
    return placed(numbered, fixes, "number__", ["lat", "long", "elev"], True).select(*traces.columns)


def load_files(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Read files of a kind: gssi, pe, ramac, segy, tek, apres, gecko, osu, seidart, mat, stomat, mcords_mat, parquet; others name the missing library."""
    from . import matlab as ML
    from . import text as T

    strict = options.pop("strict", True)

    if kind in GATED:
        raise ImportError(f"files of kind {kind} need {GATED[kind]}, which is not installed")
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "osu":
        return T.read_trace_texts(spark, path)
    if kind == "gecko":
        return in_one_profile(read_files(spark, path, parse_gecko(**options), strict), "gecko")
    if kind in LAYOUTS:
        options |= pe_options(options.pop("header")) if kind == "pe" and "header" in options else {}
        positions = options.pop("positions", None)
        traces = read_ranges(spark, kind, path, strict=strict, **options)
        return traces if positions is None else with_positions(traces, T.cor_table(spark, positions))
    if kind == "seidart":
        return read_files(spark, path, parse_simulation(options["dt"]), strict)
    parse = {"mat": ML.parse_native, "stomat": ML.parse_native, "mcords_mat": ML.parse_sounder, "tek": parse_wheel(**options) if kind == "tek" else None}.get(kind)
    if parse is None:
        raise ValueError(f"unknown kind {kind}")
    return read_files(spark, path, parse, strict)


