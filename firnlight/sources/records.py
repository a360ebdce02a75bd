"""Files of fixed-length records, read and written by ranges.

A vendor file whose traces all take the same number of bytes is a header and then
records. A :class:`Layout` says where runs of records begin, how long a record is
and how its bytes become columns; it is made from the header alone. The parsers of
whole files (:mod:`firnlight.sources.binary`) and the data source ``radar`` use the
same layouts.

``spark.read.format("radar")`` makes partitions of byte ranges, so a file of any
size is read in parallel and no value is larger than a range. Filters on trace_idx
and on fn leave out ranges and files, before anything but headers is read, and a
schema given with ``.schema(...)`` is honoured: where it asks for no samples, only
the heads of records are read. A file that ends within a record raises, or with
``strict=false`` gives its whole records; a file that is none of its kind raises,
or is then passed over.

``df.write.format("radar_segy")`` writes one SEG-Y file for each profile. A record's
place follows from trace_idx, so tasks write their records straight into one file
under a temporary name; the commit checks that all records are there and gives the
files their names, and a failed job leaves nothing. For this the folder must be on a
file system that all executors see and that allows writing at a place (POSIX).
"""

from __future__ import annotations

import io
import os
import shutil
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range, and of records decoded together.
RANGE_BYTES, BATCH_BYTES = 64 << 20, 4 << 20

#: Tasks from which on ranges grow, up to ``RANGE_BYTES``: a task costs more than a few records.
MANY_RANGES = 256

#: The columns of a trace.
TRACES = """profile_id string, fn string, trace_idx int, trace_num int, snum int, dt double, trig double, chan string, decday double,
lat double, long double, elev double, x_coord double, y_coord double, dist double, pressure double, trace_int double, data_dtype string, samples array<double>"""
NAMES = [c.split()[0] for c in TRACES.replace("\n", " ").split(",")]

SEGY_HEAD, SEGY_TRACE_HEAD = 3600, 240

#: What the 25 floats of a pulse-radar trace header hold, by their places (fixed by the format).
DT1_FIELDS = {"number": 0, "position": 1, "points": 2, "topography": 3, "bytes_per_point": 5, "stacks": 7, "window_ns": 8, "x": 9, "y": 11, "z": 13,
              "receiver_x": 14, "receiver_y": 15, "receiver_z": 16, "transmitter_x": 17, "transmitter_y": 18, "transmitter_z": 19,
              "zero_adjustment": 20, "zero_flag": 21, "seconds_of_day": 23, "comment_flag": 24}


@dataclass
class Layout:
    """Runs of (first byte, records), bytes of a record and of its head, the samples of a trace, and what all traces share.

    ``decode`` takes records as rows of bytes and gives columns, ``samples`` as
    (traces x samples). ``left`` is the number of bytes after the last whole record.
    """

    runs: list[tuple[int, int]]
    size: int
    head: int
    snum: int
    decode: Callable[[np.ndarray, bool], dict]
    shared: dict = field(default_factory=dict)
    left: int = 0

    @property
    def count(self) -> int:
        return sum(n for _, n in self.runs)


def _one_run(start: int, end: int, size: int, **more) -> Layout:
    whole = max(0, end - start) // size
    return Layout([(start, whole)], size, left=max(0, end - start) - whole * size, **more)


def _at(file, place: int, n: int) -> bytes:
    file.seek(place)
    return file.read(n)


def gssi(file, end: int, options: dict) -> Layout:
    """A header of blocks, then u16 or u32 samples; the first two samples of a trace hold no data."""
    head = _at(file, 0, 54)
    snum, bits, trigger = struct.unpack_from("<HHh", head, 4)
    span, width = struct.unpack_from("<f", head, 26)[0], bits // 8
    if snum == 0 or width not in (2, 4):
        raise ValueError("not a pulse-radar file")
    start = next((s for s in (32768 * width, 512 * width) if end - s >= width * snum), None)
    if start is None:
        raise ValueError("no samples")

    def decode(rows: np.ndarray, samples: bool) -> dict:
        data = rows.view(f"<u{width}").copy()
        if snum > 2:
            data[:, :2] = data[:, 2:3]
        return {"samples": data}

    return _one_run(start, end, width * snum, head=0, snum=snum, decode=decode,
                    shared={"dt": span / snum * 1e-9, "trig": float(trigger), "chan": str(struct.unpack_from("<H", head, 52)[0]), "data_dtype": f"uint{bits}"})


def pe_options(header: dict[str, str]) -> dict:
    """The options of a kind ``pe`` from the keys of the text file beside the traces."""
    return {"points": int(float(header["NUMBER OF PTS/TRC"])), "window_ns": float(header["TOTAL TIME WINDOW"]), "version": header.get("VERSION", "").strip()}


def pe(file, end: int, options: dict) -> Layout:
    """A head of 25 floats and 28 bytes, then 16-bit or float samples less the mean of their first 100."""
    snum = int(options["points"])
    kind = "<i2" if options.get("version", "") == "1.0" else "<f4"

    def decode(rows: np.ndarray, samples: bool) -> dict:
        heads = rows[:, :100].copy().view("<f4").astype(float)
        out = {"trace_num": heads[:, 0].astype(int), "dist": heads[:, 1] / 1000, "header": [{k: float(h[i]) for k, i in DT1_FIELDS.items()} for h in heads]}
        if samples:
            data = rows[:, 128:].copy().view(kind).astype(float)
            out["samples"] = data - np.nanmean(data[:, :100], axis=1, keepdims=True)
        return out

    return _one_run(0, end, 128 + snum * np.dtype(kind).itemsize, head=128, snum=snum, decode=decode,
                    shared={"dt": float(options["window_ns"]) / snum * 1e-9, "data_dtype": "float64"})


def ramac(file, end: int, options: dict) -> Layout:
    """16-bit samples, trace after trace."""
    snum = int(options["samples"])
    return _one_run(0, end, 2 * snum, head=0, snum=snum, decode=lambda rows, samples: {"samples": rows.view("<i2")},
                    shared={"dt": float(options["window_ns"]) / snum * 1e-9, "trig": float(options.get("trig", 36.0)), "data_dtype": "int16"})


def segy(file, end: int, options: dict) -> Layout:
    """3600 bytes of file header, then traces with heads of 240 bytes; 2 and 4-byte integers and IEEE or IBM floats."""
    head = _at(file, 3200, 400)
    if len(head) < 400:
        raise ValueError("no file header")
    order = ">" if 0 < struct.unpack_from(">h", head, 24)[0] < 20 else "<"
    interval, _, snum, _, code = struct.unpack_from(f"{order}hhhhh", head, 16)
    kinds = {1: "u4", 2: "i4", 3: "i2", 5: "f4"}
    if code not in kinds or snum <= 0:
        raise ValueError("unknown sample format")
    kind = np.dtype(f"{order}{kinds[code]}")

    def decode(rows: np.ndarray, samples: bool) -> dict:
        group = rows[:, 80:88].copy().view(f"{order}i4") / 100.0
        out = {"x_coord": group[:, 0], "y_coord": group[:, 1]}
        if samples:
            data = rows[:, SEGY_TRACE_HEAD:].copy().view(kind)
            if code == 1:
                bits = data.astype(np.uint32)
                data = np.where(bits >> 31, -1.0, 1.0) * (bits & 0xFFFFFF) / 2.0**24 * 16.0 ** (((bits >> 24) & 0x7F).astype(int) - 64)
            out["samples"] = data
        return out

    return _one_run(SEGY_HEAD, end, SEGY_TRACE_HEAD + snum * kind.itemsize, head=SEGY_TRACE_HEAD, snum=snum, decode=decode,
                    shared={"dt": interval * 1e-9, "data_dtype": "float64" if code == 1 else kind.newbyteorder("=").name})


END_OF_HEADER = b"*** End Header ***"


def apres(file, end: int, options: dict) -> Layout:
    """Phase-sensitive bursts: text keys up to a mark, then the samples of all chirps, u16, u32 or averaged floats."""
    at, runs, kinds, left = 0, [], set(), 0
    while at < end:
        text = b""
        while (stop := text.find(END_OF_HEADER)) < 0 and at + len(text) < end:
            text += _at(file, at + len(text), 1 << 14)
        if stop < 0:
            left = end - at if text.strip(b"\0\r\n\t ") else 0
            break
        keys = dict(line.split("=", 1) for line in text[:stop].decode("latin-1").splitlines() if "=" in line)
        n, chirps = int(keys["N_ADC_SAMPLES"]), int(keys.get("NSubBursts", 1)) * int(keys.get("nAttenuators", 1))
        average = int(keys.get("Average", 0))
        kind = np.dtype("<u2" if average == 0 else "<f4" if average == 2 else "<u4")
        start = at + stop + len(END_OF_HEADER)
        after = _at(file, start, 2)
        start += len(after) - len(after.lstrip(b"\r\n"))
        size = n * kind.itemsize
        whole = min(chirps, max(0, end - start) // size)
        runs.append((start, whole))
        kinds.add((n, kind.str, max(chirps, 1) if average == 1 else 1))
        at = start + chirps * size
        if at > end:
            left = max(0, end - start) - whole * size or size
    if not runs:
        raise ValueError("no bursts")
    if len(kinds) > 1:
        raise ValueError("bursts of different lengths in one file")
    n, kind, share = kinds.pop()

    def decode(rows: np.ndarray, samples: bool) -> dict:
        return {"samples": rows.view(kind).astype(float) / share * 2.5 / 2**16}

    return Layout(runs, n * np.dtype(kind).itemsize, 0, n, decode, {"dt": 1 / 40000, "data_dtype": "float64"}, left)


LAYOUTS = {"gssi": gssi, "pe": pe, "ramac": ramac, "segy": segy, "apres": apres}


def layout_of(kind: str, file, end: int, options: dict, strict: bool = True) -> Layout:
    found = LAYOUTS[kind](file, end, options)
    if not found.count:
        raise ValueError("no traces")
    if strict and found.left:
        raise ValueError(f"the file breaks off: {found.left} bytes after {found.count} whole traces")
    return found


def columns_of(path: str, layout: Layout, first: int, n: int, rows: np.ndarray | None, samples: bool = True) -> dict:
    """The columns of the file's traces from ``first`` on, of which ``rows`` are the records' bytes, if they are needed."""
    number = np.arange(first, first + n, dtype="int32")
    name = path.rsplit("/", 1)[-1]
    same = {"profile_id": name.rsplit(".", 1)[0], "fn": path, "trace_idx": number, "trace_num": number + 1, "snum": layout.snum}
    return same | layout.shared | (layout.decode(rows, samples) if rows is not None else {})


def whole_file(kind: str, path: str, raw: bytes, options: dict | None = None, strict: bool = True) -> tuple[Layout, dict]:
    """The layout and columns of a file that is in memory."""
    layout = layout_of(kind, io.BytesIO(raw), len(raw), options or {}, strict)
    rows = np.vstack([np.frombuffer(raw, np.uint8, n * layout.size, start).reshape(n, layout.size) for start, n in layout.runs])
    return layout, columns_of(path, layout, 0, len(rows), rows)


# The data source.

#: What a head of a trace holds beyond these columns is in ``header``.
SCHEMA = TRACES + ", header map<string, double>"


def store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if urlparse(path).scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def files_at(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder whose names begin with neither a dot nor an underscore."""
    from pyarrow import fs

    system, at = store(path)
    found = system.get_file_info(at)
    if found.type == fs.FileType.Directory:
        inside = system.get_file_info(fs.FileSelector(at))
        files = [x for x in inside if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    elif found.type == fs.FileType.File:
        files = [found]
    else:
        raise FileNotFoundError(path)
    root = path.rstrip("/")
    return sorted((root if x is found else f"{root}/{x.base_name}", x.size) for x in files)


class Range(InputPartition):
    """``count`` records of a file from its trace ``first`` on, which begins at byte ``place``."""

    def __init__(self, path: str, end: int, first: int, place: int, count: int):
        super().__init__(None)
        self.path, self.end, self.first, self.place, self.count = path, end, first, place, count


class RadarReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, {k.lower(): v for k, v in options.items()}
        self.kind = self.options.get("kind", "")
        if self.kind not in LAYOUTS:
            raise ValueError(f"option kind: one of {', '.join(LAYOUTS)}")
        self.strict = self.options.get("strict", "true").lower() != "false"
        self.low, self.high, self.files = 0, None, None

    def pushFilters(self, filters: list) -> Iterator:
        """Bounds of trace_idx and names of files; every filter is left to Spark as well."""
        for f in filters:
            if f.attribute == ("trace_idx",):
                if isinstance(f, (EqualTo, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value)
                elif isinstance(f, GreaterThan):
                    self.low = max(self.low, f.value + 1)
                if isinstance(f, In) and f.value:
                    self.low, self.high = max(self.low, min(f.value)), min(max(f.value), self.high if self.high is not None else max(f.value))
                top = f.value if isinstance(f, (EqualTo, LessThanOrEqual)) else f.value - 1 if isinstance(f, LessThan) else None
                if top is not None:
                    self.high = top if self.high is None else min(self.high, top)
            elif f.attribute == ("fn",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.files = wanted if self.files is None else self.files & wanted
            yield f

    def partitions(self) -> list[Range]:
        found, wanted = [], 0
        for path, end in files_at(self.options["path"]):
            if self.files is not None and path not in self.files:
                continue
            system, at = store(path)
            try:
                with system.open_input_file(at) as file:
                    layout = layout_of(self.kind, file, end, self.options, self.strict)
            except (ValueError, KeyError, struct.error):
                if self.strict:
                    raise
                continue
            first = 0
            for start, n in layout.runs:
                low = max(0, self.low - first)
                high = n if self.high is None else min(n, self.high + 1 - first)
                if low < high:
                    found.append((path, end, first, start, layout.size, low, high))
                    wanted += (high - low) * layout.size
                first += n
        size = max(int(self.options.get("rangebytes", RANGE_BYTES)), min(RANGE_BYTES, -(-wanted // MANY_RANGES)))
        out = []
        for path, end, first, start, record, low, high in found:
            step = max(1, size // record)
            out += [Range(path, end, first + k, start + k * record, min(step, high - k)) for k in range(low, high, step)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(self.schema)
        samples = "samples" in arrow.names
        system, at = store(part.path)
        with system.open_input_file(at) as file:
            layout = layout_of(self.kind, file, part.end, self.options, self.strict)
            step = max(1, BATCH_BYTES // layout.size)
            for k in range(0, part.count, step):
                n = min(step, part.count - k)
                place = part.place + k * layout.size
                width = layout.size if samples else layout.head
                rows = None
                if width:
                    raw = _at(file, place, n * width) if samples else b"".join(_at(file, place + i * layout.size, width) for i in range(n))
                    if len(raw) != n * width:
                        raise ValueError(f"{part.path} changed while it was read")
                    rows = np.frombuffer(raw, np.uint8).reshape(n, width)
                got = columns_of(part.path, layout, part.first + k, n, rows, samples)
                yield pa.RecordBatch.from_arrays([column(got.get(f.name), n, f.type) for f in arrow], schema=arrow)


def column(values, n: int, kind: pa.DataType) -> pa.Array:
    """An Arrow column of n values, of one value n times, or of nulls; rows of a matrix become lists, NaN null."""
    if values is None:
        return pa.nulls(n, kind)
    if isinstance(values, np.ndarray) and values.ndim == 2:
        flat = pa.array(np.ascontiguousarray(values, float).ravel(), from_pandas=True)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="int32") * values.shape[1]), flat).cast(kind)
    if isinstance(values, (list, np.ndarray)):
        if pa.types.is_map(kind):
            return pa.array([list(v.items()) for v in values], kind)
        return pa.array(values, from_pandas=True).cast(kind)
    return pa.array([values] * n, kind)


class RadarSource(DataSource):
    """``radar``: traces of vendor files by ranges. Options: kind, path, rangeBytes, strict, and those of the kind's layout.

    ``rangeBytes`` is the least size of a range; where more than ``MANY_RANGES`` would
    come of it, ranges are so much larger, up to ``RANGE_BYTES``.
    """

    @classmethod
    def name(cls) -> str:
        return "radar"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> RadarReader:
        return RadarReader(schema, dict(self.options))


# The writer.


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: for each profile its samples a trace and runs of trace numbers."""

    runs: list[tuple[str, int, int, int]]


def file_of(folder: str, profile: str) -> str:
    if not profile or "/" in profile or profile[0] in "._":
        raise ValueError(f"{profile!r} cannot be the name of a file")
    return f"{folder}/{profile}.sgy"


def segy_head(interval: int, snum: int) -> bytes:
    head = bytearray(SEGY_HEAD)
    struct.pack_into("<hhh", head, 3216, interval, 0, snum)
    struct.pack_into("<h", head, 3224, 5)
    return bytes(head)


def segy_records(numbers: np.ndarray, samples: np.ndarray, x: np.ndarray | None = None, y: np.ndarray | None = None) -> np.ndarray:
    """Records of traces by their numbers from 0 and (traces x samples), little endian, IEEE floats; metres to the centimetre."""
    rows = np.zeros((len(samples), SEGY_TRACE_HEAD + 4 * samples.shape[1]), np.uint8)
    rows[:, 0:4] = (numbers + 1).astype("<i4")[:, None].view(np.uint8)
    for at, v in ((80, x), (84, y)):
        if v is not None:
            rows[:, at : at + 4] = np.round(np.nan_to_num(np.asarray(v, float)) * 100).astype("<i4")[:, None].view(np.uint8)
    rows[:, SEGY_TRACE_HEAD:] = np.ascontiguousarray(samples, "<f4").view(np.uint8)
    return rows


class SegyWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        system, self.folder = store(options["path"])
        if type(system).__name__ != "LocalFileSystem":
            raise ValueError("SEG-Y files are written in place, which needs a shared POSIX folder")
        self.interval, self.overwrite = int(options["interval"]), overwrite
        self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        os.makedirs(self.temporary, exist_ok=True)
        runs: list[tuple[str, int, int, int]] = []
        for batch in batches:
            table = {n: batch.column(n) for n in batch.schema.names}
            lists = table["samples"]
            if lists.null_count:
                raise ValueError("every trace needs samples")
            names, numbers = np.asarray(table["profile_id"].to_pylist(), object), table["trace_idx"].to_numpy(zero_copy_only=False)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            # A run of the batch: one profile, one length, numbers one after the other.
            cuts = [0, *(1 + np.flatnonzero((names[1:] != names[:-1]) | (np.diff(numbers) != 1) | (np.diff(lengths) != 0))), len(numbers)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                x, y = (table[c].to_numpy(zero_copy_only=False)[a:b] if c in table else None for c in ("x_coord", "y_coord"))
                snum = int(lengths[a])
                records = segy_records(numbers[a:b], flat[starts[a] : starts[b]].reshape(b - a, snum), x, y)
                with os.fdopen(os.open(file_of(self.temporary, names[a]), os.O_WRONLY | os.O_CREAT, 0o644), "wb") as file:
                    file.seek(SEGY_HEAD + int(numbers[a]) * records.shape[1])
                    file.write(records.tobytes())
                if runs and runs[-1][0] == names[a] and runs[-1][1] == snum and runs[-1][3] == numbers[a]:
                    runs[-1] = (*runs[-1][:3], int(numbers[b - 1]) + 1)
                else:
                    runs.append((names[a], snum, int(numbers[a]), int(numbers[b - 1]) + 1))
        return Written(runs)

    def commit(self, messages: list[Written]) -> None:
        """Headers, once every profile's records follow each other without a gap; then the files' names."""
        try:
            self._finish(messages)
        finally:
            shutil.rmtree(self.temporary, ignore_errors=True)

    def _finish(self, messages: list[Written]) -> None:
        profiles: dict[str, list] = {}
        for profile, snum, first, last in (r for m in messages if m for r in m.runs):
            profiles.setdefault(profile, []).append((first, last, snum))
        for profile, runs in profiles.items():
            runs.sort()
            if runs[0][0] != 0 or any(a[1] != b[0] for a, b in zip(runs, runs[1:])):
                raise ValueError(f"the traces of {profile} are not numbered from 0, one after the other")
            if len({snum for *_, snum in runs}) > 1:
                raise ValueError(f"traces of {profile} have different lengths")
            with open(file_of(self.temporary, profile), "r+b") as file:
                file.write(segy_head(self.interval, runs[0][2]))
        taken = [p for p in profiles if os.path.exists(file_of(self.folder, p))]
        if taken and not self.overwrite:
            raise FileExistsError(f"{taken[0]}.sgy is there already")
        for profile in profiles:
            os.replace(file_of(self.temporary, profile), file_of(self.folder, profile))

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.temporary, ignore_errors=True)


class SegySource(DataSource):
    """``radar_segy``: one SEG-Y file a profile, written by all tasks. Options: path, interval."""

    @classmethod
    def name(cls) -> str:
        return "radar_segy"

    def schema(self) -> str:
        return "profile_id string, trace_idx int, samples array<double>"

    def writer(self, schema: StructType, overwrite: bool) -> SegyWriter:
        missing = {"profile_id", "trace_idx", "samples"} - set(schema.names)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
        return SegyWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make both formats known to the session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RadarSource)
    spark.dataSource.register(SegySource)


def read_ranges(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """Traces of the files at ``path`` by ranges; see :class:`RadarSource`."""
    register(spark)
    return spark.read.format("radar").options(kind=kind, **{k: str(v) for k, v in options.items()}).load(path)


def write_segy_files(traces: DataFrame, path: str, interval: int, mode: str = "append") -> None:
    """One SEG-Y file for each profile in the folder ``path``; a profile may be of any length.

    Traces are dealt out by ranges of (profile, trace), so that a task writes long
    runs. Names are taken only on ``mode="overwrite"``.
    """
    register(traces.sparkSession)
    wanted = [c for c in ("x_coord", "y_coord") if c in traces.columns]
    rows = traces.select("profile_id", F.col("trace_idx").cast("int").alias("trace_idx"), *wanted, "samples")
    rows = rows.repartitionByRange("profile_id", "trace_idx").sortWithinPartitions("profile_id", "trace_idx")
    rows.write.format("radar_segy").mode(mode).option("interval", interval).save(path)
