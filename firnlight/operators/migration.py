"""Migration of radargrams.

Kirchhoff migration sums along hyperbolas and is a join of outputs with the
traces in their aperture. Stolt's and Gazdag's methods go by columns: along the
traces sample by sample, then wavenumber by wavenumber, and back. With velocities
that vary across a profile it goes down level by level, frequency by frequency. No
group holds a profile.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.arrays import doubles
from ..sources.shared import stored
from .along import with_profile
from .batches import map_arrays
from .tiles import TILE, turn


#: Traces of a segment of outputs in Kirchhoff migration.
KIRCHHOFF_SEGMENT = 512

#: Squared cosines up to which a wave counts as evanescent; where it grazes, rounding would decide.
GRAZING = 1e-9


def edge_taper(n: int, width: int) -> np.ndarray:
    """Rises linearly from 0 at both ends over ``width`` places."""
    i = np.arange(n)
    return np.minimum(np.minimum(i, n - 1 - i) / max(width, 1), 1.0)


def tapered(traces: DataFrame, across: int, down: int) -> DataFrame:
    """Edge taper over traces and samples; long samples."""
    flat = with_profile(traces, n__=F.count(F.lit(1))).select("profile_id", "trace_idx", "n__", F.size("samples").alias("m__"), F.posexplode("samples").alias("sample_idx", "v"))
    h = F.least(F.least("trace_idx", F.col("n__") - 1 - F.col("trace_idx")) / across, F.lit(1.0))
    w = F.least(F.least("sample_idx", F.col("m__") - 1 - F.col("sample_idx")) / down, F.lit(1.0))
    return flat.select("profile_id", "trace_idx", "sample_idx", (F.col("v") * h * w).alias("v"))


def time_gradient(traces: DataFrame, step: float) -> DataFrame:
    """Central differences in time of each trace, one-sided at the ends; row-local."""
    last = F.size("samples") - 1

    def slope(v, j):
        a, b = F.greatest(j - 1, F.lit(0)), F.least(j + 1, last)
        return (F.get("samples", b) - F.get("samples", a)) / ((b - a) * step)

    return traces.withColumn("samples", F.transform("samples", slope))


def padded(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x longest) of lists, and where there is no number."""
    lists = pa.concat_arrays(lists.chunks)
    sizes = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(int)
    out, missing = np.zeros((len(lists), max(1, sizes.max()))), np.ones((len(lists), max(1, sizes.max())), bool)
    flat, there = lists.flatten(), np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[there], missing[there] = flat.to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
    return out, missing


def segment_sums(travel_time: list[float], spacing: float, velocity: float, reach: int, wide: int, nearfield: bool):
    """For :func:`kirchhoff`: the sums of a segment of ``wide`` outputs over its traces, offset by offset."""
    dt, depth = travel_time[1] - travel_time[0], np.array([velocity * t * 1e-6 / 2 for t in travel_time])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        place, begin = table["trace_idx"].to_numpy().astype(int), key[1].as_py() * wide
        size = min(wide, table["n__"][0].as_py() - begin)
        slope, missing = padded(table["samples"])
        if nearfield:
            raw, none = padded(table["heard__"])
            missing = missing | none
        total, known, heard = np.zeros((len(depth), size)), np.zeros((len(depth), size), bool), np.zeros(size, bool)
        again = pd.Series(place).groupby(place).cumcount().to_numpy()  # traces of one number are added one after the other
        for layer in range(again.max() + 1):
            mine = np.flatnonzero(again == layer)
            at_place = place[mine] - begin + reach
            # (samples x traces) from ``reach`` before the segment to as many after it, so that an offset is a slice.
            there, given = np.zeros(size + 2 * reach, bool), np.zeros((slope.shape[1], size + 2 * reach), bool)
            far, near = np.zeros(given.shape), np.zeros(given.shape if nearfield else 0)
            there[at_place], given[:, at_place], far[:, at_place] = True, ~missing[mine].T, slope[mine].T / velocity
            if nearfield:
                near[:, at_place] = raw[mine].T
            for offset in range(-reach, reach + 1):
                heard_by = slice(reach - offset, reach - offset + size)
                if not there[heard_by].any():
                    continue
                r = np.sqrt((offset * spacing) * (offset * spacing) + depth * depth)
                time = 2 * r / velocity * 1e6
                inside = (time <= travel_time[-1]) & (r > 0)  # at the surface itself the angle is not defined
                at = np.rint((time - travel_time[0]) / dt).astype(int)
                z = np.flatnonzero(inside & (at >= 0) & (at < len(far)))
                heard |= there[heard_by]
                known[~inside] |= there[heard_by]
                term = far[:, heard_by][at[z]]
                if nearfield:
                    term = term + near[:, heard_by][at[z]] / (r[z] * r[z])[:, None]
                ok = given[:, heard_by][at[z]]
                total[z] += np.where(ok, term * depth[z, None] / r[z, None], 0.0)
                known[z] |= ok
        outputs = np.flatnonzero(heard)
        values = pa.array((total.T[outputs] / (2 * math.pi)).ravel(), mask=~known.T[outputs].ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(outputs) + 1, dtype="int32") * len(depth)), values)
        return pa.table({"profile_id": pa.array([key[0].as_py()] * len(outputs), table.schema.field("profile_id").type),
                         "trace_idx": pa.array((outputs + begin).astype("int32")), "v": lists})

    return run


def kirchhoff(traces: DataFrame, travel_time: list[float], spacing: float, velocity: float = 1.69e8, aperture: int | None = None, nearfield: bool = False) -> DataFrame:
    """Kirchhoff migration in the far field, and on request with the near-field term; long samples.

    Each input trace contributes an array to the output traces of its aperture
    (all of them, if none is given). Time per output sample is the nearest
    sample to twice the distance over the velocity, nothing beyond the last; so
    traces whose distance alone lies beyond the last sample add nothing to an
    output and are not joined with it.

    Outputs go by segments of at least as many traces as they hear to a side, so a
    trace is dealt to three at most; traces are shuffled once, contributions are
    added up where they arise, and a group holds a segment and the traces that it
    hears, not a profile.
    """
    dt = travel_time[1] - travel_time[0]
    graded = time_gradient(traces.withColumn("heard__", F.col("samples")) if nearfield else traces, dt * 1e-6)
    raw = ["heard__"] if nearfield else []
    n = traces.groupBy("profile_id").agg(F.count(F.lit(1)).alias("n__"))
    heard = math.floor(velocity * travel_time[-1] * 1e-6 / 2 / spacing) + 1
    reach = F.lit(heard if aperture is None else min(aperture, heard))
    wide = max(KIRCHHOFF_SEGMENT, heard if aperture is None else min(aperture, heard))
    low, high = F.greatest(F.lit(0), F.col("trace_idx") - reach).cast("int"), F.least(F.col("n__") - 1, F.col("trace_idx") + reach).cast("int")
    sized = graded.join(F.broadcast(n), graded["profile_id"].eqNullSafe(n["profile_id"])).drop(n["profile_id"])
    dealt = sized.where(low <= high).withColumn("segment__", F.explode(F.sequence(F.floor(low / wide), F.floor(high / wide))))
    # Into a fixed number of tasks: the work is many times the input that scans are cut by.
    dealt = dealt.repartition(int(traces.sparkSession.conf.get("spark.sql.shuffle.partitions")), "profile_id", "segment__")
    shape = StructType([traces.schema["profile_id"], *StructType.fromDDL("trace_idx int, v array<double>").fields])
    work = segment_sums(travel_time, spacing, velocity, heard if aperture is None else min(aperture, heard), wide, nearfield)
    out = dealt.select("profile_id", "segment__", "n__", "trace_idx", "samples", *raw).groupBy("profile_id", "segment__").applyInArrow(work, shape)
    return out.select("profile_id", "trace_idx", F.posexplode("v").alias("sample_idx", "v"))


def numbered(traces: DataFrame) -> DataFrame:
    """Traces as rows of :func:`.tiles.turn`."""
    return with_profile(traces.where("samples is not null"), n=F.count(F.lit(1))).withColumn("place", F.col("trace_idx"))


def long_of(rows: DataFrame) -> DataFrame:
    """Long samples of rows (profile_id, place of the sample, v over the traces)."""
    return rows.select("profile_id", F.posexplode("v").alias("trace_idx", "v"), F.col("place").alias("sample_idx")).select("profile_id", "trace_idx", "sample_idx", "v")


def by_wavenumber(traces: DataFrame, work, spacing: float, across: int, down: int, tile: int = TILE) -> DataFrame:
    """Taper, transform along the traces, apply ``work`` to each wavenumber, transform back; long samples.

    Three shuffles of tiles: to rows over the traces, to wavenumbers, and back. A
    group holds some rows of one number for each trace or for each sample, never a
    profile. ``work`` takes complex rows over time and their wavenumbers.
    """
    def forward(at: np.ndarray, m: int, v: np.ndarray) -> tuple:
        z = np.fft.fft(v * edge_taper(v.shape[1], across)[None, :] * edge_taper(m, down)[at, None])
        return z.real, z.imag

    def inside(at: np.ndarray, m: int, re: np.ndarray, im: np.ndarray) -> tuple:
        z = work(re + 1j * im, 2 * np.pi * np.fft.fftfreq(m, spacing)[at])
        return z.real, z.imag

    spectra = turn(numbered(traces), ["samples"], forward, ["re", "im"], tile)
    moved = turn(spectra, ["re", "im"], inside, ["re", "im"], tile)
    return long_of(turn(moved, ["re", "im"], lambda at, m, re, im: (np.fft.ifft(re + 1j * im).real,), ["v"], tile))


def stolt_columns(columns: np.ndarray, kx: np.ndarray, dt: float, velocity: float) -> np.ndarray:
    """Stolt's mapping of frequency to vertical wavenumber at a constant velocity; a row for each horizontal wavenumber."""
    n = columns.shape[1]
    omega = 2 * np.pi * np.fft.fftfreq(n, dt)
    kz = omega * 2 / velocity
    order = np.argsort(omega)
    spec = np.fft.fft(columns)[:, order]
    root = np.sqrt(kx[:, None] ** 2 + kz[None, :] ** 2)
    wanted = np.sign(kz) * velocity / 2 * root
    value = np.array([np.interp(w, omega[order], s.real, 0, 0) + 1j * np.interp(w, omega[order], s.imag, 0, 0) for w, s in zip(wanted, spec)])
    out = value * np.divide(np.abs(kz)[None, :], root, out=np.zeros_like(root), where=root > 0)
    out[kx == 0, 0] = 0
    return np.fft.ifft(out)


def phase_shift_columns(columns: np.ndarray, kx: np.ndarray, dt: float, velocity) -> np.ndarray:
    """Gazdag's phase shift, a row for each horizontal wavenumber; ``velocity`` constant or one value per output time."""
    n = columns.shape[1]
    speed = np.broadcast_to(np.asarray(velocity, float), (n,))
    size = 1 << (2 * n - 1).bit_length()
    field = np.fft.fft(columns, size)
    omega = 2 * np.pi * np.fft.fftfreq(size, dt)[None, :]
    image = np.zeros(columns.shape, complex)
    for i in range(n):
        image[:, i] = field.sum(1) / size
        with np.errstate(divide="ignore", invalid="ignore"):
            cos2 = 1 - (speed[i] * kx[:, None] / (2 * omega)) ** 2
        inside = np.isfinite(cos2) & (cos2 > GRAZING)
        field = np.where(inside, field * np.exp(1j * omega * dt * np.sqrt(np.where(inside, cos2, 0))), 0)
    return image


def tridiagonal(low: np.ndarray, diagonal: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve a tridiagonal system in each row, all rows and places at once, by cyclic reduction.

    Every pass ties each unknown to those twice as far away. The systems must be
    diagonally dominant.
    """
    far, n = 1, right.shape[1]

    def moved(x: np.ndarray, by: int, fill: float) -> np.ndarray:
        out = np.full_like(x, fill)
        if by > 0:
            out[:, by:] = x[:, :-by]
        else:
            out[:, :by] = x[:, -by:]
        return out

    while far < n:
        a, c = -low / moved(diagonal, far, 1), -high / moved(diagonal, -far, 1)
        right = right + a * moved(right, far, 0) + c * moved(right, -far, 0)
        diagonal = diagonal + a * moved(high, far, 0) + c * moved(low, -far, 0)
        low, high = a * moved(low, far, 0), c * moved(high, -far, 0)
        far *= 2
    return right / diagonal


def lateral_steps(field: np.ndarray, omega: np.ndarray, velocity: np.ndarray, dt: float, spacing: float, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Carry frequencies (rows over the traces) down by one step for each row of ``velocity``: Fourier finite differences.

    A step has the thickness that the level's least velocity c passes in ``dt``. It
    is a phase shift with c, a thin lens for c / v, and for what is left of the
    dips a tridiagonal step, the 45-degree expansion in Cayley's form; its real
    part is held at a quarter so that the system stays dominant. Gives the field
    below and the complex field above each step.
    """
    kx = 2 * np.pi * np.fft.fftfreq(field.shape[1], spacing)[None, :]
    w, above = omega[:, None], []
    for v in velocity:
        above.append(field if weights is None else weights @ field.real)
        c = v.min()
        p = (c / v)[None, :]
        with np.errstate(divide="ignore", invalid="ignore"):
            cos2 = 1 - (c * kx / (2 * w)) ** 2
            kappa = (v[None, :] / (2 * w * spacing)) ** 2
        inside = np.isfinite(cos2) & (cos2 > GRAZING)
        shift = np.where(inside, np.exp(1j * w * dt * np.sqrt(np.where(inside, cos2, 0))), 0)
        field = np.fft.ifft(np.fft.fft(field) * shift) * np.exp(1j * w * dt * (p - 1))
        if (p < 1).any():
            still = w == 0  # the mean in time ends with the first step
            kappa = np.where(still, 0, kappa)
            real, turned = np.minimum((1 + p + p * p) / 4 * kappa, 0.25), w * dt * p * (1 - p) * kappa / 4
            bent = -2 * field
            bent[:, 1:] += field[:, :-1]
            bent[:, :-1] += field[:, 1:]
            off = real - 1j * turned
            low, high = off.copy(), off.copy()
            low[:, 0], high[:, -1] = 0, 0
            field = tridiagonal(low, 1 - 2 * off, high, field + (real + 1j * turned) * bent)
    return field, np.array(above)


def lateral(traces: DataFrame, dt: float, spacing: float, velocity: str = "velocity", across: int = 10, down: int = 10, steps: int = 64, tile: int = TILE) -> DataFrame:
    """Migration with velocities that vary along and down the profile; long samples over the levels' steps.

    ``velocity``: a column with an array of velocities for the samples of each trace.
    Frequencies do not meet until the image is summed, so the profile is parted by
    frequency: a group holds some frequencies, a number a trace each, and the
    velocities of ``steps`` levels. After these the fields are written to the shared
    folder and the next levels begin, so no group holds a profile, whatever its
    length and depth. Edges are fixed at zero in the tridiagonal step.
    """
    spark = traces.sparkSession
    size = traces.select(F.size("samples")).where("samples is not null").first()
    if size is None:
        return long_of(spark.createDataFrame([], "profile_id string, place int, v array<double>"))
    m = size[0]
    long = 1 << (2 * m - 1).bit_length()
    rows = numbered(traces)

    def spectrum(x: np.ndarray) -> tuple:
        z = np.fft.rfft(x * edge_taper(m, down)[None, :], long)
        return z.real, z.imag

    def along(at: np.ndarray, length: int, re: np.ndarray, im: np.ndarray) -> tuple:
        taper = edge_taper(re.shape[1], across)[None, :]
        return re * taper, im * taper

    spectra = map_arrays(rows.select("profile_id", "n", "place", "samples"), ["samples"], spectrum, re="double", im="double")
    fields = turn(spectra, ["re", "im"], along, ["re", "im"], tile)
    speeds = stored(turn(rows.select("profile_id", "n", "place", F.col(velocity).alias("v")), ["v"], lambda at, length, v: (v,), ["v"], tile), "velocities")
    counts = traces.groupBy("profile_id").agg(F.greatest(F.lit(1), F.floor(tile / F.count(F.lit(1)))).cast("int").alias("width"))
    state = fields.join(counts, "profile_id").select("profile_id", "place", F.floor(F.col("place") / F.col("width")).cast("int").alias("part"), F.lit(False).alias("image"), "re", "im")
    parts = counts.select("profile_id", F.explode(F.sequence(F.lit(0), F.floor((long // 2) / F.col("width")).cast("int"))).alias("part"))
    kind = "profile_id string, place int, part int, image boolean, re array<double>, im array<double>"

    def carried(first: int):
        def run(key, fields: pd.DataFrame, speeds: pd.DataFrame) -> pd.DataFrame:
            fields, speeds = fields.sort_values("place"), speeds.sort_values("place")
            k = fields["place"].to_numpy()
            z = np.array(fields["re"].tolist()) + 1j * np.array(fields["im"].tolist())
            twice = np.where((k == 0) | (k == long // 2), 1.0, 2.0)
            below, image = lateral_steps(z, 2 * np.pi * k / (long * dt), np.array(speeds["v"].tolist()), dt, spacing, twice / long)
            done = {"profile_id": key[0], "part": key[1]}
            return pd.concat([
                pd.DataFrame(done | {"place": k, "image": False, "re": list(below.real), "im": list(below.imag)}),
                pd.DataFrame(done | {"place": np.arange(first, first + len(image)), "image": True, "re": list(image), "im": None})])[[c.split()[0] for c in kind.split(", ")]]

        return run

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"profile_id": pdf["profile_id"].iloc[:1], "place": pdf["place"].iloc[:1], "v": [np.sum(pdf["re"].tolist(), axis=0)]})

    image = None
    for first in range(0, m, steps):
        levels = speeds.where(F.col("place").between(first, first + steps - 1)).join(parts, "profile_id").select("profile_id", "part", "place", "v")
        out = state.groupBy("profile_id", "part").cogroup(levels.groupBy("profile_id", "part")).applyInPandas(carried(first), kind)
        if first + steps < m:
            out = stored(out, "fields")
        state, seen = out.where("not image"), out.where("image")
        image = seen if image is None else image.unionByName(seen)
    return long_of(image.groupBy("profile_id", "place").applyInPandas(added, "profile_id string, place int, v array<double>"))


def migrate(traces: DataFrame, kind: str, travel_time: list[float], spacing: float, velocity=1.68e8, across: int = 10, down: int = 10, nearfield: bool = False) -> DataFrame:
    """Migrate every profile: kirch, stolt, phsh (velocity may vary in time), ffd (and across: the name of a column of arrays), tk (taper only)."""
    dt = (travel_time[1] - travel_time[0]) * 1e-6
    if kind == "kirch":
        return kirchhoff(traces, travel_time, spacing, velocity, nearfield=nearfield)
    if kind == "tk":
        return tapered(traces, across, down)
    if kind in ("stolt", "phsh"):
        work = {"stolt": stolt_columns, "phsh": phase_shift_columns}[kind]
        return by_wavenumber(traces, lambda z, kx: work(z, kx, dt, velocity), spacing, across, down)
    if kind == "ffd":
        if not isinstance(velocity, str):
            traces, velocity = traces.withColumn("velocity", doubles([float(v) for v in np.broadcast_to(velocity, (len(travel_time),))])), "velocity"
        return lateral(traces, dt, spacing, velocity, across, down)
    raise ValueError(f"unknown migration {kind}" + ("; it needs the external seismic tools" if kind.startswith("su") else ""))


def velocity_profile(table: list[tuple[float, float]], travel_time: list[float]) -> np.ndarray:
    """Velocity at each travel time from rows (velocity, depth), the ends carried on."""
    if not table:
        raise ValueError("an empty velocity table")
    v, z = np.array(sorted(table, key=lambda r: r[1]), float).T
    if (v <= 0).any():
        raise ValueError("velocities must be above zero")
    if z[0] > 0:
        v, z = np.r_[v[0], v], np.r_[0.0, z]
    t = np.r_[0.0, np.cumsum(2 * np.diff(z) / ((v[1:] + v[:-1]) / 2))] * 1e6
    return np.interp(travel_time, t, v)
