"""Frequency filters on traces.

Vertical filters are row-local: Arrow batches of traces are filtered as one
matrix, nothing is shuffled. Horizontal filters run per sample over the traces of
a profile, so their groups hold one number a trace.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as N
from ..plans.tables import samples as long_samples


def map_samples(traces: DataFrame, work, column: str = "samples") -> DataFrame:
    """Apply a numpy function on matrices (samples x traces) to the arrays of ``column``; nulls count as zero."""
    index = traces.columns.index(column)
    schema = traces.schema

    def run(batches):
        for batch in batches:
            rows = batch.column(index).to_pylist()
            out: list = [None] * len(rows)
            for n in {len(r) for r in rows if r is not None}:
                at = [i for i, r in enumerate(rows) if r is not None and len(r) == n]
                x = np.array([rows[i] for i in at], float)
                y = work(np.nan_to_num(x).T).T
                for k, i in enumerate(at):
                    out[i] = y[k]
            new = pa.array(out, pa.list_(pa.float64()))
            columns = [new if c == index else batch.column(c) for c in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return traces.mapInArrow(run, schema)


def corner(mhz: float, dt: float) -> float:
    """A frequency in MHz as a fraction of the Nyquist frequency of samples ``dt`` seconds apart."""
    return mhz * 1e6 * dt * 2


def band_pass_operator(dt: float, low: float, high: float, order: int = 5, kind: str = "butter", ripple: float = 5.0):
    """The numpy function of a vertical band-pass (MHz); kinds butter, cheby1, bessel, fir."""
    corners = [corner(low, dt), corner(high, dt)]
    if kind == "fir":
        taps = N.fir_bandpass(order + 1, *corners)

        def fir(x: np.ndarray) -> np.ndarray:
            # Causal, moved up by the order; the last samples stay as they were.
            out = x.copy()
            out[: len(x) - order] = sum(t * x[order - k : len(x) - k] for k, t in enumerate(taps))
            return out

        return fir
    sos, padding = N.sections(order, corners, "bandpass", kind, ripple), N.padding_of(order, "bandpass")
    return lambda x: N.zero_phase(sos, x, padding)


def vertical_band_pass(traces: DataFrame, dt: float, low: float, high: float, order: int = 5, kind: str = "butter") -> DataFrame:
    return map_samples(traces, band_pass_operator(dt, low, high, order, kind))


def band_pass_by_matrix(traces: DataFrame, matrix: np.ndarray) -> DataFrame:
    """A linear operator given as a matrix, as array expressions; long samples come out."""
    rows = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in matrix])
    return traces.withColumn("samples", F.transform(rows, lambda r: F.aggregate(F.zip_with(r, "samples", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)))


def horizontal_filter(traces: DataFrame, corners, order: int, btype: str) -> DataFrame:
    """Zero-phase filter along the traces, for each sample; long samples (profile_id, trace_idx, sample_idx, v)."""
    sos, padding = N.sections(order, corners, btype), N.padding_of(order, btype)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("trace_idx")
        v = pdf["v"].to_numpy(float)
        return pdf.assign(v=N.zero_phase(sos, v[:, None], padding)[:, 0])

    flat = long_samples(traces, "profile_id", "trace_idx")
    return flat.groupBy("profile_id", "sample_idx").applyInPandas(run, flat.schema)


def high_pass(traces: DataFrame, wavelength: float, spacing: float) -> DataFrame:
    """Keep features shorter than ``wavelength`` (m) of traces ``spacing`` metres apart."""
    return horizontal_filter(traces, [2 / _count(wavelength, spacing)], 5, "high")


def low_pass(traces: DataFrame, wavelength: float, spacing: float) -> DataFrame:
    return horizontal_filter(traces, [2 / _count(wavelength, spacing)], 3, "low")


def horizontal_band_pass(traces: DataFrame, short: float, long: float, spacing: float) -> DataFrame:
    if not 0 < short < long:
        raise ValueError("wavelengths must rise")
    return horizontal_filter(traces, [2 / _count(long, spacing), 2 / _count(short, spacing)], 5, "bandpass")


def _count(wavelength: float, spacing: float) -> int:
    n = int(wavelength / spacing)
    if n <= 2:
        raise ValueError("the wavelength spans too few traces")
    return n
