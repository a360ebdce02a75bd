"""Writers: the native Parquet layout, text tables, points and SEG-Y."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.picks import export_table
from .records import write_segy_files  # noqa: F401


def save(path: str, traces: DataFrame, picks: DataFrame | None = None, mode: str = "errorifexists") -> None:
    """Traces (partitioned by profile) and picks as Parquet under ``path``."""
    traces.write.mode(mode).partitionBy("profile_id").parquet(f"{path}/traces")
    if picks is not None:
        picks.write.mode(mode).parquet(f"{path}/picks")


def target(name: str | None, depth: list[float] | None, travel_time: list[float]) -> tuple[Column, str]:
    """What to write of a pick's samp2: depth, twtt or snum; by default depth where there is one."""
    from ..functions.arrays import doubles

    name = name or ("depth" if depth else "twtt")
    at = F.col("samp2").cast("int")
    if name == "depth":
        if not depth:
            raise ValueError("no depths")
        return F.get(doubles(depth), at), name
    if name == "twtt":
        return F.get(doubles(travel_time), at), name
    if name == "snum":
        return at.cast("double"), name
    raise ValueError(f"unknown target {name}")


def write_csv(path: str, traces: DataFrame, picks: DataFrame, layers: list[int], column: Column, name: str, delimiter: str = ",") -> None:
    """One line per trace with a column per layer."""
    export_table(picks, traces, layers, column, name).write.csv(path, sep=delimiter, header=True, emptyValue="", nullValue="nan")


def write_points(path: str, rows: DataFrame, x: str = "long", y: str = "lat") -> None:
    """GeoJSON features, one a line, with all other columns as properties."""
    others = [c for c in rows.columns if c not in (x, y)]
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates")).alias("geometry"), F.struct(*others).alias("properties"))
    rows.select(F.to_json(feature).alias("value")).write.text(path)
