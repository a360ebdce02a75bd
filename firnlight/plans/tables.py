"""The driver's tables as radar data, by formulas that SQL repeats.

``embeddings`` serves as a radargram of 64 samples a trace: the trace is the
vector, its index ``vec_id``. Geometry, triggers and picks follow from the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SNUM = 64
DT = 1e-8

#: The same tables for DuckDB: tr (a trace a row), s (a sample a row), pk (picks).
TR = """tr AS (
  SELECT vec_id::INT AS i, label::VARCHAR AS p, list_transform(embedding, lambda x: x::DOUBLE) AS a,
         0.005::DOUBLE * (vec_id - vec_id // 10) AS dist, -80.0::DOUBLE + 0.0001::DOUBLE * vec_id AS lat, 170.0::DOUBLE + 0.0002::DOUBLE * vec_id AS lon,
         1000.0::DOUBLE + 0.2::DOUBLE * (vec_id % 50) AS elev, 738885.0::DOUBLE + vec_id / 86400.0::DOUBLE AS decday, (vec_id % 3)::INT AS trig,
         3.0::DOUBLE * vec_id AS x, 2.0::DOUBLE * vec_id + (vec_id % 7) AS y FROM embeddings)"""
S = TR + """, s AS (SELECT i, p, unnest(range(64))::INT AS k, unnest(a) AS v FROM tr)"""
PK = TR + """, pk AS (
  SELECT i, n::INT AS n, CASE WHEN i % 17 = n THEN NULL ELSE (10 * n + i % 5 - 2)::DOUBLE END AS samp1,
         CASE WHEN i % 17 = n THEN NULL ELSE (10 * n + i % 5)::DOUBLE END AS samp2,
         CASE WHEN i % 17 = n THEN NULL ELSE (10 * n + i % 5 + 2)::DOUBLE END AS samp3,
         CASE WHEN i % 17 = n THEN NULL ELSE list_sum(list_transform(a[10 * n + i % 5 - 1:10 * n + i % 5 + 3], lambda v: v * v)) / 5 END AS power
  FROM tr, (SELECT unnest([1, 2, 3]) AS n))"""


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def traces(spark: SparkSession, sf_dir: str, by_label: bool = False) -> DataFrame:
    """One row per trace; a single profile, or one for each label."""
    i = F.col("vec_id")
    profile = F.col("label").cast("string") if by_label else F.lit("all")
    return read(spark, sf_dir, "embeddings").select(
        profile.alias("profile_id"),
        i.cast("int").alias("trace_idx"),
        (i + 1).cast("int").alias("trace_num"),
        (F.lit(0.005) * (i - F.floor(i / 10))).alias("dist"),
        (F.lit(-80.0) + F.lit(0.0001) * i).alias("lat"),
        (F.lit(170.0) + F.lit(0.0002) * i).alias("long"),
        (F.lit(1000.0) + F.lit(0.2) * (i % 50)).alias("elev"),
        (F.lit(738885.0) + i / F.lit(86400.0)).alias("decday"),
        (i % 3).cast("int").alias("trig"),
        (F.lit(3.0) * i).alias("x_coord"),
        (F.lit(2.0) * i + i % 7).alias("y_coord"),
        F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
    )


def travel_time() -> list[float]:
    """Two-way travel time of each sample, microseconds."""
    return [0.01 * k for k in range(SNUM)]


def picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers on every trace, each missing on every seventeenth."""
    base = traces(spark, sf_dir).select("profile_id", "trace_idx", "samples", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("picknum"))
    centre = 10 * F.col("picknum") + F.col("trace_idx") % 5
    there = F.col("trace_idx") % 17 != F.col("picknum")

    def dense(c: Column) -> Column:
        return F.when(there, c.cast("double"))

    window = F.slice("samples", centre - 1, F.lit(5))
    power = F.aggregate(window, F.lit(0.0), lambda acc, v: acc + v * v) / 5
    return base.select("profile_id", "picknum", "trace_idx", dense(centre - 2).alias("samp1"), dense(centre).alias("samp2"),
                       dense(centre + 2).alias("samp3"), dense(power).alias("power"))


def samples(df: DataFrame, *keep: str, column: str = "samples") -> DataFrame:
    """One row per sample: the kept columns, sample_idx and v."""
    return df.select(*keep, F.posexplode(column).alias("sample_idx", "v"))


def r6(c: Column | str) -> Column:
    """Rounded for comparison, without negative zeros."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)
