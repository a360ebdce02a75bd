"""Readers of text: headers, GPS sentences and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import gga


def key_values(lines: list[str], separator: str = "=") -> dict[str, str]:
    """A header's keys and values."""
    out = {}
    for line in lines:
        key, found, value = line.partition(separator)
        if found:
            out[key.strip()] = value.strip()
    return out


def header(spark: SparkSession, path: str, separator: str = "=") -> dict[str, str]:
    """The keys of one header file, read whole, so that its lines keep their order."""
    return key_values([line for r in spark.read.text(path, wholetext=True).collect() for line in r[0].splitlines()], separator)


def sentences(spark: SparkSession, path: str, mark: str, number: str) -> DataFrame:
    """GPS fixes of a file in which a line with the trace number comes before each GGA sentence.

    ``mark``: what such lines start with, ``number``: a pattern whose group is the
    number. Files are read whole, so the order of lines is theirs.
    """
    return fixes_of(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("fn"), "value"), mark, number)


def fixes_of(files: DataFrame, mark: str, number: str) -> DataFrame:
    """The same of files given as rows of fn and value, the whole text."""
    whole = files.select("fn", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    before = Window.partitionBy("fn").orderBy("line_no")
    trace = F.when(F.col("line").startswith(mark), F.regexp_extract("line", number, 1).try_cast("double"))
    found = whole.withColumn("trace_num", F.last(trace, ignorenulls=True).over(before)).where(F.col("line").rlike(r"^\$..GGA"))
    return found.select("fn", "trace_num", *[v.alias(k) for k, v in gga(F.col("line")).items()])


#: What lines with a trace number start with, and the pattern of the number, in the two kinds of files.
DZG, PULSE = ("$GSSIS", r"^\$GSSIS,(\d+)"), ("Trace", r"Trace #(\d+)")


def dzg(spark: SparkSession, path: str) -> DataFrame:
    return sentences(spark, path, *DZG)


def pulse_gps(spark: SparkSession, path: str) -> DataFrame:
    return sentences(spark, path, *PULSE)


def cor_table(spark: SparkSession, path: str) -> DataFrame:
    """Positions of a tab-separated table: trace, date, time, latitude, N or S, longitude, E or W, elevation, unit, dilution."""
    schema = "trace_num int, date string, time string, lat double, ns string, long double, ew string, elev double, unit string, pdop double"
    rows = spark.read.csv(path, sep="\t", schema=schema)
    sign = lambda c, minus: F.when(F.col(c) == minus, -1).otherwise(1)
    named = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1).alias("profile_id")
    return rows.select(named, "trace_num", F.try_to_timestamp(F.concat_ws(" ", "date", "time")).alias("ts"), (F.col("lat") * sign("ns", "S")).alias("lat"),
                       (F.col("long") * sign("ew", "W")).alias("long"), "elev", "pdop")


def table(spark: SparkSession, path: str, names: list[str], delimiter: str | None = None) -> DataFrame:
    """Numbers of a table split by white space, or by ``delimiter``; lines that start with # are left out."""
    parts = F.split(F.trim("value"), r"\s+" if delimiter is None else delimiter)
    rows = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.length(F.trim("value")) > 0))
    return rows.select(*[F.trim(F.get(parts, i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def gps_table(spark: SparkSession, path: str, names: str = "decday,long,lat,elev", delimiter: str | None = None) -> DataFrame:
    return table(spark, path, names.split(","), delimiter)


def read_trace_texts(spark: SparkSession, path: str) -> DataFrame:
    """One file per trace: date, time, lat, long, elev, dt and samples, tab-separated; ordered by time."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("fn"), part.alias("p"))
    number = lambda i: F.get("p", F.lit(i)).try_cast("double")
    out = rows.select(
        "fn", F.try_to_timestamp(F.concat_ws(" ", F.get("p", F.lit(0)), F.get("p", F.lit(1)))).alias("ts"), number(2).alias("lat"), number(3).alias("long"), number(4).alias("elev"),
        number(5).alias("dt"), F.transform(F.slice("p", 7, F.greatest(F.size("p") - 6, F.lit(0))), lambda v: v.try_cast("double")).alias("samples"))
    order = Window.partitionBy(F.regexp_replace("fn", "/[^/]*$", "")).orderBy("ts", "fn")
    return out.withColumn("trace_idx", (F.row_number().over(order) - 1).cast("int")).withColumn("profile_id", F.lit("osu"))


def gps_mat(spark: SparkSession, path: str) -> DataFrame:
    """GPS fixes of MATLAB level-5 files with decday, long, lat and elev."""
    from .matlab import gps_rows

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                yield gps_rows(bytes(content))

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "decday double, long double, lat double, elev double")
