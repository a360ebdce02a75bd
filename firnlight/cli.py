"""Command line: convert files, process stored profiles and export picks.

    python -m firnlight.cli load KIND PATH OUT
    python -m firnlight.cli proc IN OUT --dt 1e-8 [--hcrop N] [--restack N] [--rev] [--vbp LOW HIGH] [--hfilt A B] [--ahfilt N] [--nmo SEP V] [--denoise V H] [--interp SPACING] [--crop A B] [--migrate KIND SPACING V]
    python -m firnlight.cli step NAME IN OUT --dt 1e-8 [--args A ...]     one step: agc, rgain, elev, lp, hp, hbp, rev and those of proc
    python -m firnlight.cli cat IN ... OUT
    python -m firnlight.cli geolocate IN OUT --gps FIXES [--offset D] [--extrapolate]
    python -m firnlight.cli migrate IN OUT --kind stolt --dt 1e-8 --spacing 5 [--velocity V | --table FILE] [--taper ACROSS DOWN]
    python -m firnlight.cli convert KIND PATH OUT --to segy|csv|points|parquet
    python -m firnlight.cli apres PATH OUT --bandwidth B --centre F --rate K [--speed V] [--max-range R] [--bed R]     range profiles of bursts, stacked
    python -m firnlight.cli export IN OUT --picks PICKS --layers 1 2 --dt 1e-8
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession


#: Steps by name: the method of a profile, and which of its numbers are whole.
STEPS = {
    "agc": ("agc", 1), "rgain": ("gain", 0), "elev": ("elevate", 0), "lp": ("low_pass", 0), "hp": ("high_pass", 0), "hbp": ("horizontal_band_pass", 0),
    "rev": ("reverse", 0), "hcrop": ("hcrop", 1), "restack": ("restack", 1), "vbp": ("band_pass", 0), "hfilt": ("remove_mean", 2), "ahfilt": ("adaptive", 1),
    "nmo": ("moveout", 0), "denoise": ("denoise", 2), "interp": ("respace", 0), "crop": ("crop", 2),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="firnlight")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="read vendor files and store their traces")
    load.add_argument("kind")
    load.add_argument("path")
    load.add_argument("out")
    load.add_argument("--s-srs", help="system of the files' coordinates, for degrees")
    load.add_argument("--t-srs", help="system to project degrees to")
    proc = sub.add_parser("proc", help="process stored traces in the fixed order of steps")
    proc.add_argument("path")
    proc.add_argument("out")
    proc.add_argument("--dt", type=float, required=True, help="seconds between samples")
    proc.add_argument("--hcrop", type=int)
    proc.add_argument("--restack", type=int)
    proc.add_argument("--rev", action="store_true", default=None)
    proc.add_argument("--ahfilt", type=int)
    proc.add_argument("--interp", type=float)
    for name, n in (("vbp", 2), ("hfilt", 2), ("nmo", 2), ("denoise", 2), ("crop", 2)):
        proc.add_argument(f"--{name}", nargs=n, type=float)
    proc.add_argument("--migrate", nargs=3)
    step = sub.add_parser("step", help="apply one step")
    step.add_argument("name", choices=sorted(STEPS))
    step.add_argument("path")
    step.add_argument("out")
    step.add_argument("--dt", type=float, required=True)
    step.add_argument("--args", nargs="*", type=float, default=[])
    cat = sub.add_parser("cat", help="profiles one after the other")
    cat.add_argument("paths", nargs="+")
    cat.add_argument("out")
    place = sub.add_parser("geolocate", help="positions from GPS fixes, a table of decday, long, lat, elev")
    place.add_argument("path")
    place.add_argument("out")
    place.add_argument("--gps", required=True)
    place.add_argument("--offset", type=float, default=0.0)
    place.add_argument("--extrapolate", action="store_true")
    migrate = sub.add_parser("migrate", help="migrate stored traces")
    migrate.add_argument("path")
    migrate.add_argument("out")
    migrate.add_argument("--kind", choices=("kirch", "stolt", "phsh", "ffd", "tk"), default="stolt")
    migrate.add_argument("--dt", type=float, required=True)
    migrate.add_argument("--spacing", type=float, required=True, help="metres between traces")
    migrate.add_argument("--velocity", type=float, default=1.68e8)
    migrate.add_argument("--table", help="a file of velocities and depths, for phsh and ffd")
    migrate.add_argument("--taper", nargs=2, type=int, default=(10, 10), metavar=("ACROSS", "DOWN"))
    convert = sub.add_parser("convert", help="read vendor files and write them in another form")
    convert.add_argument("kind")
    convert.add_argument("path")
    convert.add_argument("out")
    convert.add_argument("--to", choices=("segy", "csv", "points", "parquet"), required=True)
    convert.add_argument("--s-srs")
    convert.add_argument("--t-srs")
    apres = sub.add_parser("apres", help="range profiles of phase-sensitive bursts, a file an acquisition, its chirps stacked")
    apres.add_argument("path")
    apres.add_argument("out")
    for name in ("bandwidth", "centre", "rate"):
        apres.add_argument(f"--{name}", type=float, required=True)
    apres.add_argument("--speed", type=float, default=1.68e8)
    apres.add_argument("--max-range", type=float, default=4000.0)
    apres.add_argument("--bed", type=float, default=0.0, help="range below which there is noise only")
    export = sub.add_parser("export", help="write picks as text, a line per trace")
    export.add_argument("path")
    export.add_argument("out")
    export.add_argument("--picks", required=True)
    export.add_argument("--layers", nargs="+", type=int, required=True)
    export.add_argument("--dt", type=float, required=True)
    return p


def steps_of(args: argparse.Namespace) -> dict:
    out: dict = {}
    for name in ("hcrop", "restack", "ahfilt", "interp"):
        if getattr(args, name) is not None:
            out[name] = getattr(args, name)
    if args.rev:
        out["rev"] = True
    for name in ("vbp", "nmo"):
        if getattr(args, name):
            out[name] = tuple(getattr(args, name))
    for name in ("hfilt", "crop", "denoise"):
        if getattr(args, name):
            out[name] = tuple(int(v) for v in getattr(args, name))
    if args.migrate:
        out["migrate"] = (args.migrate[0], float(args.migrate[1]), float(args.migrate[2]))
    return out


def converted(spark: SparkSession, args: argparse.Namespace) -> None:
    """Files of a kind as SEG-Y, a line a trace, points, or stored traces."""
    from pyspark.sql import functions as F

    from .sources.binary import load
    from .sources.sinks import write_points, write_segy_files

    traces = load(spark, args.kind, args.path, args.s_srs, args.t_srs)
    plain = traces.drop("samples", "header")
    if args.to == "parquet":
        traces.write.parquet(args.out)
    elif args.to == "csv":
        plain.write.csv(args.out, header=True)
    elif args.to == "points":
        write_points(args.out, plain.where("lat is not null and long is not null"))
    else:
        step = traces.select(F.round(F.col("dt") * 1e9).cast("int").alias("dt")).first()
        write_segy_files(traces, args.out, step["dt"] if step else 1)


def acquisitions(spark: SparkSession, args: argparse.Namespace) -> None:
    """Range profile of each file of bursts: range, power in dB, phase and its uncertainty."""
    from pyspark.sql import functions as F

    from .operators.apres import single_chain
    from .sources.binary import load

    chirps = load(spark, "apres", args.path).select(F.col("profile_id").alias("acq_id"), F.lit(0).alias("burst"), F.col("trace_idx").alias("chirp"), "samples")
    size = chirps.select(F.size("samples").alias("n")).first()
    out = single_chain(chirps, args.bed, bandwidth=args.bandwidth, centre=args.centre, rate=args.rate, speed=args.speed, max_range=args.max_range, snum=size["n"] if size else 1)
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    out.select("acq_id", "sample_idx", "range", F.when(power > 0, 10 * F.log10(power)).alias("db"), F.atan2("im", "re").alias("phase"), "uncertainty").write.parquet(args.out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "load":
        from .sources.binary import load

        load(spark, args.kind, args.path, args.s_srs, args.t_srs).write.parquet(args.out)
        return
    if args.command == "cat":
        from functools import reduce

        from .operators.shape import concat

        parts = [spark.read.parquet(p) for p in args.paths]
        concat(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)).write.parquet(args.out)
        return
    if args.command == "geolocate":
        from .operators.geometry import gps_control
        from .sources.text import gps_table

        gps_control(spark.read.parquet(args.path), gps_table(spark, args.gps), args.offset, args.extrapolate).write.parquet(args.out)
        return
    if args.command in ("convert", "apres"):
        converted(spark, args) if args.command == "convert" else acquisitions(spark, args)
        return
    traces = spark.read.parquet(args.path)
    first = traces.selectExpr("size(samples) AS n").first()
    times = tuple(args.dt * 1e6 * k for k in range(first["n"] if first else 0))
    if args.command == "proc":
        from .plans.profile import Profile, process

        process(Profile(traces, times, args.dt), **steps_of(args)).traces.write.parquet(args.out)
    elif args.command == "migrate":
        from .operators.migration import migrate, velocity_profile
        from .operators.windows import to_arrays
        from .sources.text import table

        velocity = args.velocity
        if args.table:  # a few rows: the layers of a profile
            velocity = velocity_profile([(r["v"], r["z"]) for r in table(spark, args.table, ["v", "z"]).collect()], list(times))
        image = to_arrays(migrate(traces, args.kind, list(times), args.spacing, velocity, *args.taper), "profile_id", "trace_idx")
        traces.drop("samples").join(image, ["profile_id", "trace_idx"]).select(*traces.columns).write.parquet(args.out)
    elif args.command == "step":
        from .plans.profile import Profile

        method, whole = STEPS[args.name]
        numbers = [int(v) if i < whole else v for i, v in enumerate(args.args)]
        getattr(Profile(traces, times, args.dt), method)(*numbers).traces.write.parquet(args.out)
    else:
        from .sources.sinks import target, write_csv

        column, name = target("twtt", None, list(times))
        write_csv(args.out, traces, spark.read.parquet(args.picks), args.layers, column, name)


if __name__ == "__main__":
    main()
