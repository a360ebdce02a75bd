"""Queries of filters, picking, phase-sensitive radar, analysis and migration, with their SQL."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.filters import operator_matrix, padding_of, sections, steady_state
from ..plans.registry import query
from ..plans.tables import DT, PK, SNUM, S, TR, picks, r6, samples, traces, travel_time
from . import analysis as A
from . import apres as R
from . import filters as V
from . import migration as M
from . import picks as P

BAND = (10.0, 30.0)


def _matrix(kind: str = "butter", order: int = 3) -> np.ndarray:
    return operator_matrix(V.band_pass_operator(DT, *BAND, order, kind), SNUM)


def _values(m: np.ndarray) -> str:
    return "[" + ", ".join(repr(float(x)) for x in m.ravel()) + "]::DOUBLE[]"


def _by_matrix(kind: str, order: int) -> str:
    return f"""
WITH {S}, m AS (SELECT n // 64 AS r, n % 64 AS c, w FROM (SELECT unnest(range(4096)) AS n, unnest({_values(_matrix(kind, order))}) AS w))
SELECT i AS trace_idx, r::INT AS sample_idx, round(sum(v * w), 6) + 0.0 AS v FROM s JOIN m ON m.c = s.k GROUP BY 1, 2"""


def _long(df):
    return samples(df, "trace_idx").withColumn("v", r6("v"))


for _kind, _order in (("butter", 3), ("cheby1", 3), ("bessel", 3), ("fir", 8)):

    @query(f"bandpass_{_kind}", _by_matrix(_kind, _order))
    def bandpass(spark, d, kind=_kind, order=_order):
        return _long(V.vertical_band_pass(traces(spark, d), DT, *BAND, order, kind))


def _zero_phase(sos: np.ndarray, padding: int) -> str:
    """Tables of the recursion of a zero-phase filter, from l (key, x) to zp (key, j, v): j numbers the series from 0."""
    first = steady_state(sos) * np.cumprod([1.0, *(sos[:-1, :3].sum(1) / sos[:-1, 3:].sum(1))])[:, None]

    def run(name: str, source: str) -> str:
        state = [f"z{s}{n}" for s in range(len(sos)) for n in "12"]
        begin = ", ".join(f"{float(c)!r}::DOUBLE * x[1] AS {z}" for z, c in zip(state, first.ravel()))
        step = f"SELECT {name}.key, i + 1 AS i, x[i + 2] AS w, {', '.join(state)} FROM {name} JOIN {source} USING (key) WHERE i + 1 < len(x)"
        before = "w"
        for s, (b0, *_) in enumerate(sos):
            step = f"SELECT *, {float(b0)!r}::DOUBLE * {before} + z{s}1 AS w{s} FROM ({step})"
            before = f"w{s}"
        after = []
        for s, (_, b1, b2, _, a1, a2) in enumerate(sos):
            x, y = f"w{s - 1}" if s else "w", f"w{s}"
            after += [f"{float(b1)!r}::DOUBLE * {x} - {float(a1)!r}::DOUBLE * {y} + z{s}2", f"{float(b2)!r}::DOUBLE * {x} - {float(a2)!r}::DOUBLE * {y}"]
        return f"{name} AS (SELECT key, -1 AS i, 0.0::DOUBLE AS y, {begin} FROM {source} UNION ALL SELECT key, i, {before}, {', '.join(after)} FROM ({step}))"

    return f"""wide AS (SELECT key, list_concat(list_transform(range({padding}, 0, -1), lambda j: 2 * x[1] - x[j + 1]), x, list_transform(range(1, {padding + 1}), lambda j: 2 * x[len(x)] - x[len(x) - j])) AS x FROM l),
{run("f1", "wide")},
back AS (SELECT key, list(y ORDER BY i DESC) AS x FROM f1 WHERE i >= 0 GROUP BY key),
{run("f2", "back")},
zp AS (SELECT key, (len(x) - 1 - i - {padding})::INT AS j, y AS v FROM f2 JOIN back USING (key) WHERE i >= {padding} AND i < len(x) - {padding})"""


def _along(corners, order: int, btype: str) -> str:
    return f"""
WITH RECURSIVE {S}, l AS (SELECT k AS key, list(v ORDER BY i) AS x FROM s GROUP BY k), {_zero_phase(sections(order, corners, btype), padding_of(order, btype))}
SELECT j AS trace_idx, key AS sample_idx, round(v, 6) + 0.0 AS v FROM zp"""


@query("horizontal_bandpass", _along([2 / 50, 2 / 10], 5, "bandpass"))
def horizontal_bandpass(spark, d):
    return V.horizontal_band_pass(traces(spark, d), 20.0, 100.0, 2.0).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("horizontal_lowpass", _along([2 / 25], 3, "low"))
def horizontal_lowpass(spark, d):
    return V.low_pass(traces(spark, d), 50.0, 2.0).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("horizontal_highpass", _along([2 / 25], 5, "high"))
def horizontal_highpass(spark, d):
    return V.high_pass(traces(spark, d), 50.0, 2.0).select("trace_idx", "sample_idx", r6("v").alias("v"))


PICK = P.PickWindow.of(10.0, DT, SNUM)


def _pick_sql(mid: str) -> str:
    w = PICK
    return f"""
WITH {TR}, n AS (SELECT count(*) AS n FROM tr), p AS (SELECT i, floor({mid} - {w.length} / 2.0)::INT AS st, a[floor({mid} - {w.length} / 2.0)::INT + 1:floor({mid} - {w.length} / 2.0)::INT + {w.length}] AS p FROM tr, n),
c AS (SELECT *, list_position(p[{w.margin + 2}:{w.margin + 1 + w.half_wave}], list_max(p[{w.margin + 2}:{w.margin + 1 + w.half_wave}])) + {w.margin} AS c FROM p),
t AS (SELECT *, greatest(c - {w.half_wave}, 0) AS f FROM c),
u AS (SELECT *, CASE WHEN c <= 1 THEN 0 ELSE f + list_position(p[f + 1:c], list_min(p[f + 1:c])) - 1 END AS tp,
  CASE WHEN c >= {w.length - 1} THEN {w.length - 1} ELSE c + list_position(p[c + 2:c + 1 + {w.half_wave}], list_min(p[c + 2:c + 1 + {w.half_wave}])) END AS bt FROM t)
SELECT i AS trace_idx, (tp + st)::DOUBLE AS samp1, (c + st)::DOUBLE AS samp2, (bt + st)::DOUBLE AS samp3,
  round(list_sum(list_transform(p[tp + 1:bt + 1], lambda v: v * v)) / (bt - tp + 1), 6) + 0.0 AS power FROM u"""


OUT = ("trace_idx", "samp1", "samp2", "samp3")


@query("packet_pick", _pick_sql("(30 + i % 5)"))
def packet_pick(spark, d):
    return P.pick_packets(traces(spark, d), PICK, F.lit(30) + F.col("trace_idx") % 5).select(*OUT, r6("power").alias("power"))


@query("sql_packet_pick", _pick_sql("(30 + i % 5)"))
def sql_packet_pick(spark, d):
    """The same by the table function, in SQL."""
    tables.register(spark)
    w = PICK
    return spark.sql(
        f"SELECT t.trace_idx, p.samp1, p.samp2, p.samp3, round(p.power, 6) + 0D AS power FROM {{traces}} t, LATERAL pick_packet(t.samples, 30 + t.trace_idx % 5, {w.length}, {w.half_wave}, {w.margin}, {w.polarity}) p",
        traces=traces(spark, d)).select(*OUT, "power")


@query("guided_pick", _pick_sql("(round_even(i * (40 - 20)::DOUBLE / n, 0) + 20)"))
def guided_pick(spark, d):
    return P.guided_pick(traces(spark, d), PICK, 20, 40).select(*OUT, r6("power").alias("power"))


_HALF = PICK.length // 2 + 1


def _follow(source: str) -> str:
    """One pick around ``mid`` of the samples ``a`` of ``source`` (n, way, seed, i, mid, a), with the next one's ``mid``."""
    w = PICK
    return f"""SELECT n, way, seed, i, tp + st AS top, c + st AS mid_pick, bt + st AS bottom, list_sum(list_transform(p[tp + 1:bt + 1], lambda v: v * v)) / (bt - tp + 1) AS power,
  least(greatest((tp + bt + 2 * st) // 2, {_HALF}), {max(SNUM - _HALF, _HALF)})::INT AS mid
FROM (SELECT *, CASE WHEN c <= 1 THEN 0 ELSE f + list_position(p[f + 1:c], list_min(p[f + 1:c])) - 1 END AS tp,
  CASE WHEN c >= {w.length - 1} THEN {w.length - 1} ELSE c + list_position(p[c + 2:c + 1 + {w.half_wave}], list_min(p[c + 2:c + 1 + {w.half_wave}])) END AS bt
FROM (SELECT *, greatest(c - {w.half_wave}, 0) AS f FROM (SELECT *, list_position(p[{w.margin + 2}:{w.margin + 1 + w.half_wave}], list_max(p[{w.margin + 2}:{w.margin + 1 + w.half_wave}])) + {w.margin} AS c
FROM (SELECT *, floor(mid - {w.length} / 2.0)::INT AS st, a[floor(mid - {w.length} / 2.0)::INT + 1:floor(mid - {w.length} / 2.0)::INT + {w.length}] AS p FROM ({source})))))"""


@query("auto_pick", f"""
WITH RECURSIVE {TR}, sd AS (SELECT * FROM (VALUES (1, 100, 25, -1), (1, 100, 25, 1), (2, 0, 40, -1), (2, 0, 40, 1)) AS t(n, seed, mid, way)),
f0 AS (SELECT n, way, seed, mid, CASE WHEN way < 0 THEN max(i) ELSE min(i) END AS i FROM sd JOIN tr ON (tr.i - seed) * way >= 0 GROUP BY n, way, seed, mid),
fl AS ({_follow("SELECT f0.*, a FROM f0 JOIN tr ON f0.i = tr.i")}
  UNION ALL {_follow("SELECT n, way, seed, tr.i, mid, a FROM fl JOIN tr ON tr.i = fl.i + way")})
SELECT n::INT AS picknum, i AS trace_idx, top::DOUBLE AS samp1, mid_pick::DOUBLE AS samp2, bottom::DOUBLE AS samp3, round(power, 6) + 0.0 AS power FROM fl WHERE i <> seed OR way < 0""")
def auto_pick(spark, d):
    return P.auto_pick(traces(spark, d), PICK, [(1, 100, 25), (2, 0, 40)]).select("picknum", *OUT, r6("power").alias("power"))


@query("pick_smooth", f"""
WITH RECURSIVE {PK}, r AS (SELECT *, sum((samp2 IS NULL)::INT) OVER (PARTITION BY n ORDER BY i) AS run FROM pk),
q AS (SELECT n, i, run, c, CASE c WHEN 1 THEN samp1 WHEN 2 THEN samp2 ELSE samp3 END AS v, row_number() OVER (PARTITION BY n, run, c ORDER BY i) - 1 AS j
  FROM r, (SELECT unnest([1, 2, 3]) AS c) WHERE samp2 IS NOT NULL),
l AS (SELECT {{'n': n, 'run': run, 'c': c}} AS key, list(v ORDER BY i) AS x FROM q GROUP BY n, run, c HAVING count(*) > {padding_of(3, "low")}),
{_zero_phase(sections(3, [2 / 6], "low"), padding_of(3, "low"))},
o AS (SELECT q.n, q.i, q.c, coalesce(round_even(zp.v, 0), q.v) + 0.0 AS v FROM q LEFT JOIN zp ON zp.key = {{'n': q.n, 'run': q.run, 'c': q.c}} AND zp.j = q.j)
SELECT pk.n AS picknum, pk.i AS trace_idx, max(v) FILTER (c = 1) AS samp1, max(v) FILTER (c = 2) AS samp2, max(v) FILTER (c = 3) AS samp3
FROM pk LEFT JOIN o ON o.n = pk.n AND o.i = pk.i GROUP BY 1, 2""")
def pick_smooth(spark, d):
    return P.smooth_picks(picks(spark, d), 6).select("picknum", *OUT)


@query("layer_flatten", f"""
WITH {PK}, l AS (SELECT trunc(avg(samp2))::INT AS l FROM pk WHERE n = 2), j AS (SELECT unnest(range(64))::INT AS j)
SELECT tr.i AS trace_idx, j AS sample_idx, CASE WHEN j - (l - samp2) >= 0 AND j - (l - samp2) < 64 THEN round(a[(j - (l - samp2))::INT + 1], 6) + 0.0 END AS v
FROM tr JOIN pk ON tr.i = pk.i AND pk.n = 2, l, j""")
def layer_flatten(spark, d):
    return P.flatten_layer(traces(spark, d), picks(spark, d), 2).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("pick_power_map", f"WITH {PK} SELECT tr.i AS trace_idx, x AS x_coord, y AS y_coord, CASE WHEN power > 0 THEN round(10 * log10(power), 5) + 0.0 END AS db FROM tr JOIN pk ON tr.i = pk.i AND n = 1")
def pick_power_map(spark, d):
    return P.pick_power_map(picks(spark, d), traces(spark, d), 1).select("trace_idx", "x_coord", "y_coord", (F.round("db", 5) + F.lit(0.0)).alias("db"))


@query("last_traces", f"WITH {PK} SELECT n AS picknum, max(i)::INT AS tnum, arg_max(samp2, i) AS snum FROM pk WHERE samp2 IS NOT NULL GROUP BY n")
def last_traces(spark, d):
    return P.last_traces(picks(spark, d)).select("picknum", "tnum", "snum")


@query("csv_export", f"""
WITH {PK} SELECT i AS trace_idx, (i + 1)::INT AS tnum, max(round(samp2 * 0.845::DOUBLE, 6) + 0.0) FILTER (n = 1) AS layer_1_depth, max(round(samp2 * 0.845::DOUBLE, 6) + 0.0) FILTER (n = 3) AS layer_3_depth FROM pk GROUP BY i""")
def csv_export(spark, d):
    out = P.export_table(picks(spark, d), traces(spark, d), [1, 3], r6(F.col("samp2") * 0.845), "depth")
    return out.select("trace_idx", "tnum", "layer_1_depth", "layer_3_depth")


@query("vertical_spectrum", f"""
WITH {S}, b AS (SELECT unnest(range(32))::INT AS b), f AS (SELECT i, b, sum(v * cos(2 * pi() * (b * k % 64) / 64)) AS re, sum(v * sin(2 * pi() * (b * k % 64) / 64)) AS im FROM s, b GROUP BY 1, 2)
SELECT b AS bin, round(avg(re * re + im * im), 6) + 0.0 AS power, round(b / 0.64, 6) + 0.0 AS mhz FROM f GROUP BY b""")
def vertical_spectrum(spark, d):
    return R.vertical_spectrum(traces(spark, d), DT, SNUM).select("bin", r6("power").alias("power"), r6("mhz").alias("mhz"))


@query("horizontal_spectrum", f"""
WITH {S}, n AS (SELECT count(*) AS n FROM tr), b AS (SELECT unnest(range((n + 1) // 2))::INT AS b FROM n),
f AS (SELECT b, k, n, sum(v * cos(2 * pi() * (b * i % n) / n)) AS re, sum(v * sin(2 * pi() * (b * i % n) / n)) AS im FROM s, b, n GROUP BY ALL)
SELECT b AS bin, round(avg(re * re + im * im), 4) + 0.0 AS power, CASE WHEN b > 0 THEN round(any_value(2.0 * n / b), 6) + 0.0 END AS wavelength FROM f GROUP BY b""")
def horizontal_spectrum(spark, d):
    return R.horizontal_spectrum(traces(spark, d), 2.0).select("bin", (F.round("power", 4) + F.lit(0.0)).alias("power"), r6("wavelength").alias("wavelength"))


@query("periodogram", f"""
WITH {S}, c AS (SELECT i, k, v - avg(v) OVER (PARTITION BY i) AS v FROM s), b AS (SELECT unnest(range(33))::INT AS b),
f AS (SELECT i, b, sum(v * cos(2 * pi() * (b * k % 64) / 64)) AS re, sum(v * sin(2 * pi() * (b * k % 64) / 64)) AS im FROM c, b GROUP BY 1, 2)
SELECT i AS trace_idx, b AS bin, round((re * re + im * im) / 4096 * CASE WHEN b IN (0, 32) THEN 1 ELSE 2 END, 8) + 0.0 AS power FROM f""")
def periodogram(spark, d):
    return R.periodogram(traces(spark, d), DT, SNUM).select("trace_idx", "bin", (F.round("power", 8) + F.lit(0.0)).alias("power"))


def _pairs(spark, d):
    """Pairs of complex profiles of 32 samples from traces 2k and 2k + 1."""
    flat = traces(spark, d).select((F.floor(F.col("trace_idx") / 2)).cast("int").alias("pair_id"), (F.col("trace_idx") % 2).alias("w"),
                                   F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.struct(F.get("samples", 2 * s).alias("re"), F.get("samples", 2 * s + 1).alias("im")))).alias("sample_idx", "z"))
    def of(w, part):
        return F.max(F.when(F.col("w") == w, F.col("z")[part]))

    return flat.groupBy("pair_id", "sample_idx").agg(of(0, "re").alias("re1"), of(0, "im").alias("im1"), of(1, "re").alias("re2"), of(1, "im").alias("im2"))


PAIR = TR + """, z AS (SELECT i // 2 AS pair_id, i % 2 AS w, s, a[2 * s + 1] AS re, a[2 * s + 2] AS im FROM tr, (SELECT unnest(range(32))::INT AS s)),
pr AS (SELECT pair_id::INT AS pair_id, s, max(re) FILTER (w = 0) AS r1, max(im) FILTER (w = 0) AS i1, max(re) FILTER (w = 1) AS r2, max(im) FILTER (w = 1) AS i2 FROM z GROUP BY 1, 2),
c AS (SELECT pair_id, s, sum(r1 * r2 + i1 * i2) OVER w AS x, sum(i1 * r2 - r1 * i2) OVER w AS y, sqrt(sum(r1 * r1 + i1 * i1) OVER w * sum(r2 * r2 + i2 * i2) OVER w) AS q FROM pr
  WINDOW w AS (PARTITION BY pair_id ORDER BY s ROWS BETWEEN 4 PRECEDING AND 3 FOLLOWING)),
co AS (SELECT pair_id, ((s - 4) // 2)::INT AS k, x / q AS re, y / q AS im FROM c WHERE s >= 4 AND s < 28 AND (s - 4) % 2 = 0)"""
UNWRAP = PAIR + """, raw AS (SELECT *, atan2(im, re) AS raw, max(sqrt(re * re + im * im)) OVER (PARTITION BY pair_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS near FROM co),
j AS (SELECT *, raw - lag(raw) OVER (PARTITION BY pair_id ORDER BY k) AS j FROM raw),
ph AS (SELECT pair_id, k, re, im, raw + sum(CASE WHEN near < 0.3 THEN 0 WHEN j > pi() THEN -2 * pi() WHEN j < -pi() THEN 2 * pi() ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY k) AS phi FROM j),
df AS (SELECT *, 20.0 * k AS rg, phi / (4 * pi() / 0.56 - 4 * (20.0 * k) * 2e8 / (1.68e8 * 1.68e8)) AS w FROM ph)"""


def _unwrapped(spark, d):
    return R.unwrap(R.phase_difference(_pairs(spark, d), 8, 2), 3, 0.3)


def _differences(spark, d):
    return R.range_difference(_unwrapped(spark, d).withColumn("range", F.col("ds_idx") * 20.0), 0.56, 2e8, 1.68e8, 8)


@query("phase_diff", f"WITH {PAIR} SELECT pair_id, k AS ds_idx, round(re, 6) + 0.0 AS co_re, round(im, 6) + 0.0 AS co_im FROM co")
def phase_diff(spark, d):
    return R.phase_difference(_pairs(spark, d), 8, 2).select("pair_id", "ds_idx", r6("co_re").alias("co_re"), r6("co_im").alias("co_im"))


@query("phase_unwrap", f"WITH {UNWRAP} SELECT pair_id, k AS ds_idx, round(phi, 6) + 0.0 AS phi FROM ph")
def phase_unwrap(spark, d):
    return _unwrapped(spark, d).select("pair_id", "ds_idx", r6("phi").alias("phi"))


@query("range_diff", f"WITH {UNWRAP} SELECT pair_id, k AS ds_idx, round(w, 6) + 0.0 AS w, round(sqrt(greatest(1 - (re * re + im * im), 0) / 16) / sqrt(re * re + im * im) * 0.56 / (4 * pi()), 6) + 0.0 AS w_err FROM df")
def range_diff(spark, d):
    return _differences(spark, d).select("pair_id", "ds_idx", r6("w").alias("w"), r6("w_err").alias("w_err"))


@query("strain_rate", f"WITH {UNWRAP} SELECT pair_id, round(regr_slope(w, rg), 8) + 0.0 AS strain, round(regr_intercept(w, rg), 6) + 0.0 AS w0, round(regr_r2(w, rg), 5) + 0.0 AS r2 FROM df WHERE rg > 10 AND rg < 200 GROUP BY 1")
def strain_rate(spark, d):
    out = R.strain_rate(_differences(spark, d), 10.0, 200.0)
    return out.select("pair_id", (F.round("strain", 8) + F.lit(0.0)).alias("strain"), r6("w0").alias("w0"), (F.round("r2", 5) + F.lit(0.0)).alias("r2"))


@query("difference_chain", f"""
WITH {UNWRAP.replace('3 PRECEDING AND 2 FOLLOWING', '10 PRECEDING AND 9 FOLLOWING').replace('near < 0.3', 'near < 0.9')}
SELECT pair_id, round(regr_slope(w, rg), 8) + 0.0 AS strain, round(regr_intercept(w, rg), 6) + 0.0 AS w0 FROM df WHERE rg > 10 AND rg < 200 GROUP BY 1""")
def difference_chain(spark, d):
    pair = _pairs(spark, d).withColumn("range", (F.col("sample_idx") - 4) * 10.0)
    strain = R.difference_chain(pair, 8, 2, 0.56, 2e8, 1.68e8, 10.0, 200.0).strain
    return strain.select("pair_id", (F.round("strain", 8) + F.lit(0.0)).alias("strain"), r6("w0").alias("w0"))


@query("chirp_stack", f"WITH {S}, a AS (SELECT *, i // 10 AS q, row_number() OVER (PARTITION BY i // 10, k ORDER BY i) AS n FROM s) SELECT q::INT AS acq_id, k AS sample_idx, round(avg(v), 6) + 0.0 AS v FROM a WHERE n <= 6 GROUP BY 1, 2")
def chirp_stack(spark, d):
    return R.stack_chirps(_chirps(spark, d), 6).withColumn("v", r6("v"))


def _chirps(spark, d):
    return traces(spark, d).select(F.floor(F.col("trace_idx") / 10).cast("int").alias("acq_id"), F.floor(F.col("trace_idx") / 5).cast("int").alias("burst"), (F.col("trace_idx") % 5).alias("chirp"), "samples")


W64 = np.blackman(64)


@query("range_conversion", f"""
WITH {S}, w AS (SELECT unnest(range(64)) AS k, unnest({_values(W64)}) AS w), c AS (SELECT i, s.k, (v - avg(v) OVER (PARTITION BY i)) * w AS v FROM s JOIN w ON s.k = w.k),
b AS (SELECT unnest(range(64))::INT AS b), f AS (SELECT i, b, sum(v * cos(2 * pi() * (b * k % 128) / 128)) AS re, -sum(v * sin(2 * pi() * (b * k % 128) / 128)) AS im FROM c, b GROUP BY 1, 2),
p AS (SELECT *, b / 4e8 AS tau FROM f), q AS (SELECT *, 2 * pi() * 3e8 * tau - 6e9 * tau * tau / 2 AS ph FROM p)
SELECT (i // 10)::INT AS acq_id, (i // 5)::INT AS burst, (i % 5)::INT AS chirp, b AS sample_idx, round(tau * 0.84e8, 6) + 0.0 AS range,
  round((re * cos(ph) + im * sin(ph)) * {math.sqrt(4) / 64 / math.sqrt(np.mean(W64**2))!r}, 6) + 0.0 AS re, round((im * cos(ph) - re * sin(ph)) * {math.sqrt(4) / 64 / math.sqrt(np.mean(W64**2))!r}, 6) + 0.0 AS im FROM q""")
def range_conversion(spark, d):
    out = R.range_convert(_chirps(spark, d), 2e8, 3e8, 6e9, 1.68e8)
    return out.select("acq_id", "burst", "chirp", "sample_idx", r6("range").alias("range"), r6("re").alias("re"), r6("im").alias("im"))


@query("single_chain", f"""
WITH {S}, w AS (SELECT unnest(range(64)) AS k, unnest({_values(W64)}) AS w), c AS (SELECT i, s.k, (v - avg(v) OVER (PARTITION BY i)) * w AS v FROM s JOIN w ON s.k = w.k),
b AS (SELECT unnest(range(64))::INT AS b), f AS (SELECT i, b, sum(v * cos(2 * pi() * (b * k % 128) / 128)) AS re, -sum(v * sin(2 * pi() * (b * k % 128) / 128)) AS im FROM c, b GROUP BY 1, 2),
p AS (SELECT *, b / 4e8 AS tau FROM f), q AS (SELECT *, 2 * pi() * 3e8 * tau - 6e9 * tau * tau / 2 AS ph, dense_rank() OVER (PARTITION BY i // 10, b ORDER BY i) AS n FROM p)
SELECT (i // 10)::INT AS acq_id, b AS sample_idx, round(avg(tau) * 0.84e8, 6) + 0.0 AS range,
  round(avg(re * cos(ph) + im * sin(ph)) * {math.sqrt(4) / 64 / math.sqrt(np.mean(W64**2))!r}, 6) + 0.0 AS re, round(avg(im * cos(ph) - re * sin(ph)) * {math.sqrt(4) / 64 / math.sqrt(np.mean(W64**2))!r}, 6) + 0.0 AS im
FROM q WHERE n <= 6 GROUP BY 1, 2""")
def single_chain(spark, d):
    out = R.single_chain(_chirps(spark, d), 10.0, 6, bandwidth=2e8, centre=3e8, rate=6e9, speed=1.68e8)
    return out.select("acq_id", "sample_idx", r6("range").alias("range"), r6("re").alias("re"), r6("im").alias("im"))


THETAS = [k * math.pi / 9 for k in range(10)]


def _sites(spark, d):
    def of(q, part):
        return F.max(F.when(F.col("q") == q, F.col("z")[part]))

    flat = traces(spark, d).select(F.floor(F.col("trace_idx") / 4).cast("int").alias("site"), (F.col("trace_idx") % 4).alias("q"),
                                   F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.struct(F.get("samples", 2 * s).alias("re"), F.get("samples", 2 * s + 1).alias("im")))).alias("sample_idx", "z"))
    names = ("hh", "hv", "vh", "vv")
    return flat.groupBy("site", "sample_idx").agg(*[of(q, p).alias(f"s{n}_{p}") for q, n in enumerate(names) for p in ("re", "im")])


QUAD = TR + f""", z AS (SELECT (i // 4)::INT AS site, i % 4 AS q, s, a[2 * s + 1] AS re, a[2 * s + 2] AS im FROM tr, (SELECT unnest(range(32))::INT AS s)),
st AS (SELECT site, s, {', '.join(f'max({p}) FILTER (q = {q}) AS {n}{p[0]}' for q, n in enumerate(('hh', 'hv', 'vh', 'vv')) for p in ('re', 'im'))} FROM z GROUP BY 1, 2),
th AS (SELECT unnest(range(10))::INT AS t, unnest({_values(np.cos(THETAS))}) AS c, unnest({_values(np.sin(THETAS))}) AS n),
ro AS (SELECT site, s, t, {', '.join(f'hh{p} * c * c + (vh{p} + hv{p}) * n * c + vv{p} * n * n AS h{p}, hv{p} * c * c + (vv{p} - hh{p}) * n * c - vh{p} * n * n AS x{p}, vv{p} * c * c - (vh{p} + hv{p}) * n * c + hh{p} * n * n AS v{p}' for p in 'ri')} FROM st, th),
an AS (SELECT site, s, t, 10 * log10(xr * xr + xi * xi) - avg(10 * log10(xr * xr + xi * xi)) OVER (PARTITION BY site, s) AS an FROM ro),
pc AS (SELECT a.site, a.s, a.t, (b.hr * b.vr + b.hi * b.vi) AS x, (b.hi * b.vr - b.hr * b.vi) AS y, b.hr * b.hr + b.hi * b.hi AS p, b.vr * b.vr + b.vi * b.vi AS q
  FROM ro a JOIN ro b ON a.site = b.site AND b.s >= a.s - 3 AND b.s < a.s + 3 AND b.s < 31 AND ((b.t - a.t + 12) % 10) < 4),
cc AS (SELECT site, s, t, sum(x) / sqrt(sum(p) * sum(q)) AS re, sum(y) / sqrt(sum(p) * sum(q)) AS im FROM pc GROUP BY 1, 2, 3)"""


@query("quadpol_rotation", f"WITH {QUAD} SELECT site, s AS sample_idx, t AS theta_idx, round(hr, 6) + 0.0 AS hh_re, round(xi, 6) + 0.0 AS hv_im, round(vr, 6) + 0.0 AS vv_re FROM ro")
def quadpol_rotation(spark, d):
    return R.rotate(_sites(spark, d), THETAS).select("site", "sample_idx", "theta_idx", *[r6(c).alias(c) for c in ("hh_re", "hv_im", "vv_re")])


@query("coherence2d", f"WITH {QUAD} SELECT site, s AS sample_idx, t AS theta_idx, round(re, 5) + 0.0 AS co_re, round(im, 5) + 0.0 AS co_im FROM cc")
def coherence2d(spark, d):
    out = R.coherence_2d(R.rotate(_sites(spark, d), THETAS), 2, 3)
    return out.select("site", "sample_idx", "theta_idx", *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("co_re", "co_im")])


@query("power_anomaly", f"WITH {QUAD} SELECT site, s AS sample_idx, t AS theta_idx, round(an, 5) + 0.0 AS anomaly FROM an")
def power_anomaly(spark, d):
    return R.power_anomaly(R.rotate(_sites(spark, d), THETAS)).select("site", "sample_idx", "theta_idx", (F.round("anomaly", 5) + F.lit(0.0)).alias("anomaly"))


@query("extinction_axis", f"WITH {QUAD} SELECT site, s AS sample_idx, arg_min(t, (an, t)) AS cpe_idx FROM an WHERE t >= 2 AND t < 8 GROUP BY 1, 2")
def extinction_axis(spark, d):
    return R.extinction_axis(R.power_anomaly(R.rotate(_sites(spark, d), THETAS)), 2, 8)


@query("phase_gradient", f"""
WITH {QUAD}, g AS (SELECT *, lag(re) OVER w AS r0, lead(re) OVER w AS r1, lag(im) OVER w AS i0, lead(im) OVER w AS i1 FROM cc WINDOW w AS (PARTITION BY site, t ORDER BY s)),
h AS (SELECT *, CASE WHEN r0 IS NULL THEN (r1 - re) / 1.5 WHEN r1 IS NULL THEN (re - r0) / 1.5 ELSE (r1 - r0) / 3.0 END AS dr, CASE WHEN i0 IS NULL THEN (i1 - im) / 1.5 WHEN i1 IS NULL THEN (im - i0) / 1.5 ELSE (i1 - i0) / 3.0 END AS di FROM g)
SELECT site, s AS sample_idx, t AS theta_idx, round((re * di - im * dr) / (re * re + im * im), 3) + 0.0 AS dphi FROM h""")
def phase_gradient(spark, d):
    co = R.coherence_2d(R.rotate(_sites(spark, d), THETAS), 2, 3)
    return R.phase_gradient(co, F.col("sample_idx") * 1.5).select("site", "sample_idx", "theta_idx", (F.round("dphi", 3) + F.lit(0.0)).alias("dphi"))


@query("phase_uncertainty_seeded", f"""
WITH {S}, w AS (SELECT unnest(range(64)) AS k, unnest({_values(W64)}) AS w), c AS (SELECT i, s.k, (v - avg(v) OVER (PARTITION BY i)) * w AS v FROM s JOIN w ON s.k = w.k),
b AS (SELECT unnest(range(64))::INT AS b), f AS (SELECT i, b, sum(v * cos(2 * pi() * (b * k % 128) / 128)) AS re, -sum(v * sin(2 * pi() * (b * k % 128) / 128)) AS im FROM c, b GROUP BY 1, 2),
p AS (SELECT *, b / 4e8 AS tau FROM f), q AS (SELECT *, 2 * pi() * 3e8 * tau - 6e9 * tau * tau / 2 AS ph FROM p),
z AS (SELECT i, b, tau * 0.84e8 AS r, (re * cos(ph) + im * sin(ph)) * {math.sqrt(4) / 64 / math.sqrt(np.mean(W64**2))!r} AS re, (im * cos(ph) - re * sin(ph)) * {math.sqrt(4) / 64 / math.sqrt(np.mean(W64**2))!r} AS im FROM q),
n AS (SELECT i // 10 AS acq, median(sqrt(re * re + im * im)) AS noise FROM z WHERE r > 10 GROUP BY 1),
h AS (SELECT z.*, noise, list_reduce([1::BIGINT, i // 10, i // 5, i % 5, b],
  lambda h, c: xor(xor(xor(h, c), xor(h, c) >> 16) * 73244475 % 4294967296, (xor(xor(h, c), xor(h, c) >> 16) * 73244475 % 4294967296) >> 15)) * 2 * pi() / 4294967296 AS turned FROM z JOIN n ON acq = i // 10),
e AS (SELECT *, abs(noise * sin(turned - atan2(im, re))) / sqrt(re * re + im * im) AS e FROM h)
SELECT (i // 10)::INT AS acq_id, (i // 5)::INT AS burst, i % 5 AS chirp, b AS sample_idx, CASE WHEN e <= 1 THEN round(asin(e), 5) + 0.0 END AS uncertainty FROM e""")
def phase_uncertainty_seeded(spark, d):
    out = R.range_convert(_chirps(spark, d), 2e8, 3e8, 6e9, 1.68e8)
    return R.phase_uncertainty(out, 10.0, 1).select("acq_id", "burst", "chirp", "sample_idx", (F.round("uncertainty", 5) + F.lit(0.0)).alias("uncertainty"))


def _layers(spark, d):
    z = (F.col("samp2") * 0.01 + F.col("trace_idx") * 0.001)
    return picks(spark, d).where("samp2 is not null").withColumn("z", z).withColumn("db", F.when(F.col("power") > 0, 10 * F.log10("power")))


LAY = PK + ", ly AS (SELECT *, samp2 * 0.01::DOUBLE + i * 0.001::DOUBLE AS z, CASE WHEN power > 0 THEN 10 * log10(power) END AS db FROM pk WHERE samp2 IS NOT NULL)"


@query("power_correction", f"""
WITH {LAY}, h AS (SELECT *, z * 1000 AS m FROM ly)
SELECT n AS picknum, i AS trace_idx, round(power * pow(2 * m, 2) / (CASE WHEN m - 50 <= 50 THEN 1 ELSE pow(m / (50 + (m - 50) * sqrt(1.6 / 3.12)), 2) END), 3) + 0.0 AS corrected_power FROM h""")
def power_correction(spark, d):
    rows = _layers(spark, d).withColumn("z", F.col("z") * 1000)
    return A.power_correction(rows, [1.6, 3.12], [0.0, 50.0]).select("picknum", "trace_idx", (F.round("corrected_power", 3) + F.lit(0.0)).alias("corrected_power"))


@query("attenuation_m2", f"WITH {LAY} SELECT n AS picknum, count(db)::BIGINT AS n, round(-regr_slope(db, z) / 2, 5) + 0.0 AS attenuation FROM ly GROUP BY 1")
def attenuation_m2(spark, d):
    return A.attenuation_layer(_layers(spark, d), ["picknum"]).select("picknum", "n", (F.round("attenuation", 5) + F.lit(0.0)).alias("attenuation"))


@query("attenuation_m2_deming", f"""
WITH {LAY}, s AS (SELECT n AS picknum, regr_sxx(db, z) AS a, regr_syy(db, z) AS b, regr_sxy(db, z) AS c FROM ly GROUP BY 1)
SELECT picknum, round(-((b * 0.01 - a + sqrt((b * 0.01 - a) * (b * 0.01 - a) + 0.04 * c * c)) / (0.02 * c)) / 2, 4) + 0.0 AS attenuation FROM s""")
def attenuation_m2_deming(spark, d):
    return A.attenuation_layer(_layers(spark, d), ["picknum"], 0.01).select("picknum", (F.round("attenuation", 4) + F.lit(0.0)).alias("attenuation"))


@query("attenuation_m5", f"""
WITH {LAY}, t AS (SELECT DISTINCT i FROM ly)
SELECT t.i AS trace_idx, CASE WHEN count(db) >= 5 THEN round(-regr_slope(db, z) / 2, 4) + 0.0 END AS attenuation FROM t JOIN ly ON ly.i >= t.i - 3 AND ly.i <= t.i + 3 GROUP BY 1""")
def attenuation_m5(spark, d):
    return A.attenuation_moving(_layers(spark, d), 7).select("trace_idx", (F.round("attenuation", 4) + F.lit(0.0)).alias("attenuation"))


@query("attenuation_m6a", f"""
WITH {LAY}, d AS (SELECT unnest([0.15, 0.3, 0.45]::DOUBLE[]) AS d)
SELECT d AS depth, count(db)::BIGINT AS n, CASE WHEN count(db) >= 5 THEN round(-regr_slope(db, z) / 2, 4) + 0.0 END AS attenuation FROM d JOIN ly ON abs(z - d) < 0.1 GROUP BY 1""")
def attenuation_m6a(spark, d):
    return A.attenuation_depths(_layers(spark, d), [0.15, 0.3, 0.45], 0.2).select("depth", "n", (F.round("attenuation", 4) + F.lit(0.0)).alias("attenuation"))


@query("attenuation_m7", f"""
WITH {LAY}, v AS (SELECT 10 * log10(exp(1.0)) / (-2 * a.z / ln(4 / 3.74 * b.power / a.power)) AS v FROM ly a JOIN ly b ON a.i = b.i AND a.n = 1 AND b.n = 2)
SELECT round(avg(v), 4) + 0.0 AS attenuation, round(stddev_pop(v), 4) + 0.0 AS deviation FROM v""")
def attenuation_m7(spark, d):
    rows = _layers(spark, d)
    out = A.attenuation_pair(rows.where("picknum = 1"), rows.where("picknum = 2"))
    return out.select(*[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("attenuation", "deviation")])


RATES = [float(k) for k in range(30)]
TRIED = """c AS (SELECT *, list_transform(range(30), lambda r: abs(coalesce((c + 2 * r * a) / CASE WHEN a * (b + 4 * r * c + 4 * r * r * a) > 0 THEN sqrt(a * (b + 4 * r * c + 4 * r * r * a)) END, 0))) AS t FROM r),
f AS (SELECT *, list_filter(range(30), lambda r: t[r + 1] < 0.2) AS near FROM c),
x AS (SELECT *, CASE WHEN n >= 3 AND a > 0 AND t[1] > 0.2 AND len(near) > 0 AND list_max(near) - list_min(near) <= 5 THEN list_position(t, list_min(t)) - 1 END AS rate FROM f)"""


@query("attenuation_m3", f"""
WITH {LAY}, v AS (SELECT n AS pn, i, z, db, row_number() OVER l - 1 AS t, count(*) OVER (PARTITION BY n) AS m FROM ly WHERE db IS NOT NULL WINDOW l AS (PARTITION BY n ORDER BY i)),
w AS (SELECT unnest(range(20, (SELECT 2 * max(m) FROM v), 20)) AS w),
r AS (SELECT w, a.pn, a.i, regr_count(b.db, b.z) AS n, regr_sxx(b.db, b.z) AS a, regr_syy(b.db, b.z) AS b, regr_sxy(b.db, b.z) AS c
  FROM v a JOIN w ON w // 2 <= a.t AND w // 2 <= a.m - a.t JOIN v b ON b.pn = a.pn AND b.t >= a.t - w // 2 AND b.t < a.t + w // 2 WHERE a.t >= 10 AND a.t < a.m - 10 GROUP BY 1, 2, 3),
{TRIED}, y AS (SELECT pn, i, arg_min(rate, w) FILTER (rate IS NOT NULL)::DOUBLE AS rate, min(w) FILTER (rate IS NOT NULL)::DOUBLE AS w FROM x GROUP BY 1, 2)
SELECT ly.n AS picknum, ly.i AS trace_idx, y.rate AS attenuation, y.w AS "window" FROM ly LEFT JOIN y ON y.pn = ly.n AND y.i = ly.i""")
def attenuation_m3(spark, d):
    return A.attenuation_growing(_layers(spark, d), RATES, 5.0, 0.2, 20, 20).drop("profile_id")


@query("attenuation_m6b", f"""
WITH {LAY}, d AS (SELECT unnest([0.15, 0.3, 0.45]::DOUBLE[]) AS d), w AS (SELECT 0.05::DOUBLE + unnest(range(100)) * 0.03::DOUBLE AS w),
h AS (SELECT min(z) AS low, max(z) AS high FROM ly WHERE db IS NOT NULL),
r AS (SELECT d, w, regr_count(db, z) AS n, regr_sxx(db, z) AS a, regr_syy(db, z) AS b, regr_sxy(db, z) AS c FROM ly, d, w, h WHERE abs(z - d) < w / 2 AND d - w / 2 >= low AND d + w / 2 <= high GROUP BY 1, 2),
{TRIED}, y AS (SELECT d, arg_min(rate, w) FILTER (rate IS NOT NULL)::DOUBLE AS rate, min(w) FILTER (rate IS NOT NULL) AS w FROM x GROUP BY 1)
SELECT d.d AS depth, y.rate AS attenuation, round(y.w, 6) AS "window" FROM d LEFT JOIN y USING (d)""")
def attenuation_m6b(spark, d):
    out = A.attenuation_growing_depths(_layers(spark, d), [0.15, 0.3, 0.45], RATES, 0.05, 0.03, 2.5, 0.2)
    return out.select("depth", "attenuation", F.round("window", 6).alias("window"))


@query("bed_smooth", f"""
WITH {TR}, h AS (SELECT i, elev - (i % 13) * 0.3::DOUBLE AS h, row_number() OVER (ORDER BY i) - 1 AS t, count(*) OVER () AS n FROM tr)
SELECT a.i AS trace_idx, round(list_sort(list(b.h) || list_transform(range(11 - count(*)), lambda k: 0.0::DOUBLE))[6], 6) + 0.0 AS height FROM h a JOIN h b ON abs(a.t - b.t) <= 5 GROUP BY a.i""")
def bed_smooth(spark, d):
    bed = traces(spark, d).withColumn("height", F.col("elev") - (F.col("trace_idx") % 13) * 0.3).select("profile_id", "trace_idx", "height")
    return A.smoothed_bed(bed, 11).select("trace_idx", r6("height").alias("height"))


@query("continuity_index", f"""
WITH {TR}, b AS (SELECT i, list_transform(a[13:52], lambda v: CASE WHEN v <> 0 THEN 10 * log10(v * v) END) AS d FROM tr),
g AS (SELECT i, list_transform(range(1, 41), lambda j: abs(d[least(j + 1, 40)] - d[greatest(j - 1, 1)]) / (least(j + 1, 40) - greatest(j - 1, 1))) AS g FROM b)
SELECT i AS trace_idx, round(list_sum(g) / 40, 5) + 0.0 AS continuity FROM g""")
def continuity_index(spark, d):
    t = traces(spark, d).withColumn("surface", F.lit(7)).withColumn("bed", F.lit(57))
    return A.continuity(t, 0.1).select("trace_idx", (F.round("continuity", 5) + F.lit(0.0)).alias("continuity"))


@query("roughness", f"""
WITH {TR}, h AS (SELECT i, (elev - (i % 13) * 0.3::DOUBLE) AS h, i::DOUBLE AS x FROM tr), r AS (SELECT i, count(h) OVER w AS n, regr_syy(h, x) OVER w AS b, regr_sxy(h, x) OVER w AS c, regr_sxx(h, x) OVER w AS a FROM h WINDOW w AS (ORDER BY i ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
SELECT i AS trace_idx, round(sqrt(greatest(b - c * c / a, 0) / (n - 1)), 4) + 0.0 AS rms FROM r""")
def roughness(spark, d):
    bed = traces(spark, d).withColumn("height", F.col("elev") - (F.col("trace_idx") % 13) * 0.3).select("profile_id", "trace_idx", "height")
    return A.roughness(bed, 10, 50.0).select("trace_idx", (F.round("rms", 4) + F.lit(0.0)).alias("rms"))


def _small(spark, d):
    return traces(spark, d, by_label=True).select("profile_id", (F.row_number().over(_by()) - 1).cast("int").alias("trace_idx"), "samples")


def _by():
    from pyspark.sql.window import Window

    return Window.partitionBy("profile_id").orderBy("trace_idx")


@query("kirchhoff_small", f"""
WITH {TR}, t AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i, a FROM tr), j AS (SELECT unnest(range(64))::INT AS j),
g AS (SELECT p, i, j, (a[least(j + 1, 63) + 1] - a[greatest(j - 1, 0) + 1]) / ((least(j + 1, 63) - greatest(j - 1, 0)) * 1e-8::DOUBLE) AS g FROM t, j),
o AS (SELECT t.p, t.i AS o, j AS z, 1.69e8::DOUBLE * (0.01::DOUBLE * j) * 1e-6::DOUBLE / 2 AS d FROM t, j),
r AS (SELECT o.p, o.o, o.z, o.d, t.i, sqrt(((t.i - o.o) * 0.5::DOUBLE) * ((t.i - o.o) * 0.5::DOUBLE) + o.d * o.d) AS r FROM o JOIN t ON o.p = t.p AND abs(t.i - o.o) <= 3),
h AS (SELECT *, round_even((2 * r / 1.69e8::DOUBLE * 1e6) / 0.01::DOUBLE, 0)::INT AS at FROM r WHERE 2 * r / 1.69e8::DOUBLE * 1e6 <= 0.63::DOUBLE)
SELECT h.p AS profile_id, h.o::INT AS trace_idx, z AS sample_idx, round(sum(g.g * CASE WHEN r > 0 THEN d / r ELSE 0 END / 1.69e8::DOUBLE) / (2 * pi()), 4) + 0.0 AS v
FROM h JOIN g ON g.p = h.p AND g.i = h.i AND g.j = h.at GROUP BY 1, 2, 3""")
def kirchhoff_small(spark, d):
    out = M.kirchhoff(_small(spark, d), travel_time(), 0.5, aperture=3)  # a small aperture, over all profiles
    return out.select("profile_id", "trace_idx", "sample_idx", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("kirchhoff", f"""
WITH {TR}, t AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i, a FROM tr), j AS (SELECT unnest(range(64))::INT AS j),
g AS (SELECT p, i, j, (a[least(j + 1, 63) + 1] - a[greatest(j - 1, 0) + 1]) / ((least(j + 1, 63) - greatest(j - 1, 0)) * 1e-8::DOUBLE) AS g FROM t, j),
o AS (SELECT t.p, t.i AS o, j AS z, 1.69e8::DOUBLE * (0.01::DOUBLE * j) * 1e-6::DOUBLE / 2 AS d FROM t, j),
r AS (SELECT o.p, o.o, o.z, o.d, t.i, sqrt(((t.i - o.o) * 0.5::DOUBLE) * ((t.i - o.o) * 0.5::DOUBLE) + o.d * o.d) AS r FROM o JOIN t ON o.p = t.p),
h AS (SELECT *, round_even((2 * r / 1.69e8::DOUBLE * 1e6) / 0.01::DOUBLE, 0)::INT AS at FROM r WHERE 2 * r / 1.69e8::DOUBLE * 1e6 <= 0.63::DOUBLE)
SELECT h.p AS profile_id, h.o::INT AS trace_idx, z AS sample_idx, round(sum(g.g * CASE WHEN r > 0 THEN d / r ELSE 0 END / 1.69e8::DOUBLE) / (2 * pi()), 4) + 0.0 AS v
FROM h JOIN g ON g.p = h.p AND g.i = h.i AND g.j = h.at GROUP BY 1, 2, 3""")
def kirchhoff(spark, d):
    out = M.kirchhoff(_small(spark, d), travel_time(), 0.5)
    return out.select("profile_id", "trace_idx", "sample_idx", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("kirchhoff_near", f"""
WITH {TR}, t AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i, a FROM tr), j AS (SELECT unnest(range(64))::INT AS j),
g AS (SELECT p, i, j, (a[least(j + 1, 63) + 1] - a[greatest(j - 1, 0) + 1]) / ((least(j + 1, 63) - greatest(j - 1, 0)) * 1e-8::DOUBLE) AS g, a[j + 1] AS h FROM t, j),
o AS (SELECT t.p, t.i AS o, j AS z, 1.69e8::DOUBLE * (0.01::DOUBLE * j) * 1e-6::DOUBLE / 2 AS d FROM t, j),
r AS (SELECT o.p, o.o, o.z, o.d, t.i, sqrt(((t.i - o.o) * 0.5::DOUBLE) * ((t.i - o.o) * 0.5::DOUBLE) + o.d * o.d) AS r FROM o JOIN t ON o.p = t.p),
h AS (SELECT *, round_even((2 * r / 1.69e8::DOUBLE * 1e6) / 0.01::DOUBLE, 0)::INT AS at FROM r WHERE 2 * r / 1.69e8::DOUBLE * 1e6 <= 0.63::DOUBLE)
SELECT h.p AS profile_id, h.o::INT AS trace_idx, z AS sample_idx, round(sum(CASE WHEN r > 0 THEN (g.g / 1.69e8::DOUBLE + g.h / (r * r)) * d / r ELSE 0 END) / (2 * pi()), 4) + 0.0 AS v
FROM h JOIN g ON g.p = h.p AND g.i = h.i AND g.j = h.at GROUP BY 1, 2, 3""")
def kirchhoff_near(spark, d):
    out = M.kirchhoff(_small(spark, d), travel_time(), 0.5, nearfield=True)
    return out.select("profile_id", "trace_idx", "sample_idx", (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("migration_taper", f"""
WITH {TR}, n AS (SELECT count(*) AS n FROM tr), j AS (SELECT unnest(range(64))::INT AS j)
SELECT i AS trace_idx, j AS sample_idx, round(a[j + 1] * least(least(i, n - 1 - i) / 10.0, 1.0) * least(least(j, 63 - j) / 5.0, 1.0), 6) + 0.0 AS v FROM tr, n, j""")
def migration_taper(spark, d):
    return M.tapered(traces(spark, d), 10, 5).select("trace_idx", "sample_idx", r6("v").alias("v"))


STEP = (travel_time()[1] - travel_time()[0]) * 1e-6
#: h: transforms along the tapered traces of each profile, by wavenumber k and sample s.
SPECTRA = TR + """, t AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY i) - 1 AS i, count(*) OVER (PARTITION BY p) AS n, a FROM tr),
x AS (SELECT p, i, n, s, a[s + 1] * least(least(i, n - 1 - i) / 10.0::DOUBLE, 1) * least(least(s, 63 - s) / 10.0::DOUBLE, 1) AS v FROM t, (SELECT unnest(range(64))::INT AS s)),
k AS (SELECT p, n, k, CASE WHEN k = 0 THEN 0 ELSE 2 * pi() * (CASE WHEN k <= (n - 1) // 2 THEN k ELSE k - n END) / (n * 0.5::DOUBLE) END AS kx FROM (SELECT p, n, unnest(range(n)) AS k FROM (SELECT DISTINCT p, n FROM t))),
h AS (SELECT p, k, kx, s, sum(v * cos(2 * pi() * (k * i % x.n) / x.n)) AS re, -sum(v * sin(2 * pi() * (k * i % x.n) / x.n)) AS im FROM x JOIN k USING (p) GROUP BY ALL)"""
#: From g, the migrated columns, back to traces.
IMAGE = """SELECT p AS profile_id, i::INT AS trace_idx, s::INT AS sample_idx, round(sum(re * cos(2 * pi() * (k * i % n) / n) - im * sin(2 * pi() * (k * i % n) / n)) / any_value(n), 6) + 0.0 AS v
FROM g JOIN (SELECT p, i, n FROM t) USING (p) GROUP BY 1, 2, 3"""


def _stolt(velocity: float) -> str:
    omega = 2 * np.pi * np.fft.fftfreq(SNUM, STEP)
    kz = omega * 2 / velocity
    low, high = float(omega.min()), float(omega.max())
    return f"""
WITH {SPECTRA}, m AS (SELECT unnest(range(-32, 32))::INT AS m),
f AS (SELECT p, k, m, sum(re * cos(2 * pi() * m * s / 64) + im * sin(2 * pi() * m * s / 64)) AS re, sum(im * cos(2 * pi() * m * s / 64) - re * sin(2 * pi() * m * s / 64)) AS im FROM h, m GROUP BY 1, 2, 3),
z AS (SELECT unnest(range(64))::INT AS q, unnest({_values(kz)}) AS kz, unnest({_values(np.sign(kz) * velocity / 2)}) AS half),
w AS (SELECT p, k, q, abs(kz) / sqrt(kx * kx + kz * kz) AS c, half * sqrt(kx * kx + kz * kz) AS w FROM k, z WHERE kz <> 0),
u AS (SELECT *, w / {float(2 * np.pi / (SNUM * STEP))!r}::DOUBLE AS u FROM w WHERE w >= {low!r}::DOUBLE AND w <= {high!r}::DOUBLE),
l AS (SELECT *, least(greatest(floor(u), -32), 30)::INT AS lo FROM u),
o AS (SELECT l.p, l.k, q, c * (a.re + (u - lo) * (b.re - a.re)) AS re, c * (a.im + (u - lo) * (b.im - a.im)) AS im
  FROM l JOIN f a ON a.p = l.p AND a.k = l.k AND a.m = lo JOIN f b ON b.p = l.p AND b.k = l.k AND b.m = lo + 1),
g AS (SELECT p, k, s, sum(re * cos(2 * pi() * (q * s % 64) / 64) - im * sin(2 * pi() * (q * s % 64) / 64)) / 64 AS re, sum(im * cos(2 * pi() * (q * s % 64) / 64) + re * sin(2 * pi() * (q * s % 64) / 64)) / 64 AS im
  FROM o, (SELECT unnest(range(64)) AS s) GROUP BY 1, 2, 3)
{IMAGE}"""


def _phase_shift(velocity) -> str:
    speed = np.broadcast_to(np.asarray(velocity, float), (SNUM,))
    return f"""
WITH {SPECTRA}, w AS (SELECT w, 2 * pi() * (CASE WHEN w < 64 THEN w ELSE w - 128 END) / (128 * {STEP!r}::DOUBLE) AS om FROM (SELECT unnest(range(128))::INT AS w)),
f AS (SELECT p, k, kx, w, om, sum(re * cos(2 * pi() * (w * s % 128) / 128) + im * sin(2 * pi() * (w * s % 128) / 128)) AS re, sum(im * cos(2 * pi() * (w * s % 128) / 128) - re * sin(2 * pi() * (w * s % 128) / 128)) AS im FROM h, w GROUP BY 1, 2, 3, 4, 5),
d AS (SELECT unnest(range(64))::INT AS s, unnest({_values(speed)}) AS d),
c AS (SELECT f.*, s, CASE WHEN om <> 0 THEN 1 - (d * kx / (2 * om)) * (d * kx / (2 * om)) ELSE -1 END AS c FROM f, d),
a AS (SELECT *, coalesce(sum(CASE WHEN c > 1e-9 THEN sqrt(c) ELSE 0 END) OVER b, 0) * om * {STEP!r}::DOUBLE AS ph, coalesce(min(c) OVER b, 1) AS least_c FROM c WINDOW b AS (PARTITION BY p, k, w ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT p, k, s, coalesce(sum(re * cos(ph) - im * sin(ph)) FILTER (least_c > 1e-9), 0) / 128 AS re, coalesce(sum(im * cos(ph) + re * sin(ph)) FILTER (least_c > 1e-9), 0) / 128 AS im FROM a GROUP BY 1, 2, 3)
{IMAGE}"""


def _migrated(spark, d, kind, *velocity):
    return M.migrate(_small(spark, d), kind, travel_time(), 0.5, *velocity).select("profile_id", "trace_idx", "sample_idx", r6("v").alias("v"))


@query("stolt", _stolt(1.68e8))
def stolt(spark, d):
    return _migrated(spark, d, "stolt")


@query("phase_shift", _phase_shift(1.68e8))
def phase_shift(spark, d):
    return _migrated(spark, d, "phsh")


SPEEDS = M.velocity_profile([(1.9e8, 0.0), (1.68e8, 30.0)], travel_time())


@query("gazdag", _phase_shift(SPEEDS))
def gazdag(spark, d):
    return _migrated(spark, d, "phsh", SPEEDS)


@query("ffd")
def ffd(spark, d):
    """Velocities that vary along each profile and down it; checked against a solver of whole matrices."""
    speeds = F.transform("samples", lambda v, k: F.lit(1.6e8) + 3e6 * F.pmod("trace_idx", F.lit(4)) + 1e5 * k)
    moved = M.migrate(_small(spark, d).withColumn("velocity", speeds), "ffd", travel_time(), 0.5, "velocity")
    return moved.select("profile_id", "trace_idx", "sample_idx", r6("v").alias("v"))
