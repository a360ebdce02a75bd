"""Queries of the selecting, stacking and window operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.tables import DT, PK, SNUM, S, TR, picks, r6, samples, traces, travel_time
from . import shape, windows

OUT = "trace_idx, sample_idx, v"


def flat(df, *keep):
    return samples(df, *(keep or ("trace_idx",))).withColumn("v", r6("v"))


@query("mean_trace_restack", f"""
WITH {S}, m AS (SELECT k, avg(v) FILTER (i < 100) * exp(-0.05 * 0.01 * k) AS m FROM s GROUP BY k),
d AS (SELECT i, s.k, v - m AS v FROM s JOIN m ON s.k = m.k), n AS (SELECT count(*) AS n FROM tr)
SELECT (i // 5)::INT AS trace_idx, k AS sample_idx, round(avg(v), 6) + 0.0 AS v FROM d, n WHERE i // 5 < n // 5 GROUP BY ALL""")
def mean_trace_restack(spark, d):
    clean = windows.remove_mean_trace(traces(spark, d), travel_time(), 0, 100)
    return flat(shape.restack(clean, 5))


@query("mean_trace_removal", f"""
WITH {S}, m AS (SELECT k, avg(v) FILTER (i >= 10 AND i < 60) * exp(-0.05 * 0.01 * k) AS m FROM s GROUP BY k)
SELECT i AS trace_idx, s.k AS sample_idx, round(v - m, 6) + 0.0 AS v FROM s JOIN m ON s.k = m.k""")
def mean_trace_removal(spark, d):
    return flat(windows.remove_mean_trace(traces(spark, d), travel_time(), 10, 60))


@query("restack", f"""
WITH {S}, n AS (SELECT count(*) AS n FROM tr),
g AS (SELECT i // 5 AS g, avg(dist) AS dist, avg(lat) AS lat, avg(elev) AS elev FROM tr GROUP BY 1)
SELECT (i // 5)::INT AS trace_idx, k AS sample_idx, round(avg(v), 6) + 0.0 AS v, any_value(round(g.dist, 6) + 0.0) AS dist,
       any_value(round(g.lat, 6) + 0.0) AS lat, any_value(round(g.elev, 6) + 0.0) AS elev
FROM s JOIN g ON s.i // 5 = g.g, n WHERE i // 5 < n // 5 GROUP BY 1, 2""")
def restack(spark, d):
    out = shape.restack(traces(spark, d), 4)
    return flat(out.withColumns({c: r6(c) for c in ("dist", "lat", "elev")}), "trace_idx", "dist", "lat", "elev")


@query("pick_restack", f"""
WITH {PK}, g AS (SELECT n, i // 7 AS t, count(*) AS c, avg(samp1) AS s1, avg(samp2) AS s2, avg(samp3) AS s3, avg(power) AS power FROM pk GROUP BY 1, 2)
SELECT n AS picknum, t::INT AS trace_idx, trunc(s1)::DOUBLE AS samp1, trunc(s2)::DOUBLE AS samp2, trunc(s3)::DOUBLE AS samp3, round(power, 6) + 0.0 AS power
FROM g WHERE c = 7""")
def pick_restack(spark, d):
    return shape.restack_picks(picks(spark, d), 7, SNUM).select("picknum", "trace_idx", "samp1", "samp2", "samp3", r6("power").alias("power"))


@query("hcrop_tnum", f"""
WITH {TR} SELECT (i - 99)::INT AS trace_idx, (i - 98)::INT AS trace_num, round(dist - min(dist) OVER (), 6) + 0.0 AS dist, len(a)::INT AS n
FROM tr WHERE i >= 99""")
def hcrop_tnum(spark, d):
    out = shape.hcrop(traces(spark, d), 100)
    return out.select("trace_idx", "trace_num", r6("dist").alias("dist"), F.size("samples").alias("n"))


@query("hcrop_dist", f"""
WITH {TR}, c AS (SELECT min(i) AS c FROM tr WHERE dist >= 0.5::DOUBLE)
SELECT (i - c)::INT AS trace_idx, (i - c + 1)::INT AS trace_num, round(dist - min(dist) OVER (), 6) + 0.0 AS dist FROM tr, c WHERE i >= c""")
def hcrop_dist(spark, d):
    return shape.hcrop_distance(traces(spark, d), 0.5).select("trace_idx", "trace_num", r6("dist").alias("dist"))


@query("crop_top_snum", f"WITH {S} SELECT i AS trace_idx, (k - 20)::INT AS sample_idx, round(v, 6) + 0.0 AS v FROM s WHERE k >= 20")
def crop_top_snum(spark, d):
    return flat(shape.crop(traces(spark, d), 20))


@query("crop_twtt", f"WITH {S} SELECT i AS trace_idx, k AS sample_idx, round(v, 6) + 0.0 AS v FROM s WHERE k < 30")
def crop_twtt(spark, d):
    return flat(shape.crop_time(traces(spark, d), travel_time(), 0.295, "bottom"))


@query("crop_pretrig", f"""
WITH {TR}, m AS (SELECT min(trig) AS m FROM tr), j AS (SELECT unnest(range(64))::INT AS j)
SELECT i AS trace_idx, j AS sample_idx, round(a[trig + j + 1], 6) + 0.0 AS v FROM tr, m, j WHERE j < 64 - m""")
def crop_pretrig(spark, d):
    return flat(shape.crop_pretrigger(traces(spark, d)))


@query("crop_picks", f"""
WITH {PK} SELECT n AS picknum, i AS trace_idx, CASE WHEN samp1 - 20 >= 0 THEN samp1 - 20 END AS samp1,
       CASE WHEN samp2 - 20 >= 0 THEN samp2 - 20 END AS samp2, CASE WHEN samp3 - 20 >= 0 THEN samp3 - 20 END AS samp3 FROM pk""")
def crop_picks(spark, d):
    return shape.crop_picks(picks(spark, d), 20, SNUM - 20).select("picknum", "trace_idx", "samp1", "samp2", "samp3")


@query("reverse", f"""
WITH {TR} SELECT (max(i) OVER () - i)::INT AS trace_idx, round(max(dist) OVER () - dist, 6) + 0.0 AS dist, round(lat, 6) + 0.0 AS lat, round(a[1], 6) + 0.0 AS v0 FROM tr""")
def reverse(spark, d):
    return shape.reverse(traces(spark, d)).select("trace_idx", r6("dist").alias("dist"), r6("lat").alias("lat"), r6(F.col("samples")[0]).alias("v0"))


@query("concat_profiles", f"""
WITH {TR}, e AS (SELECT p, count(*) AS n, max(dist) AS d FROM tr GROUP BY p),
o AS (SELECT p, coalesce(sum(n) OVER w, 0) AS n0, coalesce(sum(d) OVER w, 0) AS d0 FROM e WINDOW w AS (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT (row_number() OVER (PARTITION BY tr.p ORDER BY i) - 1 + n0)::INT AS trace_idx, round(dist + d0, 6) + 0.0 AS dist, round(a[1], 6) + 0.0 AS v0
FROM tr JOIN o ON tr.p = o.p""")
def concat_profiles(spark, d):
    return shape.concat(traces(spark, d, by_label=True)).select("trace_idx", r6("dist").alias("dist"), r6(F.col("samples")[0]).alias("v0"))


@query("concat_picks", f"""
WITH {PK}, l AS (SELECT DISTINCT n FROM pk WHERE n <> 2 OR i < 200), u AS (SELECT * FROM pk WHERE n <> 2 OR i < 200)
SELECT tr.i AS trace_idx, l.n AS picknum, u.samp2 FROM tr CROSS JOIN l LEFT JOIN u ON u.i = tr.i AND u.n = l.n""")
def concat_picks(spark, d):
    some = picks(spark, d).where("picknum <> 2 or trace_idx < 200")
    return shape.concat_picks(some, traces(spark, d)).select("trace_idx", "picknum", "samp2")


@query("elev_correct", f"""
WITH {TR}, e AS (SELECT *, trunc((max(elev) OVER () - elev) / (1e-8::DOUBLE * 1.69e8::DOUBLE / 2))::INT AS d FROM tr), m AS (SELECT max(d) AS m FROM e),
j AS (SELECT unnest(range(200))::INT AS j)
SELECT i AS trace_idx, j AS sample_idx, CASE WHEN j >= d AND j < d + 64 THEN round(a[j - d + 1], 6) + 0.0 END AS v FROM e, m, j WHERE j < 64 + m""")
def elev_correct(spark, d):
    return flat(shape.elevation_correct(traces(spark, d), DT))


@query("range_gain", f"""
WITH {TR}, j AS (SELECT unnest(range(64))::INT AS j)
SELECT i AS trace_idx, j AS sample_idx, round(CASE WHEN j > trig THEN a[j + 1] * (0.01::DOUBLE * j) * 2.5::DOUBLE ELSE a[j + 1] END, 6) + 0.0 AS v FROM tr, j""")
def range_gain(spark, d):
    return flat(windows.range_gain(traces(spark, d), travel_time(), 2.5))


@query("agc", f"""
WITH {S}, p AS (SELECT k, max(abs(v)) AS p FROM s GROUP BY k),
g AS (SELECT k, 50.0::DOUBLE / CASE WHEN max(p) OVER w = 0 THEN 1e-6 ELSE max(p) OVER w END AS g FROM p WINDOW w AS (ORDER BY k ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))
SELECT i AS trace_idx, s.k AS sample_idx, round(v * g, 6) + 0.0 AS v FROM s JOIN g ON s.k = g.k""")
def agc(spark, d):
    return flat(windows.agc(traces(spark, d), window=20))


@query("winavg_full", f"""
WITH {S} SELECT i AS trace_idx, k AS sample_idx, round(v - avg(v) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS v FROM s""")
def winavg_full(spark, d):
    return windows.window_average(traces(spark, d), travel_time(), 10).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("winavg_pexp", f"""
WITH {S}, e AS (SELECT k, exp(-0.05 * 0.01 * k) AS e FROM (SELECT unnest(range(64)) AS k)),
w AS (SELECT k, (e - min(e) OVER ()) / (max(e) OVER () - min(e) OVER ()) AS w FROM e)
SELECT i AS trace_idx, s.k AS sample_idx, round(v - w * avg(v) OVER (PARTITION BY s.k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS v
FROM s JOIN w ON s.k = w.k""")
def winavg_pexp(spark, d):
    return windows.window_average(traces(spark, d), travel_time(), 11, "pexp").select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("adaptive_mean", f"""
WITH {S}, n AS (SELECT count(*) AS n FROM tr), c AS (SELECT s.*, n FROM s, n),
e AS (SELECT k, avg(v) AS e FROM c WHERE i >= n - 12 GROUP BY k)
SELECT i AS trace_idx, c.k AS sample_idx, round(CASE
  WHEN i <= 6 THEN avg(v) OVER (PARTITION BY c.k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 5 FOLLOWING)
  WHEN i >= n - 6 THEN e ELSE avg(v) OVER (PARTITION BY c.k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END, 6) + 0.0 AS mean
FROM c JOIN e ON c.k = e.k""")
def adaptive_mean(spark, d):
    return windows.adaptive_means(traces(spark, d), 12).select("trace_idx", "sample_idx", r6("mean").alias("mean"))


@query("wiener", f"""
WITH {S}, q AS (SELECT i, k, v, sum(v) OVER w / 10 AS m, sum(v * v) OVER w / 10 - (sum(v) OVER w / 10) * (sum(v) OVER w / 10) AS q FROM s
  WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING)), n AS (SELECT avg(q) AS n FROM q)
SELECT i AS trace_idx, k AS sample_idx, round(CASE WHEN q < n THEN m ELSE m + (1 - n / q) * (v - m) END, 6) + 0.0 AS v FROM q, n""")
def wiener(spark, d):
    return windows.wiener(traces(spark, d)).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("median_denoise", f"""
WITH {S}, n AS (SELECT max(i) + 1 AS n FROM tr), o AS (SELECT unnest([-1, 0, 1]) AS o),
r AS (SELECT s.i, k, CASE WHEN i + o < 0 THEN -(i + o) - 1 WHEN i + o >= n THEN 2 * n - 1 - (i + o) ELSE i + o END AS j FROM s, n, o)
SELECT r.i AS trace_idx, r.k AS sample_idx, round(median(s.v), 6) + 0.0 AS v FROM r JOIN s ON s.i = r.j AND s.k = r.k GROUP BY 1, 2""")
def median_denoise(spark, d):
    return windows.median_filter(traces(spark, d), 3).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("wiener_box", f"""
WITH {S}, b AS (SELECT i, k, v, sum(v) OVER w AS s, sum(v * v) OVER w AS q FROM s WINDOW w AS (PARTITION BY i ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
q AS (SELECT i, k, v, sum(s) OVER w / 12 AS m, sum(q) OVER w / 12 - (sum(s) OVER w / 12) * (sum(s) OVER w / 12) AS q FROM b
  WINDOW w AS (PARTITION BY k ORDER BY i ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)), n AS (SELECT avg(q) AS n FROM q)
SELECT i AS trace_idx, k AS sample_idx, round(CASE WHEN q < n THEN m ELSE m + (1 - n / q) * (v - m) END, 6) + 0.0 AS v FROM q, n""")
def wiener_box(spark, d):
    return windows.wiener(traces(spark, d), 3, 4).select("trace_idx", "sample_idx", r6("v").alias("v"))


@query("median_box", f"""
WITH {S}, n AS (SELECT max(i) + 1 AS n FROM tr), o AS (SELECT unnest([-1, 0, 1]) AS o), u AS (SELECT unnest([-1, 0, 1]) AS u),
r AS (SELECT s.i, k, CASE WHEN i + o < 0 THEN -(i + o) - 1 WHEN i + o >= n THEN 2 * n - 1 - (i + o) ELSE i + o END AS j, CASE WHEN k + u < 0 THEN 0 WHEN k + u > 63 THEN 63 ELSE k + u END AS l FROM s, n, o, u)
SELECT r.i AS trace_idx, r.k AS sample_idx, round(median(s.v), 6) + 0.0 AS v FROM r JOIN s ON s.i = r.j AND s.k = r.l GROUP BY 1, 2""")
def median_box(spark, d):
    return windows.median_filter(traces(spark, d), 3, 3).select("trace_idx", "sample_idx", r6("v").alias("v"))
