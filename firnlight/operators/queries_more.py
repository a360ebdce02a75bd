"""Queries of projections, headers, orientation and remaining filters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.filters import operator_matrix, padding_of, sections
from ..plans.registry import query
from ..plans.tables import PK, S, TR, picks, r6, read, samples, traces, travel_time
from . import apres as R
from . import geometry as G
from . import windows as W
from .queries_signal import QUAD, THETAS, UNWRAP, _differences, _pairs, _sites, _values, _zero_phase


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


@query("utm_unproject", f"WITH {TR} SELECT i AS trace_idx, round(lat, 7) + 0.0 AS lat, round(lon, 7) + 0.0 AS long FROM tr")
def utm_unproject(spark, d):
    x, y, zone = X.utm(F.col("lat"), F.col("long"))
    flat = traces(spark, d).select("trace_idx", x.alias("x"), y.alias("y"), zone.alias("zone"))
    lat, long = X.utm_inverse(F.col("x"), F.col("y"), F.col("zone"), False)
    return flat.select("trace_idx", (F.round(lat, 7) + F.lit(0.0)).alias("lat"), (F.round(long, 7) + F.lit(0.0)).alias("long"))


@query("polar_stereographic", f"""
WITH {TR}, c AS (SELECT sqrt(2 / 298.257223563 - pow(1 / 298.257223563, 2)) AS e, radians(71.0) AS pc), t AS (SELECT i, lon, e, pc, tan(pi() / 4 - radians(-lat) / 2) / pow((1 - e * sin(radians(-lat))) / (1 + e * sin(radians(-lat))), e / 2) AS t,
  tan(pi() / 4 - pc / 2) / pow((1 - e * sin(pc)) / (1 + e * sin(pc)), e / 2) AS tc, cos(pc) / sqrt(1 - pow(e * sin(pc), 2)) AS mc FROM tr, c)
SELECT i AS trace_idx, round(6378137.0 * mc * t / tc * sin(radians(lon)), 3) + 0.0 AS x, round(6378137.0 * mc * t / tc * cos(radians(lon)), 3) + 0.0 AS y FROM t""")
def polar_stereographic(spark, d):
    x, y = X.polar_stereographic(F.col("lat"), F.col("long"))
    return traces(spark, d).select("trace_idx", (F.round(x, 3) + F.lit(0.0)).alias("x"), (F.round(y, 3) + F.lit(0.0)).alias("y"))


@query("project_profile", f"""
WITH {TR}, c AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563)::DOUBLE AS n), z AS (SELECT i, lat, lon, (1 + floor((avg(lon) OVER () + 180) / 6))::INT AS zone, n FROM tr, c),
p AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam, 2 * sqrt(n) / (1 + n) AS e FROM z), q AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM p),
r AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3,
  6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS big FROM q),
u AS (SELECT i, zone, 500000.0 + 0.9996 * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
  10000000.0 + 0.9996 * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM r),
d AS (SELECT *, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)), 0) / 1000 AS d FROM u WINDOW w AS (ORDER BY i))
SELECT i AS trace_idx, zone, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(sum(d) OVER (ORDER BY i), 6) + 0.0 AS dist FROM d""")
def project_profile(spark, d):
    return G.project(traces(spark, d)).select("trace_idx", "zone", r4("x_coord").alias("x"), r4("y_coord").alias("y"), r6("dist").alias("dist"))


NODES = [(1.7e8, 5.0 * a, 100.0 * b) for a in range(4) for b in range(5)]


@query("nearest_grid", f"""
WITH {TR}, g AS (SELECT unnest({[n[1] for n in NODES]}::DOUBLE[]) AS z, unnest({[n[2] for n in NODES]}::DOUBLE[]) AS x, unnest({[n[0] + k for k, n in enumerate(NODES)]}::DOUBLE[]) AS v, unnest(range({len(NODES)})) AS n)
SELECT i AS trace_idx, arg_min(g.v, (pow(g.x - tr.x, 2) + pow(g.z - (i % 16 + 0.3::DOUBLE), 2), n)) AS velocity FROM tr, g GROUP BY i""")
def nearest_grid(spark, d):
    nodes = [(v + k, z, x) for k, (v, z, x) in enumerate(NODES)]
    t = traces(spark, d).withColumn("z", F.col("trace_idx") % 16 + F.lit(0.3))
    return G.nearest_grid(t, nodes, "x_coord", "z").select("trace_idx", "velocity")


@query("drop_bad_gps", f"WITH {TR} SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS trace_idx, round(decday, 6) + 0.0 AS decday FROM tr WHERE i % 5 <> 2")
def drop_bad_gps(spark, d):
    t = traces(spark, d).withColumn("decday", F.when(F.col("trace_idx") % 5 != 2, F.col("decday")))
    return G.drop_without_position(t).select("trace_idx", r6("decday").alias("decday"))


@query("trigger_sample", f"""
WITH {S}, m AS (SELECT p, k, avg(abs(v)) AS m FROM s GROUP BY 1, 2), x AS (SELECT *, max(m) OVER (PARTITION BY p) AS x FROM m)
SELECT p AS profile_id, min(k) AS trig FROM x WHERE m > 0.95 * x GROUP BY 1""")
def trigger_sample(spark, d):
    return W.trigger_sample(traces(spark, d, by_label=True), 0.95)


@query("adaptive_filter", f"""
WITH {S}, n AS (SELECT count(*) AS n FROM tr), c AS (SELECT s.*, n FROM s, n), e AS (SELECT k, avg(v) AS e FROM c WHERE i >= n - 12 GROUP BY k),
m AS (SELECT i, c.k, v, CASE WHEN i <= 6 THEN avg(v) OVER (PARTITION BY c.k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 5 FOLLOWING)
  WHEN i >= n - 6 THEN e ELSE avg(v) OVER (PARTITION BY c.k ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) END AS mean FROM c JOIN e ON c.k = e.k),
w AS (SELECT n // 64 AS r, n % 64 AS c, w FROM (SELECT unnest(range(4096)) AS n, unnest({_values(operator_matrix(W.smooth_samples, 64))}) AS w)),
z AS (SELECT i, r, sum(mean * w) AS z FROM m JOIN w ON w.c = m.k GROUP BY 1, 2)
SELECT s.i AS trace_idx, s.k AS sample_idx, round(v - z * exp(-0.05 * 0.01 * s.k), 6) + 0.0 AS v FROM s JOIN z ON z.i = s.i AND z.r = s.k""")
def adaptive_filter(spark, d):
    out = W.horizontal_filter(traces(spark, d), "adaptive", travel_time(), width=12)
    return samples(out, "trace_idx").withColumn("v", r6("v"))


@query("mean_pick", f"WITH {PK} SELECT n AS picknum, trunc(avg(samp1))::INT AS samp1 FROM pk GROUP BY 1")
def mean_pick(spark, d):
    return picks(spark, d).groupBy("picknum").agg(F.avg("samp1").cast("int").alias("samp1"))


@query("azimuth_rotation", f"WITH {QUAD} SELECT site, s AS sample_idx, ((t - 8 + 10) % 10)::INT AS theta_idx, round(hr, 6) + 0.0 AS hh_re FROM ro")
def azimuth_rotation(spark, d):
    out = R.azimuth_rotation(R.rotate(_sites(spark, d), THETAS), THETAS, 0.5)
    return out.select("site", "sample_idx", "theta_idx", r6("hh_re").alias("hh_re"))


@query("coherence_total", f"""
WITH {TR}, z AS (SELECT i // 2 AS p, i % 2 AS w, s, a[2 * s + 1] AS re, a[2 * s + 2] AS im FROM tr, (SELECT unnest(range(32))::INT AS s)),
q AS (SELECT p, s, max(re) FILTER (w = 0) AS a, max(im) FILTER (w = 0) AS b, max(re) FILTER (w = 1) AS c, max(im) FILTER (w = 1) AS e FROM z GROUP BY 1, 2)
SELECT p::INT AS pair_id, round(sum(a * c + b * e) / sqrt(sum(a * a + b * b) * sum(c * c + e * e)), 6) + 0.0 AS co_re, round(sum(b * c - a * e) / sqrt(sum(a * a + b * b) * sum(c * c + e * e)), 6) + 0.0 AS co_im FROM q GROUP BY 1""")
def coherence_total(spark, d):
    return R.coherence_of(_pairs(spark, d), ["pair_id"]).select("pair_id", r6("co_re").alias("co_re"), r6("co_im").alias("co_im"))


@query("noise_error", f"""
WITH {TR}, z AS (SELECT (i // 2)::INT AS p, s, max(a[2 * s + 1]) FILTER (i % 2 = 0) AS a FROM tr, (SELECT unnest(range(32))::INT AS s) GROUP BY 1, 2)
SELECT p AS pair_id, s AS sample_idx, round(avg(a) OVER (PARTITION BY p ORDER BY s ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING), 6) + 0.0 AS error FROM z""")
def noise_error(spark, d):
    return R.noise_error(_pairs(spark, d), 10, "re1").select("pair_id", "sample_idx", r6("error").alias("error"))


@query("chirp_header", """
SELECT event_id, round(value, 2) AS value, round(858993459 / 4.294967296, 3) + 0.0 AS f_start, round((858993459 + 858993459 // 2 + user_id * 1000) / 4.294967296, 3) + 0.0 AS f_stop,
       round_even(abs(858993459 // 2 + user_id * 1000) / 21475.0, 0) AS steps, (40000 + user_id)::INT AS samples FROM events""")
def chirp_header(spark, d):
    def hex8(c):
        return F.lpad(F.hex(c), 8, "0")

    stop = F.lit(858993459 + 858993459 // 2) + F.col("user_id") * 1000
    text = F.concat(F.lit('Reg0B="'), hex8(stop), hex8(F.lit(858993459)), F.lit('"\nReg0C="'), hex8(F.lit(21475)), hex8(F.lit(21475)), F.lit('"\nReg0D="13881388"\nN_ADC_SAMPLES='), (F.lit(40000) + F.col("user_id")).cast("string"), F.lit("\n"))
    h = R.chirp_header(F.col("text"))
    e = read(spark, d, "events").select("event_id", F.round("value", 2).alias("value"), text.alias("text"))
    return e.select("event_id", "value", (F.round(h["f_start"], 3) + F.lit(0.0)).alias("f_start"), (F.round(h["f_stop"], 3) + F.lit(0.0)).alias("f_stop"), h["steps"].alias("steps"), h["samples"].alias("samples"))


@query("quadpol_zip", f"""
WITH {TR}, z AS (SELECT (i // 4)::INT AS site, i % 4 AS q, s, a[2 * s + 1] AS re FROM tr, (SELECT unnest(range(32))::INT AS s))
SELECT site, s AS sample_idx, s * 1.5::DOUBLE AS range, round(max(re) FILTER (q = 0), 6) + 0.0 AS hh_re, round(max(re) FILTER (q = 3), 6) + 0.0 AS vv_re FROM z GROUP BY 1, 2""")
def quadpol_zip(spark, d):
    site = _sites(spark, d)
    parts = {n: site.select("site", "sample_idx", (F.col("sample_idx") * 1.5).alias("range"), F.col(f"s{n}_re").alias("re"), F.col(f"s{n}_im").alias("im")) for n in ("hh", "hv", "vh", "vv")}
    return R.zip_acquisitions(parts, ["site", "sample_idx"]).select("site", "sample_idx", "range", r6("hh_re").alias("hh_re"), r6("vv_re").alias("vv_re"))


@query("extinction_filtered", f"""
WITH RECURSIVE {QUAD}, l AS (SELECT {{'site': site, 't': t}} AS key, list(an ORDER BY s) AS x FROM an GROUP BY site, t), {_zero_phase(sections(3, [0.2], "low"), padding_of(3, "low"))}
SELECT key.site AS site, j AS sample_idx, arg_min(key.t, (v, key.t)) AS cpe_idx FROM zp WHERE key.t >= 2 AND key.t < 8 GROUP BY 1, 2""")
def extinction_filtered(spark, d):
    anomalies = R.power_anomaly(R.rotate(_sites(spark, d), THETAS)).select("site", "sample_idx", "theta_idx", "anomaly")
    return R.extinction_axis(R.low_pass_range(anomalies, "anomaly", 0.1, 1.0), 2, 8)


PICKED = f"""{UNWRAP},
pz AS (SELECT i // 2 AS p, i % 2 AS w, s, a[2 * s + 1] AS re, a[2 * s + 2] AS im FROM tr, (SELECT unnest(range(32))::INT AS s)),
pd AS (SELECT p, w, s, 10 * log10(greatest(re * re + im * im, 1e-300)) AS d FROM pz WHERE p IN (SELECT p FROM pz WHERE w = 1)),
sm AS (SELECT p, w, s, list_sort([coalesce(lag(d) OVER o, 0), d, coalesce(lead(d) OVER o, 0)])[2] AS x FROM pd WINDOW o AS (PARTITION BY p, w ORDER BY s)),
rn AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY p, w ORDER BY s) AS r FROM (SELECT *, coalesce(x <> lag(x) OVER (PARTITION BY p, w ORDER BY s), true) AS new FROM sm)),
ru AS (SELECT p, w, min(s) AS f, max(s) AS l, any_value(x) AS x, r FROM rn GROUP BY p, w, r),
ca AS (SELECT b.p, b.w, ((b.f + b.l) // 2) AS pos, b.x FROM ru b JOIN ru a ON a.p = b.p AND a.w = b.w AND a.r = b.r - 1 AND a.x < b.x JOIN ru c ON c.p = b.p AND c.w = b.w AND c.r = b.r + 1 AND c.x < b.x),
ed AS (SELECT ca.*, coalesce(max(m.s) FILTER (m.s < pos AND m.x > ca.x), -1) + 1 AS lf, coalesce(min(m.s) FILTER (m.s > pos AND m.x > ca.x), 32) - 1 AS rt FROM ca JOIN sm m USING (p, w) GROUP BY ca.p, ca.w, pos, ca.x),
prm AS (SELECT ed.*, ed.x - greatest(min(m.x) FILTER (m.s BETWEEN lf AND pos), min(m.x) FILTER (m.s BETWEEN pos AND rt)) AS rise FROM ed JOIN sm m USING (p, w) GROUP BY ed.p, ed.w, pos, ed.x, lf, rt),
wd AS (SELECT prm.*, prm.x - rise / 2 AS lv, coalesce(max(m.s) FILTER (m.s BETWEEN lf AND pos AND m.x <= prm.x - rise / 2), lf) AS a, coalesce(min(m.s) FILTER (m.s BETWEEN pos AND rt AND m.x <= prm.x - rise / 2), rt) AS b
  FROM prm JOIN sm m USING (p, w) WHERE rise >= 1 GROUP BY prm.p, prm.w, pos, prm.x, lf, rt, rise),
hw AS (SELECT wd.*, CASE WHEN ma.x < lv THEN a + (lv - ma.x) / (na.x - ma.x) ELSE a END AS lo, CASE WHEN mb.x < lv THEN b - (lv - mb.x) / (nb.x - mb.x) ELSE b END AS hi
  FROM wd JOIN sm ma ON ma.p = wd.p AND ma.w = wd.w AND ma.s = a JOIN sm mb ON mb.p = wd.p AND mb.w = wd.w AND mb.s = b
  LEFT JOIN sm na ON na.p = wd.p AND na.w = wd.w AND na.s = a + 1 LEFT JOIN sm nb ON nb.p = wd.p AND nb.w = wd.w AND nb.s = b - 1),
la AS (SELECT p, max(pos) FILTER (w = 0) AS p1, max(pos) FILTER (w = 1) AS p2 FROM hw WHERE hi - lo >= 1 GROUP BY p),
ok AS (SELECT d.p, p1, p2, CASE WHEN p1 IS NULL OR p2 IS NULL THEN 'no peak' WHEN abs(p1 - p2) >= 20 THEN 'picks too far apart' END AS fault FROM (SELECT DISTINCT p FROM pd) d LEFT JOIN la USING (p)),
sa AS (SELECT *, CASE WHEN fault IS NULL THEN (p1 + p2) // 2 END AS sample FROM ok),
co2 AS (SELECT pair_id AS p, row_number() OVER (PARTITION BY pair_id ORDER BY rg) - 1 AS j, rg, sqrt(re * re + im * im) AS size FROM df),
ne AS (SELECT sa.p, arg_min(j, (abs(rg - sample * 10.0::DOUBLE), j)) AS near FROM sa JOIN co2 USING (p) WHERE sample IS NOT NULL GROUP BY sa.p),
me AS (SELECT ne.p, median(size) AS coherence FROM ne JOIN co2 USING (p) WHERE j >= greatest(near - 10, 0) AND j < near + 10 GROUP BY ne.p)"""


@query("bed_pick", f"""WITH {PICKED}
SELECT sa.p::INT AS pair_id, sample::DOUBLE AS sample_idx, sample * 10.0::DOUBLE AS range, round(CASE WHEN sample IS NOT NULL THEN coalesce(coherence, 0) END, 6) + 0.0 AS coherence,
  round((x1.x + x2.x) / 2, 6) + 0.0 AS power, coalesce(fault, CASE WHEN coalesce(coherence, 0) <= 0.2 THEN 'coherence too low' END) AS fault
FROM sa LEFT JOIN me USING (p) LEFT JOIN sm x1 ON sample IS NOT NULL AND x1.p = sa.p AND x1.w = 0 AND x1.s = p1 LEFT JOIN sm x2 ON sample IS NOT NULL AND x2.p = sa.p AND x2.w = 1 AND x2.s = p2""")
def bed_pick(spark, d):
    pair = _pairs(spark, d).withColumn("range", F.col("sample_idx") * 10.0)
    out = R.bed_pick(pair, _differences(spark, d), kernel=3, prominence=1.0, width=1.0, most_apart=20, least_coherence=0.2)
    return out.withColumns({c: r6(c) for c in ("coherence", "power")} | {"sample_idx": F.col("sample_idx").cast("double")})


@query("difference_bed", f"""WITH {PICKED.replace("sample * 10.0::DOUBLE), j", "(sample - 4) * 10.0::DOUBLE), j")}
SELECT sa.p::INT AS pair_id, sample::DOUBLE AS sample_idx, (sample - 4) * 10.0::DOUBLE AS range, round(CASE WHEN sample IS NOT NULL THEN coalesce(coherence, 0) END, 6) + 0.0 AS coherence,
  coalesce(fault, CASE WHEN coalesce(coherence, 0) <= 0.2 THEN 'coherence too low' END) AS fault FROM sa LEFT JOIN me USING (p)""")
def difference_bed(spark, d):
    """The beds at the end of the chain of time pairs."""
    pair = _pairs(spark, d).withColumn("range", (F.col("sample_idx") - 4) * 10.0)
    chain = R.difference_chain(pair, 8, 2, 0.56, 2e8, 1.68e8, 10.0, 200.0, kernel=3, prominence=1.0, width=1.0, most_apart=20, least_coherence=0.2)
    return chain.bed.select("pair_id", F.col("sample_idx").cast("double").alias("sample_idx"), "range", r6("coherence").alias("coherence"), "fault")


@query("pick_edits", f"""
WITH {PK}, e AS (SELECT * FROM pk WHERE n <> 2 UNION ALL SELECT i, 2, samp1 + 1, samp2 + 1, samp3 + 1, power FROM pk WHERE n = 2 UNION ALL SELECT i, 4, NULL, NULL, NULL, NULL FROM tr)
SELECT n AS picknum, i AS trace_idx, CASE WHEN n <> 1 OR i < 100 THEN samp1 END AS samp1, CASE WHEN n <> 1 OR i < 100 THEN samp2 END AS samp2, CASE WHEN n <> 1 OR i < 100 THEN round(power, 6) + 0.0 END AS power FROM e""")
def pick_edits(spark, d):
    """A layer added, one replaced, and one cleared from a trace on."""
    from . import picks as P

    have = picks(spark, d)
    moved = have.where("picknum = 2").drop("picknum").withColumns({c: F.col(c) + 1 for c in ("samp1", "samp2", "samp3")})
    out = P.delete_right(P.update_pick(P.add_pick(have, traces(spark, d), 4), moved, 2), 1, 100)
    return out.select("picknum", "trace_idx", "samp1", "samp2", r6("power").alias("power"))


@query("polarised_chain", f"""
WITH {QUAD}, x AS (SELECT site, s, arg_min(t, (an, t)) AS t FROM an WHERE t >= 2 AND t < 8 GROUP BY 1, 2)
SELECT site, s AS sample_idx, t AS cpe_idx, round(re, 4) + 0.0 AS co_re, round(im, 4) + 0.0 AS co_im FROM x JOIN cc USING (site, s, t)""")
def polarised_chain(spark, d):
    out = R.polarised_chain(_sites(spark, d), THETAS, 2, 8, 2, 3)
    return out.select("site", "sample_idx", "cpe_idx", r4("co_re").alias("co_re"), r4("co_im").alias("co_im"))


@query("surface_elevation", f"WITH {TR} SELECT i AS trace_idx, round(elev - (i % 9) * 1e-6 * 3e8 / 2, 6) + 0.0 AS elev FROM tr")
def surface_elevation(spark, d):
    return traces(spark, d).select("trace_idx", r6(X.surface_elevation(F.col("elev"), (F.col("trace_idx") % 9) * 1e-6)).alias("elev"))


@query("comment_time", "SELECT event_id, make_date(year(ts), month(ts), day(ts))::VARCHAR AS day FROM events")
def comment_time(spark, d):
    text = F.concat(F.lit("[a] note [b] "), F.month("ts").cast("string"), F.lit("/"), F.dayofmonth("ts").cast("string"), F.lit("/"), F.year("ts").cast("string"))
    return read(spark, d, "events").select("event_id", X.comment_time(text).cast("string").alias("day"))


@query("fabric_strength", f"WITH {TR} SELECT i AS trace_idx, round(3e8 / (4 * pi() * 3e8) * (2 * sqrt(3.12) / 0.035) * a[1], 6) + 0.0 AS fabric FROM tr")
def fabric_strength(spark, d):
    return traces(spark, d).select("trace_idx", r6(R.fabric_strength(F.col("samples")[0], 3e8)).alias("fabric"))


