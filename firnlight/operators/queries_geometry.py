"""Queries of scalar functions, positions and resampling, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as X
from ..plans.registry import query
from ..plans.tables import S, TR, r6, read, traces
from . import geometry as G
from .quantiles import quantiles


@query("cumulative_distance", f"""
WITH {TR}, d AS (SELECT i, coalesce(sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)), 0) / 1000 AS d FROM tr WINDOW w AS (ORDER BY i))
SELECT i AS trace_idx, round(sum(d) OVER (ORDER BY i), 6) + 0.0 AS dist FROM d""")
def cumulative_distance(spark, d):
    return G.cumulative_distance(traces(spark, d)).select("trace_idx", r6("dist").alias("dist"))


@query("stationary_cull", f"""
WITH {TR}, a AS (SELECT i, dist, dist - lag(dist) OVER (ORDER BY i) AS st FROM tr), b AS (SELECT *, coalesce(st * 1000 < 0.01, false) AS still FROM a),
c AS (SELECT *, dist - sum(CASE WHEN still THEN st ELSE 0 END) OVER (ORDER BY i) AS nd FROM b)
SELECT (row_number() OVER (ORDER BY i) - 1)::INT AS trace_idx, round(nd, 6) + 0.0 AS dist FROM c WHERE NOT still""")
def stationary_cull(spark, d):
    return G.cull_stationary(traces(spark, d)).select("trace_idx", r6("dist").alias("dist"))


@query("constant_space", f"""
WITH {TR}, b AS (SELECT *, lag(dist) OVER (ORDER BY i) AS pd FROM tr), k AS (SELECT * FROM b WHERE pd IS NULL OR (dist - pd) * 1000 >= 0.01),
n AS (SELECT *, lead(dist) OVER w AS nd, lead(lat) OVER w AS nl, lead(a) OVER w AS na, min(dist) OVER () AS d0 FROM k WINDOW w AS (ORDER BY i)),
g AS (SELECT *, unnest(range(ceil((dist - d0) / 0.0035::DOUBLE - 1e-9)::INT, ceil((nd - d0) / 0.0035::DOUBLE - 1e-9)::INT))::INT AS j FROM n WHERE nd IS NOT NULL),
w AS (SELECT *, (d0 + j * 0.0035::DOUBLE - dist) / (nd - dist) AS w FROM g)
SELECT j AS trace_idx, round(d0 + j * 0.0035::DOUBLE, 6) + 0.0 AS dist, round(lat + (nl - lat) * w, 6) + 0.0 AS lat, round(a[5] + (na[5] - a[5]) * w, 6) + 0.0 AS v4 FROM w""")
def constant_space(spark, d):
    out = G.constant_spacing(traces(spark, d), 3.5, ["lat", "long"])
    return out.select("trace_idx", r6("dist").alias("dist"), r6("lat").alias("lat"), r6(F.col("samples")[4]).alias("v4"))


FIX = "f AS (SELECT user_id, epoch(ts)::DOUBLE AS t, value AS v FROM events), r AS (SELECT user_id, t, avg(v) AS v FROM f GROUP BY 1, 2)"


def _events(spark, d):
    e = read(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").cast("double").alias("t"), F.col("value").alias("v"))
    return e.groupBy("user_id", "t").agg(F.avg("v").alias("v"))


@query("gps_interp", f"""
WITH {FIX}, p AS (SELECT user_id, unnest(range(0, 240)) * 10800.0::DOUBLE + 1704067200.0::DOUBLE AS t FROM (SELECT DISTINCT user_id FROM r)),
s AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1 FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT p.user_id, p.t, round(CASE WHEN s.t = p.t THEN s.v ELSE s.v + (s.v1 - s.v) * ((p.t - s.t) / (s.t1 - s.t)) END, 6) + 0.0 AS v
FROM p LEFT JOIN s ON p.user_id = s.user_id AND p.t >= s.t AND (p.t < s.t1 OR s.t1 IS NULL AND p.t = s.t)""")
def gps_interp(spark, d):
    fixes = _events(spark, d)
    grid = F.explode(F.sequence(F.lit(0), F.lit(239))).alias("k")
    points = fixes.select("user_id").distinct().select("user_id", grid).select("user_id", (F.col("k") * 10800.0 + 1704067200.0).alias("t"))
    return G.interpolate(points, fixes, "user_id", "t", ["v"]).select("user_id", "t", r6("v").alias("v"))


@query("gps_extrapolated", f"""
WITH {FIX}, p AS (SELECT user_id, unnest(range(-10, 260, 10)) * 10800.0::DOUBLE + 1704067200.0::DOUBLE AS t FROM (SELECT user_id FROM r GROUP BY 1 HAVING count(*) > 1)),
s AS (SELECT *, lead(t) OVER w AS t1, lead(v) OVER w AS v1, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS c FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)),
g AS (SELECT *, CASE WHEN n = 1 THEN '-infinity'::DOUBLE ELSE t END AS low, CASE WHEN n = c - 1 THEN 'infinity'::DOUBLE ELSE t1 END AS high FROM s WHERE t1 IS NOT NULL)
SELECT p.user_id, p.t, round(g.v + (g.v1 - g.v) * ((p.t - g.t) / (g.t1 - g.t)), 3) + 0.0 AS v FROM p JOIN g ON p.user_id = g.user_id AND p.t >= g.low AND p.t < g.high""")
def gps_extrapolated(spark, d):
    fixes = _events(spark, d)
    many = fixes.groupBy("user_id").count().where("count > 1")
    points = many.select("user_id", F.explode(F.sequence(F.lit(-10), F.lit(250), F.lit(10))).alias("k")).select("user_id", (F.col("k") * 10800.0 + 1704067200.0).alias("t"))
    out = G.interpolate(points, fixes, "user_id", "t", ["v"], extrapolate=True)
    return out.select("user_id", "t", (F.round("v", 3) + F.lit(0.0)).alias("v"))


def _gaps(spark, d):
    return traces(spark, d).withColumn("elev", F.when(F.col("trace_idx") % 7 < 4, F.sin(F.col("trace_idx") * 0.1)))


@query("clean_gps", f"""
WITH {TR}, e AS (SELECT i, CASE WHEN i % 7 < 4 THEN sin(i * 0.1::DOUBLE) END AS e FROM tr), k AS (SELECT i, e, lead(i) OVER (ORDER BY i) AS i1, lead(e) OVER (ORDER BY i) AS e1, count(*) OVER () AS c, row_number() OVER (ORDER BY i) AS n FROM e WHERE e IS NOT NULL),
g AS (SELECT *, CASE WHEN n = 1 THEN -1 ELSE i END AS lo, CASE WHEN n = c - 1 THEN 1000000000 ELSE i1 END AS hi FROM k WHERE i1 IS NOT NULL)
SELECT e.i AS trace_idx, round(g.e + (g.e1 - g.e) * ((e.i - g.i) / (g.i1 - g.i)), 6) + 0.0 AS elev FROM e JOIN g ON e.i >= g.lo AND e.i < g.hi""")
def clean_gps(spark, d):
    return G.clean_gps(_gaps(spark, d).select("profile_id", "trace_idx", "elev"), ["elev"]).select("trace_idx", r6("elev").alias("elev"))


def _clocks(spark, d):
    own = traces(spark, d).select("profile_id", "decday", (F.sin(F.col("trace_idx") * 0.05) - 80).alias("lat"), (F.cos(F.col("trace_idx") * 0.03) + 170).alias("long"), "trace_idx")
    fixes = own.where("trace_idx % 5 = 0").withColumn("decday", F.col("decday") - 0.0005)
    return own.drop("trace_idx"), fixes.drop("trace_idx")


OFFSETS = [round(-0.001 + 0.0001 * k, 6) for k in range(21)]


@query("gps_offset_scores", f"""
WITH {TR}, o AS (SELECT decday AS t, sin(i * 0.05::DOUBLE) - 80 AS lat, cos(i * 0.03::DOUBLE) + 170 AS lon, i FROM tr),
g AS (SELECT unnest({OFFSETS}::DOUBLE[]) AS o), f AS (SELECT g.o, t - 0.0005::DOUBLE + g.o AS t, lat, lon FROM o, g WHERE i % 5 = 0),
s AS (SELECT *, lead(t) OVER w AS t1, lead(lat) OVER w AS lat1, lead(lon) OVER w AS lon1 FROM f WINDOW w AS (PARTITION BY o ORDER BY t)),
m AS (SELECT s.o, o.lat AS a, o.lon AS b, s.lat + (s.lat1 - s.lat) * ((o.t - s.t) / (s.t1 - s.t)) AS c, s.lon + (s.lon1 - s.lon) * ((o.t - s.t) / (s.t1 - s.t)) AS e
  FROM o JOIN s ON o.t >= s.t AND o.t < s.t1)
SELECT o AS "offset", round(corr(a, c) + corr(b, e), 4) + 0.0 AS score FROM m GROUP BY o""")
def gps_offset_scores(spark, d):
    own, fixes = _clocks(spark, d)
    return G.offset_scores(own, fixes, OFFSETS).select("offset", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query("profile_intersection", f"""
WITH {TR}, m AS (SELECT i, x, y FROM tr WHERE i % 2 = 0), c AS (SELECT i, x + 1.5::DOUBLE AS x, y * 1.001::DOUBLE AS y FROM tr WHERE i % 2 = 1),
d AS (SELECT c.i AS ci, m.i AS mi, (c.x - m.x) * (c.x - m.x) + (c.y - m.y) * (c.y - m.y) AS d2 FROM c, m WHERE abs(c.x - m.x) < 10 AND abs(c.y - m.y) < 10)
SELECT ci AS cross_idx, arg_min(mi, (d2, mi)) AS main_idx, round(sqrt(min(d2)), 6) + 0.0 AS distance FROM d WHERE d2 < 100 GROUP BY ci""")
def profile_intersection(spark, d):
    t = traces(spark, d)
    cross = t.where("trace_idx % 2 = 1").withColumn("x_coord", F.col("x_coord") + 1.5).withColumn("y_coord", F.col("y_coord") * 1.001)
    return G.intersections(t.where("trace_idx % 2 = 0"), cross).withColumn("distance", r6("distance"))


DEPTHS, SPEEDS = [0.0, 1.0, 10.0, 30.0, 51.0], [2.1e8, 1.9e8, 1.8e8, 1.7e8, 1.68e8]


@query("nearest_velocity", f"""
WITH {TR}, z AS (SELECT unnest({DEPTHS}::DOUBLE[]) AS z, unnest({SPEEDS}::DOUBLE[]) AS v, unnest(range(5)) AS n), d AS (SELECT i, (i % 60)::DOUBLE + 0.25 AS z FROM tr)
SELECT i AS trace_idx, arg_min(z.v, (abs(z.z - d.z), n)) AS velocity FROM d, z GROUP BY i""")
def nearest_velocity(spark, d):
    t = traces(spark, d).withColumn("z", (F.col("trace_idx") % 60).cast("double") + 0.25)
    return G.nearest_velocity(t, DEPTHS, SPEEDS, "z").select("trace_idx", "velocity")


@query("utm_project", f"""
WITH {TR}, c AS (SELECT 1 / 298.257223563 / (2 - 1 / 298.257223563)::DOUBLE AS n), z AS (SELECT i, lat, lon, (1 + floor((lon + 180) / 6))::INT AS zone, n FROM tr, c),
p AS (SELECT *, radians(lat) AS phi, radians(lon - (zone * 6 - 183)) AS lam, 2 * sqrt(n) / (1 + n) AS e FROM z),
q AS (SELECT *, sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))) AS t FROM p), r AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta,
  n / 2 - 2 * n * n / 3 + 5 * n * n * n / 16 AS a1, 13 * n * n / 48 - 3 * n * n * n / 5 AS a2, 61 * n * n * n / 240 AS a3, 6378137.0 / (1 + n) * (1 + n * n / 4 + n * n * n * n / 64) AS big FROM q)
SELECT i AS trace_idx, zone, round(500000.0 + 0.9996 * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 4) + 0.0 AS x,
  round(CASE WHEN lat < 0 THEN 10000000.0 ELSE 0.0 END + 0.9996 * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)), 4) + 0.0 AS y FROM r""")
def utm_project(spark, d):
    x, y, zone = X.utm(F.col("lat"), F.col("long"))
    return traces(spark, d).select("trace_idx", zone.alias("zone"), (F.round(x, 4) + F.lit(0.0)).alias("x"), (F.round(y, 4) + F.lit(0.0)).alias("y"))


@query("flat_earth", f"WITH {TR} SELECT i AS trace_idx, round(lon * 110000 * abs(cos(radians(lat))), 4) + 0.0 AS x, round(lat * 110000, 4) + 0.0 AS y FROM tr")
def flat_earth(spark, d):
    x, y = X.flat_earth(F.col("lat"), F.col("long"))
    return traces(spark, d).select("trace_idx", (F.round(x, 4) + F.lit(0.0)).alias("x"), (F.round(y, 4) + F.lit(0.0)).alias("y"))


CLOCK = "(hour(ts) * 10000 + minute(ts) * 100 + second(ts))::DOUBLE"


@query("hhmmss_to_day", f"""
SELECT event_id, round(floor({CLOCK} / 10000) / 24 + floor(({CLOCK} % 10000) / 100) / 1440 + ({CLOCK} % 100) / 86400, 9) + 0.0 AS day FROM events""")
def hhmmss_to_day(spark, d):
    clock = (F.hour("ts") * 10000 + F.minute("ts") * 100 + F.second("ts")).cast("double")
    return read(spark, d, "events").select("event_id", (F.round(X.hhmmss_to_day(clock), 9) + F.lit(0.0)).alias("day"))


@query("ddmm_to_deg", f"WITH {TR} SELECT i AS trace_idx, round(-((7900 + i % 60 + 0.25::DOUBLE - (7900 + i % 60 + 0.25::DOUBLE) % 100) / 100 + ((7900 + i % 60 + 0.25::DOUBLE) % 100) / 60), 8) + 0.0 AS deg FROM tr")
def ddmm_to_deg(spark, d):
    x = F.lit(7900) + F.col("trace_idx") % 60 + F.lit(0.25)
    return traces(spark, d).select("trace_idx", (F.round(X.ddmm_to_degrees(x, -1), 8) + F.lit(0.0)).alias("deg"))


NMEA = "'$GPGGA,' || lpad((120000 + i % 60)::VARCHAR, 6, '0') || ',79' || lpad((i % 60)::VARCHAR, 2, '0') || '.5,S,170' || lpad((i % 60)::VARCHAR, 2, '0') || '.25,' || CASE WHEN i % 2 = 0 THEN 'E' ELSE 'W' END || ',1,08,0.9,' || CASE WHEN i % 11 = 0 THEN '' ELSE (1000 + i)::VARCHAR END || ',M,-5.5,M,,*47'"


@query("nmea_parse", f"""
WITH {TR}, l AS (SELECT i, string_split({NMEA}, ',') AS f FROM tr)
SELECT i AS trace_idx, round(0.5 + (i % 60) / 86400.0, 8) + 0.0 AS day, round(-(79 + (i % 60 + 0.5) / 60), 8) + 0.0 AS lat,
       round(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * (170 + (i % 60 + 0.25) / 60), 8) + 0.0 AS long, try_cast(f[10] AS DOUBLE) AS altitude, f[12]::DOUBLE AS geoid, f[7]::INT AS quality FROM l""")
def nmea_parse(spark, d):
    minutes = F.lpad((F.col("trace_idx") % 60).cast("string"), 2, "0")
    line = F.concat(
        F.lit("$GPGGA,"), F.lpad((F.lit(120000) + F.col("trace_idx") % 60).cast("string"), 6, "0"), F.lit(",79"), minutes, F.lit(".5,S,170"), minutes, F.lit(".25,"),
        F.when(F.col("trace_idx") % 2 == 0, "E").otherwise("W"), F.lit(",1,08,0.9,"), F.when(F.col("trace_idx") % 11 == 0, "").otherwise((F.col("trace_idx") + 1000).cast("string")), F.lit(",M,-5.5,M,,*47"))
    g = X.gga(F.col("line"))
    r8 = {k: (F.round(g[k], 8) + F.lit(0.0)).alias(k) for k in ("day", "lat", "long")}
    return traces(spark, d).select("trace_idx", line.alias("line")).select("trace_idx", *r8.values(), *[g[k].alias(k) for k in ("altitude", "geoid", "quality")])


@query("permittivity_snow", f"WITH {TR} SELECT i AS trace_idx, round(1 + 1.7 * (i % 90) / 100.0 + 0.7 * ((i % 90) / 100.0) * ((i % 90) / 100.0) + 0.02 * pow(2.0, 1.015) + 0.073 * pow(2.0, 1.31) / (1 + 2e8 / 9.07e9), 8) + 0.0 AS eps FROM tr")
def permittivity_snow(spark, d):
    rho = (F.col("trace_idx") % 90) / 100.0
    return traces(spark, d).select("trace_idx", (F.round(X.snow_permittivity(rho, 2e8, 2.0), 8) + F.lit(0.0)).alias("eps"))


@query("permittivity_firn", f"""
WITH {TR}, r AS (SELECT pow(sqrt(3.12 * 3.12 + 9.5 * 9.5), 1.0 / 3) AS r, -atan2(9.5, 3.12) / 3 AS f), z AS (SELECT i, (300 + i % 600) / 917.0 AS s, r * cos(f) AS a, r * sin(f) AS b FROM tr, r)
SELECT i AS trace_idx, round(pow(1 + s * (a - 1), 3) - 3 * (1 + s * (a - 1)) * pow(s * b, 2), 8) + 0.0 AS eps FROM z""")
def permittivity_firn(spark, d):
    return traces(spark, d).select("trace_idx", (F.round(X.firn_permittivity((F.lit(300) + F.col("trace_idx") % 600)), 8) + F.lit(0.0)).alias("eps"))


@query("power_db", f"WITH {S} SELECT i AS trace_idx, k AS sample_idx, CASE WHEN v * v > 0 THEN round(10 * log10(v * v), 5) + 0.0 END AS db FROM s")
def power_db(spark, d):
    from ..plans.tables import samples

    return samples(traces(spark, d), "trace_idx").select("trace_idx", "sample_idx", (F.round(X.amplitude_decibel(F.col("v")), 5) + F.lit(0.0)).alias("db"))


@query("percentile_limits", f"WITH {S} SELECT round(quantile_cont(v, 0.01), 6) + 0.0 AS low, round(quantile_cont(v, 0.99), 6) + 0.0 AS high FROM s")
def percentile_limits(spark, d):
    from ..plans.tables import samples

    q = quantiles(samples(traces(spark, d), "trace_idx"), [], "v", [0.01, 0.99])
    return q.select(r6(F.col("quantiles")[0]).alias("low"), r6(F.col("quantiles")[1]).alias("high"))


@query("profile_quantiles", f"WITH {S} SELECT p AS profile_id, count(v) AS n, round(quantile_cont(v, 0.05), 6) + 0.0 AS low, round(median(v), 6) + 0.0 AS mid, round(quantile_cont(v, 0.95), 6) + 0.0 AS high FROM s GROUP BY p")
def profile_quantiles(spark, d):
    """Limits and medians of each profile's samples."""
    from ..plans.tables import samples

    q = quantiles(samples(traces(spark, d, by_label=True), "profile_id"), ["profile_id"], "v", [0.05, 0.5, 0.95])
    return q.select("profile_id", "n", *[r6(F.col("quantiles")[i]).alias(c) for i, c in enumerate(("low", "mid", "high"))])


@query("phase_to_range", f"""
WITH {S} SELECT i AS trace_idx, k AS sample_idx, round(v / (4 * pi() / 0.56 - 4 * (k * 2.0) * 2e8 / (1.68e8 * 1.68e8)), 8) + 0.0 AS r FROM s""")
def phase_to_range(spark, d):
    from ..plans.tables import samples

    r = X.phase_to_range(F.col("v"), 0.56, F.col("sample_idx") * 2.0, 2e8, 1.68e8)
    return samples(traces(spark, d), "trace_idx").select("trace_idx", "sample_idx", (F.round(r, 8) + F.lit(0.0)).alias("r"))


@query("packed_date", """
WITH p AS (SELECT event_id, ((year(ts) - 1980) << 25) | (month(ts) << 21) | (day(ts) << 16) | (hour(ts) << 11) | (minute(ts) << 5) | (second(ts) // 2) AS x FROM events)
SELECT event_id, (x >> 25) + 1980 AS year, ((x >> 5) & 63)::BIGINT AS minute, ((x & 31) * 2)::BIGINT AS second FROM p""")
def packed_date(spark, d):
    def shl(c, n):
        return F.shiftleft(c.cast("long"), n)

    x = shl(F.year("ts") - 1980, 25) + shl(F.month("ts"), 21) + shl(F.dayofmonth("ts"), 16) + shl(F.hour("ts"), 11) + shl(F.minute("ts"), 5) + F.floor(F.second("ts") / 2)
    ts = X.packed_date(F.col("x"))
    return read(spark, d, "events").select("event_id", x.alias("x")).select("event_id", F.year(ts).cast("long").alias("year"), F.minute(ts).cast("long").alias("minute"), F.second(ts).cast("long").alias("second"))


