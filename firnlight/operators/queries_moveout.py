"""Queries of moveout, processing chains and text parsing, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..functions.arrays import doubles
from ..plans.profile import Profile, process
from ..plans.registry import query
from ..plans.tables import DT, PK, S, TR, picks, r6, read, samples, traces, travel_time
from . import moveout as N

_T = np.array(travel_time())
_SHIFT = 1e6 * 10.0 / 1.69e8
_MOVED = np.sqrt((_T + _SHIFT) ** 2 - _SHIFT**2)
_AXIS = np.arange(0.0, _MOVED.max(), 0.01)


def _list(x) -> str:
    return "[" + ", ".join(repr(float(v)) for v in x) + "]::DOUBLE[]"


@query("nmo_constant", f"""
WITH {TR}, m AS (SELECT unnest(range(64))::INT AS k, unnest({_list(_MOVED)}) AS t), b AS (SELECT k, t, lead(t) OVER (ORDER BY k) AS t1 FROM m),
g AS (SELECT unnest(range({len(_AXIS)}))::INT AS j, unnest({_list(_AXIS)}) AS x), w AS (SELECT j, k, (x - t) / (t1 - t) AS w, x FROM g JOIN b ON x >= t AND x < t1)
SELECT i AS trace_idx, j AS sample_idx, round(a[k + 1] * (1 - w) + a[k + 2] * w, 6) + 0.0 AS v FROM tr, w""")
def nmo_constant(spark, d):
    _, _, out = N.moveout(traces(spark, d), travel_time(), DT, 10.0)
    return samples(out, "trace_idx").withColumn("v", r6("v"))


_UNEVEN = [0.01 * k * (1 + 0.002 * k) for k in range(64)]


@query("constant_depth", f"""
WITH {TR}, m AS (SELECT unnest(range(64))::INT AS k, unnest({_list(_UNEVEN)}) AS t), b AS (SELECT k, t, lead(t) OVER (ORDER BY k) AS t1 FROM m),
g AS (SELECT unnest(range(64))::INT AS j, unnest({_list(np.linspace(_UNEVEN[0], _UNEVEN[-1], 64))}) AS x), w AS (SELECT j, k, (x - t) / (t1 - t) AS w FROM g JOIN b ON x >= t AND (x < t1 OR k = 62))
SELECT i AS trace_idx, j AS sample_idx, round(a[k + 1] * (1 - w) + a[k + 2] * w, 6) + 0.0 AS v FROM tr, w""")
def constant_depth(spark, d):
    _, out = N.even_depths(traces(spark, d), _UNEVEN)
    return samples(out, "trace_idx").withColumn("v", r6("v"))


@query("process_chain", f"""
WITH {S}, r AS (SELECT (i - 9) // 3 AS g, k, avg(v) AS v, count(*) AS c FROM s WHERE i >= 9 GROUP BY 1, 2), n AS (SELECT max(g) AS n FROM r WHERE c = 3)
SELECT (n - g)::INT AS trace_idx, (k - 8)::INT AS sample_idx, round(v, 6) + 0.0 AS v FROM r, n WHERE c = 3 AND k >= 8 AND k < 40""")
def process_chain(spark, d):
    out = process(Profile(traces(spark, d), tuple(travel_time()), DT), crop=(8, 40), rev=True, hcrop=10, restack=3)
    return samples(out.traces, "trace_idx").withColumn("v", r6("v"))


@query("title_prefix", """
WITH u AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, url FROM pages), g AS (SELECT host, min(url) AS a, max(url) AS b FROM u GROUP BY host)
SELECT host, left(a, list_max(list_filter(range(0, length(a) + 1), lambda n: left(a, n) = left(b, n)))) AS shared FROM g""")
def title_prefix(spark, d):
    urls = read(spark, d, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "url")
    ends = urls.groupBy("host").agg(F.array(F.min("url"), F.max("url")).alias("ends"))
    return ends.select("host", X.common_start(F.col("ends")).alias("shared"))


@query("xml_value", "SELECT event_id, event_type || '-' || user_id AS v FROM events")
def xml_value(spark, d):
    xml = F.concat(F.lit("<LV><Name>Kind</Name>\n<Val>"), "event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit("</Val></LV>"))
    return read(spark, d, "events").select("event_id", X.xml_value(xml, "kind").alias("v"))


@query("decday_to_time", f"WITH {TR} SELECT i AS trace_idx, epoch_us(to_timestamp((i * 60)::DOUBLE) + INTERVAL 19356 DAY)::BIGINT AS us FROM tr")
def decday_to_time(spark, d):
    day = F.lit(738885.0) + F.col("trace_idx") / F.lit(1440.0)
    whole = F.round(F.unix_micros(X.day_to_timestamp(day)) / 1e6).cast("bigint") * 1000000
    return traces(spark, d).select("trace_idx", whole.alias("us"))


_FIRN_Z, _FIRN_RHO = [0.0, 8.0, 20.0, 45.0], [350.0, 520.0, 740.0, 917.0]
_FIRN = f"""f AS (SELECT unnest({_list(_FIRN_Z)}) AS z, unnest(list_transform({_list(_FIRN_RHO)}, lambda r: 3e8 / (1 + 0.000845::DOUBLE * r))) AS u),
y AS (SELECT 0 AS k, 0.0::DOUBLE AS z UNION ALL SELECT k + 1, y.z + 0.005::DOUBLE * 1e-6 * (SELECT arg_min(u, (abs(f.z - y.z), f.z)) FROM f) FROM y WHERE k < 63)"""


def _permittivity(density: float) -> float:
    return (1 + 0.000845 * density) ** 2


@query("firn_depth", f"WITH RECURSIVE {PK}, {_FIRN} SELECT n AS picknum, i AS trace_idx, round(z, 6) + 0.0 AS depth FROM pk LEFT JOIN y ON k = samp2")
def firn_depth(spark, d):
    """Depths of picks under a density profile."""
    depth = N.depths_of(travel_time(), _FIRN_Z, _FIRN_RHO, _permittivity)
    return picks(spark, d).select("picknum", "trace_idx", r6(F.get(doubles(depth), F.col("samp2").cast("int"))).alias("depth"))


@query("firn_rms_depth", f"""
WITH RECURSIVE {PK}, {_FIRN}, g AS (SELECT list(z ORDER BY k) AS b FROM y),
u AS (SELECT b, list_transform(range(1, 65), lambda k: (b[least(k + 1, 64)] - b[greatest(k - 1, 1)]) / ((least(k + 1, 64) - greatest(k - 1, 1)) * 0.01::DOUBLE) * 2e6) AS v FROM g),
it AS (SELECT 0 AS r, list_transform(range(64), lambda k: k * 0.01::DOUBLE / 2 * 1.69e8 * 1e-6) AS d, false AS done
  UNION ALL SELECT r + 1, n, r >= 5 AND list_max(list_transform(range(1, 65), lambda k: abs(n[k] - d[k]))) <= 0.1::DOUBLE * 1e-8 / 2 * 1.69e8
  FROM (SELECT r, d, list_transform(range(1, 65), lambda k: (k - 1) * 0.01::DOUBLE / 2 * 1e-6 * sqrt(list_avg(list_filter(list_transform(range(1, 65), lambda j: CASE WHEN b[j] <= d[k] THEN v[j] * v[j] END), lambda q: q IS NOT NULL)))) AS n FROM it, u WHERE NOT done AND r < 40)),
o AS (SELECT unnest(range(64)) AS k, unnest(d) AS z FROM it WHERE r = (SELECT max(r) FROM it))
SELECT n AS picknum, i AS trace_idx, round(z, 6) + 0.0 AS depth FROM pk LEFT JOIN o ON k = samp2""")
def firn_rms_depth(spark, d):
    """The same by root-mean-square velocities."""
    depth = N.rms_depths(travel_time(), _FIRN_Z, _FIRN_RHO, _permittivity, DT, rounds=40)
    return picks(spark, d).select("picknum", "trace_idx", r6(F.get(doubles(depth), F.col("samp2").cast("int"))).alias("depth"))
