"""Registered queries of the sources: tables written as files of each format and read back, whole."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from borespark.functions import crs, selectors
from borespark.operators import time_depth
from borespark.plans.workload import r6, register, table
from borespark.plans.workload_traces import INTERVAL, WIDTH, dense, line_count, samples
from borespark.sources import folder, logs, segy, tables, zarr


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def mounted(path: str) -> str:
    """The path as Python's open wants it, made where needed."""
    out = re.sub(r"^file:/*", "/", path)
    os.makedirs(os.path.dirname(out), exist_ok=True)
    return out


# --- logs

_HEAD = """~Version
 VERS. 2.0 : log standard
 WRAP. NO  : one line per depth
~Well
 STRT.M  0 : first depth
 NULL.  -999.25 : missing
 WELL.  {0} : a well: with a colon
~Curve
 DEPT.M  : depth
 V   .API 1 2 : value
~ASCII
"""


def _log_files(spark, sf_dir, path: str) -> None:
    """A log file per well: depth is the event's number, every seventh value is missing."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "event_id", F.when(F.col("event_id") % 7 != 0, F.round("value", 4)).alias("v"))
    line = F.format_string(" %d.0 %s", "event_id", F.coalesce(F.col("v").cast("decimal(18,4)").cast("string"), F.lit("-999.25")))
    rows = e.groupBy("well").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("rows"))
    head = F.replace(F.lit(_HEAD), F.lit("{0}"), F.col("well").cast("string"))
    rows.select("well", F.concat(head, "rows").alias("value")).write.mode("overwrite").partitionBy("well").text(path)


@register("s01_log_files", "SELECT user_id AS well, event_id AS id, CASE WHEN event_id % 7 <> 0 THEN ROUND(value, 4) END AS v FROM events")
def s01_log_files(spark, sf_dir):
    path = workspace(spark, "logs")
    _log_files(spark, sf_dir, path)
    cells = logs.read_logs(spark, path)
    value = logs.typed(logs.apply_null_policy(F.col("raw"), "strict", F.col("null_value")))
    rows = logs.wide(cells.withColumn("value", value), ["DEPT", "V"])
    well = F.regexp_extract("file", "well=([0-9]+)", 1).cast("long")
    return rows.select(well.alias("well"), F.col("DEPT").cast("long").alias("id"), r6("V", 4).alias("v"))


@register("s03_log_headers", "SELECT user_id AS well, CAST(user_id AS VARCHAR) AS name, 'a well: with a colon' AS note, 'API' AS unit, '1 2' AS value FROM events GROUP BY 1")
def s03_log_headers(spark, sf_dir):
    path = workspace(spark, "logs")
    _log_files(spark, sf_dir, path)
    h = logs.read_log_headers(spark, path).withColumn("well", F.regexp_extract("file", "well=([0-9]+)", 1).cast("long"))
    name, curve = h.where("mnemonic = 'WELL'"), h.where("section = 'C' and mnemonic = 'V'")
    return name.select("well", F.col("value").alias("name"), F.col("description").alias("note")).join(curve.select("well", "unit", "value"), "well")


@register("s09_package", "SELECT event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events WHERE event_id BETWEEN 50 AND 900 GROUP BY 1")
def s09_package(spark, sf_dir):
    """A package of logs by type, read through a depth window."""
    path = workspace(spark, "package")
    logs.write_package(table(spark, sf_dir, "events").select("event_type", "event_id", "value"), path, index="event_id", partition=["event_type"])
    return logs.open_package(spark, path).where("event_id between 50 and 900").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), 4).alias("total"))


# --- tables


@register("s08_tops_csv", "SELECT o_orderkey, o_orderpriority AS name, ROUND(o_totalprice, 2) AS top_depth, 'md' AS depth_domain, 'kb' AS depth_datum FROM orders")
def s08_tops_csv(spark, sf_dir):
    path = workspace(spark, "tops")
    o = table(spark, sf_dir, "orders")
    o.select(F.col("o_orderpriority").alias("Top Name"), F.round("o_totalprice", 2).alias("Top"), F.col("o_orderkey").alias("Source"), F.lit("Measured Depth").alias("depth_domain"), F.lit("Kelly Bushing").alias("reference")).write.option("header", True).csv(path)
    rows = tables.read_family(spark, path, "tops")
    return rows.select(F.col("source").cast("long").alias("o_orderkey"), "name", r6("top_depth", 2).alias("top_depth"), "depth_domain", "depth_datum")


def _text(df, path: str, *cells, sep: str = " ") -> None:
    df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in cells]).alias("value")).write.text(path)


@register("s28_horizon_text", "SELECT l_partkey AS x, l_suppkey AS y, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS z FROM lineitem GROUP BY 1, 2")
def s28_horizon_text(spark, sf_dir):
    path = workspace(spark, "horizon")
    li = table(spark, sf_dir, "lineitem")
    _text(li, path, "l_partkey", "l_suppkey", "l_quantity", sep="; ")
    spark.range(3).select(F.concat(F.lit("# note "), F.col("id").cast("string")).alias("value")).write.mode("append").text(path)
    return tables.read_horizon(spark, path).groupBy(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).agg(F.count("*").alias("n"), r6(F.sum("z"), 2).alias("z"))


@register("s29_velocity_text", "SELECT l_partkey AS x, l_suppkey AS y, COUNT(*) AS n, ROUND(SUM(CASE WHEN l_linenumber % 2 = 0 THEN 1600.0 + l_quantity ELSE 1500.0 + l_quantity END), 2) AS v FROM lineitem GROUP BY 1, 2")
def s29_velocity_text(spark, sf_dir):
    """Rows of four and of seven numbers in one file."""
    path = workspace(spark, "velocity")
    li = table(spark, sf_dir, "lineitem").withColumns({"t": F.col("l_linenumber") * 100, "v": 1500.0 + F.col("l_quantity"), "w": 1600.0 + F.col("l_quantity")})
    short = F.concat_ws(" ", "l_partkey", "l_suppkey", "t", "v")
    full = F.concat_ws(" ", "l_partkey", "l_suppkey", "t", F.lit("1700"), "w", F.lit("1800"), F.lit("90"))
    li.select(F.when(F.col("l_linenumber") % 2 == 0, full).otherwise(short).alias("value")).write.text(path)
    f = tables.read_velocity_functions(spark, path, "interval")
    return f.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.size("times").cast("long").alias("n"), r6(F.aggregate("velocities", F.lit(0.0), lambda s, v: s + v), 2).alias("v"))


@register("s34_checkshot_text", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS well, CAST(event_id AS DOUBLE) AS depth, ROUND(value, 3) AS time_ms FROM events")
def s34_checkshot_text(spark, sf_dir):
    """Signs and exact repetitions go."""
    path = workspace(spark, "checkshots")
    e = table(spark, sf_dir, "events").select((-F.round("value", 3)).cast("decimal(18,3)").alias("t"), (-F.col("event_id")).alias("z"), "user_id")
    _text(e.union(e), path, "t", "z", "user_id", sep="\t")
    return tables.read_checkshots(spark, path).withColumn("time_ms", r6("time_ms", 3))


@register("s35_time_depth_text", "SELECT CAST(l_partkey AS DOUBLE) AS depth, ROUND(MIN(l_quantity), 3) AS time_ms FROM lineitem GROUP BY 1")
def s35_time_depth_text(spark, sf_dir):
    path = workspace(spark, "time-depth")
    _text(table(spark, sf_dir, "lineitem").withColumn("s", F.col("l_quantity") / 1000.0), path, "l_partkey", "s")
    return tables.read_time_depth(spark, path).withColumn("time_ms", r6("time_ms", 3))


@register("s37_well_text", "SELECT o_custkey % 50 AS well, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS depths, CAST(0 AS BIGINT) AS issues FROM orders GROUP BY 1")
def s37_well_text(spark, sf_dir):
    """Tops with header lines, a file per well (fifty); the sums of two-digit depths are exact."""
    path = workspace(spark, "tops-text")
    o = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("well"), F.format_string("%.2f\t%.2f\t%s\t\t\tx", "o_totalprice", F.col("o_totalprice") + 1.0, "o_orderpriority").alias("l"))
    rows = o.groupBy("well").agg(F.array_join(F.sort_array(F.collect_list("l")), "\n").alias("rows"))
    text = F.concat(F.lit("Well Name: "), F.col("well").cast("string"), F.lit("\nDepth Ref Point: KB\nSource: log\nTop(m)\tBase(m)\tName\n"), "rows")
    rows.select("well", text.alias("value")).write.partitionBy("well").text(path)
    t = folder.read_tops_text(spark, path)
    return t.groupBy(F.col("well").cast("long").alias("well")).agg(F.count("*").alias("n"), F.sum(F.col("top_depth").cast("decimal(18,2)")).cast("double").alias("depths"), F.count("issue").alias("issues"))


# --- traces


def _trace_file(spark, sf_dir, path: str) -> segy.Layout:
    """The dense volume as one file, written by all tasks; lines from 100, crosslines from 7."""
    v = dense(spark, sf_dir).select((F.col("il") * WIDTH + F.col("xl")).alias("trace"), (F.col("il") + 100).alias("inline"), (F.col("xl") + 7).alias("crossline"), "amplitude")
    layout = segy.make_layout(v.count(), 64, int(INTERVAL * 1000), code=6)
    segy.export_traces(v, path, layout, ["inline", "crossline"])
    return layout


@register("s13_trace_file", f"SELECT vec_id // {WIDTH} + 100 AS inline, vec_id % {WIDTH} + 7 AS crossline, t, ROUND(x, 6) AS x FROM (SELECT vec_id, UNNEST(RANGE(64)) AS t, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings)")
def s13_trace_file(spark, sf_dir):
    path = mounted(workspace(spark, "traces") + "/volume.sgy")
    _trace_file(spark, sf_dir, path)
    t = segy.read_traces(spark, path, ("inline", "crossline")).select(F.col("inline").cast("long").alias("inline"), F.col("crossline").cast("long").alias("crossline"), "amplitude")
    return samples(t, "inline", "crossline")


@register("s12_trace_headers", f"SELECT vec_id AS trace, CAST(64 AS INT) AS samples, CAST(4000 AS INT) AS interval_us, CAST(vec_id // {WIDTH} + 100 AS INT) AS inline FROM embeddings")
def s12_trace_headers(spark, sf_dir):
    """Headers alone, by a reader that takes the files from any store."""
    path = mounted(workspace(spark, "traces") + "/volume.sgy")
    _trace_file(spark, sf_dir, path)
    return segy.read_stored(spark, path, ("samples", "interval_us", "inline"), samples=False).select("trace", "samples", "interval_us", "inline")


@register("s16_volume_ingest", f"SELECT vec_id // {WIDTH} + 100 AS il, COUNT(*) AS traces, ROUND(SUM(CAST(embedding[1] AS DOUBLE)), 6) AS first FROM embeddings GROUP BY 1")
def s16_volume_ingest(spark, sf_dir):
    """A file becomes a tiled volume, of which every line is read."""
    path = mounted(workspace(spark, "traces") + "/volume.sgy")
    _trace_file(spark, sf_dir, path)
    store = workspace(spark, "volume")
    segy.ingest_volume(spark, path, store)
    v = segy.read_volume(spark, store, il=(0, 1 << 30))
    return v.groupBy(F.col("il").cast("long").alias("il")).agg(F.count_if("occupied").alias("traces"), r6(F.sum(F.when(F.col("occupied"), F.get("amplitude", F.lit(0))))).alias("first"))


@register("s19_zarr_volume", f"SELECT vec_id // {WIDTH} AS il, vec_id % {WIDTH} AS xl, t, ROUND(x, 5) AS x FROM (SELECT vec_id, UNNEST(RANGE(64)) AS t, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings)")
def s19_zarr_volume(spark, sf_dir):
    path = mounted(workspace(spark, "zarr") + "/volume.zarr")
    zarr.write_volume(dense(spark, sf_dir), path, (line_count(spark, sf_dir), WIDTH, 64), (8, 10))
    v = zarr.read_volume(spark, f"file://{path}")
    return samples(v, digits=5)


@register("s22_tiled_volume", f"SELECT vec_id // {WIDTH} AS il, vec_id % {WIDTH} AS xl, ROUND(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE vec_id // {WIDTH} BETWEEN 3 AND 9 AND vec_id % {WIDTH} >= 5")
def s22_tiled_volume(spark, sf_dir):
    """A window of a stored volume."""
    path = workspace(spark, "volume")
    segy.write_volume(dense(spark, sf_dir), path, tile=8)
    v = segy.read_volume(spark, path, il=(3, 9), xl=(5, WIDTH), tile=8)
    return v.select("il", "xl", r6(F.get("amplitude", F.lit(0))).alias("first"))


# --- names, coordinates, trends

_SELECTORS = ("Gamma", "RHO_B", "com pressional slowness", "MyCurve", " vs ")


@register("p33_log_type", "SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'GammaRay' WHEN 1 THEN 'BulkDensity' WHEN 2 THEN 'CompressionalSlowness' WHEN 3 THEN 'MyCurve' ELSE 'SVelocity' END AS log_type, CASE WHEN o_orderkey % 2 = 0 THEN 'top_set' ELSE 'well_marker_set' END AS kind FROM orders")
def p33_log_type(spark, sf_dir):
    pick = F.element_at(F.array(*[F.lit(s) for s in _SELECTORS]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    kind = F.when(F.col("o_orderkey") % 2 == 0, "Top-Set").otherwise("well markers")
    return table(spark, sf_dir, "orders").select("o_orderkey", selectors.log_type(pick).alias("log_type"), selectors.interval_set_kind(kind).alias("kind"))


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_C = 2 * _N**0.5 / (1 + _N)
_RADIUS = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
_EAST = " + ".join(f"{k!r}::DOUBLE * COS({2 * j} * u) * (EXP({2 * j} * v) - EXP(-{2 * j} * v)) / 2" for j, k in enumerate(_ALPHA, 1))
_NORTH = " + ".join(f"{k!r}::DOUBLE * SIN({2 * j} * u) * (EXP({2 * j} * v) + EXP(-{2 * j} * v)) / 2" for j, k in enumerate(_ALPHA, 1))


@register("h05_reproject", f"""WITH p AS (SELECT event_id, (event_id % 600) / 100.0 AS lon, -60.0 + (event_id % 1201) / 10.0 AS lat FROM events), q AS (SELECT *, SIN(RADIANS(lat)) AS s, RADIANS(lon - 3.0) AS l FROM p),
 r AS (SELECT *, 0.5 * LN((1 + s) / (1 - s)) - {_C!r}::DOUBLE * 0.5 * LN((1 + {_C!r}::DOUBLE * s) / (1 - {_C!r}::DOUBLE * s)) AS m FROM q), w AS (SELECT *, (EXP(m) - EXP(-m)) / 2 AS t FROM r), z AS (SELECT *, ATAN2(t, COS(l)) AS u, SIN(l) / SQRT(1 + t * t) AS k FROM w), o AS (SELECT *, 0.5 * LN((1 + k) / (1 - k)) AS v FROM z)
 SELECT event_id, ROUND(500000.0 + {_RADIUS!r}::DOUBLE * (v + {_EAST}), 3) AS x, ROUND({_RADIUS!r}::DOUBLE * (u + {_NORTH}), 3) AS y, ROUND(lon, 7) AS lon, ROUND(lat, 7) AS lat FROM o""")
def h05_reproject(spark, sf_dir):
    """Longitude and latitude to zone 31 and back."""
    e = table(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 600) / 100.0).alias("x"), (-60.0 + (F.col("event_id") % 1201) / 10.0).alias("y"))
    there = crs.reproject(e, 4326, "EPSG:32631")
    back = crs.reproject(there.withColumns({"lon": F.col("x"), "lat": F.col("y")}), 32631, 4326, "lon", "lat")
    return back.select("event_id", r6("x", 3).alias("x"), r6("y", 3).alias("y"), r6("lon", 7).alias("lon"), r6("lat", 7).alias("lat"))


@register("x17_systems", "SELECT CAST(32600 + z AS INT) AS code, 'WGS 84 / UTM zone ' || z || 'N' AS name FROM (SELECT UNNEST(RANGE(30, 40)) AS z) UNION ALL SELECT CAST(25800 + z AS INT), 'ETRS89 / UTM zone ' || z || 'N' FROM (SELECT UNNEST(RANGE(30, 39)) AS z) UNION ALL SELECT CAST(32700 + z AS INT), 'WGS 84 / UTM zone ' || z || 'S' FROM (SELECT UNNEST(RANGE(30, 40)) AS z)")
def x17_systems(spark, sf_dir):
    return crs.search(crs.catalogue(spark), "utm zone 3").where("zone between 30 and 39").select("code", "name")


@register("d06_depth_trend", """WITH RECURSIVE e AS (SELECT vec_id, 20.0 + vec_id % 7 AS top, 200.0 AS base, 1800.0 AS v0, CAST(0.5 AS DOUBLE) + (vec_id % 3) / 10.0 AS g FROM embeddings),
 r(vec_id, top, base, v0, g, t, depth, last, v, value) AS (SELECT vec_id, top, base, v0, g, 0, CAST(0 AS DOUBLE), CAST(top AS DOUBLE), CAST(v0 AS DOUBLE), CAST(v0 AS DOUBLE) FROM e UNION ALL
  SELECT vec_id, top, base, v0, g, t, d1, CASE WHEN moves THEN now ELSE last END, CASE WHEN moves THEN v0 + g * d1 ELSE v END, CASE WHEN ms > top THEN CASE WHEN moves THEN v0 + g * d1 ELSE v END ELSE v0 END
  FROM (SELECT *, CASE WHEN moves THEN depth + (now - last) / 2000.0 * v ELSE depth END AS d1 FROM (SELECT *, ms > top AND now > last AS moves FROM (SELECT vec_id, top, base, v0, g, t + 1 AS t, depth, last, v, (t + 1) * 4.0 AS ms, LEAST((t + 1) * 4.0, base) AS now FROM r WHERE t < 63))))
 SELECT vec_id, t, ROUND(value, 6) AS v FROM r""")
def d06_depth_trend(spark, sf_dir):
    """Velocity linear with depth, by the recursion over the samples."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", (20.0 + F.col("vec_id") % 7).alias("top"), F.lit(200.0).alias("base"), F.lit(1800.0).alias("v0"), (0.5 + (F.col("vec_id") % 3) / 10.0).alias("gradient"))
    v = time_depth.depth_trend_traces(e, [INTERVAL * k for k in range(64)])
    return v.select("vec_id", F.posexplode("velocity").alias("t", "v")).select("vec_id", F.col("t").cast("long").alias("t"), r6("v").alias("v"))
