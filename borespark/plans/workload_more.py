"""Registered queries: projections, edits, name and unit rules, policies, catalog, remaining section and tie operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from borespark.functions import petro
from borespark.operators import frames, gathers, grid, time_depth, traces, well_tie
from borespark.plans.registry import Family, built_in
from borespark.plans.workload import ELASTIC, LOGS, elastic, formula, logs, r6, register, table
from borespark.plans.workload_traces import INLINE, INTERVAL, ORIGIN, WIDTH, XLINE, depth_curves, line_count, pairs, samples, volume
from borespark.sources.logs import apply_null_policy, typed

formula("p30_slowness_by_unit", lambda: petro.slowness_by_unit("dt", "US/M"), "CASE WHEN dt > 0 THEN 1000000.0 / dt END")
formula("p30_velocity_by_unit", lambda: petro.velocity_by_unit("vp", "ft/s"), "vp * CAST(0.3048 AS DOUBLE)", 9)
formula("p30_density_by_unit", lambda: petro.density_by_unit("rho", "kg/m3"), "rho / 1000.0")
formula("p29_depth_metres", lambda: petro.index_in_feet("dt", ".1IN"), "dt / 120.0", 9)


@register("p26_strict_ratio", f"WITH {ELASTIC} SELECT ok, ln, ROUND(vp / vs, 6) AS value FROM elastic WHERE vp > 0 AND vs > 0")
def p26_strict_ratio(spark, sf_dir):
    """The array variant raises on unusable input; here all input is usable."""
    rows = elastic(spark, sf_dir).where("vp > 0 and vs > 0")
    return rows.select("ok", "ln", r6(petro.strict(petro.vp_vs_ratio("vp", "vs"), "vp", "vs")).alias("value"))


@register("p32_depth_semantics", "SELECT o_orderkey, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'md' WHEN 1 THEN 'tvd' WHEN 2 THEN 'tvdss' WHEN 3 THEN 'md' END AS domain, CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'kb' WHEN 3 THEN 'gl' END AS datum FROM orders")
def p32_depth_semantics(spark, sf_dir):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    domain, datum = pick(" Measured Depth", "TVD", "tvdss_m", "", "?"), pick("Kelly Bushing", "", "x", "GL", "")
    return table(spark, sf_dir, "orders").select("o_orderkey", petro.depth_domain(domain, datum).alias("domain"), petro.depth_datum(datum).alias("datum"))


@register("f01_projection", "SELECT l_orderkey, l_quantity FROM lineitem")
def f01_projection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")


@register("f03_depth_window", f"WITH {LOGS} SELECT id, v FROM logs WHERE CAST(id AS DOUBLE) BETWEEN 250.5 AND 700")
def f03_depth_window(spark, sf_dir):
    return frames.depth_window(logs(spark, sf_dir).withColumn("d", F.col("id").cast("double")), "d", 250.5, 700.0, ["well"], ["id"]).select("id", "v")


@register("o06_sorted_unique", "SELECT l_suppkey, STRING_AGG(DISTINCT CAST(l_linenumber AS VARCHAR), ',' ORDER BY CAST(l_linenumber AS VARCHAR)) AS numbers FROM lineitem GROUP BY 1")
def o06_sorted_unique(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_set(F.col("l_linenumber").cast("string"))), ",").alias("numbers"))


@register("o07_cell_update", f"WITH {LOGS} SELECT id, CASE WHEN id = 42 THEN 1.5 ELSE v END AS v FROM logs WHERE id <> 43")
def o07_cell_update(spark, sf_dir):
    rows = logs(spark, sf_dir).select("id", "v")
    change = spark.createDataFrame([(42, 1.5)], "id long, v double")
    return frames.apply_edits(rows, ["id"], change, spark.createDataFrame([(43,)], "id long"))


@register("w02_smooth_inclination", "SELECT event_id AS id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS inclination FROM events")
def w02_smooth_inclination(spark, sf_dir):
    df, _ = built_in().execute("smooth_inclination", table(spark, sf_dir, "events"), {"curve": "value"}, {"keys": "user_id", "order": "event_id"})
    return df.select(F.col("event_id").alias("id"), r6("value").alias("inclination"))


@register("w04_drilling_average", "SELECT event_id AS id, ROUND(AVG(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS average FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)")
def w04_drilling_average(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("x", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    df, _ = built_in().execute("drilling_average", rows, {"curve": "x"}, {"keys": "user_id", "order": "event_id"})
    return df.select(F.col("event_id").alias("id"), r6("value").alias("average"))


@register("s06_null_policy", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN NULL ELSE ROUND(o_totalprice, 2) END AS value FROM orders")
def s06_null_policy(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 4 == 0, "-999.25").when(F.col("o_orderkey") % 4 == 1, "(null)").otherwise(F.col("o_totalprice").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", r6(typed(apply_null_policy(raw, "common")), 2).alias("value"))


@register("s07_integer_keeps_text", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS value FROM orders")
def s07_integer_keeps_text(spark, sf_dir):
    raw = F.when(F.col("o_orderkey") % 4 == 1, "n/a").otherwise(F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", typed(raw, "integer").alias("value"))


@register("j12_marker_residual", """WITH st AS (SELECT user_id AS well, CAST(event_id AS DOUBLE) AS md, CAST(event_id AS DOUBLE) * CAST(0.9 AS DOUBLE) AS tvd FROM events WHERE event_type = 'view'), mk AS (SELECT user_id AS well, event_id AS marker, CAST(event_id AS DOUBLE) AS md, value FROM events),
 a AS (SELECT m.*, s.md AS x0, s.tvd AS y0 FROM mk m ASOF LEFT JOIN st s ON m.well = s.well AND m.md >= s.md), b AS (SELECT a.*, s.md AS x1, s.tvd AS y1 FROM a ASOF LEFT JOIN st s ON a.well = s.well AND a.md <= s.md)
 SELECT marker, ROUND(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x0 = x1 THEN y0 ELSE y0 + (y1 - y0) * (md - x0) / (x1 - x0) END - (500.0 + value), 7) AS residual FROM b WHERE y0 IS NOT NULL OR y1 IS NOT NULL""")
def j12_marker_residual(spark, sf_dir):
    """Marker depth on its trajectory, whose stations are the views, minus the horizon's depth there."""
    e = table(spark, sf_dir, "events")
    stations = e.where("event_type = 'view'").select(F.col("user_id").alias("well"), F.col("event_id").cast("double").alias("md"), (F.col("event_id").cast("double") * F.lit(0.9)).alias("tvd"))
    markers = e.select(F.col("user_id").alias("well"), F.col("event_id").cast("double").alias("md"), F.col("event_id").alias("marker"), (500.0 + F.col("value")).alias("horizon"))
    rows = frames.bracket(markers, stations, ["well"], "md", "tvd").where("tvd is not null")
    return rows.select("marker", r6(F.col("tvd") - F.col("horizon"), 7).alias("residual"))


_MAPPINGS = {"line and quantity": ("l_linenumber", "l_quantity"), "supplier and line": ("l_suppkey", "l_linenumber"), "order and line": ("l_orderkey", "l_linenumber")}
_CANDIDATE = """SELECT '{label}' AS label, COUNT(*) AS u, SUM(n) AS o, LEAST(COUNT(DISTINCT a), COUNT(DISTINCT b)) AS axis, COUNT(DISTINCT a) * COUNT(DISTINCT b) AS x, COUNT(*) FILTER (n > 1) AS dup FROM (SELECT {a} AS a, {b} AS b, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)"""


@register("a21_rank_geometries", "SELECT label, u AS cells, CAST(10000 * CASE WHEN dup = 0 THEN 2 WHEN x = u THEN 1 ELSE 0 END + CASE WHEN dup = 0 THEN 1000 ELSE 0 END + axis + FLOOR(u / x * 100) AS BIGINT) AS score, dup = 0 AND COUNT(*) FILTER (dup = 0) OVER () = 1 AS chosen FROM (" + " UNION ALL ".join(_CANDIDATE.format(label=k, a=a, b=b) for k, (a, b) in _MAPPINGS.items()) + ")")
def a21_rank_geometries(spark, sf_dir):
    """Which two columns of the line items could be the lines of a survey."""
    c = grid.candidate_geometries(table(spark, sf_dir, "lineitem"), _MAPPINGS)
    return grid.rank_geometries(c).select("label", "cells", "score", "chosen")


@register("a22_storage_estimate", "WITH c AS (SELECT l_linenumber AS il, l_quantity AS xl, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT SUM(n) AS o, COUNT(DISTINCT il) * COUNT(DISTINCT xl) AS x, COUNT(*) AS u FROM c) SELECT ROUND(x / o, 6) AS ratio, x * 64 * 4 AS amplitude_bytes, CASE WHEN x > u THEN x ELSE 0 END AS occupancy_bytes FROM s")
def a22_storage_estimate(spark, sf_dir):
    g = grid.geometry(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("il"), F.col("l_quantity").alias("xl")))
    return grid.storage_estimate(g, 64).select(r6("ratio").alias("ratio"), "amplitude_bytes", "occupancy_bytes")


@register("f15_spectrum_window", f"WITH v AS (SELECT vec_id % {WIDTH} AS xl, vec_id, CAST(embedding AS DOUBLE[])[17:48] AS a FROM embeddings WHERE FLOOR(vec_id / {WIDTH}) = 2 AND vec_id % 17 <> 0 AND vec_id % {WIDTH} BETWEEN 3 AND 18), s AS (SELECT vec_id, UNNEST(RANGE(32)) AS t, UNNEST(list_transform(a, lambda y: y - list_avg(a))) AS x FROM v), f AS (SELECT vec_id, k, SQRT(POW(SUM(x * COS(2 * PI() * k * t / 32)), 2) + POW(SUM(x * SIN(2 * PI() * k * t / 32)), 2)) / 32 * CASE WHEN k IN (0, 16) THEN 1 ELSE 2 END AS a FROM s, (SELECT UNNEST(RANGE(17)) AS k) GROUP BY 1, 2) SELECT k AS bin, ROUND(AVG(a), 6) AS spectrum FROM f GROUP BY k")
def f15_spectrum_window(spark, sf_dir):
    """The spectrum of a rectangle of a section: traces 3 to 18, samples 16 to 47."""
    part = traces.section_tile(volume(spark, sf_dir), "il", 2, "xl", (3, 19), (16, 48))
    return traces.amplitude_spectrum(part, INTERVAL).select("bin", r6("spectrum").alias("spectrum"))


@register("g04_velocity_at_time", "SELECT event_id, ROUND(CASE WHEN t <= 100 THEN 1500.0 WHEN t <= 400 THEN 1500.0 + 900.0 * (t - 100.0) / 300.0 ELSE 2400.0 END, 7) AS v FROM (SELECT event_id, CAST(event_id % 600 AS DOUBLE) AS t FROM events)")
def g04_velocity_at_time(spark, sf_dir):
    t = (F.col("event_id") % 600).cast("double")
    return table(spark, sf_dir, "events").select("event_id", r6(gathers.velocity_at(t, [(100.0, 1500.0), (400.0, 2400.0)]), 7).alias("v"))


@register("u04_panel_depth", "SELECT event_id, ROUND(CASE WHEN x < 150 THEN 10.0 + (x - 100.0) * 0.4 ELSE 30.0 + (x - 150.0) * 1.7 END, 6) AS panel FROM (SELECT event_id, CAST(event_id % 300 AS DOUBLE) AS x FROM events)")
def u04_panel_depth(spark, sf_dir):
    """Linear between the pairs and beyond the ends."""
    xs, ys = F.array(F.lit(100.0), F.lit(150.0), F.lit(250.0)), F.array(F.lit(10.0), F.lit(30.0), F.lit(200.0))
    return table(spark, sf_dir, "events").select("event_id", r6(time_depth.map_depth(xs, ys, (F.col("event_id") % 300).cast("double"))).alias("panel"))


@register("d04_interval_overlay", "WITH z AS (SELECT vec_id, t, vel FROM (SELECT vec_id, UNNEST(RANGE(64)) AS t, UNNEST(list_transform(CAST(embedding AS DOUBLE[]), lambda x: 2000.0 + 100.0 * x)) AS vel FROM embeddings)) SELECT vec_id, t, ROUND(CASE WHEN t = 0 THEN (LEAD(vel) OVER w + vel) / 2 ELSE (vel + LAG(vel) OVER w) / 2 END, 4) AS velocity FROM z WINDOW w AS (PARTITION BY vec_id ORDER BY t)")
def d04_interval_overlay(spark, sf_dir):
    """Interval velocity back from integrated depths: the mean of the two samples' velocities."""
    rows = depth_curves(spark, sf_dir).select("vec_id", F.posexplode("depths").alias("t", "z")).withColumn("ms", F.col("t") * INTERVAL)
    return frames.interval_velocity(rows, ["vec_id"], "ms", "z").select("vec_id", F.col("t").cast("long").alias("t"), r6("velocity", 4).alias("velocity"))


@register("k01_section_at_well", f"SELECT vec_id, 'inline' AS axis, CAST(FLOOR(vec_id / {WIDTH}) AS BIGINT) AS section, vec_id % {WIDTH} AS trace FROM embeddings")
def k01_section_at_well(spark, sf_dir):
    i, x = F.floor(F.col("vec_id") / WIDTH), F.col("vec_id") % WIDTH
    rows = table(spark, sf_dir, "embeddings").select("vec_id", well_tie.section_at_well(1000.0 + 25.0 * i - 5.0 * x + 2.0, 2000.0 + 5.0 * i + 25.0 * x - 1.0, ORIGIN, INLINE, XLINE, line_count(spark, sf_dir), WIDTH).alias("s"))
    return rows.select("vec_id", "s.axis", "s.section", "s.trace")


@register("k03_mean_step", "SELECT vec_id, ROUND(AVG(d), 6) AS step FROM (SELECT vec_id, x - LAG(x) OVER (PARTITION BY vec_id ORDER BY t) AS d FROM (SELECT vec_id, UNNEST(RANGE(64)) AS t, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings)) WHERE d > 0 GROUP BY vec_id")
def k03_mean_step(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(well_tie.mean_step(F.col("embedding").cast("array<double>"))).alias("step"))


_TIMES = "(SELECT UNNEST(RANGE(64)) AS t)"


@register("k07_affine_alignment", f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT vec_id, a, t, GREATEST(0.0, LEAST(63.0, (126.0 + (t * 4.0 - 8.0 - 126.0) / CAST(1.02 AS DOUBLE)) / 4.0)) AS p FROM e, {_TIMES}) SELECT vec_id, t, ROUND(a[CAST(FLOOR(p) AS INT) + 1] + (a[LEAST(64, CAST(FLOOR(p) AS INT) + 2)] - a[CAST(FLOOR(p) AS INT) + 1]) * (p - FLOOR(p)), 6) AS x FROM p")
def k07_affine_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("amplitude"))
    return samples(well_tie.align_traces(rows, INTERVAL, 1.02, 8.0), "vec_id")


@register("k02_resample_trace", f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), p AS (SELECT vec_id, a, t, LEAST(63.0, t * 3.0 / 4.0) AS p FROM e, (SELECT UNNEST(RANGE(90)) AS t)) SELECT vec_id, t, ROUND(a[CAST(FLOOR(p) AS INT) + 1] + (a[LEAST(64, CAST(FLOOR(p) AS INT) + 2)] - a[CAST(FLOOR(p) AS INT) + 1]) * (p - FLOOR(p)), 6) AS x FROM p")
def k02_resample_trace(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("amplitude"))
    return samples(time_depth.resample_traces(rows, INTERVAL, np.arange(90) * 3.0), "vec_id")


@register("k12_convolution", f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS a FROM embeddings), c AS (SELECT vec_id, t, 0.25 * COALESCE(a[CASE WHEN t > 0 THEN t END], 0) + a[t + 1] + 0.5 * COALESCE(a[t + 2], 0) AS x FROM e, {_TIMES}) SELECT vec_id, t, ROUND(x / MAX(ABS(x)) OVER (PARTITION BY vec_id), 6) AS x FROM c")
def k12_convolution(spark, sf_dir):
    kernel = np.array([0.25, 1.0, 0.5])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("amplitude"))
    return samples(traces.map_traces(rows, lambda x: np.stack([well_tie.convolve_same(row, kernel) for row in x]), "amplitude"), "vec_id")


# the normal equations solved by conjugate gradients, 40 steps for 25 unknowns
_WAVE = """WITH RECURSIVE p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS tr, list_concat(list_concat(list_transform(RANGE(12), lambda i: 0.0::DOUBLE), CAST(b.embedding AS DOUBLE[])), list_transform(RANGE(12), lambda i: 0.0::DOUBLE)) AS pad FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
 c AS (SELECT vec_id, tr, list_transform(RANGE(25), lambda j: pad[j + 1:j + 64]) AS cols FROM p),
 n AS (SELECT vec_id, list_transform(cols, lambda x: list_dot_product(x, tr)) AS b, list_transform(cols, lambda x: list_transform(cols, lambda y: list_dot_product(x, y))) AS m FROM c),
 k AS (SELECT vec_id, b, m, GREATEST(1.0, list_sum(list_transform(RANGE(1, 26), lambda j: m[j][j])) / 25) * 1e-3 AS ridge FROM n),
 a AS (SELECT vec_id, b, list_transform(RANGE(1, 26), lambda i: list_transform(RANGE(1, 26), lambda j: m[i][j] + CASE WHEN i = j THEN ridge ELSE 0 END)) AS m FROM k),
 g(vec_id, step, x, r, d) AS (SELECT vec_id, 0, list_transform(b, lambda v: 0.0::DOUBLE), b, b FROM a UNION ALL
  SELECT vec_id, step + 1, x1, r1, CASE WHEN rr > 0 THEN list_transform(RANGE(1, 26), lambda i: r1[i] + list_dot_product(r1, r1) / rr * d[i]) ELSE d END FROM (SELECT vec_id, step, d, rr, list_transform(RANGE(1, 26), lambda i: x[i] + s * d[i]) AS x1, list_transform(RANGE(1, 26), lambda i: r[i] - s * ad[i]) AS r1 FROM
  (SELECT *, list_dot_product(r, r) AS rr, CASE WHEN list_dot_product(d, ad) > 0 THEN list_dot_product(r, r) / list_dot_product(d, ad) ELSE 0 END AS s FROM (SELECT g.*, list_transform(a.m, lambda row: list_dot_product(row, g.d)) AS ad FROM g JOIN a ON a.vec_id = g.vec_id WHERE step < 40)))),
 w AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: ABS(v))) AS peak FROM g WHERE step = 40)
 SELECT vec_id, tap, ROUND(x[tap + 1] / peak, 5) AS value FROM w, (SELECT UNNEST(RANGE(25)) AS tap)"""


@register("k10_wavelet", _WAVE)
def k10_wavelet(spark, sf_dir):
    def work(it):
        for pdf in it:
            waves = [well_tie.wavelet(np.asarray(s), np.asarray(t), INTERVAL, 256.0) for s, t in zip(pdf["synthetic"], pdf["trace"], strict=True)]
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "wavelet": [None if w is None else list(w) for w in waves]})

    w = pairs(spark, sf_dir).select("vec_id", "synthetic", "trace").mapInPandas(work, "vec_id long, wavelet array<double>")
    return w.select("vec_id", F.posexplode("wavelet").alias("tap", "v")).select("vec_id", F.col("tap").cast("long").alias("tap"), r6("v", 5).alias("value"))


@register("k08_best_trace", """WITH e AS (SELECT label, vec_id, vec_id % 50 AS i, CAST(embedding AS DOUBLE[]) AS tr FROM embeddings), y AS (SELECT label, ARG_MIN(tr, vec_id) AS sy FROM e GROUP BY label), w AS (SELECT label, vec_id, i, tr, sy FROM e JOIN y USING (label) WHERE ABS(i - 25) <= 8),
 l AS (SELECT label, vec_id, i, tr, sy, UNNEST(RANGE(-12, 13)) AS lag FROM w), u AS (SELECT label, vec_id, i, lag, UNNEST(tr[GREATEST(lag, 0) + 1:LEAST(64, 64 + lag)]) AS y, UNNEST(sy[GREATEST(-lag, 0) + 1:LEAST(64, 64 - lag)]) AS x FROM l), c AS (SELECT label, vec_id, i, lag, CORR(x, y) AS c FROM u GROUP BY ALL),
 b AS (SELECT label, i, lag, c FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY label, i ORDER BY c DESC, lag) = 1)
 SELECT label, i AS index, lag, ROUND(c, 6) AS correlation FROM b QUALIFY c >= MAX(c) OVER (PARTITION BY label) - 0.001 AND ROW_NUMBER() OVER (PARTITION BY label ORDER BY CASE WHEN c >= (SELECT MAX(b2.c) FROM b b2 WHERE b2.label = b.label) - 0.001 THEN 0 ELSE 1 END, ABS(i - 25), c DESC, i, lag) = 1""")
def k08_best_trace(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("trace"))
    synthetic = e.groupBy("label").agg(F.min_by("trace", "vec_id").alias("synthetic"))
    best = well_tie.best_trace(e.withColumn("index", F.col("vec_id") % 50), synthetic, ["label"], 25, 200.0, 25.0, INTERVAL)
    return best.withColumn("correlation", r6("correlation"))


@register("x04_availability", "SELECT c_custkey AS asset, CAST(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS INT) AS shale, CAST(CASE WHEN c_custkey % 3 <> 2 THEN 1 ELSE 0 END AS INT) AS gaps FROM customer")
def x04_availability(spark, sf_dir):
    """Assets with gamma ray, with sonic, or with depth alone."""
    kind = F.element_at(F.array(F.lit("gamma_ray"), F.lit("sonic"), F.lit("depth")), (F.col("c_custkey") % 3 + 1).cast("int"))
    a = built_in().availability(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("asset"), kind.alias("kind")))
    return a.groupBy("asset").agg(F.max(F.when(F.col("operator") == "vshale_linear", F.col("available").cast("int"))).alias("shale"), F.max(F.when(F.col("operator") == "gap_flag", F.col("available").cast("int"))).alias("gaps"))


@register("x08_catalog", "SELECT 'log' AS family, CAST(1 AS BOOLEAN) AS some UNION ALL SELECT UNNEST(['trajectory', 'tops', 'pressure', 'drilling']), TRUE")
def x08_catalog(spark, sf_dir):
    return built_in().catalog(spark).groupBy("family").agg((F.count("*") > 0).alias("some")).where(F.col("family") != str(Family.TRACES))


@register("a12_collapse_profiles", "SELECT label, t, ROUND(AVG(x), 6) AS x FROM (SELECT label, UNNEST(RANGE(64)) AS t, CAST(UNNEST(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, t")
def a12_collapse_profiles(spark, sf_dir):
    return samples(time_depth.collapse_profiles(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "amplitude"), ["label"], "amplitude"), "label")
