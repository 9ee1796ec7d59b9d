"""Registered queries: windows, intervals, alignment, joins, summaries, order and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from borespark.operators import frames
from borespark.plans.workload import ELASTIC, LOGS, elastic, logs, r6, register, rounded, table

W = ["well"]
ORDER = ["ts", "id"]
#: Share of a log's depth range that its summary leaves out at either end.
MARGIN = 0.02
_OVER = "OVER (PARTITION BY well ORDER BY ts, id ROWS BETWEEN {a} PRECEDING AND {b} FOLLOWING)"


@register("slice_log_summary", f"""WITH {LOGS}, e AS (SELECT well, MIN(id) AS top, MAX(id) AS bottom FROM logs GROUP BY well), f AS (SELECT logs.* FROM logs JOIN e USING (well) WHERE id BETWEEN top + {MARGIN} * (bottom - top) AND bottom - {MARGIN} * (bottom - top)), s AS (SELECT *, AVG(v) {_OVER.format(a=2, b=2)} AS smooth, CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END AS gap FROM f),
 z AS (SELECT *, CASE WHEN STDDEV_POP(v) OVER (PARTITION BY well) < 2.3e-16 THEN CASE WHEN v IS NOT NULL THEN 0.0 END ELSE (v - AVG(v) OVER (PARTITION BY well)) / STDDEV_POP(v) OVER (PARTITION BY well) END AS z FROM s)
 SELECT well, COUNT(*) AS n, ROUND(AVG(smooth), 6) AS mean_smooth, ROUND(MAX(z), 6) AS max_z, CAST(SUM(gap) AS DOUBLE) AS gaps FROM z GROUP BY well""")
def slice_log_summary(spark, sf_dir):
    """Each log without the margins at its ends, smoothed, scaled and flagged, then summed up per well."""
    from borespark.functions.petro import gap_flag

    rows = frames.trim_ends(logs(spark, sf_dir), W, "id", MARGIN)
    rows = frames.z_score(frames.moving_average(rows, W, ORDER, "v"), W, "v").withColumn("gap", gap_flag("v"))
    return rows.groupBy("well").agg(F.count("*").alias("n"), r6(F.avg("smooth")).alias("mean_smooth"), r6(F.max("z")).alias("max_z"), F.sum("gap").alias("gaps"))


@register("w01_moving_average", f"WITH {LOGS} SELECT id, ROUND(AVG(v) {_OVER.format(a=2, b=2)}, 6) AS smooth FROM logs")
def w01_moving_average(spark, sf_dir):
    return frames.moving_average(logs(spark, sf_dir), W, ORDER, "v", 5).select("id", r6("smooth").alias("smooth"))


@register("w03_moving_average_even", f"WITH {LOGS} SELECT id, ROUND(AVG(v) {_OVER.format(a=2, b=2)}, 6) AS smooth FROM logs")
def w03_moving_average_even(spark, sf_dir):
    """An even window becomes the next odd one."""
    return frames.moving_average(logs(spark, sf_dir), W, ORDER, "v", 4).select("id", r6("smooth").alias("smooth"))


@register("p02_z_score", f"WITH {LOGS} SELECT id, ROUND(CASE WHEN STDDEV_POP(v) OVER w < 2.3e-16 THEN CASE WHEN v IS NOT NULL THEN 0.0 END ELSE (v - AVG(v) OVER w) / STDDEV_POP(v) OVER w END, 6) AS z FROM logs WINDOW w AS (PARTITION BY well)")
def p02_z_score(spark, sf_dir):
    return frames.z_score(logs(spark, sf_dir), W, "v").select("id", r6("z").alias("z"))


@register("p03_min_max", f"WITH {LOGS} SELECT id, ROUND(CASE WHEN v IS NOT NULL THEN CASE WHEN MAX(v) OVER w = MIN(v) OVER w THEN -1.0 ELSE -1.0 + (v - MIN(v) OVER w) / (MAX(v) OVER w - MIN(v) OVER w) * 2.0 END END, 6) AS scaled FROM logs WINDOW w AS (PARTITION BY well)")
def p03_min_max(spark, sf_dir):
    return frames.min_max_scale(logs(spark, sf_dir), W, "v", -1.0, 1.0).select("id", r6("scaled").alias("scaled"))


@register("w05_fill_base", "SELECT o_orderkey, ROUND(COALESCE(base, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)), 4) AS base FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1.0 END AS base FROM orders)")
def w05_fill_base(spark, sf_dir):
    tops = table(spark, sf_dir, "orders").withColumn("base", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1.0))
    return frames.fill_base(tops, ["o_custkey"], "o_totalprice", "base").select("o_orderkey", r6("base", 4).alias("base"))


@register("w07_monotonic", f"WITH {LOGS}, d AS (SELECT well, v - LAG(v) OVER (PARTITION BY well ORDER BY ts, id) AS d FROM logs) SELECT well, CASE WHEN COALESCE(MIN(d) >= 0, TRUE) THEN 'ascending' WHEN MAX(d) <= 0 THEN 'descending' ELSE 'none' END AS direction FROM d GROUP BY well")
def w07_monotonic(spark, sf_dir):
    return frames.monotonic_order(logs(spark, sf_dir), W, ORDER, "v")


@register("w08_differentiate", "SELECT event_id AS id, ROUND(CASE WHEN b IS NULL AND a IS NULL THEN 0.0 WHEN b IS NULL THEN (a - value) / 0.5 WHEN a IS NULL THEN (value - b) / 0.5 ELSE (a - b) / 1.0 END, 6) AS slope FROM (SELECT *, LAG(value) OVER w AS b, LEAD(value) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def w08_differentiate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), F.col("event_id").alias("id"), "ts", "value")
    return frames.differentiate(e, W, ORDER, "value", 0.5).select("id", r6("slope").alias("slope"))


_TD = "td AS (SELECT user_id AS well, event_id AS id, CAST(event_id AS DOUBLE) AS t, CAST(event_id AS DOUBLE) * 1.1 + value AS z FROM events)"


def time_depth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("well"), F.col("event_id").alias("id"), F.col("event_id").cast("double").alias("t"), (F.col("event_id").cast("double") * F.lit(1.1) + F.col("value")).alias("z"))


@register("w09_interval_velocity", f"WITH {_TD}, s AS (SELECT *, (t - LAG(t) OVER w) / 1000.0 AS dt, z - LAG(z) OVER w AS dz, ROW_NUMBER() OVER w AS n FROM td WINDOW w AS (PARTITION BY well ORDER BY t)), v AS (SELECT *, CASE WHEN dt > 0 AND dz > 0 THEN 2.0 * dz / dt END AS v FROM s) SELECT id, ROUND(CASE WHEN n = 1 THEN LEAD(v) OVER (PARTITION BY well ORDER BY t) ELSE v END, 4) AS velocity FROM v")
def w09_interval_velocity(spark, sf_dir):
    return frames.interval_velocity(time_depth(spark, sf_dir), W, "t", "z").select("id", r6("velocity", 4).alias("velocity"))


@register("w10_integrate_velocity", "WITH e AS (SELECT user_id AS well, event_id AS id, CAST(event_id AS DOUBLE) / 1000.0 AS t, 2000.0 + value AS v FROM events), s AS (SELECT *, COALESCE((t - LAG(t) OVER w) * 0.5 * (v + LAG(v) OVER w), t * v) * 0.5 AS step FROM e WINDOW w AS (PARTITION BY well ORDER BY t)) SELECT id, ROUND(SUM(step) OVER (PARTITION BY well ORDER BY t ROWS UNBOUNDED PRECEDING), 8) AS depth FROM s")
def w10_integrate_velocity(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), F.col("event_id").alias("id"), F.col("event_id").cast("double").alias("t"), (2000.0 + F.col("value")).alias("v"))
    return frames.integrate_velocity(e, W, "t", "v").select("id", r6("depth", 8).alias("depth"))


@register("w11_average_velocity_depth", "SELECT event_id AS id, ROUND(CAST(event_id AS DOUBLE) / 1000.0 * (2000.0 + value) / 2.0, 8) AS depth FROM events")
def w11_average_velocity_depth(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), r6(frames.average_velocity_depth(F.col("event_id").cast("double"), 2000.0 + F.col("value")), 8).alias("depth"))


# stations: the views of a well; points: all its events, at shifted positions
_STATIONS = "st AS (SELECT user_id AS well, CAST(event_id AS DOUBLE) AS x, value AS y FROM events WHERE event_type = 'view'), pt AS (SELECT user_id AS well, event_id AS id, CAST(event_id AS DOUBLE) + CAST(0.25 AS DOUBLE) AS x FROM events)"


@register("w14_interpolate", f"""WITH {_STATIONS}, a AS (SELECT p.*, s.x AS x0, s.y AS y0 FROM pt p ASOF LEFT JOIN st s ON p.well = s.well AND p.x >= s.x), b AS (SELECT a.*, s.x AS x1, s.y AS y1 FROM a ASOF LEFT JOIN st s ON a.well = s.well AND a.x <= s.x)
 SELECT id, ROUND(CASE WHEN y0 IS NULL THEN y1 WHEN y1 IS NULL OR x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 9) AS y FROM b""")
def w14_interpolate(spark, sf_dir):
    """Linear interpolation between stations: an as-of join both ways."""
    e = table(spark, sf_dir, "events")
    stations = e.where("event_type = 'view'").select(F.col("user_id").alias("well"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    points = e.select(F.col("user_id").alias("well"), (F.col("event_id").cast("double") + 0.25).alias("x"), F.col("event_id").alias("id"))
    return frames.bracket(points, stations, W, "x", "y").select("id", r6("y", 9).alias("y"))


@register("j01_positional_join", f"WITH {LOGS}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY well ORDER BY ts, id) AS p FROM logs) SELECT id, ROUND(v * 2.0 + v, 6) AS total FROM n")
def j01_positional_join(spark, sf_dir):
    from pyspark.sql import Window

    rows = logs(spark, sf_dir).withColumn("p", F.row_number().over(Window.partitionBy("well").orderBy("ts", "id"))).withColumn("depth", F.col("id").cast("double"))
    other = rows.select("well", "p", "depth", (F.col("v") * 2.0).alias("v2"))
    return frames.positional_join(rows, other, W, "p", "depth").select("id", r6(F.col("v") + F.col("v2")).alias("total"))


@register("j02_resample", """WITH a AS (SELECT user_id AS well, CAST(event_id AS DOUBLE) AS x, value AS y FROM events WHERE event_type IN ('click', 'view')), b AS (SELECT user_id AS well, CAST(event_id AS DOUBLE) AS x, value * 10.0 AS y FROM events WHERE event_type NOT IN ('click', 'view')),
 s AS (SELECT well, GREATEST(MIN(a0), MIN(b0)) AS t, LEAST(MIN(a1), MIN(b1)) AS e FROM (SELECT well, MIN(x) AS a0, MAX(x) AS a1 FROM a GROUP BY well) JOIN (SELECT well, MIN(x) AS b0, MAX(x) AS b1 FROM b GROUP BY well) USING (well) GROUP BY well),
 g AS (SELECT well, t + (UNNEST(RANGE(CAST(FLOOR((e - t) / 50.0) AS BIGINT))) + 0.5) * 50.0 AS x FROM s WHERE e > t),
 p AS (SELECT g.*, q.x AS x0, q.y AS y0 FROM g ASOF LEFT JOIN a q ON g.well = q.well AND g.x >= q.x), r AS (SELECT p.*, q.x AS x1, q.y AS y1 FROM p ASOF LEFT JOIN a q ON p.well = q.well AND p.x <= q.x),
 u AS (SELECT r.*, q.x AS u0, q.y AS v0 FROM r ASOF LEFT JOIN b q ON r.well = q.well AND r.x >= q.x), w AS (SELECT u.*, q.x AS u1, q.y AS v1 FROM u ASOF LEFT JOIN b q ON u.well = q.well AND u.x <= q.x)
 SELECT well, x, ROUND(CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (x - x0) / (x1 - x0) END, 9) AS a, ROUND(CASE WHEN u1 = u0 THEN v0 ELSE v0 + (v1 - v0) * (x - u0) / (u1 - u0) END, 9) AS b FROM w""")
def j02_resample(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), "event_type", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    first = F.col("event_type").isin("click", "view")
    channels = {"a": e.where(first).select("well", "x", "y"), "b": e.where(~first).select("well", "x", (F.col("y") * 10.0).alias("y"))}
    return frames.resample_aligned(channels, W, "x", "y", 50.0).select("well", "x", rounded(F.col("a"), 9).alias("a"), rounded(F.col("b"), 9).alias("b"))


_LAYERS = "iv AS (SELECT o_custkey AS k, o_orderkey AS layer, o_totalprice AS top, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS base FROM orders)"


def _layers(o):
    """(k, layer, top, base): of several orders at one top the last holds the layer, the others have no thickness."""
    tops = o.where("k is not null and depth is not null").groupBy("k", "depth").agg(F.max("o_orderkey").alias("layer"))
    return frames.edges_to_intervals(tops, ["k"], "depth")


@register("j03_interval_join", f"WITH {_LAYERS}, l AS (SELECT *, base = MAX(base) OVER (PARTITION BY k) AS is_last FROM iv WHERE base > top) SELECT o_custkey AS k, d.o_orderkey AS id, l.layer FROM (SELECT o_custkey, o_orderkey, o_totalprice * CAST(1.01 AS DOUBLE) AS depth FROM orders) d JOIN l ON l.k = d.o_custkey AND d.depth >= l.top AND (d.depth < l.base OR (is_last AND d.depth = l.base))")
def j03_interval_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("depth"))
    layers = _layers(o)
    samples = o.select("k", F.col("o_orderkey").alias("id"), (F.col("depth") * F.lit(1.01)).alias("depth"))
    return frames.in_intervals(samples, layers, ["k"], "depth", "top", "base").select("k", "id", "layer")


@register("a05_interval_means", f"WITH {_LAYERS}, l AS (SELECT *, base = MAX(base) OVER (PARTITION BY k) AS is_last FROM iv WHERE base > top) SELECT l.k, l.layer, COUNT(*) AS n, ROUND(AVG(d.depth), 6) AS mean FROM (SELECT o_custkey, o_totalprice * CAST(1.01 AS DOUBLE) AS depth FROM orders) d JOIN l ON l.k = d.o_custkey AND d.depth >= l.top AND (d.depth < l.base OR (is_last AND d.depth = l.base)) GROUP BY l.k, l.layer")
def a05_interval_means(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.col("o_totalprice").alias("depth"))
    layers = _layers(o)
    rows = frames.in_intervals(o.select("k", (F.col("depth") * F.lit(1.01)).alias("depth")), layers, ["k"], "depth", "top", "base")
    return rows.groupBy("k", "layer").agg(F.count("*").alias("n"), rounded(F.avg("depth"), 6).alias("mean"))


@register("a04_layer_means", "WITH e AS (SELECT user_id AS well, CAST(event_id AS DOUBLE) AS d, value, MIN(CAST(event_id AS DOUBLE)) OVER (PARTITION BY user_id) AS d0 FROM events) SELECT well, CAST(FLOOR((d - d0) / 500.0) AS BIGINT) AS layer, COUNT(*) AS samples, ROUND(AVG(value), 6) AS value FROM e GROUP BY 1, 2 HAVING COUNT(*) >= 2")
def a04_layer_means(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("well"), F.col("event_id").cast("double").alias("d"), "value")
    return frames.layer_means(e, W, "d", ["value"], 500.0, min_samples=2).select("well", "layer", "samples", r6("value").alias("value"))


@register("o10_edges", "SELECT o_custkey, o_totalprice AS top, LEAD(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS base FROM (SELECT DISTINCT o_custkey, o_totalprice FROM orders) QUALIFY base IS NOT NULL")
def o10_edges(spark, sf_dir):
    return frames.edges_to_intervals(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice").distinct(), ["o_custkey"], "o_totalprice")


@register("o11_interfaces", "WITH l AS (SELECT user_id AS well, CAST(FLOOR(event_id / 500) AS BIGINT) AS layer, AVG(value) AS v FROM events GROUP BY 1, 2) SELECT a.well, (a.layer + 1) * 500.0 AS interface_depth, ROUND(a.v, 6) AS v1, ROUND(b.v, 6) AS v2 FROM l a JOIN l b ON a.well = b.well AND b.layer = a.layer + 1")
def o11_interfaces(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("well"), F.floor(F.col("event_id") / 500).alias("layer")).agg(F.avg("value").alias("v"))
    layers = e.select("well", (F.col("layer") * 500.0).alias("top"), ((F.col("layer") + 1) * 500.0).alias("base"), "v")
    return frames.adjacent_interfaces(layers, W, ["v"]).select("well", "interface_depth", r6("v1").alias("v1"), r6("v2").alias("v2"))


@register("a16_curve_statistics", f"WITH {LOGS}, s AS (SELECT *, CAST(id AS DOUBLE) AS d, CAST(id AS DOUBLE) - LAG(CAST(id AS DOUBLE)) OVER (PARTITION BY well ORDER BY id) AS step FROM logs) SELECT well, COUNT(*) AS rows, COUNT(v) AS samples, MIN(CASE WHEN v IS NOT NULL THEN d END) AS first, MAX(CASE WHEN v IS NOT NULL THEN d END) AS last, MEDIAN(step) AS step FROM s GROUP BY well")
def a16_curve_statistics(spark, sf_dir):
    return frames.curve_statistics(logs(spark, sf_dir).withColumn("d", F.col("id").cast("double")), W, "d", "v")


@register("a15_depth_bins", f"WITH {LOGS}, w AS (SELECT *, CAST(id AS DOUBLE) AS d, MIN(CAST(id AS DOUBLE)) OVER (PARTITION BY well) AS lo, MAX(CAST(id AS DOUBLE)) OVER (PARTITION BY well) AS hi FROM logs) SELECT well, CAST(CASE WHEN hi > lo THEN LEAST(9, FLOOR((d - lo) / (hi - lo) * 10)) ELSE 0 END AS BIGINT) AS bucket, ROUND(AVG(d), 4) AS mean_depth, MIN(v) AS least, MAX(v) AS greatest, COUNT(*) AS n FROM w WHERE v IS NOT NULL GROUP BY 1, 2")
def a15_depth_bins(spark, sf_dir):
    return frames.depth_bins(logs(spark, sf_dir).withColumn("d", F.col("id").cast("double")), W, "d", "v", 10).withColumn("mean_depth", r6("mean_depth", 4))


@register("a10_axis_summary", "WITH v AS (SELECT DISTINCT l_suppkey AS k, l_quantity AS q FROM lineitem), d AS (SELECT *, q - LAG(q) OVER (PARTITION BY k ORDER BY q) AS d FROM v), s AS (SELECT *, FIRST_VALUE(d IGNORE NULLS) OVER (PARTITION BY k ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS s FROM d) SELECT k, COUNT(*) AS count, MIN(q) AS first, MAX(q) AS last, ANY_VALUE(s) AS step, COALESCE(BOOL_AND(ABS(d - s) <= 1e-9), TRUE) AS regular FROM s GROUP BY k")
def a10_axis_summary(spark, sf_dir):
    return frames.axis_summary(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").alias("q")), ["k"], "q")


@register("a08_extents", f"WITH {LOGS} SELECT well, MIN(id) AS first, MAX(id) AS last, COUNT(*) AS rows FROM logs GROUP BY well")
def a08_extents(spark, sf_dir):
    return frames.extents(logs(spark, sf_dir), W, "id")


@register("f02_row_window", f"WITH {LOGS} SELECT id FROM logs WHERE id >= 100 AND id < 600")
def f02_row_window(spark, sf_dir):
    return frames.row_window(logs(spark, sf_dir), "id", 100, 500).select("id")


@register("f04_regular_window", f"WITH {LOGS} SELECT id FROM logs WHERE 1000.0 + id * CAST(0.5 AS DOUBLE) BETWEEN 1100.0 - 5e-10 AND 1400.0 + 5e-10")
def f04_regular_window(spark, sf_dir):
    return frames.regular_depth_window(logs(spark, sf_dir), "id", 1000.0, 0.5, 1100.0, 1400.0).select("id")


@register("f06_optional_depth", f"WITH {LOGS} SELECT id FROM logs WHERE v IS NULL OR v BETWEEN 20 AND 60")
def f06_optional_depth(spark, sf_dir):
    return frames.optional_depth_range(logs(spark, sf_dir), "v", 20, 60, keep_missing=True).select("id")


@register("f05_required_depth", f"WITH {LOGS} SELECT id FROM logs WHERE v >= 20")
def f05_required_depth(spark, sf_dir):
    return frames.optional_depth_range(logs(spark, sf_dir), "v", 20, None, keep_missing=False).select("id")


@register("f08_by_label", f"WITH {LOGS} SELECT event_type, COUNT(*) AS n FROM logs WHERE LOWER(TRIM(event_type)) IN ('click', 'view') GROUP BY 1")
def f08_by_label(spark, sf_dir):
    return frames.labelled(logs(spark, sf_dir), "event_type", " Click", "VIEW").groupBy("event_type").agg(F.count("*").alias("n"))


@register("f14_covering", f"WITH {LOGS}, e AS (SELECT well, MIN(id) AS first, MAX(id) AS last FROM logs GROUP BY well) SELECT well FROM e WHERE first <= 900 AND last >= 500")
def f14_covering(spark, sf_dir):
    return frames.covering(frames.extents(logs(spark, sf_dir), W, "id"), 500, 900).select("well")


@register("f07_candidates", "SELECT c_custkey FROM customer WHERE c_custkey % 4 IN (0, 2)")
def f07_candidates(spark, sf_dir):
    """Each customer holds a curve, by turns gamma ray, depth, density and time."""
    from borespark.functions.petro import curve_kind

    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("c_custkey") % 4 + 1).cast("int"))
    curves = table(spark, sf_dir, "customer").select("c_custkey", curve_kind(pick("GR", "DEPT", "RHOB", "TIME"), pick("GAPI", "M", "G/CC", "MS")).alias("kind"))
    return frames.curve_candidates(curves, "kind").select("c_custkey")


@register("j13_preferred", "SELECT o_custkey, o_orderkey FROM orders QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def j13_preferred(spark, sf_dir):
    return frames.preferred(table(spark, sf_dir, "orders"), ["o_custkey"], F.desc("o_totalprice"), "o_orderkey").select("o_custkey", "o_orderkey")


@register("a23_duplicate_logs", "SELECT MIN(o_orderkey) AS o_orderkey, COUNT(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority")
def a23_duplicate_logs(spark, sf_dir):
    """Of the logs of one signature the first is selected."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey", "o_orderpriority").agg(F.min("o_orderkey").alias("o_orderkey"), F.count("*").alias("n")).select("o_orderkey", "n")


@register("o02_natural_order", "SELECT c_custkey, ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS pos FROM customer")
def o02_natural_order(spark, sf_dir):
    """The curves of an asset (nation): names with numbers sort by the numbers' values."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("CURVE["), F.col("c_custkey").cast("string"), F.lit("]")))
    return c.withColumn("k", frames.natural_key(F.col("name"))).select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("k")).cast("long").alias("pos"))


@register("o01_sort_tops", "SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS pos FROM orders")
def o01_sort_tops(spark, sf_dir):
    from pyspark.sql import Window

    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).cast("long").alias("pos"))


_NEW = "n AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p FROM orders WHERE o_orderkey % 97 <> 0 UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 101 = 0)"


@register("j15_row_difference", f"WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice AS p FROM orders), {_NEW} SELECT o_orderkey, change FROM (SELECT COALESCE(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed' WHEN o.p <> n.p THEN 'changed' END AS change FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey) WHERE change IS NOT NULL")
def j15_row_difference(spark, sf_dir):
    old, new = revisions(spark, sf_dir)
    return frames.row_difference(old, new, ["o_orderkey"], ["o_custkey", "p"])


def revisions(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("p"))
    edits = old.where("o_orderkey % 10 = 0").select("o_orderkey", (F.col("p") + 1).alias("p"))
    adds = old.where("o_orderkey % 101 = 0").withColumn("o_orderkey", F.col("o_orderkey") + 100000000)
    return old, frames.apply_edits(old, ["o_orderkey"], edits, old.where("o_orderkey % 97 = 0"), adds)


@register("o08_row_edits", f"WITH {_NEW} SELECT o_orderkey, o_custkey, ROUND(p, 4) AS p FROM n")
def o08_row_edits(spark, sf_dir):
    return revisions(spark, sf_dir)[1].withColumn("p", r6("p", 4))


@register("a17_revision_summary", f"WITH o AS (SELECT o_orderkey, o_totalprice AS p FROM orders), {_NEW} SELECT COUNT(*) AS changed, MIN(o_orderkey) AS first, MAX(o_orderkey) AS last FROM o JOIN n USING (o_orderkey) WHERE o.p <> n.p")
def a17_revision_summary(spark, sf_dir):
    old, new = revisions(spark, sf_dir)
    d = frames.row_difference(old, new, ["o_orderkey"], ["o_custkey", "p"]).where("change = 'changed'")
    return d.agg(F.count("*").alias("changed"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@register("o09_curve_sets", "SELECT n_name AS curve, 'removed' AS change FROM nation WHERE n_regionkey = 0 UNION ALL SELECT r_name, 'added' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 0)")
def o09_curve_sets(spark, sf_dir):
    old = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_name").alias("curve"))
    new = table(spark, sf_dir, "region").select(F.col("r_name").alias("curve"))
    return old.join(new, "curve", "left_anti").withColumn("change", F.lit("removed")).union(new.join(old, "curve", "left_anti").withColumn("change", F.lit("added")))


@register("j14_catalog", "SELECT r_name, n_name, COUNT(DISTINCT c_custkey) AS wells, COUNT(o_orderkey) AS assets FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def j14_catalog(spark, sf_dir):
    """Region, nation, customer, order as project, well, wellbore, asset."""
    r, n, c, o = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders"))
    per = o.groupBy("o_custkey").agg(F.count("*").alias("assets"))
    rows = r.join(n, r.r_regionkey == n.n_regionkey).join(c, c.c_nationkey == n.n_nationkey).join(per, per.o_custkey == c.c_custkey, "left")
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("wells"), F.coalesce(F.sum("assets"), F.lit(0)).alias("assets"))


@register("a18_project_summary", "SELECT (SELECT COUNT(*) FROM nation) AS wells, (SELECT COUNT(*) FROM customer) AS wellbores, (SELECT COUNT(*) FROM orders) AS assets")
def a18_project_summary(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t).agg(F.count("*").alias(a)) for t, a in (("nation", "wells"), ("customer", "wellbores"), ("orders", "assets")))
    return n.crossJoin(c).crossJoin(o)  # a row each


@register("a19_dominant_value", "SELECT l_suppkey, MAX(CASE WHEN n = m THEN l_linenumber END) AS mode FROM (SELECT *, MAX(n) OVER (PARTITION BY l_suppkey) AS m FROM (SELECT l_suppkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)) GROUP BY 1")
def a19_dominant_value(spark, sf_dir):
    """The mode of a header; the greatest value on ties."""
    c = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("n"))
    return c.groupBy("l_suppkey").agg(F.max_by("l_linenumber", F.struct("n", "l_linenumber")).alias("mode"))


@register("x13_elastic_channels", f"WITH {ELASTIC} SELECT ok, ln, ROUND(COALESCE(vp, CASE WHEN dt > 1000 THEN 1000000.0 / dt WHEN dt > 0 THEN 304800.0 / dt END), 6) AS vp FROM elastic")
def x13_elastic_channels(spark, sf_dir):
    """Missing velocity is made from sonic."""
    from borespark.functions.petro import slowness_to_velocity

    return elastic(spark, sf_dir).select("ok", "ln", r6(F.coalesce("vp", slowness_to_velocity("dt")), 6).alias("vp"))
