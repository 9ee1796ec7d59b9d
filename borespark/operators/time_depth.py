"""Time and depth: velocity trends, profiles, maps between the domains, and their use on traces."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borespark.operators.traces import as_doubles, map_traces, sum_traces

STRICT = 1e-3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _below(xs: Column, x: Column, body: Callable[[Column], Column]) -> Column:
    """body(number of the array's values below x); one scan of the array inside the JVM."""
    return _let(F.size(F.filter(xs, lambda v: v < x)), body)


def lookup(xs: Column, ys: Column, x: Column) -> Column:
    """Clamped linear interpolation in two rising arrays; one scan of the array per value (see ``lookup_traces``)."""
    last = F.size(xs) - 1

    def line(below):
        x0, x1, y0, y1 = F.get(xs, below - 1), F.get(xs, below), F.get(ys, below - 1), F.get(ys, below)
        return F.when(x1 - x0 <= 1.1920929e-07, y1).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    return F.when(x <= F.get(xs, F.lit(0)), F.get(ys, F.lit(0))).when(x >= F.get(xs, last), F.get(ys, last)).otherwise(_below(xs, x, line))


def resample_traces(df: DataFrame, interval_ms: float, times: Sequence[float], column: str = "amplitude") -> DataFrame:
    """Traces of a regular axis from 0 at other times, clamped at the ends; one Arrow pass."""
    at = np.asarray(times, float) / interval_ms

    def work(x: np.ndarray) -> np.ndarray:
        p = np.clip(at, 0, x.shape[1] - 1)
        low = p.astype(np.int64)
        return x[:, low] + (x[:, np.minimum(low + 1, x.shape[1] - 1)] - x[:, low]) * (p - low)

    return map_traces(df, work, column)


def nearest_sample(axis: Column, x: Column) -> Column:
    """Index of the nearest value of a rising array; ties go to the lower one."""
    last = F.size(axis) - 1
    inner = _below(axis, x, lambda below: F.when(x - F.get(axis, below - 1) <= F.get(axis, below) - x, below - 1).otherwise(below))
    return F.when(F.isnan(x) | x.isNull() | (F.size(axis) == 0), None).when(x <= F.get(axis, F.lit(0)), 0).when(x >= F.get(axis, last), last).otherwise(inner)


def average_velocity(time_ms: Column, depth: Column) -> Column:
    return F.when(time_ms > 1.1920929e-07, depth * 2000.0 / time_ms)


def depth_curve(times: Column, velocities: Column, kind: str = "interval", two_way: bool = True) -> Column:
    """Depths of an array of times (ms) by its velocities: 'average' (t v / 2), or 'interval' (trapezoids)."""
    if kind == "average":
        return F.zip_with(times, velocities, lambda t, v: t / 1000.0 * v * 0.5)
    if kind != "interval":
        raise ValueError("RMS velocities must first become average or interval velocities")
    factor = 0.5 if two_way else 1.0

    def step(i):
        t, v = F.get(times, i), F.get(velocities, i)
        return F.when(i == 0, t / 1000.0 * v * factor).otherwise((t - F.get(times, i - 1)) / 1000.0 * (v + F.get(velocities, i - 1)) * 0.5 * factor)

    return F.when(F.size(times) == 0, F.array().cast("array<double>")).otherwise(running_sums(F.transform(F.sequence(F.lit(0), F.size(times) - 1), step)))


#: Values that a running sum appends to one piece; a longer array is summed piece by piece.
PIECE = 64


def running_sums(values: Column) -> Column:
    """Running sums of an array.  Pieces of ``PIECE`` values keep the cost of appending linear in the array."""
    empty = F.array().cast("array<double>")

    def add(acc, v):
        d = acc["d"] + v
        return F.struct(d.alias("d"), F.concat(acc["out"], F.array(d)).alias("out"))

    def piece(acc, k):
        own = F.aggregate(F.slice(values, k * PIECE + 1, F.lit(PIECE)), F.struct(acc["d"].alias("d"), empty.alias("out")), add)
        return _let(own, lambda o: F.struct(o["d"].alias("d"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    start = F.struct(F.lit(0.0).alias("d"), F.array().cast("array<array<double>>").alias("out"))
    whole = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PIECE).cast("int")), start, piece)["out"]
    return F.when(F.size(values) == 0, empty).otherwise(F.flatten(whole))


def integrate_traces(df: DataFrame, interval_ms: float, two_way: bool = True, column: str = "velocity") -> DataFrame:
    """Traces of interval velocity become traces of depth (trapezoids from time 0), in one Arrow pass."""
    factor = (0.5 if two_way else 1.0) * interval_ms / 1000.0

    def work(v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        np.cumsum(0.5 * (v[:, 1:] + v[:, :-1]) * factor, axis=1, out=out[:, 1:])
        return out

    return map_traces(df, work, column)


def trend(time_ms: Column, top: Column, base: Column, v0: float, gradient: float = 0.0, kind: str = "constant") -> Column:
    """Interval velocity at a time: constant, or linear with time inside [top, base] and held outside."""
    if kind == "constant":
        return F.lit(float(v0))
    return v0 + gradient * (F.greatest(top, F.least(base, time_ms)) - top)


def depth_trend(times: Sequence[float], top: float, base: float, v0: float, gradient: float, two_way: bool = True) -> list[float]:
    """Velocity linear with depth below the top, by the recursion over the samples."""
    out, depth, last, v = [], 0.0, top, v0
    for t in times:
        if t > top:
            now = min(t, base)
            if now > last:
                depth += (now - last) / 1000.0 * v * (0.5 if two_way else 1.0)
                v, last = v0 + gradient * depth, now
            out.append(v)
        else:
            out.append(v0)
    return out


def depth_trend_traces(df: DataFrame, times: Sequence[float], two_way: bool = True, out: str = "velocity") -> DataFrame:
    """df (top, base, v0, gradient per trace) with the velocities of ``depth_trend`` at the times, in one Arrow pass.

    All traces of a batch take each step of the recursion together.  A trace without one of the four gets NULL.
    """
    axis, factor = np.asarray(times, float), (0.5 if two_way else 1.0) / 1000.0
    schema = T.StructType([f for f in df.schema if f.name != out]).add(out, T.ArrayType(T.DoubleType()))

    def work(it):
        for pdf in it:
            top, base, v0, gradient = (pdf[c].to_numpy(float) for c in ("top", "base", "v0", "gradient"))
            v, depth, last = v0.copy(), np.zeros(len(pdf)), top.copy()
            values = np.empty((len(pdf), len(axis)))
            for k, t in enumerate(axis):
                now = np.minimum(t, base)
                moves = (t > top) & (now > last)
                depth = np.where(moves, depth + (now - last) * factor * v, depth)
                v, last = np.where(moves, v0 + gradient * depth, v), np.where(moves, now, last)
                values[:, k] = np.where(t > top, v, v0)
            known = np.isfinite(top + base + v0 + gradient)
            yield pdf.assign(**{out: [row if ok else None for row, ok in zip(values, known, strict=True)]})[[f.name for f in schema]]

    return df.mapInPandas(work, schema)


def profile(x: Column, knots: Column, values: Column, how: str = "linear") -> Column:
    """Values of a profile between its knots: 'linear', or 'step' (the last knot at or above); ends are held."""
    if how == "linear":
        return lookup(knots, values, x)
    at = F.size(F.filter(knots, lambda v: v <= x)) - 1
    return F.get(values, F.greatest(at, F.lit(0)))


def map_depth(xs: Column, ys: Column, x: Column) -> Column:
    """Linear map between two rising arrays that carries on beyond their ends; one pair gives its value."""
    n = F.size(xs)

    def line(below):
        k = F.greatest(F.lit(0), F.least(n - 2, below - 1))
        x0, x1, y0, y1 = F.get(xs, k), F.get(xs, k + 1), F.get(ys, k), F.get(ys, k + 1)
        return F.when(x1 == x0, y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))

    return F.when(n == 0, x).when(n == 1, F.get(ys, F.lit(0))).otherwise(_below(xs, x, line))


def collapse_profiles(profiles: DataFrame, keys: Sequence[str], curve: str = "curve") -> DataFrame:
    """(keys, curve): the mean of the curves of all profiles in a cell, sample by sample."""
    sums = sum_traces(profiles, keys, curve).select(*keys, F.struct("__t", (F.col("__s") / F.col("__n")).alias("v")).alias("__p"))
    return sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("__p")), lambda p: p["v"]).alias(curve))  # the samples of one curve


def blend(control: Column, tendency: Column, weight: float) -> Column:
    if not 0 <= weight <= 1:
        raise ValueError("the weight is in [0, 1]")
    return F.zip_with(control, tendency, lambda c, t: c * weight + t * (1.0 - weight))


def merge_intervals(samples: DataFrame, intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """samples (keys, t) with the velocity of the interval (keys, number, top, base, velocity) that holds t.

    Intervals are half open, the one of the greatest number closed; a trace (keys) counts as valid if every
    sample of it is in exactly one interval and all its intervals have their top above their base.  ``valid``
    tells; velocities of others are 0.  Numbers tell a trace's intervals apart; equal samples count once.

    No sample meets the intervals: tops, bases and samples of a trace are put in one order, and the intervals
    that are open, with the sum of their numbers, are carried along it.
    """
    keys = list(keys)
    last = intervals.groupBy(*keys).agg(F.max("number").alias("__last"), F.bool_and(F.col("top") < F.col("base")).alias("__ordered"))
    i = intervals.join(last, keys)
    number = F.col("number").cast("long")

    def edge(column, kind, sign):
        return i.select(*keys, F.col(column).cast("double").alias("__x"), kind.alias("__k"), F.lit(sign).alias("__one"), (number * sign).alias("__no"))

    closed = F.when(number == F.col("__last"), 2).otherwise(0)  # the last interval ends after the samples at its base
    rows = edge("top", F.lit(0), 1).union(edge("base", closed, -1))
    rows = rows.unionByName(samples.select(*keys, F.col("t").cast("double").alias("__x"), "t", F.lit(1).alias("__k")).distinct(), allowMissingColumns=True)
    carry = Window.partitionBy(*keys).orderBy("__x", "__k").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"__open": F.coalesce(F.sum("__one").over(carry), F.lit(0)), "__no": F.coalesce(F.sum("__no").over(carry), F.lit(0))}).where("__k = 1 and t is not null")
    whole = rows.groupBy(*keys).agg(F.bool_and(F.col("__open") == 1).alias("__all")).join(last, keys, "left")
    whole = whole.select(*keys, (F.col("__all") & F.coalesce("__ordered", F.lit(False))).alias("valid"))
    velocity = intervals.select(*keys, number.alias("__no"), "velocity")
    out = rows.join(whole, keys).join(velocity, [*keys, "__no"], "left")
    return out.select(*keys, "t", F.when(F.col("valid"), F.coalesce("velocity", F.lit(0.0))).otherwise(0.0).alias("velocity"), "valid")


def depths_from_pairs(times: Column, pair_times: Column, pair_depths: Column) -> Column:
    """Depths of sample times by paired horizons: piecewise linear from (0, 0), the last slope carried on."""
    ts, ds = F.concat(F.array(F.lit(0.0)), pair_times), F.concat(F.array(F.lit(0.0)), pair_depths)
    n = F.size(ts)

    def one(t):
        def line(below):
            k = F.greatest(F.lit(0), F.least(n - 2, below - 1))
            return F.get(ds, k) + (t - F.get(ts, k)) * (F.get(ds, k + 1) - F.get(ds, k)) / (F.get(ts, k + 1) - F.get(ts, k))

        return _below(ts, t, line)

    return F.transform(times, one)


def pairs_rise(pair_times: Column, pair_depths: Column) -> Column:
    """Whether paired horizons rise strictly in both domains from (0, 0)."""

    def rise(x):
        full = F.concat(F.array(F.lit(0.0)), x)
        return F.forall(F.sequence(F.lit(1), F.size(x)), lambda i: F.get(full, i) - F.get(full, i - 1) > STRICT)

    return rise(pair_times) & rise(pair_depths)


def to_depth(df: DataFrame, interval_ms: float, n_out: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Traces with ``amplitude`` and ``depths`` (of its samples, per trace) on the keys' common regular depth axis.

    The axis spans the least first to the greatest last depth of the valid traces; samples are looked up
    by the clamped inverse of each trace's map.  Traces without a map become zeros.  One small aggregate,
    joined back, then an Arrow pass.
    """
    d = F.when(F.col("depths").isNotNull() & (F.size("depths") == F.size("amplitude")), F.col("depths"))
    spans = df.groupBy(*keys).agg(F.min(F.element_at(d, 1)).alias("__d0"), F.max(F.element_at(d, -1)).alias("__d1"), F.max(F.size("amplitude")).alias("__n"))
    rows = df.withColumns({"amplitude": as_doubles("amplitude"), "depths": d})
    rows = rows.join(spans, list(keys)) if keys else rows.crossJoin(F.broadcast(spans))  # one row
    schema = rows.drop("__d0", "__d1", "__n", "depths").withColumn("depth0", F.lit(0.0)).withColumn("depth_step", F.lit(0.0)).schema
    plain = [c for c in rows.columns if c not in ("__d0", "__d1", "__n", "depths")]

    def work(it):
        for pdf in it:
            out, steps = [], []
            for a, depth, d0, d1, n in zip(pdf["amplitude"], pdf["depths"], pdf["__d0"], pdf["__d1"], pdf["__n"], strict=True):
                n = n_out or int(n)
                axis = np.linspace(d0, d1, n)
                steps.append((d1 - d0) / max(n - 1, 1))
                if a is None or depth is None:
                    out.append(np.zeros(n))
                else:
                    times = np.interp(axis, depth, np.arange(len(depth)) * interval_ms)
                    out.append(np.interp(times, np.arange(len(a)) * interval_ms, a))
            yield pdf[plain].assign(amplitude=out, depth0=pdf["__d0"], depth_step=steps)

    return rows.mapInPandas(work, schema)


def step_costs(bases: tuple[tuple[float, float], tuple[float, float]]) -> tuple[int, int, int, int]:
    """Costs along both lines and both diagonals: basis lengths in whole thousandths."""
    (ax, ay), (bx, by) = bases
    return tuple(int(np.floor(np.hypot(dx, dy) * 1000 + 0.5)) for dx, dy in ((ax, ay), (bx, by), (ax + bx, ay + by), (ax - bx, ay - by)))


def path_lengths(di: np.ndarray, dx: np.ndarray, costs: tuple[int, int, int, int]) -> np.ndarray:
    """Lengths of the shortest 8-neighbour paths over (di, dx) cells of a grid whose bases differ in direction.

    Such a path goes diagonally as far as both differences last, then straight: by the triangle inequality a
    diagonal is no longer than its two sides, and two diagonals no shorter than the two steps that they replace.
    """
    straight_i, straight_x, plus, minus = costs
    i, x = np.abs(di), np.abs(dx)
    both = np.minimum(i, x)
    diagonal = np.where((di > 0) == (dx > 0), plus, minus)
    return both * np.minimum(diagonal, straight_i + straight_x) + (i - both) * straight_i + (x - both) * straight_x


def nearest_sources(i: np.ndarray, x: np.ndarray, cells: tuple[int, int], sources: np.ndarray, bases) -> tuple[np.ndarray, np.ndarray]:
    """(source, distance) of the cells (i, x): the nearest source by ``path_lengths``.

    sources: rows (source, i, x); of several in one cell the last counts.  Where several are equally near, a cell
    goes with the neighbour on a shortest path to it that is first by distance, then line, then crossline, and that
    neighbour's source, found the same way, is its own.
    """
    costs = step_costs(bases)
    at = {(int(r[1]), int(r[2])): int(r[0]) for r in sources}
    places = np.array(list(at), np.int64).reshape(-1, 2)
    names = np.array(list(at.values()), np.int64)

    def lengths(i, x):
        return path_lengths(i[:, None] - places[:, 0], x[:, None] - places[:, 1], costs)

    d = lengths(i, x)
    nearest = d.min(axis=1)
    source = names[d.argmin(axis=1)]
    open_ = np.flatnonzero((d == nearest[:, None]).sum(axis=1) > 1)
    ci, cx, left = i[open_].copy(), x[open_].copy(), nearest[open_].copy()
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]  # in the order of line and crossline
    while len(open_):
        best, bi, bx = np.full(len(open_), np.iinfo(np.int64).max), ci.copy(), cx.copy()
        for a, b in steps:
            ni, nx = ci + a, cx + b
            inside = (ni >= 0) & (ni < cells[0]) & (nx >= 0) & (nx < cells[1])
            near = lengths(ni, nx).min(axis=1)
            take = inside & (near + path_lengths(np.array([a]), np.array([b]), costs) == left) & (near < best)
            best, bi, bx = np.where(take, near, best), np.where(take, ni, bi), np.where(take, nx, bx)
        ci, cx, left = bi, bx, best
        d = lengths(ci, cx)
        one = (d == left[:, None]).sum(axis=1) == 1
        source[open_[one]] = names[d[one].argmin(axis=1)]
        open_, ci, cx, left = open_[~one], ci[~one], cx[~one], left[~one]
    return source, nearest


def assign_sources(sources: DataFrame, keys: Sequence[str], cells: tuple[int, int], bases) -> DataFrame:
    """(keys, i, x, source, distance_milli): ``nearest_sources`` of every cell of each survey (keys).

    Distances have a closed form on a whole grid, so every line of cells is computed on its own, against the survey's
    control profiles (a short list: a row of the table below holds them); no front runs over the grid.
    """
    n_il, n_xl = cells
    rows = sources.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("long").alias(c) for c in ("source", "i", "x")]))).alias("__s"))
    lines = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(int(n_il) - 1)))).repartition(*keys, "i")
    schema = ", ".join(f"`{k}` {sources.schema[k].dataType.simpleString()}" for k in keys) + ", i long, x long, source long, distance_milli long"

    def work(it):
        x = np.arange(int(n_xl))
        for pdf in it:
            for r in pdf.to_dict("records"):
                places = np.array([[s["source"], s["i"], s["x"]] for s in r["__s"]], np.int64)
                source, d = nearest_sources(np.full(len(x), int(r["i"])), x, (int(n_il), int(n_xl)), places, bases)
                yield pd.DataFrame({k: [r[k]] * len(x) for k in keys} | {"i": int(r["i"]), "x": x, "source": source, "distance_milli": d})

    return lines.mapInPandas(work, schema)
