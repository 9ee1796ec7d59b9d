"""Well tie: correlation of a synthetic with traces, shift and stretch, wavelets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_PAIRS = 8
NEAR, GAIN, STRETCH = 0.0005, 0.01, 0.005


def lagged_correlations(pairs: DataFrame, keys: Sequence[str], synthetic: str, trace: str, most: int) -> DataFrame:
    """(keys, lag, correlation, n): Pearson correlation of the overlap at every lag; trace[i] meets synthetic[i - lag].

    The pairs of a batch go through a lag together; fewer than 8 samples or no variance give no row.
    """
    schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", lag long, correlation double, n long"
    names = list(keys)

    def work(it):
        for pdf in it:
            pdf = pdf[pdf[["__s", "__t"]].notna().all(axis=1)]
            alike = [(len(s), len(t)) for s, t in zip(pdf["__s"], pdf["__t"], strict=True)]
            for sizes in dict.fromkeys(alike):
                own = pdf[[a == sizes for a in alike]]
                s, t = (np.stack(own[c]).astype(float) for c in ("__s", "__t"))
                for lag in range(-most, most + 1):
                    lo, hi = max(0, lag), min(sizes[1], sizes[0] + lag)
                    if hi - lo >= LEAST_PAIRS:
                        c = correlations(s[:, lo - lag : hi - lag], t[:, lo:hi])
                        yield own[names].assign(lag=lag, correlation=c, n=hi - lo)[~np.isnan(c)]

    return pairs.select(*keys, F.col(synthetic).cast("array<double>").alias("__s"), F.col(trace).cast("array<double>").alias("__t")).mapInPandas(work, schema)


def best_shift(pairs: DataFrame, keys: Sequence[str], synthetic: str, trace: str, most: int) -> DataFrame:
    """(keys, lag, correlation) of the greatest correlation; the first lag on ties."""
    c = lagged_correlations(pairs, keys, synthetic, trace, most)
    best = c.groupBy(*keys).agg(F.max(F.struct("correlation", (-F.col("lag")).alias("l"))).alias("b"))
    return best.select(*keys, (-F.col("b.l")).alias("lag"), F.col("b.correlation").alias("correlation"))


def section_at_well(px: Column, py: Column, origin: tuple, inline: tuple, xline: tuple, n_il: int, n_xl: int) -> Column:
    """struct(axis, section, trace, spacing): the section through a well's surface location.

    The section runs along the line with the smaller trace spacing; numbers are rounded, below 0 there is
    none, beyond the end the last one counts.
    """
    det = inline[0] * xline[1] - inline[1] * xline[0]
    kind = "struct<axis:string,section:bigint,trace:bigint,spacing:double>"
    if abs(det) <= 2.220446049250313e-16:
        return F.lit(None).cast(kind)
    dx, dy = px - origin[0], py - origin[1]
    i, x = F.round((dx * xline[1] - dy * xline[0]) / det), F.round((dy * inline[0] - dx * inline[1]) / det)
    si, sx = max(1.0, float(np.hypot(*inline))), max(1.0, float(np.hypot(*xline)))
    il, xl = F.least(i, F.lit(n_il - 1)).cast("long"), F.least(x, F.lit(n_xl - 1)).cast("long")
    along = F.struct(F.lit("inline").alias("axis"), il.alias("section"), xl.alias("trace"), F.lit(sx).alias("spacing")) if sx <= si else F.struct(F.lit("xline").alias("axis"), xl.alias("section"), il.alias("trace"), F.lit(si).alias("spacing"))
    return F.when((i >= 0) & (x >= 0), along)


def mean_step(times: Column) -> Column:
    """Mean of the positive steps of an array of times."""
    steps = F.filter(F.zip_with(F.slice(times, F.lit(2), F.size(times)), F.slice(times, F.lit(1), F.greatest(F.lit(0), F.size(times) - 1)), lambda b, a: b - a), lambda d: d > 0)
    return F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0.0), lambda a, d: a + d) / F.size(steps))


def align_traces(df: DataFrame, interval_ms: float, stretch: float, shift: float, column: str = "amplitude") -> DataFrame:
    """df with its traces under a stretch about their middle time and a shift, in one Arrow pass; a stretch of 0.5 or less counts as 1."""
    from borespark.operators.traces import map_traces

    def work(x: np.ndarray) -> np.ndarray:
        times = np.arange(x.shape[1]) * interval_ms
        if len(times) < 2:
            return x
        return align_rows(times, x, (times[0] + times[-1]) / 2, stretch if np.isfinite(stretch) and stretch > 0.5 else 1.0, shift)

    return map_traces(df, work, column)


def corrected_time(time_ms: Column, middle: Column | float, stretch: Column | float, shift: Column | float) -> Column:
    """Observation times after a correction: stretched about the middle, then shifted."""
    middle = F.lit(middle) if not isinstance(middle, Column) else middle
    return middle + (time_ms - middle) * stretch + shift


def correlations(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation of each row of x with that of y, over their common length; NaN where there is none."""
    n = min(x.shape[1], y.shape[1])
    if n < LEAST_PAIRS:
        return np.full(len(x), np.nan)
    x, y = x[:, :n], y[:, :n]
    sx, sy = x.sum(axis=1), y.sum(axis=1)
    below = np.sqrt(np.maximum(0.0, (n * (x * x).sum(axis=1) - sx**2) * (n * (y * y).sum(axis=1) - sy**2)))
    sound = below > 2.220446049250313e-16
    return np.where(sound, (n * (x * y).sum(axis=1) - sx * sy) / np.where(sound, below, 1), np.nan)


def align_rows(times: np.ndarray, traces: np.ndarray, middle: float, stretch: float, shift: float) -> np.ndarray:
    """Traces [rows, samples] on one axis, at the times before a stretch about ``middle`` and a shift; clamped at the ends."""
    at = middle + (times - shift - middle) / stretch
    high = np.clip(np.searchsorted(times, at), 1, len(times) - 1)
    part = np.clip((at - times[high - 1]) / (times[high] - times[high - 1]), 0, 1)
    return traces[:, high - 1] * (1 - part) + traces[:, high] * part


def shift_and_stretch(times: np.ndarray, synthetic: np.ndarray, trace: np.ndarray, most: int, step_ms: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """lags, stretches and correlations of rows of synthetics and traces on one axis; NaN where none correlates.

    Among 17 stretches and all lags near-ties prefer less stretch, then less lag; the stretch is used only if it
    gains 0.01 over the best plain shift.  All rows go through a stretch and lag together.
    """
    rows, lags = len(trace), range(-most, most + 1)
    lag0, c0 = np.zeros(rows, np.int64), np.full(rows, np.nan)
    for lag in lags:
        lo, hi = max(0, lag), min(trace.shape[1], synthetic.shape[1] + lag)
        if hi > lo:
            c = correlations(synthetic[:, lo - lag : hi - lag], trace[:, lo:hi])
            take = (c > c0) | (np.isnan(c0) & ~np.isnan(c))
            lag0, c0 = np.where(take, lag, lag0), np.where(take, c, c0)
    best, stretch1, c1 = np.zeros(rows, np.int64), np.ones(rows), np.full(rows, np.nan)
    middle = (times[0] + times[-1]) / 2
    for k in range(-8, 9):
        stretch = 1.0 + k * STRETCH
        for lag in lags:
            c = correlations(synthetic, align_rows(times, trace, middle, stretch, lag * step_ms))
            near, less = np.abs(c - c1) <= NEAR, abs(stretch - 1) - np.abs(stretch1 - 1)
            take = np.isnan(c1) & ~np.isnan(c) | (c > c1 + NEAR) | near & ((less < 0) | (np.abs(less) <= NEAR) & (abs(lag) < np.abs(best)))
            best, stretch1, c1 = np.where(take, lag, best), np.where(take, stretch, stretch1), np.where(take, c, c1)
    gains = (c1 - c0 >= GAIN) & (np.abs(stretch1 - 1) >= STRETCH - 1e-12)
    return np.where(gains, best, lag0), np.where(gains, stretch1, 1.0), np.where(gains, c1, c0)


def tie(pairs: DataFrame, keys: Sequence[str], most: int, step_ms: float) -> DataFrame:
    """(keys, lag, stretch, correlation) per pair (times, synthetic, trace arrays); pairs that nothing ties give no row."""
    schema = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys) + ", lag long, stretch double, correlation double"

    def work(it):
        for pdf in it:
            pdf = pdf[pdf[["times", "synthetic", "trace"]].notna().all(axis=1)]
            alike = [(np.asarray(t, float).tobytes(), len(s), len(x)) for t, s, x in zip(pdf["times"], pdf["synthetic"], pdf["trace"], strict=True)]
            for axis in dict.fromkeys(alike):
                own = pdf[[a == axis for a in alike]]
                times = np.frombuffer(axis[0], float)
                if len(times) < 2 or axis[2] != len(times) or not axis[1]:
                    continue
                lag, stretch, c = shift_and_stretch(times, *(np.stack(own[n]).astype(float) for n in ("synthetic", "trace")), most, step_ms)
                yield own[list(keys)].assign(lag=lag, stretch=stretch, correlation=c)[~np.isnan(c)]

    return pairs.select(*keys, "times", "synthetic", "trace").mapInPandas(work, schema)


def wavelet(reflectivity: np.ndarray, trace: np.ndarray, step_ms: float, length_ms: float) -> np.ndarray | None:
    """Least-squares wavelet with a ridge of a thousandth of the mean diagonal (at least 1), peak 1."""
    if len(reflectivity) < 16 or len(trace) < 16 or step_ms <= 0:
        return None
    half = int(min(24, max(8, np.floor(min(160.0, max(96.0, length_ms / 4)) / step_ms * 0.5 + 0.5))))
    at = np.arange(len(trace))[:, None] + np.arange(-half, half + 1)
    inside = (at >= 0) & (at < len(reflectivity))
    a = np.where(inside, reflectivity[np.clip(at, 0, len(reflectivity) - 1)], 0.0)
    normal = a.T @ a
    w = np.linalg.solve(normal + np.eye(len(normal)) * max(1.0, np.trace(normal) / len(normal)) * 1e-3, a.T @ trace)
    peak = np.abs(w).max()
    return w / peak if peak > 1.1920929e-07 else None


def convolve_same(signal: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-length correlation form, scaled to a peak of 1."""
    if not len(signal) or not len(kernel):
        return np.zeros(0)
    half = len(kernel) // 2
    padded = np.concatenate([np.zeros(half), signal, np.zeros(len(kernel) - 1 - half)])
    out = np.lib.stride_tricks.sliding_window_view(padded, len(kernel)) @ kernel
    peak = np.abs(out).max()
    return out / peak if peak > 1.1920929e-07 else out


def best_trace(traces: DataFrame, synthetic: DataFrame, keys: Sequence[str], center: int, radius: float, spacing: float, interval_ms: float, near: float = 0.001) -> DataFrame:
    """The trace (position ``index``) around the well that ties best; near-ties prefer the nearer trace."""
    half = int(min(24, max(4, np.ceil(radius / spacing))))
    most = int(min(16, max(1, np.floor(48.0 / interval_ms + 0.5))))
    window = traces.where((F.abs(F.col("index") - center) <= half) & F.col("trace").isNotNull()).join(synthetic, list(keys))
    shifts = best_shift(window, [*keys, "index"], "synthetic", "trace", most)
    top = shifts.groupBy(*keys).agg(F.max("correlation").alias("__top"))
    rows = shifts.join(top, list(keys)).where(F.col("correlation") >= F.col("__top") - near)
    return rows.groupBy(*keys).agg(F.min(F.struct(F.abs(F.col("index") - center).alias("d"), (-F.col("correlation")).alias("c"), "index", "lag")).alias("b")).select(*keys, F.col("b.index").alias("index"), F.col("b.lag").alias("lag"), (-F.col("b.c")).alias("correlation"))
