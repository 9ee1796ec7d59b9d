"""Prestack gathers: moveout, mutes, semblance, velocity picks.

A gather trace is a row (gather, offset, amplitude array); sample k is at start_ms + k * interval_ms.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from borespark.operators.traces import as_doubles, map_traces, sum_traces

SMALL = 1e-12
MOST_VELOCITIES = 4096


def velocity_at(time_ms: Column, pairs: Sequence[tuple[float, float]] | float) -> Column:
    """A constant, or linear interpolation in (time, velocity) pairs, constant beyond their ends."""
    if not isinstance(pairs, Sequence):
        return F.lit(float(pairs))
    pairs = sorted(pairs)
    value = F.lit(float(pairs[-1][1]))
    for (t0, v0), (t1, v1) in reversed(list(zip(pairs, pairs[1:], strict=False))):
        line = F.lit(float(v1)) if t1 - t0 <= 1e-6 else v0 + (v1 - v0) * (time_ms - t0) / (t1 - t0)
        value = F.when(time_ms <= t1, line).otherwise(value)
    return F.when(time_ms <= pairs[0][0], F.lit(float(pairs[0][1]))).otherwise(value)


def velocities(times: np.ndarray, pairs: Sequence[tuple[float, float]] | float) -> np.ndarray:
    """``velocity_at`` of an axis of times."""
    if not isinstance(pairs, Sequence):
        return np.full(len(times), float(pairs))
    knots = np.array(sorted(pairs), float)
    k = np.searchsorted(knots[:, 0], times)
    inner = np.clip(k, 1, max(len(knots) - 1, 1))
    (t0, v0), (t1, v1) = (knots[np.minimum(j, len(knots) - 1)].T for j in (inner - 1, inner))
    close = t1 - t0 <= 1e-6
    line = np.where(close, v1, v0 + (v1 - v0) * (times - t0) / np.where(close, 1, t1 - t0))
    return np.where(k == 0, knots[0, 1], np.where(k == len(knots), knots[-1, 1], line))


def moveout(times: np.ndarray, offset: np.ndarray, velocity: np.ndarray) -> np.ndarray:
    """Moveout times [traces, samples] of zero-offset times, ms."""
    t, x = times / 1000.0, offset[:, None] / velocity
    return np.sqrt(t * t + x * x) * 1000.0


def samples_at(x: np.ndarray, times: np.ndarray, interval_ms: float) -> np.ndarray:
    """Linear interpolation of traces [rows, n] at times [rows, m] on a regular axis from 0; 0 outside it."""
    at = times / interval_ms
    inside = (at >= 0) & (at < x.shape[1])
    at = np.where(inside, at, 0)
    low = at.astype(np.int64)
    part = at - low
    rows = np.arange(len(x))[:, None]
    return np.where(inside, x[rows, low] * (1 - part) + x[rows, np.minimum(low + 1, x.shape[1] - 1)] * part, 0.0)


def nmo(df: DataFrame, interval_ms: float, velocity, start_ms: float = 0.0) -> DataFrame:
    """Normal moveout: each sample from the trace at its moveout time; 0 for times up to 0 and outside, and
    throughout where the offset is missing.  One Arrow pass."""

    def work(x, offset):
        t = start_ms + np.arange(x.shape[1]) * interval_ms
        return np.where(t <= 0, 0.0, samples_at(x, moveout(t, offset, velocities(t, velocity)), interval_ms))

    return map_traces(df, work, "amplitude", ["offset"])


def stretch_mute(df: DataFrame, interval_ms: float, velocity, most: float, start_ms: float = 0.0) -> DataFrame:
    """Zeroes samples that moveout stretches by more than ``most``.  One Arrow pass."""
    if not 0 < most <= 100:
        raise ValueError("the stretch limit is in (0, 100]")

    def work(x, offset):
        t = start_ms + np.arange(x.shape[1]) * interval_ms
        later = np.where(t > 0, t, 1)
        stretch = (moveout(t, offset, velocities(t, velocity)) - t) / later
        return np.where((t <= 0) | (stretch > most), 0.0, x)

    return map_traces(df, work, "amplitude", ["offset"])


def offset_mute(df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Zeroes the traces outside the offsets (inclusive; at least one bound)."""
    if low is None and high is None:
        raise ValueError("a mute needs a bound")
    if low is not None and high is not None and low > high:
        raise ValueError("the mute's bounds are in the wrong order")
    inside = F.lit(True)
    if low is not None:
        inside = inside & (F.col("offset") >= low)
    if high is not None:
        inside = inside & (F.col("offset") <= high)
    x = as_doubles("amplitude")
    return df.withColumn("amplitude", F.when(inside, x).otherwise(F.transform(x, lambda _: F.lit(0.0))))


def select_gather(df: DataFrame, il: int | None = None, xl: int | None = None, ordinal: int | None = None) -> DataFrame:
    if ordinal is not None:
        return df.where(F.col("gather") == ordinal)
    return df.where((F.col("il") == il) & (F.col("xl") == xl))


def trial_velocities(low: float, high: float, step: float) -> list[float]:
    """low, low + step, ... capped at high; the last step may be short by half."""
    if not (0 < low <= high) or step <= 0:
        raise ValueError("velocities are positive and rise")
    out, k = [], 0
    while low + k * step <= high + step / 2:
        out.append(min(low + k * step, high))
        k += 1
        if k > MOST_VELOCITIES:
            raise ValueError(f"more than {MOST_VELOCITIES} trial velocities")
    return out


def semblance(df: DataFrame, interval_ms: float, trials: Sequence[float], keys: Sequence[str] = ("gather",), start_ms: float = 0.0) -> DataFrame:
    """(keys, velocity, t, semblance) of every trial velocity and sample.

    Each task moves its traces out at every velocity and adds them up per gather (``sum_traces``), so a large
    gather neither meets in one task nor sends its traces anywhere.  Traces without an offset add nothing but
    their number.
    """

    def work(x, offset):
        t = np.maximum(0.0, start_ms + np.arange(x.shape[1]) * interval_ms)
        return np.stack([samples_at(x, moveout(t, offset, np.full(len(t), float(v))), interval_ms) for v in trials])

    sums = sum_traces(df, keys, "amplitude", ["offset"], work)
    s, e, n = (F.col(c) for c in ("__s", "__e", "__n"))
    value = F.when(e <= SMALL, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), s * s / (n * e + SMALL))))
    velocity = F.element_at(F.array(*[F.lit(float(v)) for v in trials]), F.col("__label") + 1)
    return sums.select(*keys, velocity.alias("velocity"), F.col("__t").cast("long").alias("t"), value.alias("semblance"))


def pick_velocities(panel: DataFrame, interval_ms: float, keys: Sequence[str] = ("gather",), stride: int = 1, least: float = 0.0, times: tuple[float | None, float | None] = (None, None), smoothing: int = 1, start_ms: float = 0.0) -> DataFrame:
    """The best velocity of every stride-th sample (the lower one on ties), smoothed along time."""
    if stride < 1 or not 0 <= least <= 1 or smoothing < 1:
        raise ValueError("stride and smoothing are at least 1, the least semblance is in [0, 1]")
    time = start_ms + F.col("t") * interval_ms
    rows = panel.where(F.col("t") % stride == 0).withColumn("time_ms", time)
    if times[0] is not None:
        rows = rows.where(F.col("time_ms") >= times[0])
    if times[1] is not None:
        rows = rows.where(F.col("time_ms") <= times[1])
    best = rows.groupBy(*keys, "t", "time_ms").agg(F.max(F.struct("semblance", (-F.col("velocity")).alias("v"))).alias("b"))
    best = best.select(*keys, "t", "time_ms", (-F.col("b.v")).alias("picked"), F.col("b.semblance").alias("semblance")).where(F.col("semblance") >= least)
    r = smoothing // 2
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(-r, r)
    return best.withColumn("velocity", F.avg("picked").over(w))
