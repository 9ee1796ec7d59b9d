"""Operators over the traces around each trace: similarity, local statistics, dip.

Volumes are cut into square tiles with a rim of neighbours, and each tile is computed as one cube
(``by_tile``); ``gather_around`` gives the pairs themselves as rows, by an equi-join on shifted line numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borespark.operators.traces import as_doubles, blocks

TINY, FLAT = 1e-6, 1e-9
#: Lines and crosslines of a tile.
TILE = 32


@dataclass(frozen=True)
class Around:
    """Steps to each side along both lines and the gate's length in ms."""

    inline: int = 1
    xline: int = 1
    gate_ms: float = 24.0

    def half(self, interval_ms: float) -> int:
        if not 0 < self.gate_ms <= 10_000:
            raise ValueError("the gate is in (0, 10000] ms")
        if self.inline < 0 or self.xline < 0 or self.inline + self.xline == 0:
            raise ValueError("a step is needed along at least one line")
        return max(1, int(self.gate_ms / interval_ms + 0.5)) // 2


def gather_around(df: DataFrame, around: Around) -> DataFrame:
    """il, xl, center, di, dx, near: each occupied trace with each occupied trace around it, itself too."""
    own = df.where(F.col("amplitude").isNotNull()).select("il", "xl", as_doubles("amplitude").alias("near"))
    steps = F.array(*[F.struct(F.lit(i).alias("di"), F.lit(x).alias("dx")) for i in range(-around.inline, around.inline + 1) for x in range(-around.xline, around.xline + 1)])
    sent = own.withColumn("s", F.explode(steps)).select((F.col("il") - F.col("s.di")).alias("il"), (F.col("xl") - F.col("s.dx")).alias("xl"), F.col("s.di").alias("di"), F.col("s.dx").alias("dx"), "near")
    return own.withColumnRenamed("near", "center").join(sent, ["il", "xl"])


def similarity_expression(df: DataFrame, interval_ms: float, around: Around) -> DataFrame:
    """As ``similarity`` by array expressions on joined rows, JVM-side; for short gates."""
    half = around.half(interval_ms)
    near = gather_around(df, around).where("di <> 0 or dx <> 0")
    n = F.size("center")

    def gate(a, i):
        low = F.greatest(i - half, F.lit(0))
        return F.slice(a, low + 1, F.least(i + half + 1, n) - low)

    def norm(a):
        return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))

    def one(_, i):
        a, b = gate(F.col("center"), i), gate(F.col("near"), i)
        below = norm(a) * norm(b)
        dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return F.when((norm(a) <= TINY) | (below <= TINY), 0.0).otherwise(F.least(F.lit(1.0), F.abs(dot / below)))

    per = near.select("il", "xl", F.posexplode(F.transform("center", one)).alias("t", "c"))
    means = per.groupBy("il", "xl", "t").agg(F.avg("c").alias("c"))
    out = means.groupBy("il", "xl").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "c"))), lambda p: p["c"]).alias("amplitude"))
    alone = df.where(F.col("amplitude").isNotNull()).select("il", "xl", F.transform(as_doubles("amplitude"), lambda _: F.lit(0.0)).alias("zero"))
    return alone.join(out, ["il", "xl"], "left").select("il", "xl", F.coalesce("amplitude", "zero").alias("amplitude"))


def by_tile(df: DataFrame, interval_ms: float, around: Around, work, outputs: Sequence[str], tile: int = TILE) -> DataFrame:
    """il, xl and the output arrays of every occupied trace, computed on square tiles with a rim of neighbours.

    A trace goes to its own tile and to those whose rim it belongs to, so about (1 + 2 r / tile)**2 times the
    volume moves, not (2 r + 1)**2 times.  ``work`` gets the tile as a cube [lines, crosslines, samples] with
    rim, its occupancy, and the gate's half length, and returns the outputs' cubes without the rim.
    Traces shorter than the longest of their tile are filled up with zeros and cut again.
    """
    half, r1, r2 = around.half(interval_ms), around.inline, around.xline
    own = df.where(F.col("amplitude").isNotNull() & (F.size("amplitude") > 0)).select(F.col("il").cast("long").alias("il"), F.col("xl").cast("long").alias("xl"), F.col("amplitude").alias("a"))

    def tiles(column, r):
        return F.explode(F.sequence(F.floor((F.col(column) - r) / tile), F.floor((F.col(column) + r) / tile)))

    sent = own.withColumn("ti", tiles("il", r1)).withColumn("tx", tiles("xl", r2))

    def run(key, table):
        i0, x0 = key[0].as_py() * tile, key[1].as_py() * tile
        batch = table.select(["il", "xl", "a"]).combine_chunks().to_batches()[0]
        il, xl = (batch.column(k).to_numpy() for k in range(2))
        i, x, size = il - i0 + r1, xl - x0 + r2, np.zeros(len(il), np.int64)
        parts = list(blocks(batch, "a"))
        cube, there = np.zeros((tile + 2 * r1, tile + 2 * r2, max(p.shape[1] for _, p in parts))), np.zeros((tile + 2 * r1, tile + 2 * r2), bool)
        for rows, part in parts:
            cube[i[rows], x[rows], : part.shape[1]] = part
            size[rows] = part.shape[1]
        there[i, x] = True
        inner = np.flatnonzero((i >= r1) & (i < tile + r1) & (x >= r2) & (x < tile + r2))
        out = work(cube, there, half) if len(inner) else [cube] * len(outputs)
        offsets = pa.array(np.concatenate([[0], np.cumsum(size[inner])]).astype(np.int32))
        keep = np.arange(cube.shape[2]) < size[inner][:, None]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values[i[inner] - r1, x[inner] - r2][keep])) for values in out]
        return pa.table([pa.array(il[inner]), pa.array(xl[inner]), *lists], ["il", "xl", *outputs])

    return sent.groupBy("ti", "tx").applyInArrow(run, "il long, xl long, " + ", ".join(f"{o} array<double>" for o in outputs))


def _inner(cube: np.ndarray, r1: int, r2: int, di: int = 0, dx: int = 0) -> np.ndarray:
    """The cube without its rim, seen from a neighbour (di, dx)."""
    return cube[r1 + di : cube.shape[0] - r1 + di, r2 + dx : cube.shape[1] - r2 + dx]


def _gates(n: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)


def _sums(x: np.ndarray, half: int) -> np.ndarray:
    """Sums over the gate of ``half`` samples to each side (cut at the ends) along the samples.

    Sums of 1, 2, 4, ... neighbouring samples are doubled from one another, and a gate is put together from those that
    make up its length: the cost grows with the logarithm of the gate.  Nothing is subtracted, so a NaN or an infinite
    sample stays in its own gates, and large samples elsewhere take no digits away.
    """
    n, size = x.shape[-1], 2 * half + 1
    part = np.zeros((*x.shape[:-1], n + size - 1))
    part[..., half : half + n] = x
    out, at, width = None, 0, 1
    while width <= size:
        if size & width:
            own = part[..., at : at + n]
            out = own.copy() if out is None else np.add(out, own, out=out)
            at += width
        if 2 * width <= size:
            part = part[..., :-width] + part[..., width:]
        width *= 2
    return out


def _offsets(around: Around, itself: bool) -> list[tuple[int, int]]:
    return [(i, x) for i in range(-around.inline, around.inline + 1) for x in range(-around.xline, around.xline + 1) if itself or i or x]


def similarity(df: DataFrame, interval_ms: float, around: Around, tile: int = TILE) -> DataFrame:
    """il, xl, amplitude: mean |normalised cross-correlation| of each gate with the occupied traces around it.

    Running sums: the cost per sample doesn't grow with the gate.  A trace without neighbours gives zeros.
    """
    r1, r2 = around.inline, around.xline

    def work(cube, there, half):
        norms = np.sqrt(_sums(cube * cube, half))
        n_i, n_x = cube.shape[0] - 2 * r1, cube.shape[1] - 2 * r2
        total, count = np.zeros((n_i, n_x, cube.shape[2])), np.zeros((n_i, n_x))
        for di, dx in _offsets(around, False):
            if (di, dx) < (0, 0):
                continue  # a pair of traces is correlated once and counts for both
            low, high = max(dx, 0), max(-dx, 0)
            a = np.s_[r1 - di : r1 + n_i, r2 - low : r2 + n_x + high]
            b = np.s_[r1 : r1 + n_i + di, r2 - low + dx : r2 + n_x + high + dx]
            below = norms[a] * norms[b]
            dot = np.abs(_sums(cube[a] * cube[b], half))
            sound = (below > TINY) & (there[a] & there[b])[:, :, None]
            c = np.where(sound, np.minimum(dot / np.where(sound, below, 1), 1), 0)
            first, second = np.s_[di : di + n_i, low : low + n_x], np.s_[:n_i, high : high + n_x]  # where a, or b, is inside
            total += np.where(norms[a][first] > TINY, c[first], 0)
            total += np.where(norms[b][second] > TINY, c[second], 0)
            count += there[b][first]
            count += there[a][second]
        return [total / np.maximum(count, 1)[:, :, None]]

    return by_tile(df, interval_ms, around, work, ["amplitude"], tile)


def local_statistics(df: DataFrame, interval_ms: float, around: Around, tile: int = TILE) -> DataFrame:
    """il, xl and arrays mean, rms, variance (population), least, greatest over gate and traces around, itself included."""
    r1, r2 = around.inline, around.xline

    def work(cube, there, half):
        n = cube.shape[2]
        lo, hi = _gates(n, half)
        sums, squares = _sums(cube, half), _sums(cube * cube, half)
        least, greatest = np.full(cube.shape, np.inf), np.full(cube.shape, -np.inf)
        for k in range(-half, half + 1):
            at, to = slice(max(0, k), min(n, n + k)), slice(max(0, -k), min(n, n - k))
            least[..., to], greatest[..., to] = np.minimum(least[..., to], cube[..., at]), np.maximum(greatest[..., to], cube[..., at])
        s, q, m, a, b = (np.zeros(_inner(cube, r1, r2).shape) for _ in range(5))
        a[:], b[:] = np.inf, -np.inf
        for di, dx in _offsets(around, True):
            near = _inner(there, r1, r2, di, dx)[:, :, None]
            s += np.where(near, _inner(sums, r1, r2, di, dx), 0)
            q += np.where(near, _inner(squares, r1, r2, di, dx), 0)
            m += near * (hi - lo)
            a, b = np.minimum(a, np.where(near, _inner(least, r1, r2, di, dx), np.inf)), np.maximum(b, np.where(near, _inner(greatest, r1, r2, di, dx), -np.inf))
        m = np.maximum(m, 1)
        return [s / m, np.sqrt(np.maximum(q / m, 0)), np.maximum(q / m - (s / m) ** 2, 0), a, b]

    return by_tile(df, interval_ms, around, work, ["mean", "rms", "variance", "least", "greatest"], tile)


def dip(df: DataFrame, interval_ms: float, around: Around, tile: int = TILE) -> DataFrame:
    """il, xl and arrays inline_dip, xline_dip (ms per trace), azimuth (degrees), steepness.

    Per neighbour the lag whose gate correlates best in magnitude with the center's (near-ties go to the
    smaller lag) is one observation of a plane, weighted by the correlation; the plane is fitted per sample
    and falls back to one line where the other has no spread (``best_lag`` and ``fit_dip`` define it).
    """
    r1, r2 = around.inline, around.xline

    def work(cube, there, half):
        n = cube.shape[2]
        most, (lo, hi) = max(1, half), _gates(n, half)
        ends = np.flatnonzero(hi - lo < 2 * half + 1)
        power = _sums(cube * cube, half)
        norm = np.sqrt(_inner(power, r1, r2))
        center = _inner(cube, r1, r2)
        a, b, c, d, e = (np.zeros(center.shape) for _ in range(5))
        for di, dx in _offsets(around, False):
            other, energy = _inner(cube, r1, r2, di, dx), _inner(power, r1, r2, di, dx)
            squares = other * other
            best, weight = np.zeros(center.shape), np.zeros(center.shape)
            for lag in range(-most, most + 1):
                fits = (lo + lag >= 0) & (hi + lag <= n)
                shifted = np.zeros(center.shape)
                at, to = slice(max(0, lag), min(n, n + lag)), slice(max(0, -lag), min(n, n - lag))
                shifted[..., to] = other[..., at]
                # a whole gate's energy is that at the shifted sample; gates cut at the ends are summed up anew
                gates = np.zeros(center.shape)
                gates[..., to] = energy[..., at]
                for t in ends[fits[ends]]:
                    gates[..., t] = squares[..., lo[t] + lag : hi[t] + lag].sum(axis=-1)
                below = norm * np.sqrt(gates)
                sound = below > TINY
                w = np.where(sound, np.minimum(np.abs(_sums(center * shifted, half)) / np.where(sound, below, 1), 1), 0)
                take = fits & ((w > weight + TINY) | ((np.abs(w - weight) <= TINY) & (abs(lag) < np.abs(best))))
                best, weight = np.where(take, lag, best), np.where(take, w, weight)
            weight = np.where((weight > TINY) & (norm > TINY) & _inner(there, r1, r2, di, dx)[:, :, None], weight, 0)
            shift = best * interval_ms
            a, b, c = a + weight * di * di, b + weight * di * dx, c + weight * dx * dx
            d, e = d + weight * di * shift, e + weight * dx * shift
        det = a * c - b * b
        plane, line_i, line_x = np.abs(det) > FLAT, np.abs(a) > FLAT, np.abs(c) > FLAT
        safe = lambda x, ok: np.where(ok, x, 1)
        i = np.where(plane, (d * c - b * e) / safe(det, plane), np.where(line_i, d / safe(a, line_i), 0))
        x = np.where(plane, (a * e - b * d) / safe(det, plane), np.where(~line_i & line_x, e / safe(c, line_x), 0))
        flat = (np.abs(i) <= TINY) & (np.abs(x) <= TINY)
        return [i, x, np.where(flat, 0, np.degrees(np.arctan2(x, i)) % 360), np.hypot(i, x)]

    return by_tile(df, interval_ms, around, work, ["inline_dip", "xline_dip", "azimuth", "steepness"], tile)


def best_lag(center: np.ndarray, start: int, near: np.ndarray, most: int) -> tuple[int, float] | None:
    """The shift of ``near`` that correlates best in magnitude with the gate; near-ties go to the smaller shift."""
    size, norm = len(center), float(np.sqrt((center**2).sum()))
    lags = range(max(-start, -most), min(len(near) - size - start, most) + 1)
    best, weight = 0, 0.0
    for lag in lags:
        other = near[start + lag : start + lag + size]
        below = norm * float(np.sqrt((other**2).sum()))
        w = min(1.0, abs(float((center * other).sum()) / below)) if below > TINY else 0.0
        if w > weight + TINY or (abs(w - weight) <= TINY and abs(lag) < abs(best)):
            best, weight = lag, w
    return (best, weight) if weight > TINY else None


def fit_dip(observations: list[tuple[int, int, float, float]]) -> tuple[float, float]:
    """Weighted plane through (di, dx, shift, weight); falls back to one line where the other has no spread."""
    if not observations:
        return 0.0, 0.0
    di, dx, shift, w = np.array(observations, float).T
    a, b, c, d, e = (w * di * di).sum(), (w * di * dx).sum(), (w * dx * dx).sum(), (w * di * shift).sum(), (w * dx * shift).sum()
    det = a * c - b * b
    if abs(det) > FLAT:
        return float((d * c - b * e) / det), float((a * e - b * d) / det)
    if abs(a) > FLAT:
        return float(d / a), 0.0
    return (0.0, float(e / c)) if abs(c) > FLAT else (0.0, 0.0)
