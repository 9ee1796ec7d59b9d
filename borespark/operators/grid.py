"""Survey grids: geometry, affine fits, snapping, regularisation, horizons, lateral refinement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borespark.operators.traces import as_doubles

SNAP = 0.6
#: Lines and crosslines of a tile that is refined at a time.
TILE = 32


def geometry(headers: DataFrame, il: str = "il", xl: str = "xl", third: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """One row per key: observed, unique, expected, missing, duplicates, completeness and class of a survey."""
    axes = [il, xl] + ([third] if third else [])
    cells = headers.groupBy(*keys, *axes).agg(F.count("*").alias("__n"))
    counts = cells.groupBy(*keys).agg(F.sum("__n").alias("observed"), F.count("*").alias("unique"), F.count_if(F.col("__n") > 1).alias("duplicates"), *[F.count_distinct(a).alias(f"n_{i}") for i, a in enumerate(axes)])
    expected = F.col("n_0") * F.col("n_1") * (F.col("n_2") if third else F.lit(1))
    out = counts.withColumn("expected", expected).withColumn("missing", F.greatest(F.lit(0), F.col("expected") - F.col("unique")))
    kind = F.when((F.col("duplicates") == 0) & (F.col("missing") == 0), "regular_dense").when(F.col("duplicates") == 0, "regular_sparse").when(F.col("missing") == 0, "duplicate_coordinates").otherwise("ambiguous_mapping")
    return out.select(*keys, "observed", "unique", "expected", "missing", "duplicates", (F.col("unique") / F.col("expected")).alias("completeness"), kind.alias("kind"), F.least("n_0", "n_1").alias("axis_count"))


def candidate_geometries(headers: DataFrame, mappings: Mapping[str, tuple[str, str]]) -> DataFrame:
    """For ``rank_geometries``: a row per way (label) to read two header columns as line and crossline.

    Only a mapping without duplicate positions can be taken without asking; a sparse one counts like a dense one.
    """
    out = None
    for label, (il, xl) in mappings.items():
        g = geometry(headers.select(F.col(il).alias("il"), F.col(xl).alias("xl")))
        automatic = F.col("duplicates") == 0
        row = g.select(F.lit(label).alias("label"), F.when(automatic, 2).when(F.col("missing") == 0, 1).otherwise(0).alias("action"), automatic.alias("automatic"), "axis_count", "completeness", F.col("unique").alias("cells"))
        out = row if out is None else out.union(row)
    return out


def duplicate_positions(headers: DataFrame, il: str = "il", xl: str = "xl", most: int = 8) -> DataFrame:
    """The first positions with several traces."""
    return headers.groupBy(il, xl).agg(F.count("*").alias("n")).where("n > 1").orderBy(il, xl).limit(most)


def rank_geometries(candidates: DataFrame) -> DataFrame:
    """Header mappings (label, action 0.., automatic, axis_count, completeness, cells) by score, with ``chosen``.

    The score weighs action 10000, automatic 1000, the smaller axis count 1 and whole per cent of
    completeness 1; ties go by cells, then label.  One is chosen only if it alone is automatic.
    """
    score = F.col("action") * 10000 + F.col("automatic").cast("int") * 1000 + F.col("axis_count") + F.floor(F.col("completeness") * 100)
    alone = candidates.agg(F.count_if("automatic").alias("__n"))
    rows = candidates.withColumn("score", score.cast("long")).crossJoin(F.broadcast(alone))  # one row
    return rows.withColumn("chosen", F.col("automatic") & (F.col("__n") == 1)).drop("__n").orderBy(F.desc("score"), F.desc("cells"), "label")


def storage_estimate(geometries: DataFrame, samples: int) -> DataFrame:
    """Expected to observed ratio and bytes of a dense store of float32 amplitudes and a byte of occupancy."""
    return geometries.withColumns({"ratio": F.col("expected") / F.col("observed"), "amplitude_bytes": F.col("expected") * samples * 4, "occupancy_bytes": F.when(F.col("missing") > 0, F.col("expected")).otherwise(0)})


def fit_affine(points: DataFrame, i: str, x: str, px: str, py: str, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares affine grid per key: origin, inline and crossline basis; NULL where degenerate.

    Twelve sums over the points, then a closed form: nothing but sums moves.
    """
    p, q, u, v = (F.col(c) for c in (i, x, px, py))
    s = points.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(p).alias("si"), F.sum(q).alias("sx"), F.sum(p * p).alias("sii"), F.sum(p * q).alias("six"), F.sum(q * q).alias("sxx"), F.sum(u).alias("su"), F.sum(p * u).alias("siu"), F.sum(q * u).alias("sxu"), F.sum(v).alias("sv"), F.sum(p * v).alias("siv"), F.sum(q * v).alias("sxv"))
    c = F.col

    def det(a, b, d):
        (a0, a1, a2), (b0, b1, b2), (d0, d1, d2) = a, b, d
        return a0 * (b1 * d2 - b2 * d1) - a1 * (b0 * d2 - b2 * d0) + a2 * (b0 * d1 - b1 * d0)

    m = [[c("n"), c("si"), c("sx")], [c("si"), c("sii"), c("six")], [c("sx"), c("six"), c("sxx")]]
    whole = det(*m)
    out = {}
    for name, r in (("x", ("su", "siu", "sxu")), ("y", ("sv", "siv", "sxv"))):
        for k, part in enumerate(("origin", "inline", "xline")):
            replaced = [[c(r[row]) if col == k else m[row][col] for col in range(3)] for row in range(3)]
            out[f"{part}_{name}"] = F.when(F.abs(whole) >= 1e-9, det(*replaced) / whole)
    return s.select(*keys, *[value.alias(name) for name, value in out.items()])


def snap(px: Column, py: Column, origin: tuple, inline: tuple, xline: tuple, n_il: int, n_xl: int, tolerance: float = SNAP) -> Column:
    """struct(i, x) of the grid node of a point; NULL off the grid or farther than the tolerance in cells."""
    det = inline[0] * xline[1] - inline[1] * xline[0]
    if abs(det) <= 2.220446049250313e-16:
        return F.lit(None).cast("struct<i:bigint,x:bigint>")
    dx, dy = px - origin[0], py - origin[1]
    i, x = (dx * xline[1] - dy * xline[0]) / det, (dy * inline[0] - dx * inline[1]) / det
    ri, rx = F.round(i), F.round(x)
    sound = (F.abs(i - ri) <= tolerance) & (F.abs(x - rx) <= tolerance) & (ri >= 0) & (ri < n_il) & (rx >= 0) & (rx < n_xl)
    return F.when(sound, F.struct(ri.cast("long").alias("i"), rx.cast("long").alias("x")))


def import_horizon(points: DataFrame, order: str, origin: tuple, inline: tuple, xline: tuple, n_il: int, n_xl: int, check: bool = True) -> DataFrame:
    """Points (x, y, z) on the grid: (i, x, z), the last point in ``order`` wins.

    At least nine distinct cells per ten points must be mapped, else the query fails (``check``).  Cells and
    points are counted in one pass: points off the grid form a row of their own, of no cell.
    """
    rows = points.withColumn("__c", snap(F.col("x"), F.col("y"), origin, inline, xline, n_il, n_xl))
    cells = rows.groupBy("__c.i", "__c.x").agg(F.max_by("z", order).alias("z"), F.count("*").alias("__n"))
    if check:
        share = cells.agg(F.sum("__n").alias("__points"), F.count("i").alias("__mapped"))
        enough = F.when(F.col("__mapped") * 10 < F.col("__points") * 9, F.raise_error(F.concat(F.lit("too few cells are mapped: "), F.col("__mapped").cast("string")))).otherwise(F.lit(True)).cast("boolean")
        cells = cells.crossJoin(F.broadcast(share.select(enough.alias("__enough")))).where("__enough")  # one row
    return cells.where("i is not null").select("i", "x", "z")


def regularise(traces: DataFrame, fill: float = 0.0) -> DataFrame:
    """The dense grid of the observed lines with the traces; missing ones are filled, ``occupied`` tells.

    The grid has as many rows as lines times crosslines, which is the size of the result.
    """
    il, xl = traces.select("il").distinct(), traces.select("xl").distinct()
    n = traces.agg(F.max(F.size("amplitude")).alias("__n"))
    grid = il.crossJoin(xl).crossJoin(F.broadcast(n))
    rows = grid.join(traces.withColumn("occupied", F.lit(True)), ["il", "xl"], "left")
    return rows.withColumns({"amplitude": F.coalesce(as_doubles("amplitude"), F.array_repeat(F.lit(fill), F.col("__n"))), "occupied": F.coalesce("occupied", F.lit(False))}).drop("__n")


def horizon_on_section(horizon: DataFrame, axis: str, index: int, interval_ms: float, samples: int, start_ms: float = 0.0) -> DataFrame:
    """Horizon cells on a section with their nearest sample; beyond half a step of the axis there is none."""
    at = (F.col("z") - start_ms) / interval_ms
    inside = (at >= -0.5) & (at <= samples - 0.5)
    return horizon.where(F.col(axis) == index).withColumn("sample", F.when(inside, F.greatest(F.lit(0), F.least(F.lit(samples - 1), F.round(at))).cast("long")))


def refine_linear(traces: DataFrame, present: bool = False) -> DataFrame:
    """A grid of (2n - 1) by (2m - 1) traces: midpoints are means of their two or four neighbours.

    Missing neighbours count as zeros; with ``present`` the mean is of those that there are.
    """
    return _refine(traces, False, present)


def refine_cubic(traces: DataFrame) -> DataFrame:
    """As ``refine_linear`` by cubic midpoints (-1, 9, 9, -1)/16 where two cells lie on each side, else linear."""
    return _refine(traces, True)


def _refine(traces: DataFrame, cubic: bool, present: bool = False) -> DataFrame:
    """Tiles of lines and crosslines, with the lines that their midpoints lean on, refined as cubes.

    A trace goes to its own tile and to the one or two whose rim it belongs to, so little more than the volume
    moves.  Missing traces count as zeros, unless means are of the ``present`` ones; a node on which no trace has a weight
    has no row.  Traces of one tile are filled up to its longest.
    """
    t = traces.where(F.col("amplitude").isNotNull()).select(F.col("il").cast("long").alias("il"), F.col("xl").cast("long").alias("xl"), as_doubles("amplitude").alias("a"))
    size = t.agg(F.max("il").alias("last_i"), F.max("xl").alias("last_x"))

    def tiles(column):  # tile k holds the lines k * TILE - 1 to (k + 1) * TILE + 1
        return F.explode(F.sequence(F.floor((F.col(column) - 2) / TILE), F.floor((F.col(column) + 1) / TILE)))

    sent = t.crossJoin(F.broadcast(size)).withColumn("ti", tiles("il")).withColumn("tx", tiles("xl"))  # one row

    def run(key, pdf):
        i0, x0 = int(key[0]) * TILE, int(key[1]) * TILE
        last_i, last_x = int(pdf["last_i"].iloc[0]), int(pdf["last_x"].iloc[0])
        cube, there = np.zeros((TILE + 3, TILE + 3, pdf["a"].map(len).max())), np.zeros((TILE + 3, TILE + 3, 1))
        for row, i, x in zip(pdf["a"], pdf["il"] - i0 + 1, pdf["xl"] - x0 + 1, strict=True):
            if present:  # also of several at one place
                cube[i, x, : len(row)] += row
                there[i, x] += 1
            else:
                cube[i, x, : len(row)], there[i, x] = row, 1
        lines, cross = i0 + np.arange(TILE), x0 + np.arange(TILE)
        edge_i, edge_x = ((at == 0) | (at + 1 >= last) for at, last in ((lines, last_i), (cross, last_x)))

        def between(c, outer):
            """Midpoints between the lines k and k + 1 along the first axis, linear and cubic."""
            half = 0.5 * (c[1:-2] + c[2:-1])
            return half, 0.5625 * (c[1:-2] + c[2:-1]) + outer * (c[:-3] + c[3:]) if cubic else half

        def across(c, outer):
            return [np.swapaxes(m, 0, 1) for m in between(np.swapaxes(c, 0, 1), outer)]

        def refined(c, outer):
            out = np.zeros((2 * TILE, 2 * TILE, c.shape[2]))
            ends_i, ends_x = edge_i[:, None, None], edge_x[None, :, None]
            half, curve = between(c, outer)
            out[::2, ::2] = c[1:-2, 1:-2]
            out[1::2, ::2] = np.where(ends_i, half[:, 1:-2], curve[:, 1:-2])
            out[::2, 1::2] = np.where(ends_x, *across(c[1:-2], outer))
            out[1::2, 1::2] = np.where(ends_i | ends_x, across(half, outer)[0], across(curve, outer)[1])
            return out

        values, weights = refined(cube, -0.0625), refined(there, 0.0625)
        filled = weights[:, :, 0] > 0  # with positive weights: has any trace a part
        if present:
            values /= np.where(weights > 0, weights, 1)
        i, x = 2 * i0 + np.arange(2 * TILE), 2 * x0 + np.arange(2 * TILE)
        filled &= ((i >= 0) & (i <= 2 * last_i))[:, None] & ((x >= 0) & (x <= 2 * last_x))[None, :]
        i, x = np.nonzero(filled)
        return pd.DataFrame({"il": 2 * i0 + i, "xl": 2 * x0 + x, "amplitude": pd.Series(list(values[i, x]), dtype=object)})

    return sent.groupBy("ti", "tx").applyInPandas(run, "il long, xl long, amplitude array<double>")


def thin_lateral(traces: DataFrame, step: int = 2) -> DataFrame:
    """Every step-th trace along both lines."""
    return traces.where((F.col("il") % step == 0) & (F.col("xl") % step == 0)).withColumns({"il": F.floor(F.col("il") / step).cast("long"), "xl": F.floor(F.col("xl") / step).cast("long")})


def volume_error(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("il", "xl")) -> DataFrame:
    """RMSE, mean and greatest absolute difference of two volumes at their common positions and samples."""
    both = left.select(*keys, as_doubles("amplitude").alias("a")).join(right.select(*keys, as_doubles("amplitude").alias("b")), list(keys))
    d = both.select(F.filter(F.zip_with("a", "b", lambda x, y: x - y), lambda x: x.isNotNull()).alias("d"))

    def total(term):
        return F.aggregate("d", F.lit(0.0), lambda s, x: s + term(x))

    per = d.select(total(lambda x: x * x).alias("q"), total(F.abs).alias("a"), F.array_max(F.transform("d", F.abs)).alias("m"), F.size("d").alias("n")).where("n > 0")
    n = F.sum("n")
    return per.agg(F.sqrt(F.sum("q") / n).alias("rmse"), (F.sum("a") / n).alias("mae"), F.max("m").alias("max_abs"), F.coalesce(n, F.lit(0)).alias("n"))
