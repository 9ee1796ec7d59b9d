"""Windows, intervals, alignment and ordering of depth-indexed rows (DataFrame -> DataFrame).

A log is a table of rows (keys..., order column, values...).  ``keys`` name the columns of one log (a well
and curve, say); every operator partitions by them, so logs are independent and nothing is global.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def _w(keys: Keys, *order):
    return Window.partitionBy(*keys).orderBy(*order)


def with_statistics(df: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    """df with aggregates of its log.

    A partially aggregated table of one row per log is joined back, so rows aren't shuffled and a log with a
    large share of them needs no task of its own; the planner broadcasts the table where it is small.  NULL
    keys count as one log.
    """
    stats = df.groupBy(*keys).agg(*[v.alias(k) for k, v in aggregates.items()]).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(stats, same).drop(*[f"__k_{k}" for k in keys])


# --- frames


def odd_window(window: float) -> int:
    """The window rounded half away from zero, at least 1, made odd upwards."""
    n = max(1, int(window + 0.5))
    return n + 1 - n % 2


def moving_average(df: DataFrame, keys: Keys, order: Sequence, value: str, window: int = 5, out: str = "smooth") -> DataFrame:
    """Centred mean over rows; NULLs are left out and filled, frames shrink at the ends."""
    r = odd_window(window) // 2
    return df.withColumn(out, F.avg(value).over(_w(keys, *order).rowsBetween(-r, r)))


def z_score(df: DataFrame, keys: Keys, value: str, out: str = "z") -> DataFrame:
    """(x - mean) / population standard deviation of the log; 0 where that is below epsilon."""
    rows = with_statistics(df, keys, __mean=F.avg(value), __sigma=F.stddev_pop(value))
    x, mean, sigma = F.col(value), F.col("__mean"), F.col("__sigma")
    scaled = F.when(sigma < 2.220446049250313e-16, F.when(x.isNotNull(), 0.0)).otherwise((x - mean) / sigma)
    return rows.withColumn(out, scaled).drop("__mean", "__sigma")


def min_max_scale(df: DataFrame, keys: Keys, value: str, low: float = 0.0, high: float = 1.0, out: str = "scaled") -> DataFrame:
    """Linear scaling of the log's range to [low, high]; a flat log gives low."""
    rows = with_statistics(df, keys, __least=F.min(value), __most=F.max(value))
    x, least, most = F.col(value), F.col("__least"), F.col("__most")
    scaled = F.when(x.isNotNull(), F.when(most == least, F.lit(low)).otherwise(low + (x - least) / (most - least) * (high - low)))
    return rows.withColumn(out, scaled).drop("__least", "__most")


def impedance_terms(df: DataFrame, keys: Keys, vp: str, vs: str, rho: str) -> DataFrame:
    """One row per log: means of Vp, Vs, rho (g/cc) and (Vs/Vp)^2 over rows valid in all three."""
    from borespark.functions.petro import density_gcc

    r = density_gcc(rho)
    rows = df.withColumn("__r", r).where((F.col(vp) > 0) & (F.col(vs) > 0) & F.col("__r").isNotNull())
    return rows.groupBy(*keys).agg(F.avg(vp).alias("vp0"), F.avg(vs).alias("vs0"), F.avg("__r").alias("rho0"), F.avg((F.col(vs) / F.col(vp)) * (F.col(vs) / F.col(vp))).alias("k"))


def monotonic_order(df: DataFrame, keys: Keys, order: Sequence, value: str) -> DataFrame:
    """Per log: 'ascending' (not falling; also below two values), 'descending' (not rising) or 'none'."""
    step = F.col(value) - F.lag(value).over(_w(keys, *order))
    return df.withColumn("__d", step).groupBy(*keys).agg(F.when(F.coalesce(F.min("__d") >= 0, F.lit(True)), "ascending").when(F.max("__d") <= 0, "descending").otherwise("none").alias("direction"))


def differentiate(df: DataFrame, keys: Keys, order: Sequence, value: str, step: float, out: str = "slope") -> DataFrame:
    """Central differences, one-sided at the ends; 0 for a single row."""
    w = _w(keys, *order)
    before, after, x = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    slope = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - x) / step).when(after.isNull(), (x - before) / step).otherwise((after - before) / (2.0 * step))
    return df.withColumn(out, slope)


def interval_velocity(df: DataFrame, keys: Keys, time: str, depth: str, out: str = "velocity") -> DataFrame:
    """2 dz/dt (time in ms) of each interval's lower row; the first row takes the second's; bad steps NULL."""
    w = _w(keys, time)
    dt, dz = (F.col(time) - F.lag(time).over(w)) / 1000.0, F.col(depth) - F.lag(depth).over(w)
    own = F.when((dt > 0) & (dz > 0), 2.0 * dz / dt)
    rows = df.withColumns({"__v": own, "__n": F.row_number().over(w)})
    return rows.withColumn(out, F.when(F.col("__n") == 1, F.lead("__v").over(w)).otherwise(F.col("__v"))).drop("__v", "__n")


def integrate_velocity(df: DataFrame, keys: Keys, time: str, velocity: str, two_way: bool = True, out: str = "depth") -> DataFrame:
    """Cumulative trapezoids of velocity over time (ms), halved for two-way time; the first depth is t * v."""
    w, factor = _w(keys, time), 0.5 if two_way else 1.0
    t, v = F.col(time) / 1000.0, F.col(velocity)
    step = F.coalesce((t - F.lag(t).over(w)) * 0.5 * (v + F.lag(v).over(w)), t * v) * factor
    return df.withColumn("__s", step).withColumn(out, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def average_velocity_depth(time: Column, velocity: Column) -> Column:
    """Depth from average velocity and two-way time in ms."""
    return time / 1000.0 * velocity / 2.0


def fill_base(df: DataFrame, keys: Keys, top: str, base: str) -> DataFrame:
    """A missing base is the next top; the last stays missing."""
    return df.withColumn(base, F.coalesce(base, F.lead(top).over(_w(keys, F.asc_nulls_last(top), base))))


# --- interpolation


def bracket(points: DataFrame, table: DataFrame, keys: Keys, x: str, y: str) -> DataFrame:
    """points (keys, x and others) with y interpolated linearly in table (keys, x, y), clamped at its ends.

    An as-of join both ways (``bracket_all``).
    """
    return bracket_all(points, {y: table}, keys, x, y)


def bracket_all(points: DataFrame, tables: dict[str, DataFrame], keys: Keys, x: str, y: str) -> DataFrame:
    """points (keys, x and others) with a column per table (keys, x, y): its y, interpolated linearly, clamped at its ends.

    Points and the rows of all tables are put in one order per key, and each table's last row at or before and first
    row at or after a point are carried by ignoring NULLs: one shuffle and two orders however many tables there
    are.  No pairs are made.
    """
    names = list(tables)
    others = [c for c in points.columns if c not in (*keys, x)]
    rows = points.select(*keys, x, F.struct(*[F.col(c) for c in others] or [F.lit(1).alias("one")]).alias("__o"), F.lit(None).cast("double").alias("__y"), F.lit(-1).alias("__c"))
    kind = rows.schema["__o"].dataType
    for number, table in enumerate(tables.values()):
        t = table.where(F.col(y).isNotNull() & F.col(x).isNotNull())
        rows = rows.unionByName(t.select(*keys, x, F.lit(None).cast(kind).alias("__o"), F.col(y).cast("double").alias("__y"), F.lit(number).alias("__c")))
    point = F.col("__c") < 0
    back, ahead = (Window.partitionBy(*keys).orderBy(order, point.cast("int")).rowsBetween(Window.unboundedPreceding, 0) for order in (x, F.desc(x)))
    carried = {}
    for number in range(len(names)):
        knot = F.when(F.col("__c") == number, F.struct(F.col(x).cast("double").alias("x"), F.col("__y").alias("y")))
        carried |= {f"__a{number}": F.last(knot, ignorenulls=True).over(back), f"__b{number}": F.last(knot, ignorenulls=True).over(ahead)}
    rows = rows.withColumns(carried).where(point)

    def value(number):
        a, b = F.col(f"__a{number}"), F.col(f"__b{number}")
        return F.when(a.isNull(), b["y"]).when(b.isNull() | (b["x"] == a["x"]), a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"]))

    return rows.select(*keys, x, *[F.col("__o")[c].alias(c) for c in others], *[value(k).alias(n) for k, n in enumerate(names)])


def resample_aligned(channels: dict[str, DataFrame], keys: Keys, x: str, y: str, step: float | None = None) -> DataFrame:
    """Regular centres over the channels' overlap with every channel interpolated (all columns non-NULL).

    The step is the largest of the channels' median steps unless given.
    """
    span = None
    for name, df in channels.items():
        df = df.where(F.col(y).isNotNull())
        stats = extents(df, keys, x) if step else curve_statistics(df, keys, x, y)
        stats = stats.select(*keys, F.col("first").alias(f"f_{name}"), F.col("last").alias(f"l_{name}"), *([] if step else [F.col("step").alias(f"s_{name}")]))
        span = stats if span is None else span.join(stats, list(keys))
    names = list(channels)
    many = len(names) > 1
    top = F.greatest(*[F.col(f"f_{n}") for n in names]) if many else F.col(f"f_{names[0]}")
    end = F.least(*[F.col(f"l_{n}") for n in names]) if many else F.col(f"l_{names[0]}")
    width = F.lit(float(step)) if step else (F.greatest(*[F.col(f"s_{n}") for n in names]) if many else F.col(f"s_{names[0]}"))
    grid = span.select(*keys, top.alias("__t"), end.alias("__e"), width.alias("__s")).where("__s > 0 and __e > __t")
    grid = grid.withColumn("__n", F.floor((F.col("__e") - F.col("__t")) / F.col("__s"))).where("__n > 0").select(*keys, "__t", "__s", "__n")
    return _centres(grid, channels, keys, x, y)


def _centres(grid: DataFrame, channels: dict[str, DataFrame], keys: Keys, x: str, y: str) -> DataFrame:
    """The centres __t + (i + 0.5) * __s, i < __n, of each row of grid, with every channel interpolated.

    Only the channels' rows are put in order: each carries the segments of all channels that it lies in and then makes
    the centres from itself up to the next row, so that centres, of which there may be far more than rows, are never
    shuffled, sorted or spilled.  Rows move before anything is added to them.  Centres lie in the channels' overlap,
    behind a row of each.
    """
    rows = None
    for number, df in enumerate(channels.values()):
        knots = df.where(F.col(y).isNotNull() & F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"), F.lit(number).alias("__c"))
        rows = knots if rows is None else rows.unionByName(knots)
    own, order = _w([*keys, "__c"], "__x", "__y"), _w(keys, "__x", "__c", "__y")
    rows = rows.repartition(*keys).withColumns({"__nx": F.lead("__x").over(own), "__ny": F.lead("__y").over(own)})
    rows = rows.sortWithinPartitions(*keys, "__x", "__c", "__y")  # before the segments make them wide
    segment = F.struct(F.col("__x").alias("x0"), F.col("__y").alias("y0"), F.col("__nx").alias("x1"), F.col("__ny").alias("y1"))
    back = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"__to": F.lead("__x").over(order)} | {f"__s{i}": F.last(F.when(F.col("__c") == i, segment), ignorenulls=True).over(back) for i in range(len(channels))})
    rows = rows.where(F.col("__to").isNull() | (F.col("__to") > F.col("__x"))).join(grid, list(keys))  # the last of several rows at a place has all of them behind it

    def number_at(place):
        return (F.col(place) - F.col("__t")) / F.col("__s") - 0.5

    last = F.col("__n") - 1
    first = F.greatest(F.lit(0), F.floor(number_at("__x")))
    rows = rows.withColumns({"__lo": first, "__hi": F.coalesce(F.least(last, F.ceil(number_at("__to"))), last)}).where("__lo <= __hi")
    rows = rows.withColumn("__i", F.explode(F.sequence("__lo", "__hi"))).withColumn("__p", F.col("__t") + (F.col("__i") + 0.5) * F.col("__s"))
    rows = rows.where((F.col("__p") >= F.col("__x")) & (F.col("__to").isNull() | (F.col("__p") < F.col("__to"))))

    def value(number):
        s, p = F.col(f"__s{number}"), F.col("__p")
        return F.when(s["x1"].isNull() | (p == s["x0"]), s["y0"]).otherwise(s["y0"] + (s["y1"] - s["y0"]) * (p - s["x0"]) / (s["x1"] - s["x0"]))

    return rows.select(*keys, F.col("__p").alias(x), *[value(i).alias(n) for i, n in enumerate(channels)])


def positional_join(left: DataFrame, right: DataFrame, keys: Keys, position: str, depth: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of two curves by position; lengths must agree and depths differ by at most the tolerance."""
    r = right.withColumnRenamed(depth, "__d").withColumn("__r", F.lit(1))
    both = left.withColumn("__l", F.lit(1)).join(r, [*keys, position], "full")
    bad = F.col("__l").isNull() | F.col("__r").isNull() | (F.abs(F.col(depth) - F.col("__d")) > tolerance)
    check = F.when(bad, F.raise_error(F.lit("curves do not align: lengths or depths differ"))).otherwise(F.lit(True))
    return both.where(check).drop("__d", "__l", "__r")


# --- layers and intervals


def layer_means(df: DataFrame, keys: Keys, depth: str, values: Sequence[str], thickness: float, min_samples: int = 1, partial_last: bool = True) -> DataFrame:
    """Means over layers of fixed thickness from the first depth on: layer, top, base, samples, means."""
    if thickness <= 0:
        raise ValueError("thickness must be positive")
    rows = with_statistics(df, keys, __d0=F.min(depth), __d1=F.max(depth))
    rows = rows.withColumn("layer", F.floor((F.col(depth) - F.col("__d0")) / thickness).cast("long"))
    out = rows.groupBy(*keys, "layer").agg(F.first("__d0").alias("__d0"), F.first("__d1").alias("__d1"), F.count("*").alias("samples"), *[F.avg(v).alias(v) for v in values])
    out = out.withColumns({"top": F.col("__d0") + F.col("layer") * thickness, "base": F.col("__d0") + (F.col("layer") + 1) * thickness})
    out = out.where(F.col("samples") >= min_samples)
    if not partial_last:
        out = out.where(F.col("base") <= F.col("__d1") + 1e-9)
    return out.drop("__d0", "__d1")


def in_intervals(samples: DataFrame, intervals: DataFrame, keys: Keys, depth: str, top: str, base: str) -> DataFrame:
    """samples joined with the interval that holds them: top <= depth < base; the last base is inclusive.

    Intervals of one key don't overlap, so the interval is the one of the greatest top at or above the
    sample: an as-of carry in one sorted pass per key instead of a join by inequality.
    """
    others = [c for c in intervals.columns if c not in keys]
    last = Window.partitionBy(*keys)
    i = intervals.withColumn("__last", F.col(base) == F.max(base).over(last))
    i = i.select(*keys, F.col(top).cast("double").alias("__x"), F.struct(*others, "__last").alias("__i"), F.lit(0).alias("__p"))
    s = samples.select(*keys, F.col(depth).cast("double").alias("__x"), F.lit(1).alias("__p"), F.struct(*[c for c in samples.columns if c not in keys]).alias("__s"))
    both = i.unionByName(s, allowMissingColumns=True)
    carry = Window.partitionBy(*keys).orderBy("__x", "__p").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("__i", F.last("__i", ignorenulls=True).over(carry)).where("__p = 1 and __i is not null")
    rows = rows.where((F.col("__x") < F.col(f"__i.{base}")) | (F.col("__i.__last") & (F.col("__x") == F.col(f"__i.{base}"))))
    return rows.select(*keys, "__s.*", *[F.col(f"__i.{c}").alias(c) for c in others])


def edges_to_intervals(edges: DataFrame, keys: Keys, depth: str, label: str | None = None) -> DataFrame:
    """Consecutive edges as intervals (top, base); edges must rise strictly."""
    w = _w(keys, depth)
    rows = edges.withColumn("base", F.lead(depth).over(w)).where("base is not null")
    check = F.when(F.col("base") <= F.col(depth), F.raise_error(F.lit("edges must rise strictly"))).otherwise(F.lit(True))
    return rows.where(check).withColumnRenamed(depth, "top")


def adjacent_interfaces(layers: DataFrame, keys: Keys, values: Sequence[str], allow_gaps: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """Pairs of consecutive layers (top, base, values) as interfaces: depth, value1.., value2..."""
    w = _w(keys, "top")
    rows = layers.withColumns({"__t": F.lead("top").over(w)} | {f"{v}2": F.lead(v).over(w) for v in values}).where("__t is not null")
    if not allow_gaps:
        rows = rows.where(F.abs(F.col("__t") - F.col("base")) <= tolerance)
    return rows.select(*keys, F.col("base").alias("interface_depth"), *[F.col(v).alias(f"{v}1") for v in values], *[f"{v}2" for v in values])


# --- summaries


def curve_statistics(df: DataFrame, keys: Keys, depth: str, value: str) -> DataFrame:
    """Per curve: rows, samples (with a value), first and last depth of these, median positive step."""
    has = F.col(value).isNotNull()
    step = F.col(depth) - F.lag(depth).over(_w(keys, depth))
    rows = df.withColumn("__s", F.when(step > 2.220446049250313e-16, step))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_if(has).alias("samples"), F.min(F.when(has, F.col(depth))).alias("first"), F.max(F.when(has, F.col(depth))).alias("last"), F.median("__s").alias("step"))


def depth_bins(df: DataFrame, keys: Keys, depth: str, value: str, buckets: int) -> DataFrame:
    """Level of detail: per depth bucket the mean depth, least and greatest value."""
    rows = with_statistics(df, keys, __low=F.min(depth), __high=F.max(depth))
    low, high = F.col("__low"), F.col("__high")
    number = F.when(high > low, F.least(F.lit(buckets - 1), F.floor((F.col(depth) - low) / (high - low) * buckets))).otherwise(0).cast("long")
    return rows.withColumn("bucket", number).where(F.col(value).isNotNull()).groupBy(*keys, "bucket").agg(F.avg(depth).alias("mean_depth"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count("*").alias("n"))


def axis_summary(df: DataFrame, keys: Keys, axis: str, tolerance: float = 1e-9) -> DataFrame:
    """Distinct axis values: count, first, last, step; regular if all steps equal the first."""
    values = df.where(F.col(axis).isNotNull()).select(*keys, axis).distinct()
    w = _w(keys, axis)
    rows = values.withColumn("__d", F.col(axis) - F.lag(axis).over(w)).withColumn("__s", F.first("__d", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.groupBy(*keys).agg(F.count("*").alias("count"), F.min(axis).alias("first"), F.max(axis).alias("last"), F.first("__s", ignorenulls=True).alias("step"), F.coalesce(F.bool_and(F.abs(F.col("__d") - F.col("__s")) <= tolerance), F.lit(True)).alias("regular"))


def extents(df: DataFrame, keys: Keys, depth: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(depth).alias("first"), F.max(depth).alias("last"), F.count("*").alias("rows"))


# --- filters


def row_window(df: DataFrame, position: str, start: int, count: int) -> DataFrame:
    return df.where((F.col(position) >= start) & (F.col(position) < start + count))


def depth_window(df: DataFrame, depth: str, low: float, high: float, keys: Keys | None = None, order: Keys = ()) -> DataFrame:
    """Both ends inclusive.

    With ``keys`` the depths of each log, in ``order``, must be finite and run one way, else the query fails.
    """
    if not (math.isfinite(low) and math.isfinite(high)) or low > high:
        raise ValueError("the window's ends are finite and in order")
    if keys is not None:
        df = df.join(_checked_depths(df, keys, order, depth), _same(keys), "left_semi")
    return df.where(F.col(depth).between(low, high))


def _same(keys: Keys) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return same


def _checked_depths(df: DataFrame, keys: Keys, order: Keys, depth: str) -> DataFrame:
    """A row per log, whose making fails where a depth is missing, no number or turns round."""
    x = F.col(depth)
    rows = df.withColumn("__d", x - F.lag(x).over(_w(keys, *order)))
    wrong = (F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) > 0) | ((F.min("__d") < 0) & (F.max("__d") > 0))
    logs = rows.groupBy(*keys).agg(F.when(wrong, F.raise_error(F.lit("depths are finite and run one way"))).otherwise(F.lit(True)).cast("boolean").alias("__sound"))
    return logs.where("__sound").select(*[F.col(k).alias(f"__k_{k}") for k in keys])


def trim_ends(df: DataFrame, keys: Keys, depth: str, share: float) -> DataFrame:
    """Each log without the rows in the first and last ``share`` of its own depth range."""
    if not 0 <= share < 0.5:
        raise ValueError("the share is in [0, 0.5)")
    rows = with_statistics(df, keys, __top=F.min(depth), __bottom=F.max(depth))
    margin = share * (F.col("__bottom") - F.col("__top"))
    return rows.where(F.col(depth).between(F.col("__top") + margin, F.col("__bottom") - margin)).drop("__top", "__bottom")


def regular_depth_window(df: DataFrame, position: str, start: float, step: float, low: float, high: float) -> DataFrame:
    """The rows of a regular index (start + position * step) inside the window, by arithmetic on positions."""
    if low > high or step == 0:
        raise ValueError("a window needs ordered ends and a step")
    eps = abs(step) * 1e-9
    at = start + F.col(position) * step
    return df.where((at >= low - eps) & (at <= high + eps))


def optional_depth_range(df: DataFrame, depth: str, low: float | None, high: float | None, keep_missing: bool) -> DataFrame:
    """Inclusive optional bounds; rows without a depth stay if ``keep_missing`` (pressure and drilling rows)."""
    cond = F.lit(True)
    if low is not None:
        cond = cond & (F.col(depth) >= low)
    if high is not None:
        cond = cond & (F.col(depth) <= high)
    return df.where((F.col(depth).isNull() & F.lit(keep_missing)) | (F.col(depth).isNotNull() & cond))


def covering(df: DataFrame, low: float, high: float, first: str = "first", last: str = "last") -> DataFrame:
    """Rows whose extent [first, last] meets [low, high]."""
    return df.where((F.col(first) <= high) & (F.col(last) >= low))


def labelled(df: DataFrame, column: str, *labels: str) -> DataFrame:
    """Rows by label without regard to case and outer blanks."""
    return df.where(F.lower(F.trim(column)).isin([x.strip().lower() for x in labels]))


def curve_candidates(curves: DataFrame, kind: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Curves an operator may take: any numeric kind but depth and time, or the allowed ones."""
    rows = curves.where(~F.col(kind).isin("depth", "time"))
    return rows.where(F.col(kind).isin(list(allowed))) if allowed else rows


# --- order, choice, sets


def preferred(df: DataFrame, keys: Keys, *order) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(_w(keys, *order))).where("__n = 1").drop("__n")


def natural_key(x: Column) -> Column:
    """A sort key by which numbers inside names sort by value."""
    padded = F.transform(F.regexp_extract_all(F.concat(x, F.lit(" ")), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))
    return F.rtrim(F.array_join(padded, ""))


def row_difference(old: DataFrame, new: DataFrame, keys: Keys, values: Sequence[str]) -> DataFrame:
    """Rows that differ between two revisions: keys, change ('added', 'removed', 'changed'); NULL equals NULL."""
    a = old.select(*keys, F.struct(*values).alias("__a"))
    b = new.select(*keys, F.struct(*values).alias("__b"))
    both = a.join(b, list(keys), "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return both.withColumn("change", change).where("change is not null").select(*keys, "change")


def apply_edits(df: DataFrame, keys: Keys, updates: DataFrame | None = None, deletes: DataFrame | None = None, adds: DataFrame | None = None) -> DataFrame:
    """Row edits by key: deletes, then updates (columns not NULL replace), then adds."""
    if deletes is not None:
        df = df.join(deletes.select(*keys), list(keys), "left_anti")
    if updates is not None:
        new = [c for c in updates.columns if c not in keys]
        joined = df.join(updates.select(*keys, *[F.col(c).alias(f"__{c}") for c in new]), list(keys), "left")
        df = joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in new else F.col(c) for c in df.columns])
    return df if adds is None else df.unionByName(adds, allowMissingColumns=True)
