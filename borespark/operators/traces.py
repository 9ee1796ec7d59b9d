"""Trace operators: JVM-side array expressions and NumPy kernels fused into one Arrow pass.

A trace table has one row per trace with ``amplitude`` (an array) and position columns.  A pipeline is a
list of steps; consecutive steps run as one ``mapInArrow`` over blocks of equally long traces, so a trace
crosses to Python once however many steps there are.  A NULL amplitude is an unoccupied trace and stays.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RMS_FLOOR, MOST_GAIN = 1e-8, 1e6
SMALL = 1e-8
_DOUBLES = "array<double>"


def as_doubles(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(_DOUBLES)


# --- JVM-side


def scale(trace: Column, factor: float) -> Column:
    if not 0.0 <= factor <= 10.0:
        raise ValueError("the factor is in [0, 10]")
    return F.transform(as_doubles(trace), lambda x: x * factor)


def energy(trace: Column) -> Column:
    return F.aggregate(as_doubles(trace), F.lit(0.0), lambda s, x: s + x * x)


def rms_normalise(trace: Column) -> Column:
    rms = F.sqrt(energy(trace) / F.greatest(F.size(trace), F.lit(1)))
    gain = F.least(F.lit(MOST_GAIN), 1.0 / F.greatest(rms, F.lit(RMS_FLOOR)))
    return F.transform(as_doubles(trace), lambda x: x * gain)


def combine(left: Column, right: Column, how: str) -> Column:
    """Arithmetic of two volumes' traces; without a right trace add and subtract keep the left, others give 0."""
    a, b = as_doubles(left), as_doubles(right)
    both = {
        "add": lambda x, y: x + y,
        "subtract": lambda x, y: x - y,
        "multiply": lambda x, y: x * y,
        "divide": lambda x, y: F.when(F.abs(y) <= SMALL, 0.0).otherwise(x / y),
    }[how]
    alone = a if how in ("add", "subtract") else F.transform(a, lambda _: F.lit(0.0))
    return F.when(b.isNull(), alone).otherwise(F.zip_with(a, b, both))


def volume_arithmetic(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Every left trace with the right one at the same position."""
    r = right.select(*keys, F.col("amplitude").alias("__right"))
    return left.join(r, list(keys), "left").withColumn("amplitude", combine(F.col("amplitude"), F.col("__right"), how)).drop("__right")


def crop_samples(trace: Column, first: int, count: int) -> Column:
    return F.slice(trace, first + 1, count)


def thin(trace: Column, level: int) -> Column:
    """Every 2**level-th sample."""
    step = 1 << level
    return F.filter(trace, lambda _, i: i % step == 0)


def section(df: DataFrame, axis: str, index: int) -> DataFrame:
    return df.where(F.col(axis) == index)


def section_tile(df: DataFrame, axis: str, index: int, across: str, traces: tuple[int, int], samples: tuple[int, int], level: int = 0) -> DataFrame:
    """A window of a section at a level of detail: half-open ranges, stride 2**level both ways."""
    rows = section(df, axis, index).where((F.col(across) >= traces[0]) & (F.col(across) < traces[1]) & ((F.col(across) - traces[0]) % (1 << level) == 0))
    return rows.withColumn("amplitude", thin(crop_samples(F.col("amplitude"), samples[0], samples[1] - samples[0]), level))


def subvolume(df: DataFrame, il: tuple[int, int], xl: tuple[int, int], samples: tuple[int, int], check: bool = True) -> DataFrame:
    """Inclusive ranges of both lines and of samples.

    With ``check`` the ends must be lines, crosslines and samples that the volume has, and the window must not be the
    whole volume: one aggregate over the headers, whose violation fails the query.
    """
    if any(a > b for a, b in (il, xl, samples)) or samples[0] < 0:
        raise ValueError("a window's ends are in order")
    if check:
        found = [F.max((F.col(axis) == end).cast("int")).alias(f"__{axis}{k}") for axis, ends in (("il", il), ("xl", xl)) for k, end in enumerate(ends)]
        a = df.agg(*found, F.max(F.size("amplitude")).alias("__n"), *[f(axis).alias(f"__{name}_{axis}") for name, f in (("low", F.min), ("high", F.max)) for axis in ("il", "xl")])
        there = (F.col("__il0") + F.col("__il1") + F.col("__xl0") + F.col("__xl1") == 4) & (F.col("__n") > samples[1])
        whole = (F.col("__low_il") == il[0]) & (F.col("__high_il") == il[1]) & (F.col("__low_xl") == xl[0]) & (F.col("__high_xl") == xl[1]) & F.lit(samples[0] == 0) & (F.col("__n") == samples[1] + 1)
        sound = F.when(there & ~whole, True).otherwise(F.raise_error(F.lit("the window's ends are on the axes and it is a strict part of the volume")).cast("boolean"))
        df = df.crossJoin(F.broadcast(a.select(sound.alias("__sound")))).where("__sound").drop("__sound")  # one row
    rows = df.where(F.col("il").between(*il) & F.col("xl").between(*xl))
    return rows.withColumn("amplitude", crop_samples(F.col("amplitude"), samples[0], samples[1] - samples[0] + 1))


def section_statistics(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """count, least, greatest, mean, mean of absolute values and RMS of the amplitudes, in one pass over arrays."""
    x = as_doubles("amplitude")
    per = df.select(*keys, F.size(x).alias("n"), F.array_min(x).alias("lo"), F.array_max(x).alias("hi"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("s"), F.aggregate(x, F.lit(0.0), lambda s, v: s + F.abs(v)).alias("a"), energy(x).alias("e")).where("n > 0")
    out = per.groupBy(*keys).agg(F.sum("n").alias("count"), F.min("lo").alias("least"), F.max("hi").alias("greatest"), F.sum("s").alias("s"), F.sum("a").alias("a"), F.sum("e").alias("e"))
    return out.select(*keys, "count", "least", "greatest", (F.col("s") / F.col("count")).alias("mean"), (F.col("a") / F.col("count")).alias("mean_abs"), F.sqrt(F.col("e") / F.col("count")).alias("rms"))


# --- NumPy kernels: [traces, samples] float64 -> the same shape


def _hilbert(x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    spectrum = np.fft.rfft(x, axis=1) * -1j
    spectrum[:, 0] = 0
    if n % 2 == 0:
        spectrum[:, -1] = 0
    return np.fft.irfft(spectrum, n, axis=1)


def _slope(x: np.ndarray, dt: float) -> np.ndarray:
    out = np.zeros_like(x)
    if x.shape[1] > 1:
        out[:, 1:-1] = (x[:, 2:] - x[:, :-2]) / (2 * dt)
        out[:, 0], out[:, -1] = (x[:, 1] - x[:, 0]) / dt, (x[:, -1] - x[:, -2]) / dt
    return out


def _frequency(x: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    h = _hilbert(x)
    return (x * _slope(h, dt) - _slope(x, dt) * h) / (x * x + h * h + SMALL) / (2 * np.pi), h


def _ramp(f: np.ndarray, outer: float, inner: float) -> np.ndarray:
    """0 at the outer corner to 1 at the inner one along half a cosine; a step where they coincide."""
    if outer == inner:
        return (f == inner).astype(float)
    return 0.5 * (1 - np.cos(np.pi * np.clip((f - outer) / (inner - outer), 0, 1)))


def response(f: np.ndarray, f1: float | None, f2: float | None, f3: float | None, f4: float | None) -> np.ndarray:
    """Gain of the trapezoid with cosine tapers; open to one side where its corners are None."""
    gain = np.ones_like(f)
    if f1 is not None:
        gain = np.where(f <= f1, 0.0, np.where(f >= f2, 1.0, _ramp(f, f1, f2)))
    if f4 is not None:
        gain = np.where(f <= f3, gain, np.where(f >= f4, 0.0, _ramp(f, f4, f3)))
        if f1 is not None:
            gain = np.where(f >= f4, 0.0, gain)
    return gain


def _filter(x: np.ndarray, dt: float, corners) -> np.ndarray:
    """The mean is taken out first."""
    n = x.shape[1]
    spectrum = np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)
    return np.fft.irfft(spectrum * response(np.fft.rfftfreq(n, dt), *corners), n, axis=1)


def _agc(x: np.ndarray, dt: float, window_ms: float) -> np.ndarray:
    n = x.shape[1]
    half = max(1, int(window_ms / (dt * 1000) + 0.5)) // 2
    total = np.concatenate([np.zeros((len(x), 1)), np.cumsum(x * x, axis=1)], axis=1)
    lo, hi = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    rms = np.sqrt(np.maximum(total[:, hi] - total[:, lo], 0) / (hi - lo))
    return x * np.minimum(1 / np.maximum(rms, RMS_FLOOR), MOST_GAIN)


def _rotate(x: np.ndarray, degrees: float) -> np.ndarray:
    n, a = x.shape[1], np.radians(degrees)
    spectrum = np.fft.rfft(x, axis=1)
    turned = spectrum * np.exp(1j * a)
    turned[:, 0] = spectrum[:, 0].real * np.cos(a)
    if n % 2 == 0:
        turned[:, -1] = spectrum[:, -1].real * np.cos(a)
    return np.fft.irfft(turned, n, axis=1)


def _normalise(x: np.ndarray) -> np.ndarray:
    rms = np.sqrt((x * x).mean(axis=1, keepdims=True))
    return x * np.minimum(1 / np.maximum(rms, RMS_FLOOR), MOST_GAIN)


def _sweet(x: np.ndarray, dt: float) -> np.ndarray:
    f, h = _frequency(x, dt)
    return np.hypot(x, h) / np.sqrt(np.maximum(f, 1.0))


@dataclass(frozen=True)
class Step:
    """One trace-local operation by name with its parameters; sample intervals are in ms."""

    name: str
    parameters: dict = field(default_factory=dict)

    def kernel(self, dt: float) -> Callable[[np.ndarray], np.ndarray]:
        p = self.parameters
        return {
            "scale": lambda x: x * p["factor"],
            "rms_normalise": _normalise,
            "agc": lambda x: _agc(x, dt, p["window_ms"]),
            "phase_rotation": lambda x: _rotate(x, p["degrees"]),
            "envelope": lambda x: np.hypot(x, _hilbert(x)),
            "instantaneous_phase": lambda x: (np.degrees(np.arctan2(_hilbert(x), x)) + 180) % 360 - 180,
            "instantaneous_frequency": lambda x: _frequency(x, dt)[0],
            "sweetness": lambda x: _sweet(x, dt),
            "lowpass": lambda x: _filter(x, dt, (None, None, p["f3"], p["f4"])),
            "highpass": lambda x: _filter(x, dt, (p["f1"], p["f2"], None, None)),
            "bandpass": lambda x: _filter(x, dt, (p["f1"], p["f2"], p["f3"], p["f4"])),
        }[self.name]

    def check(self, dt: float) -> None:
        p = self.parameters
        if self.name == "agc" and not 0 < p["window_ms"] <= 10_000:
            raise ValueError("the AGC window is in (0, 10000] ms")
        if self.name == "phase_rotation" and abs(p["degrees"]) > 180:
            raise ValueError("the rotation is in [-180, 180] degrees")
        if self.name == "scale" and not 0 <= p["factor"] <= 10:
            raise ValueError("the factor is in [0, 10]")
        corners = [p[k] for k in ("f1", "f2", "f3", "f4") if k in p]
        if corners and (corners != sorted(corners) or corners[0] < 0 or corners[-1] > 0.5 / dt):
            raise ValueError("filter corners rise from 0 to the Nyquist frequency at most")


def save_presets(path: str, presets: Mapping[str, Sequence[Step]]) -> None:
    """Named pipelines as a JSON file."""
    Path(path).write_text(json.dumps({name: [{"name": s.name, "parameters": s.parameters} for s in steps] for name, steps in presets.items()}, indent=1, sort_keys=True))


def load_presets(path: str, interval_ms: float) -> dict[str, list[Step]]:
    """The pipelines of a file; steps that don't fit the sample interval are errors."""
    out = {name: [Step(s["name"], s.get("parameters", {})) for s in steps] for name, steps in json.loads(Path(path).read_text()).items()}
    for steps in out.values():
        for step in steps:
            step.kernel(interval_ms / 1000.0)
            step.check(interval_ms / 1000.0)
    return out


def run_pipeline(df: DataFrame, steps: Sequence[Step], interval_ms: float, column: str = "amplitude") -> DataFrame:
    """df with the steps applied to its traces in the given order, fused into one Arrow pass."""
    if interval_ms <= 0:
        raise ValueError("the sample interval must be positive")
    dt = interval_ms / 1000.0
    for step in steps:
        step.check(dt)
    kernels = [step.kernel(dt) for step in steps]

    def work(x: np.ndarray) -> np.ndarray:
        for kernel in kernels:
            x = kernel(x)
        return x

    return map_traces(df, work, column)


def blocks(batch: pa.RecordBatch, column: str):
    """The traces of a batch by length: row numbers, samples [rows, length], and where these lie in the values."""
    traces = batch.column(batch.schema.get_field_index(column))
    lists = pa.ListArray.from_arrays(traces.offsets, traces.values) if traces.offset == 0 else traces
    offsets = lists.offsets.to_numpy()
    values = np.array(lists.values.to_numpy(zero_copy_only=False), float)
    lengths = np.diff(offsets) if not traces.null_count else np.where(traces.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
    for n in np.unique(lengths[lengths > 0]):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def _numbers(batch: pa.RecordBatch, names: Sequence[str], rows: np.ndarray) -> list[np.ndarray]:
    """Columns of the given rows as floats; NaN where missing."""
    return [batch.column(batch.schema.get_field_index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False)[rows] for c in names]


_PLAIN = (T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def plain(df: DataFrame, column: str) -> DataFrame:
    """df whose traces NumPy takes as they are: plain numbers stay, as casting arrays in the JVM boxes every sample."""
    return df if isinstance(df.schema[column].dataType.elementType, _PLAIN) else df.withColumn(column, as_doubles(column))


def map_traces(df: DataFrame, work: Callable[..., np.ndarray], column: str, by: Sequence[str] = ()) -> DataFrame:
    """A kernel over the traces of each batch, grouped by length; NULL and empty traces pass.

    ``work`` gets the samples [rows, length] as doubles and a float array per column of ``by``; its result may have
    another length.  The column holds doubles afterwards.
    """
    df = plain(df, column)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType())) if f.name == column else f for f in df.schema])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(column)
            kept = batch.column(at).is_valid().to_numpy(zero_copy_only=False)
            lengths, parts = np.zeros(batch.num_rows, np.int64), []
            for rows, x in blocks(batch, column):
                y = work(x, *_numbers(batch, by, rows))
                lengths[rows] = y.shape[1]
                parts.append((rows, y))
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            values = np.empty(offsets[-1])
            for rows, y in parts:
                values[offsets[rows][:, None] + np.arange(y.shape[1])] = y
            out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=pa.array(~kept))
            yield pa.RecordBatch.from_arrays([out if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)


#: Bytes of sums that a task holds before it hands them on.
SUM_BYTES = 64 << 20


def sum_traces(df: DataFrame, keys: Sequence[str], column: str = "amplitude", by: Sequence[str] = (), work: Callable[..., np.ndarray] | None = None) -> DataFrame:
    """(keys, __label, __t, __s, __e, __n): sums, sums of squares and numbers of the traces of a key, sample by sample.

    ``work`` makes [labels, rows, length] of samples [rows, length] and a float array per column of ``by``; the
    default has the traces as they are, as label 0.  Each task adds up whole arrays before anything moves, so
    the shuffle carries a few sums per task, key and label, never a row per trace and sample.
    """
    work = work or (lambda x: x[None])
    keyed = plain(df.select(*keys, *[c for c in by if c not in keys], column), column)

    def run(batches):
        held: dict[tuple, list] = {}
        size = 0

        def rows():
            for key, (s, e, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(s), keyed_types[i]) for i, v in enumerate(key[:-1])]
                    + [pa.array(np.arange(len(s), dtype=np.int32)), *[pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1]), pa.array(v.ravel())) for v in (s, e)], pa.array(np.full(len(s), n))],
                    [*keys, "__label", "__s", "__e", "__n"],
                )

        for batch in batches:
            names = [batch.column(i).to_pylist() for i in range(len(keys))]
            keyed_types = [batch.schema.field(i).type for i in range(len(keys))]
            for at, x in blocks(batch, column):
                groups: dict[tuple, list[int]] = {}
                for k, r in enumerate(at):
                    groups.setdefault(tuple(c[r] for c in names), []).append(k)
                extra = _numbers(batch, by, at)
                for key, own in groups.items():
                    y = work(x[own], *[v[own] for v in extra])
                    s, e = y.sum(axis=1), (y * y).sum(axis=1)
                    place = (*key, x.shape[1])
                    if place in held:
                        old = held[place]
                        old[0], old[1], old[2] = old[0] + s, old[1] + e, old[2] + len(own)
                    else:
                        held[place] = [s, e, len(own)]
                        size += s.nbytes + e.nbytes
                    if size > SUM_BYTES:
                        yield from rows()
                        held.clear()
                        size = 0
        yield from rows()

    names = ", ".join(f"`{k}` {keyed.schema[k].dataType.simpleString()}" for k in keys)
    sums = keyed.mapInArrow(run, f"{names}{', ' if names else ''}__label int, __s array<double>, __e array<double>, __n long")
    cells = sums.select(*keys, "__label", "__n", F.posexplode(F.arrays_zip("__s", "__e")).alias("__t", "__v"))
    return cells.groupBy(*keys, "__label", "__t").agg(F.sum("__v.__s").alias("__s"), F.sum("__v.__e").alias("__e"), F.sum("__n").alias("__n"))


def amplitude_spectrum(df: DataFrame, interval_ms: float, keys: Sequence[str] = ()) -> DataFrame:
    """Mean single-sided amplitude spectrum per key: bin, frequency, amplitude, traces.

    The mean of each trace is taken out and inner bins count twice.  Each task adds up its traces per key
    and length before anything moves, so the shuffle carries one spectrum per task and key.
    """
    x = df.where(F.col("amplitude").isNotNull() & (F.size("amplitude") > 0)).select(*keys, "amplitude")

    def spectra(v: np.ndarray) -> np.ndarray:
        n = v.shape[1]
        a = np.abs(np.fft.rfft(v - v.mean(axis=1, keepdims=True), axis=1)) / n
        a[:, 1:-1] *= 2
        full = np.zeros_like(v)
        full[:, : a.shape[1]] = a
        return full

    bins = map_traces(x, spectra, "amplitude").select(*keys, F.size("amplitude").alias("samples"), F.posexplode(F.slice("amplitude", F.lit(1), (F.floor(F.size("amplitude") / 2) + 1).cast("int"))).alias("bin", "a"))
    out = bins.groupBy(*keys, "samples", "bin").agg(F.avg("a").alias("spectrum"), F.count("*").alias("traces"))
    return out.select(*keys, F.col("bin").cast("long").alias("bin"), (F.col("bin") * 1000.0 / (F.col("samples") * interval_ms)).alias("frequency"), "spectrum", "traces")


def agc_expression(trace: Column, interval_ms: float, window_ms: float) -> Column:
    """AGC as a JVM-side array expression, for short windows: each gain sums its own window."""
    half = max(1, int(window_ms / interval_ms + 0.5)) // 2
    x = as_doubles(trace)

    def gain(v, i):
        part = F.slice(x, F.greatest(i - half, F.lit(0)) + 1, F.least(i + half + 1, F.size(x)) - F.greatest(i - half, F.lit(0)))
        rms = F.sqrt(F.aggregate(part, F.lit(0.0), lambda s, y: s + y * y) / F.size(part))
        return v * F.least(F.lit(MOST_GAIN), 1.0 / F.greatest(rms, F.lit(RMS_FLOOR)))

    return F.transform(x, gain)
