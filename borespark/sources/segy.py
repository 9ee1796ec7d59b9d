"""SEG-Y files: inspection, headers, traces in ranges, decoding, ingest, export.

Trace ranges are rows of a small table; each task reads its own byte ranges, so a file is read in parallel
and never whole.  Paths of ``read_traces`` and ``export_traces`` must be readable by the executors (a mounted
store); ``read_stored`` takes whole files from any store that Spark reads, one task a file.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sample formats: code -> (bytes, NumPy kind or decoder name) (fixed values).
FORMATS = {1: (4, "ibm"), 2: (4, "i4"), 3: (2, "i2"), 4: (4, "fixed"), 5: (4, "f4"), 6: (8, "f8"), 7: (3, "i3"), 8: (1, "i1"), 9: (8, "i8"), 10: (4, "u4"), 11: (2, "u2"), 12: (8, "u8"), 15: (3, "u3"), 16: (1, "u1")}
#: Trace header fields of revision 1: first byte (from 1) and size (fixed values of the public standard).
FIELDS = {
    "trace_seq": (1, 4), "trace_seq_file": (5, 4), "field_record": (9, 4), "channel": (13, 4), "source_point": (17, 4), "cdp": (21, 4), "cdp_trace": (25, 4),
    "trace_id": (29, 2), "vertical_sum": (31, 2), "horizontal_sum": (33, 2), "data_use": (35, 2), "offset": (37, 4),
    "receiver_elevation": (41, 4), "source_elevation": (45, 4), "source_depth": (49, 4), "receiver_datum": (53, 4), "source_datum": (57, 4), "source_water": (61, 4), "receiver_water": (65, 4),
    "elevation_scalar": (69, 2), "scalar": (71, 2), "source_x": (73, 4), "source_y": (77, 4), "receiver_x": (81, 4), "receiver_y": (85, 4), "coordinate_units": (89, 2),
    "weathering_velocity": (91, 2), "subweathering_velocity": (93, 2), "source_uphole": (95, 2), "receiver_uphole": (97, 2), "source_static": (99, 2), "receiver_static": (101, 2), "total_static": (103, 2),
    "lag_a": (105, 2), "lag_b": (107, 2), "delay": (109, 2), "mute_start": (111, 2), "mute_end": (113, 2), "samples": (115, 2), "interval_us": (117, 2),
    "gain_type": (119, 2), "gain_constant": (121, 2), "initial_gain": (123, 2), "correlated": (125, 2),
    "sweep_start": (127, 2), "sweep_end": (129, 2), "sweep_length": (131, 2), "sweep_type": (133, 2), "taper_start": (135, 2), "taper_end": (137, 2), "taper_type": (139, 2),
    "alias_frequency": (141, 2), "alias_slope": (143, 2), "notch_frequency": (145, 2), "notch_slope": (147, 2), "low_cut": (149, 2), "high_cut": (151, 2), "low_cut_slope": (153, 2), "high_cut_slope": (155, 2),
    "year": (157, 2), "day": (159, 2), "hour": (161, 2), "minute": (163, 2), "second": (165, 2), "time_basis": (167, 2), "weighting": (169, 2),
    "roll_group": (171, 2), "first_group": (173, 2), "last_group": (175, 2), "gap": (177, 2), "overtravel": (179, 2),
    "cdp_x": (181, 4), "cdp_y": (185, 4), "inline": (189, 4), "crossline": (193, 4), "shotpoint": (197, 4), "shotpoint_scalar": (201, 2),
    "measurement_unit": (203, 2), "transduction_mantissa": (205, 4), "transduction_exponent": (209, 2), "transduction_unit": (211, 2), "device": (213, 2), "time_scalar": (215, 2),
    "source_type": (217, 2), "source_mantissa": (225, 4), "source_exponent": (229, 2), "source_unit": (231, 2),
}
HEAD, TRACE_HEAD = 3600, 240


@dataclass(frozen=True)
class Layout:
    """What the binary header says, and what follows for the file."""

    big_endian: bool
    format: int
    samples: int
    interval_us: int
    revision: int
    extended: int
    traces: int
    textual: str
    warnings: tuple[str, ...] = ()
    head: bytes = b""

    @property
    def sample_bytes(self) -> int:
        return FORMATS[self.format][0]

    @property
    def record(self) -> int:
        return TRACE_HEAD + self.samples * self.sample_bytes

    @property
    def first(self) -> int:
        return HEAD + 3200 * self.extended

    def offset(self, trace: int) -> int:
        return self.first + trace * self.record


def inspect(path: str) -> Layout:
    """Layout of a file, with its textual, binary and extended headers as ``head``."""
    with open(path, "rb") as f:
        layout = layout_of(f.read(HEAD), os.path.getsize(path))
        f.seek(0)
        return replace(layout, head=f.read(layout.first))


def layout_of(head: bytes, size: int) -> Layout:
    """Layout by the first 3600 bytes; the byte order is the one under which more header values make sense."""
    if len(head) < HEAD:
        raise ValueError("shorter than its headers")

    def read(order: str) -> tuple[int, ...]:
        at = 3200
        get = lambda o, k: struct.unpack_from(order + k, head, at + o)[0]
        return get(16, "H"), get(20, "H"), get(24, "h"), get(300, "H"), get(304, "h")

    def score(v) -> int:
        interval, samples, code, _, extended = v
        rest = size - HEAD - 3200 * max(extended, 0)
        fits = code in FORMATS and samples > 0 and rest % (TRACE_HEAD + samples * FORMATS[code][0]) == 0
        return 4 * (code in FORMATS) + 2 * (0 < samples <= 50_000) + (0 < interval <= 50_000) + 4 * fits

    big, little = read(">"), read("<")
    order = score(big) >= score(little)
    interval, samples, code, revision, extended = big if order else little
    if code not in FORMATS or samples == 0:
        raise ValueError(f"format code {code} with {samples} samples isn't readable")
    extended = max(0, extended)
    ebcdic = head[:3200]
    textual = ebcdic.decode("cp500") if ebcdic[:1] != b"C" else ebcdic.decode("latin-1")
    rest, record = size - HEAD - 3200 * extended, TRACE_HEAD + samples * FORMATS[code][0]
    notes = () if rest % record == 0 else (f"{rest % record} bytes after the last whole trace",)
    return Layout(order, code, samples, interval, revision >> 8 if revision > 255 else revision, extended, rest // record, textual, notes)


def ibm_to_float(words: np.ndarray) -> np.ndarray:
    """IBM System/360 single precision (uint32) as float64."""
    sign = np.where(words >> 31, -1.0, 1.0)
    power = ((words >> 24) & 0x7F).astype(np.int64) - 64
    return sign * (words & 0xFFFFFF) / float(1 << 24) * np.power(16.0, power)


def float_to_ibm(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    mantissa, power = np.frexp(np.abs(x))
    exponent = -(-power // 4)
    fraction = np.round(mantissa * 2.0 ** (power - 4 * exponent) * (1 << 24)).astype(np.int64)
    over = fraction >= 1 << 24
    fraction, exponent = np.where(over, fraction >> 4, fraction), exponent + over
    word = (np.signbit(x).astype(np.int64) << 31) | ((exponent + 64) << 24) | fraction
    return np.where(x == 0, 0, word).astype(np.uint32)


def decode_samples(data: np.ndarray, code: int, big_endian: bool) -> np.ndarray:
    """[traces, bytes] uint8 -> [traces, samples] float64."""
    size, kind = FORMATS[code]
    n = data.shape[1] // size
    order = ">" if big_endian else "<"
    if kind in ("i3", "u3"):
        b = data.reshape(-1, n, 3).astype(np.int64)
        b = b if big_endian else b[:, :, ::-1]
        v = (b[:, :, 0] << 16) | (b[:, :, 1] << 8) | b[:, :, 2]
        return np.where((kind == "i3") & (v >= 1 << 23), v - (1 << 24), v).astype(float)
    if kind == "fixed":  # gain in the second byte, value in the last two
        b = data.reshape(-1, n, 4)
        b = b if big_endian else b[:, :, ::-1]
        value = (b[:, :, 2].astype(np.int16) << 8 | b[:, :, 3]).astype(np.int16)
        return value.astype(float) * 2.0 ** b[:, :, 1].astype(float)
    raw = np.ascontiguousarray(data).view(f"{order}{'u4' if kind == 'ibm' else kind}").reshape(len(data), n)
    return ibm_to_float(raw.astype(np.uint32)) if kind == "ibm" else raw.astype(float)


def _ranges(spark: SparkSession, path: str, traces: int, chunk: int) -> DataFrame:
    count = -(-traces // chunk)
    return spark.range(count).repartition(max(1, min(count, 4 * spark.sparkContext.defaultParallelism))).select((F.col("id") * chunk).alias("start"), F.least(F.lit(chunk), traces - F.col("id") * chunk).alias("n"), F.lit(path).alias("path"))


def _places(fields: Sequence[str] | Mapping[str, tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """Fields by name, or by (first byte, size) where a file has them elsewhere."""
    return dict(fields) if isinstance(fields, Mapping) else {f: FIELDS[f] for f in fields}


def _frame(block: np.ndarray, start: int, layout: Layout, places: Mapping[str, tuple[int, int]], samples: bool, raw: bool) -> pd.DataFrame:
    """Rows of the records [traces, bytes]."""
    order = ">" if layout.big_endian else "<"
    out = {"trace": np.arange(start, start + len(block))}
    for field, (byte, size) in places.items():
        out[field] = np.ascontiguousarray(block[:, byte - 1 : byte - 1 + size]).view(f"{order}i{size}").ravel().astype(np.int32)
    if raw:
        out["header"] = [row.tobytes() for row in block[:, :TRACE_HEAD]]
    if samples:
        out["amplitude"] = list(decode_samples(block[:, TRACE_HEAD:], layout.format, layout.big_endian))
    return pd.DataFrame(out)


def _schema(places: Mapping, samples: bool, raw: bool) -> str:
    return "trace long" + "".join(f", `{f}` int" for f in places) + (", header binary" if raw else "") + (", amplitude array<double>" if samples else "")


def read_traces(spark: SparkSession, path: str, fields: Sequence[str] | Mapping[str, tuple[int, int]] = ("inline", "crossline", "offset"), chunk: int = 512, samples: bool = True, raw: bool = False) -> DataFrame:
    """(trace, fields..., amplitude) of a file, by ranges of ``chunk`` traces; without ``samples`` headers only.

    ``raw`` adds the 240 header bytes as they are, which ``export_traces`` writes back.
    """
    layout, places = inspect(path), _places(fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for start, n, name in pdf.itertuples(index=False):
                with open(name, "rb") as f:
                    f.seek(layout.offset(int(start)))
                    block = np.frombuffer(f.read(int(n) * layout.record), np.uint8).reshape(int(n), layout.record)
                yield _frame(block, int(start), layout, places, samples, raw)

    return _ranges(spark, path, layout.traces, chunk).mapInPandas(run, _schema(places, samples, raw))


def read_stored(spark: SparkSession, path: str, fields: Sequence[str] | Mapping[str, tuple[int, int]] = ("inline", "crossline", "offset"), chunk: int = 512, samples: bool = True, raw: bool = False) -> DataFrame:
    """(file, trace, fields..., amplitude) of all files under a path of any store; a file is held by one task (2 GB at most)."""
    places = _places(fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                layout, data = layout_of(bytes(content[:HEAD]), len(content)), np.frombuffer(content, np.uint8)
                for start in range(0, layout.traces, chunk):
                    n = min(chunk, layout.traces - start)
                    block = data[layout.offset(start) : layout.offset(start + n)].reshape(n, layout.record)
                    rows = _frame(block, start, layout, places, samples, raw)
                    rows.insert(0, "file", name)
                    yield rows

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "file string, " + _schema(places, samples, raw))


def preflight(headers: DataFrame) -> DataFrame:
    """Geometry of the headers and what an import should do with it."""
    from borespark.operators.grid import geometry

    g = geometry(headers, "inline", "crossline")
    action = F.when(F.col("kind") == "regular_dense", "import").when(F.col("kind") == "regular_sparse", "regularise").otherwise("review")
    return g.withColumn("action", action)


def encode_samples(x: np.ndarray, code: int, big_endian: bool) -> np.ndarray:
    """[traces, samples] as bytes [traces, bytes]; integers are rounded."""
    order = ">" if big_endian else "<"
    kind = {1: "u4", 5: "f4", 2: "i4", 3: "i2", 6: "f8", 8: "i1"}[code]
    values = float_to_ibm(x) if code == 1 else x if code in (5, 6) else np.rint(x)
    return np.ascontiguousarray(values.astype(f"{order}{kind}")).view(np.uint8).reshape(len(x), -1)


def make_layout(traces: int, samples: int, interval_us: int, code: int = 5, big_endian: bool = True, text: str = "C 1 EXPORT") -> Layout:
    """The layout of a new file."""
    order, head = ">" if big_endian else "<", bytearray(HEAD)
    head[:3200] = text.ljust(3200).encode("cp500")
    for at, kind, value in ((16, "H", interval_us), (20, "H", samples), (24, "h", code), (300, "H", 0x0100), (302, "H", 1)):
        struct.pack_into(order + kind, head, 3200 + at, value)
    return Layout(big_endian, code, samples, interval_us, 1, 0, traces, text, (), bytes(head))


def pack_header(layout: Layout, fields: Mapping[str, int], base: bytes | None = None) -> bytes:
    """240 header bytes with the fields set, over ``base`` where given."""
    order, out = ">" if layout.big_endian else "<", bytearray(base or TRACE_HEAD)
    for name, value in {"samples": layout.samples, "interval_us": layout.interval_us, **fields}.items():
        byte, size = FIELDS[name]
        value = int(value) if size == 4 else (int(value) + (1 << 15)) % (1 << 16) - (1 << 15)
        struct.pack_into(order + ("i" if size == 4 else "h"), out, byte - 1, value)
    return bytes(out)


def export_traces(traces: DataFrame, path: str, layout: Layout, fields: Sequence[str] = ()) -> int:
    """Writes traces (trace, amplitude, header of ``read_traces`` if kept, columns of ``fields``) as one file.

    Every task writes its own byte ranges of the file, in any order; a task that runs again writes the same bytes to the
    same places.  ``trace`` numbers the traces from 0; each must occur once.  Headers kept at import are written
    back, with ``fields`` set anew.  The number of traces written is returned.
    """
    kept = ["header"] if "header" in traces.columns else []
    n, low, high = traces.agg(F.count("*"), F.min("trace"), F.max("trace")).first()
    if n != layout.traces or (n and (low, high) != (0, n - 1)):
        raise ValueError(f"the layout has {layout.traces} traces, the table {n} from {low} to {high}")
    with open(path, "wb") as f:
        f.write(layout.head)
        f.truncate(layout.offset(layout.traces))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            with open(path, "r+b") as f:
                for row in pdf.to_dict("records"):
                    x = np.asarray(row["amplitude"], float)
                    if len(x) != layout.samples:
                        raise ValueError(f"trace {row['trace']} has {len(x)} samples, not {layout.samples}")
                    f.seek(layout.offset(int(row["trace"])))
                    f.write(pack_header(layout, {c: row[c] for c in fields}, bytes(row["header"]) if kept else None))
                    f.write(encode_samples(x[None], layout.format, layout.big_endian).tobytes())
            yield pd.DataFrame({"n": [len(pdf)]})

    written = traces.select("trace", "amplitude", *kept, *fields).mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise ValueError(f"{written} of {n} traces were written")
    return written


def write_segy(traces: Sequence[np.ndarray], headers: pd.DataFrame, path: str, interval_us: int, code: int = 1, big_endian: bool = True) -> None:
    """A small file from memory: traces with header fields by name (``FIELDS``)."""
    layout = make_layout(len(traces), len(traces[0]), interval_us, code, big_endian)
    with open(path, "wb") as f:
        f.write(layout.head)
        for trace, row in zip(traces, headers.to_dict("records"), strict=True):
            f.write(pack_header(layout, row))
            f.write(encode_samples(np.asarray(trace, float)[None], code, big_endian).tobytes())


# --- ingest


def ingest_volume(spark: SparkSession, path: str, store: str, il: str = "inline", xl: str = "crossline", sparse: str = "regularise", tile: int = 64) -> dict:
    """A poststack file as a tiled volume (il, xl, amplitude, occupied); its geometry is returned.

    Several offsets at one position mean prestack data, which is refused here (``ingest_gathers``); other duplicate
    positions are refused for review.  A regular survey with missing traces becomes dense, or is refused
    (``sparse='refuse'``).
    """
    from borespark.operators import grid

    headers = read_traces(spark, path, (il, xl, "offset"), samples=False)
    g = grid.geometry(headers, il, xl).first().asDict()
    if g["duplicates"]:
        several = headers.groupBy(il, xl).agg(F.count_distinct("offset").alias("n")).where("n > 1")
        raise ValueError("prestack data: several offsets at a position" if not several.isEmpty() else "several traces at a position: review the header mapping")
    if g["missing"] and sparse != "regularise":
        raise ValueError(f"{g['missing']} positions have no trace")
    traces = read_traces(spark, path, (il, xl)).select(F.col(il).alias("il"), F.col(xl).alias("xl"), "amplitude")
    traces = grid.regularise(traces) if g["missing"] else traces.withColumn("occupied", F.lit(True))
    write_volume(traces, store, tile)
    return g


def ingest_gathers(spark: SparkSession, path: str, store: str, il: str = "inline", xl: str = "crossline", axis: str = "offset") -> dict:
    """A prestack file as a gather store (il, xl, offset, amplitude): the offsets must form a regular third axis."""
    from borespark.operators import grid

    headers = read_traces(spark, path, (il, xl, axis), samples=False)
    if headers.select(axis).distinct().count() < 2:
        raise ValueError("prestack ingest needs an offset axis")
    g = grid.geometry(headers, il, xl, third=axis).first().asDict()
    if g["kind"] != "regular_dense":
        raise ValueError(f"gathers must be regular and dense; these are {g['kind']}")
    traces = read_traces(spark, path, (il, xl, axis))
    write_gathers(traces.select(F.col(il).alias("il"), F.col(xl).alias("xl"), F.col(axis).alias("offset"), "amplitude"), store)
    return g


def ingest_velocity(spark: SparkSession, path: str, store: str, domain: str, unit: str, start: float, step: float, kind: str = "interval", **options) -> dict:
    """A file of velocities as a volume in m/s whose vertical axis is declared: domain 'time' (ms) or 'depth' (m)."""
    if domain not in ("time", "depth") or step <= 0 or kind not in ("interval", "rms", "average"):
        raise ValueError("a vertical axis is of time or depth with a positive step; velocities are interval, rms or average")
    factor = {"m/s": 1.0, "km/s": 1000.0, "ft/s": 0.3048}[unit.strip().lower()]
    g = ingest_volume(spark, path, f"{store}/samples", **options)
    rows = spark.read.parquet(f"{store}/samples").withColumn("velocity", F.transform("amplitude", lambda v: v * factor)).drop("amplitude", "tile_i", "tile_x")
    axis = {"domain": F.lit(domain), "start": F.lit(float(start)), "step": F.lit(float(step)), "kind": F.lit(kind)}
    rows.withColumns(axis).write.mode("overwrite").parquet(f"{store}/velocity")
    return g


def read_gathers(spark: SparkSession, path: str, il: tuple[int, int] | None = None, xl: tuple[int, int] | None = None) -> DataFrame:
    """Gathers of a store; inlines prune folders."""
    df = spark.read.parquet(path)
    for name, window in (("il", il), ("xl", xl)):
        if window is not None:
            df = df.where(F.col(name).between(*window))
    return df


def write_volume(traces: DataFrame, path: str, tile: int = 64) -> None:
    """Traces as Parquet in square tiles of lines, sorted inside, so that sections and windows prune files."""
    rows = traces.withColumns({"tile_i": F.floor(F.col("il") / tile).cast("int"), "tile_x": F.floor(F.col("xl") / tile).cast("int")})
    rows.repartition("tile_i", "tile_x").sortWithinPartitions("tile_i", "tile_x", "il", "xl").write.mode("overwrite").option("compression", "zstd").partitionBy("tile_i", "tile_x").parquet(path)


def read_volume(spark: SparkSession, path: str, il: tuple[int, int] | None = None, xl: tuple[int, int] | None = None, tile: int = 64) -> DataFrame:
    """A volume or a window of it; the tile columns prune whole folders."""
    df = spark.read.parquet(path)
    for name, part, window in (("il", "tile_i", il), ("xl", "tile_x", xl)):
        if window is not None:
            df = df.where(F.col(part).between(window[0] // tile, window[1] // tile) & F.col(name).between(*window))
    return df.drop("tile_i", "tile_x")


def transcode_volume(spark: SparkSession, path: str, out: str, codec: str = "lz4raw") -> None:
    """The same tiles and rows under another Parquet codec ('none', 'snappy', 'zstd', 'lz4raw'); nothing is lost either way."""
    rows = spark.read.parquet(path)
    rows.sortWithinPartitions("tile_i", "tile_x", "il", "xl").write.mode("overwrite").option("compression", {"lz4raw": "lz4_raw"}.get(codec, codec)).partitionBy("tile_i", "tile_x").parquet(out)


def write_gathers(traces: DataFrame, path: str) -> None:
    traces.repartition("il").sortWithinPartitions("il", "xl", "offset").write.mode("overwrite").partitionBy("il").parquet(path)


def sections_to_csv(section: DataFrame, path: str, across: str = "xl") -> None:
    """A section as text rows (position, sample, amplitude)."""
    section.select(across, F.posexplode("amplitude").alias("sample", "amplitude")).orderBy(across, "sample").write.mode("overwrite").option("header", True).csv(path)
