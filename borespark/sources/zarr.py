"""Zarr (version 2) arrays of three axes as volumes: chunks are files, read in parallel by any store Spark reads.

Understood are C order, numbers, no filters, and no compressor, zlib, gzip or (where the library is there) zstd.
Chunks that are missing hold the fill value; their traces come without a row.  A trace of NaN alone is NULL.
"""

from __future__ import annotations

import gzip
import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Window = tuple[int, int]


def read_meta(spark: SparkSession, path: str) -> dict:
    """The array's description; what can't be read is an error."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/.zarray")  # a hidden file: Spark's readers skip it
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(target)
    try:
        meta = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    codec = (meta.get("compressor") or {}).get("id")
    if meta.get("zarr_format") != 2 or len(meta["shape"]) != 3 or meta.get("order", "C") != "C" or meta.get("filters"):
        raise ValueError("not a plain array of three axes")
    if codec not in (None, "zlib", "gzip", "zstd"):
        raise ValueError(f"chunks packed by {codec} can't be read")
    np.dtype(meta["dtype"])
    return meta


def estimate(meta: dict, il: Window | None = None, xl: Window | None = None, samples: Window | None = None) -> dict:
    """Traces, chunks and unpacked bytes that a window (half open) of the array has."""
    spans = [w or (0, n) for w, n in zip((il, xl, samples), meta["shape"], strict=True)]
    counts = [max(0, min(b, n) - max(a, 0)) for (a, b), n in zip(spans, meta["shape"], strict=True)]
    chunks = [len(_chunks(w, n, c)) for w, n, c in zip(spans, meta["shape"], meta["chunks"], strict=True)]
    return {"traces": counts[0] * counts[1], "chunks": int(np.prod(chunks)), "bytes": int(np.prod(counts)) * np.dtype(meta["dtype"]).itemsize}


def _chunks(window: Window | None, size: int, chunk: int) -> range:
    low, high = window or (0, size)
    return range(max(0, low) // chunk, -(-min(high, size) // chunk))


def _unpack(data: bytes, codec: str | None) -> bytes:
    if codec == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return {None: bytes, "zlib": zlib.decompress, "gzip": gzip.decompress}[codec](data)


def read_volume(spark: SparkSession, path: str, il: Window | None = None, xl: Window | None = None, samples: Window | None = None) -> DataFrame:
    """(il, xl, amplitude) of the array or of a window of it (half open), by position.

    A task holds one chunk; only the lines' chunks of the window are opened.  Where chunks cut the sample axis, the
    pieces of a trace are put together by a shuffle.
    """
    meta = read_meta(spark, path)
    shape, chunk, dtype, codec = meta["shape"], meta["chunks"], np.dtype(meta["dtype"]), (meta.get("compressor") or {}).get("id")
    sep = meta.get("dimension_separator", ".")
    spans = [w or (0, n) for w, n in zip((il, xl, samples), shape, strict=True)]
    lines = _chunks(il, shape[0], chunk[0])
    if not len(lines) or not all(len(_chunks(w, n, c)) for w, n, c in zip((il, xl, samples), shape, chunk, strict=True)):
        return spark.createDataFrame([], "il long, xl long, amplitude array<double>")
    names = "[0-9]*" if il is None else "{" + ",".join(str(k) for k in lines) + "}"
    files = spark.read.format("binaryFile").load(f"{path}/{names}{sep}[0-9]*{sep}[0-9]*").select("path", "content")
    whole = len(_chunks(samples, shape[2], chunk[2])) == 1
    wanted = [set(_chunks(w, n, c)) for w, n, c in zip((il, xl, samples), shape, chunk, strict=True)]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                at = [int(k) for k in re.findall(r"\d+", name)[-3:]]
                if any(k not in own for k, own in zip(at, wanted, strict=True)):
                    continue
                cube = np.frombuffer(_unpack(bytes(content), codec), dtype).reshape(chunk)
                first = [k * c for k, c in zip(at, chunk, strict=True)]
                part = [slice(max(0, a - f), max(0, min(b, n, f + c) - f)) for (a, b), f, c, n in zip(spans, first, chunk, shape, strict=True)]
                cube = cube[tuple(part)].astype(float)
                i, x = (m.ravel() for m in np.meshgrid(*[f + p.start + np.arange(k) for f, p, k in zip(first, part, cube.shape[:2], strict=False)], indexing="ij"))
                yield pd.DataFrame({"il": i, "xl": x, "piece": at[2], "amplitude": [None if whole and np.isnan(row).all() else row for row in cube.reshape(len(i), -1)]})

    rows = files.mapInPandas(run, "il long, xl long, piece int, amplitude array<double>")
    if whole:
        return rows.drop("piece")
    pieces = rows.groupBy("il", "xl").agg(F.sort_array(F.collect_list(F.struct("piece", "amplitude"))).alias("p"))  # of one trace
    return pieces.select("il", "xl", F.flatten(F.transform("p", lambda p: p["amplitude"])).alias("amplitude"))


#: Where a multidimensional store of the energy industry keeps its samples (fixed value).
MDIO_SAMPLES = "data/chunked_012"


def read_mdio(spark: SparkSession, path: str, il: Window | None = None, xl: Window | None = None, samples: Window | None = None, most_bytes: int | None = None) -> DataFrame:
    """The samples of a group store as ``read_volume``; with ``most_bytes`` a larger window is an error."""
    size = estimate(read_meta(spark, f"{path}/{MDIO_SAMPLES}"), il, xl, samples)["bytes"]
    if most_bytes is not None and size > most_bytes:
        raise ValueError(f"the window has {size} bytes, more than {most_bytes}")
    return read_volume(spark, f"{path}/{MDIO_SAMPLES}", il, xl, samples)


def write_volume(traces: DataFrame, path: str, shape: Sequence[int], chunks: Sequence[int] = (32, 32), dtype: str = "<f4", codec: str | None = "zlib") -> None:
    """Traces (il, xl from 0, amplitude) as an array of the shape, one chunk a task over the whole sample axis.

    The path must be mounted on all machines.  A chunk is renamed into place when it is whole; NULL traces hold
    the fill value NaN.
    """
    if codec not in (None, "zlib"):
        raise ValueError("chunks are written plain or by zlib")
    size = [int(chunks[0]), int(chunks[1]), int(shape[2])]
    meta = {"zarr_format": 2, "shape": [int(n) for n in shape], "chunks": size, "dtype": dtype, "compressor": {"id": "zlib", "level": 1} if codec else None, "fill_value": "NaN", "order": "C", "filters": None}
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/.zarray", "w") as f:
        json.dump(meta, f)
    rows = traces.select(F.col("il").cast("long").alias("il"), F.col("xl").cast("long").alias("xl"), F.col("amplitude").cast("array<double>").alias("amplitude")).where("amplitude is not null")
    rows = rows.withColumns({"ci": F.floor(F.col("il") / size[0]).cast("int"), "cx": F.floor(F.col("xl") / size[1]).cast("int")})

    def run(key, pdf):
        cube = np.full(size, np.nan, np.dtype(dtype))
        for i, x, a in zip(pdf["il"], pdf["xl"], pdf["amplitude"], strict=True):
            cube[i - key[0] * size[0], x - key[1] * size[1]] = a
        data = zlib.compress(cube.tobytes(), 1) if codec else cube.tobytes()
        name = f"{path}/{key[0]}.{key[1]}.0"
        draft = f"{path}/_{key[0]}.{key[1]}.{os.getpid()}"
        with open(draft, "wb") as f:
            f.write(data)
        os.replace(draft, name)
        return pd.DataFrame({"n": [len(pdf)]})

    rows.groupBy("ci", "cx").applyInPandas(run, "n long").agg(F.sum("n")).first()
