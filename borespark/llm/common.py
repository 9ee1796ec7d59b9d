"""Shared pieces: written intermediate tables, column guards, Arrow mapping."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from borespark.llm.kernels import SLICE_BYTES, slices

#: Columns of the documents table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("borespark.scratch", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="borespark-")
        spark.conf.set("borespark.scratch", folder)
    return folder.rstrip("/")


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.count, self.paths = 0, []

    def keep(self, df: DataFrame, name: str, **options) -> DataFrame:
        """df as written and read again.  The write's own shuffle files go with it: nothing reads them any more."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        with _setting(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            df.write.options(**{"compression": "zstd"} | options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def keep_only(self, df: DataFrame, name: str, **options) -> DataFrame:
        """As ``keep`` for an operator's result, which alone stays: the tables that it was made of are removed."""
        out = self.keep(df, name, **options)
        for path in self.paths[:-1]:
            self._remove(path)
        del self.paths[:-1]
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table of ``keep`` that no later plan reads."""
        path = getattr(df, "_scratch_path", None)
        if path in self.paths:
            self.paths.remove(path)
            self._remove(path)

    def _remove(self, path: str) -> None:
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        with contextlib.suppress(Exception):  # space is freed with the folder otherwise
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def map_slices(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch] | None], schema: T.StructType | str, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over parts of at most ``limit`` bytes of text; ``function`` returns a batch or None."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, column, limit):
                out = function(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def map_counts(df: DataFrame, function: Callable[[pa.RecordBatch], np.ndarray], names: list[str], column: str = "text") -> DataFrame:
    """Adds up, in each task, the integer rows [len(names), cells] of its slices; (cell, names...) where not all 0."""

    def run(batches):
        total = None
        for batch in batches:
            for part in slices(batch, column):
                own = function(part)
                total = own if total is None else total + own
        if total is not None:
            at = np.flatnonzero(total.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))] + [pa.array(row[at].astype(np.int64)) for row in total], ["cell", *names])

    return df.mapInArrow(run, "cell long, " + ", ".join(f"{x} long" for x in names))


def word_count(text: Column) -> Column:
    """The number of words of a text, JVM-side; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_part(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % modulus
