"""Well folders: what the files of a folder are, and their import; tops and deviation text with header lines."""

from __future__ import annotations

import contextlib
import os
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.sources import segy
from borespark.sources.tables import FAMILIES

#: Kinds by file name (fixed values); the first that matches counts.
KINDS = (("log", r"\.las$"), ("traces", r"\.(sgy|segy)$"), ("volume", r"\.(zarr|mdio)/?$"), ("vds", r"\.vds$"), ("trajectory", r"(deviation|trajectory|survey).*\.(txt|csv)$"), ("tops", r"(tops|markers|formation).*\.(txt|csv)$"), ("pressure", r"pressure.*\.csv$"), ("drilling", r"(drilling|events).*\.csv$"), ("checkshot", r"(checkshot|tdr).*\.(txt|csv)$"), ("horizon", r"\.(xyz|dat)$"))


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, kind, imported) of all files below a folder, by any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    kind = F.lit("other")
    for name, pattern in reversed(KINDS):
        kind = F.when(F.lower("path").rlike(pattern), name).otherwise(kind)
    return files.withColumn("kind", kind).withColumn("imported", ~F.col("kind").isin("other", "vds"))


def detect_format(path: str) -> str:
    """The kind of one path by its name, else by what a folder holds or how a file begins (paths of this machine)."""
    if os.path.isdir(path):
        inside = set(os.listdir(path))
        if inside & {".zarray", ".zgroup", ".zmetadata"}:
            return "volume"
    elif os.path.isfile(path) and not os.path.splitext(path)[1]:
        with open(path, "rb") as f:
            head = f.read(3600)
        if head.lstrip()[:1] == b"~":
            return "log"
        with contextlib.suppress(ValueError):
            segy.layout_of(head, os.path.getsize(path))
            return "traces"
    return next((name for name, pattern in KINDS if re.search(pattern, path.lower())), "other")


def read_tops_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, well, depth_reference, source, name, top_depth, base_depth, issue) of tab-separated tops with header lines.

    Header lines name the well, the reference point and the source; rows follow a line that begins with
    ``Top(m)``.  Rows of fewer than six fields are skipped; a missing name or top is an issue, the row stays.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))

    def head(prefix: str):
        found = F.get(F.filter("l", lambda x: F.trim(x).startswith(prefix)), F.lit(0))
        return F.nullif(F.trim(F.regexp_replace(F.trim(found), "^" + re.escape(prefix), "")), F.lit(""))

    # what is looked for in a file has a step of its own: beside the generator it would be looked for once per row;
    # explode_outer, as the filter that the planner derives from explode does all of it again
    start = F.array_position(F.transform("l", lambda x: F.trim(x).startswith("Top(m)").cast("string")), "true").cast("int")
    files = lines.select("file", head("Well Name:").alias("well"), head("Depth Ref Point:").alias("depth_reference"), head("Source:").alias("source"), "l", start.alias("start"))
    body = F.when(F.col("start") > 0, F.slice("l", F.col("start") + 1, F.size("l")))
    rows = files.select("file", "well", "depth_reference", "source", F.explode_outer(body).alias("x"))
    rows = rows.where(F.trim("x") != "").withColumn("c", F.split("x", "\t")).where(F.size("c") >= 6)

    def cell(i: int):
        return F.nullif(F.trim(F.get("c", F.lit(i))), F.lit(""))

    rows = rows.select("file", "well", "depth_reference", "source", cell(2).alias("name"), cell(0).try_cast("double").alias("top_depth"), cell(1).try_cast("double").alias("base_depth"))
    return rows.withColumn("issue", F.when(F.col("name").isNull(), "name is missing").when(F.col("top_depth").isNull(), "top is missing"))


def read_deviation_text(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, md, inclination, azimuth, tvd, x, y) of tab-separated surveys; rows follow a line that begins with ``Depth(m)``.

    Cells may be missing.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.split("value", r"\r?\n").alias("l"))
    start = F.array_position(F.transform("l", lambda x: F.trim(x).startswith("Depth(m)").cast("string")), "true").cast("int")
    rows = lines.select("file", F.posexplode(F.when(start > 0, F.slice("l", start + 1, F.size("l")))).alias("row", "x"))
    cells = F.transform(F.split("x", "\t"), lambda c: F.trim(c).try_cast("double"))
    names = ("md", "inclination", "azimuth", "tvd", "x", "y")
    return rows.where(F.trim("x") != "").withColumn("c", cells).select("file", "row", *[F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def usable_surveys(rows: DataFrame) -> DataFrame:
    """(file, usable, issue): a survey needs two values each of depth, inclination and azimuth, or of depth, tvd, x and y."""
    n = {c: F.count(c) for c in ("md", "inclination", "azimuth", "tvd", "x", "y")}
    usable = (F.least(n["md"], n["inclination"], n["azimuth"]) >= 2) | (F.least(n["md"], n["tvd"], n["x"], n["y"]) >= 2)
    return rows.groupBy("file").agg(usable.alias("usable")).withColumn("issue", F.when(~F.col("usable"), "survey columns are too incomplete"))


def commit_folder(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Imports a well folder: a table of Parquet per kind under ``out``; (kind, table, rows, issue) tells what became of it.

    Logs, tops and surveys as text, the families' CSV files, checkshots and horizons are read and written; traces are
    left to ``segy.ingest_volume``, other kinds are named as left out.  Files of one kind form one table with
    the column ``file``; a kind that can't be read is named with its error and doesn't stop the others.
    """
    from borespark.sources import logs, tables

    found: dict[str, list[str]] = {}
    for r in scan_folder(spark, path).select("kind", "path").toLocalIterator():  # a row per file of one well's folder
        text = r["kind"] in ("tops", "trajectory") and r["path"].lower().endswith(".txt")
        found.setdefault(r["kind"] + "_text" * text, []).append(r["path"])

    def table_of(kind: str, files: list[str]) -> DataFrame:
        if kind == "log":
            return logs.read_logs(spark, files)
        if kind == "tops_text":
            return read_tops_text(spark, files)
        if kind == "trajectory_text":
            rows = read_deviation_text(spark, files)
            return rows.join(usable_surveys(rows).where("usable").select("file"), "file")
        if kind in FAMILIES:
            parts = [tables.read_family(spark, f, kind).withColumn("file", F.lit(f)) for f in files]
            whole = parts[0]
            for part in parts[1:]:
                whole = whole.unionByName(part)
            return whole
        return {"checkshot": tables.read_checkshots, "horizon": tables.read_horizon}[kind](spark, files)

    said = []
    for kind, files in sorted(found.items()):
        if kind not in ("log", "checkshot", "horizon", "tops_text", "trajectory_text", *FAMILIES):
            said.append((kind, None, len(files), "left out"))
            continue
        try:
            table_of(kind, files).write.mode("overwrite").parquet(f"{out}/{kind}")
            said.append((kind, f"{out}/{kind}", spark.read.parquet(f"{out}/{kind}").count(), None))
        except (PySparkException, ValueError, KeyError) as error:
            said.append((kind, None, len(files), str(error).splitlines()[0][:300]))
    return spark.createDataFrame(said, "kind string, table string, rows long, issue string")


def ingest(spark: SparkSession, path: str, out: str, **options) -> DataFrame:
    """Imports a well folder, a trace file or an array by what it is (``detect_format``); says what became of it."""
    from borespark.sources import zarr

    kind = detect_format(path)
    if kind == "traces":
        return spark.createDataFrame([(kind, out, segy.ingest_volume(spark, path, out, **options)["unique"], None)], "kind string, table string, rows long, issue string")
    if kind == "volume":
        segy.write_volume(zarr.read_volume(spark, path), out)
        return spark.createDataFrame([(kind, out, spark.read.parquet(out).count(), None)], "kind string, table string, rows long, issue string")
    return commit_folder(spark, path, out)


def import_plan(files: DataFrame) -> DataFrame:
    """(kind, files, bytes, family) of a scanned folder: what an import would read and what it leaves out."""
    known = F.array(*[F.lit(f) for f in FAMILIES])
    return files.groupBy("kind", "imported").agg(F.count("*").alias("files"), F.sum("length").alias("bytes")).withColumn("family", F.when(F.array_contains(known, F.col("kind")), F.col("kind")))
