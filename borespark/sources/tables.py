"""Tables of wells and surfaces from text: trajectories, tops, pressures, markers, drilling, horizons, velocities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.functions.petro import depth_datum, depth_domain

#: Columns of each family with their accepted headers; required ones are marked by '!' (fixed values).
FAMILIES = {
    "trajectory": {
        "md!": ("md", "measured_depth"), "tvd": ("tvd", "true_vertical_depth", "tvd_m"), "tvdss": ("tvdss", "true_vertical_depth_subsea", "true_vertical_depth_ss", "tvdss_m"),
        "azimuth": ("azimuth", "azimuth_deg", "azi"), "inclination": ("inclination", "inclination_deg", "inc"),
        "northing": ("northing_offset", "northing", "northing_m", "y_offset"), "easting": ("easting_offset", "easting", "easting_m", "x_offset"),
    },
    "tops": {
        "name!": ("name", "top_name"), "top_depth!": ("top_depth", "top"), "base_depth": ("base_depth", "base"), "source": ("source",),
        "depth_reference": ("source_depth_reference", "depth_reference", "reference"), "depth_domain": ("depth_domain",), "depth_datum": ("depth_datum",),
    },
    "markers": {
        "name!": ("name", "marker_name", "top_name"), "kind": ("marker_kind", "kind"), "top_depth!": ("top_depth", "top"), "base_depth": ("base_depth", "base"), "source": ("source",),
        "depth_reference": ("source_depth_reference", "depth_reference", "reference"), "depth_domain": ("depth_domain",), "depth_datum": ("depth_datum",), "note": ("note", "notes", "comment"),
    },
    "pressure": {"md": ("md", "measured_depth"), "pressure!": ("pressure",), "phase": ("phase",), "test_kind": ("test_kind", "kind"), "timestamp": ("timestamp", "time")},
    "drilling": {"md": ("md", "measured_depth"), "event_kind!": ("event_kind", "kind"), "value": ("value",), "unit": ("unit",), "timestamp": ("timestamp", "time"), "comment": ("comment", "description")},
}
NUMBERS = {"md", "tvd", "tvdss", "azimuth", "inclination", "northing", "easting", "top_depth", "base_depth", "pressure", "value"}


def read_family(spark: SparkSession, path: str, family: str, separator: str = ",") -> DataFrame:
    """One family's rows with its own column names; a missing required column is an error, others are NULL."""
    return conform(spark.read.option("header", True).option("sep", separator).csv(path), family)


def conform(df: DataFrame, family: str) -> DataFrame:
    have = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    out = []
    for name, aliases in FAMILIES[family].items():
        column, required = name.rstrip("!"), name.endswith("!")
        found = next((have[a] for a in aliases if a in have), None)
        if found is None and required:
            raise ValueError(f"{family}: no column for {column}")
        value = F.lit(None).cast("string") if found is None else F.nullif(F.trim(F.col(f"`{found}`").cast("string")), F.lit(""))
        out.append((value.try_cast("double") if column in NUMBERS else value).alias(column))
    rows = df.select(*out)
    if "depth_domain" in rows.columns:
        domain, datum = depth_domain("depth_domain", "depth_datum", "depth_reference"), depth_datum("depth_datum", "depth_reference")
        rows = rows.withColumns({"depth_domain": domain, "depth_datum": datum})
    return rows


def read_horizon(spark: SparkSession, path: str) -> DataFrame:
    """(line, x, y, z) of text rows by blanks, commas or semicolons; comments and blank rows are skipped, bad rows kept with NULLs."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~F.trim("value").rlike(r"^(#|//|$)"))
    cells = F.split(F.trim("value"), r"[\s,;]+")
    return lines.select("line", *[F.get(cells, F.lit(i)).try_cast("double").alias(c) for i, c in enumerate("xyz")])


def horizon_issues(points: DataFrame, most: int = 8) -> DataFrame:
    """The first bad rows; count them by the same condition."""
    return points.where("x is null or y is null or z is null").orderBy("line").limit(most)


def read_checkshots(spark: SparkSession, path: str) -> DataFrame:
    """(well, depth, time_ms) of rows time, depth, well: absolute values, without exact repetitions, ordered."""
    cells = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).select(F.abs(F.get(cells, F.lit(0)).try_cast("double")).alias("time_ms"), F.abs(F.get(cells, F.lit(1)).try_cast("double")).alias("depth"), F.get(cells, F.lit(2)).alias("well"))
    return rows.where("time_ms is not null and depth is not null").dropDuplicates().select("well", "depth", "time_ms").orderBy("well", "depth", "time_ms")


def read_time_depth(spark: SparkSession, path: str) -> DataFrame:
    """(depth, time_ms) of rows depth, seconds: in ms, one row per depth (the earliest), ordered."""
    cells = F.split(F.trim("value"), r"[\s,;]+")
    rows = spark.read.text(path).select(F.get(cells, F.lit(0)).try_cast("double").alias("depth"), (F.get(cells, F.lit(1)).try_cast("double") * 1000.0).alias("time_ms"))
    return rows.where("depth is not null and time_ms is not null").groupBy("depth").agg(F.min("time_ms").alias("time_ms")).orderBy("depth")


#: Columns of the rows of velocity text by their number (fixed values).
VELOCITY_ROWS = {4: ("x", "y", "t", "v"), 7: ("x", "y", "t", "rms", "interval", "average", "depth")}
#: Beginnings of lines that hold no row (fixed values).
VELOCITY_NOTES = ("#", "This data contains", "CDP-X", "12345678901234567890", "0        1         2")


def read_velocity_rows(spark: SparkSession, path: str, kind: str = "interval") -> DataFrame:
    """(line, x, y, t, rms, interval, average, depth) of velocity text by blanks or commas.

    Rows of four numbers are x, y, time and a velocity of ``kind``; rows of seven or more x, y, time, RMS, interval and
    average velocity and depth.  Comments, headings and lines without three numbers are skipped; other rows, of three or
    of five and six numbers, or with text among the numbers, are errors, as are velocities that aren't positive and
    negative times.
    """
    if kind not in ("rms", "interval", "average"):
        raise ValueError("velocities are rms, interval or average")
    text = F.trim("value")
    note = text == ""
    for start in VELOCITY_NOTES:
        note = note | text.startswith(start)
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(~note)
    cells = F.filter(F.split(text, r"[\s,]+"), lambda c: c != "")
    numbers = F.filter(F.transform("c", lambda c: c.try_cast("double")), lambda v: v.isNotNull())
    rows = lines.select("line", "value", cells.alias("c")).withColumn("n", numbers).where(F.size("n") >= 3)
    wrong = (F.size("n") != F.size("c")) | ~((F.size("n") == 4) | (F.size("n") >= 7))
    at = lambda i: F.get("n", F.lit(i))
    full = F.size("n") >= 7
    speeds = {k: F.when(full, at(i)).otherwise(at(3) if k == kind else F.lit(None)) for i, k in ((3, "rms"), (4, "interval"), (5, "average"))}
    wrong = wrong | (at(2) < 0) | F.coalesce(F.least(at(3), F.when(full, at(4)), F.when(full, at(5))) <= 0, F.lit(False))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a velocity row: "), "value"))).otherwise(F.lit(True)).cast("boolean")
    rows = rows.where(checked)
    return rows.select("line", at(0).alias("x"), at(1).alias("y"), at(2).alias("t"), *[v.alias(k) for k, v in speeds.items()], F.when(full, at(6)).alias("depth"))


def read_velocity_functions(spark: SparkSession, path: str, kind: str = "interval") -> DataFrame:
    """(x, y, times, velocities) of ``read_velocity_rows``: one row per profile, by time, with the velocities of a kind."""
    rows = read_velocity_rows(spark, path, kind).where(F.col(kind).isNotNull())
    pairs = rows.groupBy("x", "y").agg(F.array_sort(F.collect_list(F.struct("t", F.col(kind).alias("v")))).alias("p"))  # of one profile
    return pairs.select("x", "y", F.col("p.t").alias("times"), F.col("p.v").alias("velocities"))
