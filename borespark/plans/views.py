"""Composite views: well panels, crossplots, reflectivity responses, catalog summaries, trace operator catalog."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from borespark.functions import avo, petro
from borespark.operators import frames

#: Crossplot templates: the quantities of both axes (fixed values).
CROSSPLOTS = {
    "vp-vs-vs-ai": ("acoustic_impedance", "vp_vs_ratio"), "ai-vs-si": ("acoustic_impedance", "shear_impedance"), "vp-vs-vs": ("vp", "vs"),
    "porosity-vs-vp": ("porosity", "vp"), "lambda-rho-vs-mu-rho": ("lambda_rho", "mu_rho"), "neutron-porosity-vs-bulk-density": ("porosity", "density"),
    "phi-vs-ai": ("porosity", "acoustic_impedance"), "pr-vs-ai": ("poisson", "acoustic_impedance"), "vp-vs-density": ("vp", "density"),
}


def quantities() -> dict:
    """Quantities of a row with the channels vp, vs, rho, phi."""
    return {
        "vp": F.col("vp"), "vs": F.col("vs"), "density": petro.density_gcc("rho"), "porosity": petro.porosity_fraction("phi"),
        "vp_vs_ratio": petro.vp_vs_ratio("vp", "vs"), "acoustic_impedance": petro.acoustic_impedance("vp", "rho"), "shear_impedance": petro.shear_impedance("vs", "rho"),
        "lambda_rho": petro.lambda_rho("vp", "vs", "rho"), "mu_rho": petro.mu_rho("vs", "rho"), "poisson": petro.poisson_ratio("vp", "vs"),
    }


def crossplot(rows: DataFrame, template: str, keys: Sequence[str], color: str | None = None, depth: tuple[str, float, float] | None = None) -> DataFrame:
    """(keys, x, y, color) of the rows that have both quantities, in a depth window if given."""
    if depth is not None:
        rows = frames.depth_window(rows, *depth)
    x, y = (quantities()[q] for q in CROSSPLOTS[template])
    out = rows.select(*keys, x.alias("x"), y.alias("y"), *([F.col(color).alias("color")] if color else []))
    return out.where("x is not null and y is not null")


def well_panel(samples: DataFrame, tops: DataFrame, keys: Sequence[str], depth: str = "depth") -> DataFrame:
    """Curve samples with the name of the unit they lie in (NULL above the first top); tops: keys, name, top_depth."""
    units = frames.fill_base(tops.withColumn("base_depth", F.lit(None).cast("double")), keys, "top_depth", "base_depth")
    carry = frames.in_intervals(samples, units.select(*keys, "name", F.col("top_depth").alias("top"), F.coalesce("base_depth", F.lit(float("inf"))).alias("base")), keys, depth, "top", "base")
    inside = carry.drop("top", "base")
    first = tops.groupBy(*keys).agg(F.min("top_depth").alias("__t"))
    above = samples.join(first, list(keys), "left").where(F.col("__t").isNull() | (F.col(depth) < F.col("__t"))).drop("__t")
    return inside.unionByName(above.withColumn("name", F.lit(None).cast("string")))


def reflectivity_response(interfaces: DataFrame, angles: Sequence[float], methods: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, angle, method, reflectivity) of several methods side by side."""
    out = None
    for method in methods:
        rows = avo.reflectivity(interfaces, list(angles), method).select(*keys, "angle", F.lit(method).alias("method"), "reflectivity")
        out = rows if out is None else out.union(rows)
    return out


def chi_view(interfaces: DataFrame, keys: Sequence[str], chi: float) -> DataFrame:
    """(keys, intercept, gradient, projection) of interfaces."""
    i = avo.Interface()
    rows = interfaces.select(*keys, i.intercept().alias("intercept"), i.gradient().alias("gradient"))
    return rows.withColumn("projection", petro.chi_projection("intercept", "gradient", chi))


def catalog_summary(wells: DataFrame, wellbores: DataFrame, collections: DataFrame, assets: DataFrame) -> DataFrame:
    """One row: how many wells, wellbores, collections and assets there are."""
    counts = [df.agg(F.count("*").alias(name)) for df, name in ((wells, "wells"), (wellbores, "wellbores"), (collections, "collections"), (assets, "assets"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.crossJoin(c)  # a row each
    return out


def assets_covering(assets: DataFrame, samples: DataFrame, keys: Sequence[str], depth: str, low: float, high: float) -> DataFrame:
    """Assets whose samples' extent meets the depth range."""
    return assets.join(frames.covering(frames.extents(samples, keys, depth), low, high).select(*keys), list(keys), "left_semi")


#: Trace operators by the layouts they run on and what they need around a trace (fixed values).
TRACE_OPERATORS = [
    *[(n, "any", "trace") for n in ("scale", "rms_normalise", "agc", "phase_rotation", "envelope", "instantaneous_phase", "instantaneous_frequency", "sweetness", "lowpass", "highpass", "bandpass", "volume_arithmetic")],
    *[(n, "post_stack", "neighborhood") for n in ("similarity", "local_statistics", "dip")], ("subvolume", "post_stack", "trace"),
    *[(n, "prestack_offset", "gather") for n in ("nmo", "stretch_mute", "offset_mute", "velocity_scan")],
]


def trace_operators(spark, layout: str) -> DataFrame:
    """(id, needs, available, reason) of the trace operators for 'post_stack' or 'prestack_offset' data."""
    rows = [(n, needs, ok := on in ("any", layout), None if ok else f"runs on {on} data") for n, on, needs in TRACE_OPERATORS]
    return spark.createDataFrame(rows, "id string, needs string, available boolean, reason string")
