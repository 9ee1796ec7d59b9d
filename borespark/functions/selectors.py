"""Names by which users select curves and interval sets, and what they mean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from borespark.functions.petro import C, col

#: Log types by selector, without blanks and underscores, in lower case (fixed values).
LOG_TYPES = {
    "gr": "GammaRay", "gamma": "GammaRay", "gammaray": "GammaRay",
    "rhob": "BulkDensity", "rho": "BulkDensity", "density": "BulkDensity", "bulkdensity": "BulkDensity", "bdcx": "BulkDensity",
    "nphi": "NeutronPorosity", "cnl": "NeutronPorosity", "neutronporosity": "NeutronPorosity",
    "dt": "CompressionalSlowness", "dtc": "CompressionalSlowness", "dtco": "CompressionalSlowness", "sonic": "CompressionalSlowness",
    "compressionalsonic": "CompressionalSlowness", "compressionalslowness": "CompressionalSlowness",
    "dts": "ShearSlowness", "dtsm": "ShearSlowness", "dtsh": "ShearSlowness", "shearsonic": "ShearSlowness", "shearslowness": "ShearSlowness",
    "vp": "PVelocity", "pvelocity": "PVelocity", "pwavevelocity": "PVelocity", "vs": "SVelocity", "svelocity": "SVelocity", "swavevelocity": "SVelocity",
    "depth": "Depth",
}
#: Kinds of interval sets by selector, likewise, also without hyphens (fixed values).
INTERVAL_SETS = {
    "top": "top_set", "tops": "top_set", "topset": "top_set",
    "marker": "well_marker_set", "markers": "well_marker_set", "markerset": "well_marker_set",
    "wellmarker": "well_marker_set", "wellmarkers": "well_marker_set", "wellmarkerset": "well_marker_set",
}
#: What may be bound to an elastic channel, by selector (fixed values).
BINDINGS = {
    "vp": {
        "vp": "PVelocity", "pvelocity": "PVelocity", "pwavevelocity": "PVelocity", "pwave": "PVelocity",
        "compressionalslowness": "CompressionalSlowness", "compressionalsonic": "CompressionalSlowness", "dt": "CompressionalSlowness", "dtc": "CompressionalSlowness", "dtco": "CompressionalSlowness", "sonic": "CompressionalSlowness",
    },
    "vs": {
        "vs": "SVelocity", "svelocity": "SVelocity", "swavevelocity": "SVelocity", "swave": "SVelocity",
        "shearslowness": "ShearSlowness", "shearsonic": "ShearSlowness", "dts": "ShearSlowness", "dtsm": "ShearSlowness", "dtsh": "ShearSlowness",
    },
    "density": {"density": "BulkDensity", "rho": "BulkDensity", "rhob": "BulkDensity", "den": "BulkDensity", "bulkdensity": "BulkDensity"},
}


def _look_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in table.items() for v in pair]), key)


def _key(selector: Column, also: str = "") -> Column:
    return F.lower(F.translate(F.trim(selector), f" _{also}", ""))


def _checked(selector: Column, key: Column, value: Column, what: str) -> Column:
    return F.when((key == "") | key.isNull(), F.raise_error(F.lit(f"{what}: empty selector"))).otherwise(F.coalesce(value, F.trim(selector)))


def log_type(selector: C) -> Column:
    """The log type that a selector names; an unknown selector stands for itself, an empty one is an error."""
    s = col(selector)
    return _checked(s, _key(s), _look_up(LOG_TYPES, _key(s)), "log type")


def interval_set_kind(selector: C) -> Column:
    """The kind of interval set that a selector names, by the same rules."""
    s = col(selector)
    return _checked(s, _key(s, "-"), _look_up(INTERVAL_SETS, _key(s, "-")), "interval set")


def channel_binding(selector: C, role: str) -> Column:
    """What a selector binds to an elastic channel ('vp', 'vs' or 'density'); anything else is an error, NULL stays."""
    s = col(selector)
    value = _look_up(BINDINGS[role], _key(s))
    return F.when(s.isNotNull(), F.coalesce(value, F.raise_error(F.concat(F.lit(f"nothing for {role} is called "), s)).cast("string")))
