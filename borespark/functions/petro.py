"""Petrophysics and rock physics as Column expressions.

Log functions give NULL on bad input and propagate NULL; ``strict`` variants raise instead.  NaN and
infinities count as bad input.  Defaults are those of common practice and are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
C = Column | str


def col(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column) -> Column:
    """x, or NULL for NaN and infinities."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def gap_flag(x: C) -> Column:
    """1.0 where there is no value, else 0.0; never NULL."""
    return col(x).isNull().cast("double")


# --- shale volume from gamma ray


def gamma_index(gr: C, low: float, high: float) -> Column:
    if high <= low:
        raise ValueError("the shale line must be above the clean line")
    return (col(gr) - low) / (high - low)


def vshale_linear(gr: C, low: float = 30.0, high: float = 100.0) -> Column:
    return clamp(gamma_index(gr, low, high), 0.0, 1.0)


def vshale_clavier(gr: C, low: float = 30.0, high: float = 100.0) -> Column:
    """The index isn't clamped before the curve; under a negative root the rock counts as shale."""
    index = gamma_index(gr, low, high)
    inner = 3.38 - (index + 0.7) * (index + 0.7)
    return clamp(F.when(inner < 0, 1.0).otherwise(1.7 - F.sqrt(inner)), 0.0, 1.0)


def vshale_steiber(gr: C, low: float = 30.0, high: float = 100.0) -> Column:
    index = clamp(gamma_index(gr, low, high), 0.0, 1.0)
    return clamp(index / (3.0 - 2.0 * index), 0.0, 1.0)


# --- units by magnitude or name


def slowness_to_velocity(s: C) -> Column:
    """m/s from microseconds per metre (above 1000) or per foot."""
    s = col(s)
    return F.when(s > 1000.0, 1e6 / s).when(s > 0, 304800.0 / s)


def density_gcc(rho: C, unit: str | None = None) -> Column:
    """g/cc; kg/m3 by unit or by a value above 10."""
    rho = finite(col(rho))
    name = (unit or "").strip().lower().replace(" ", "")
    metric = any(x in name for x in ("kg/m3", "kg/m^3", "kg/m³"))
    scaled = rho / 1000.0
    return F.when(rho > 0, scaled if metric else F.when(rho > 10.0, scaled).otherwise(rho))


def porosity_fraction(phi: C, unit: str | None = None) -> Column:
    """A fraction in [0, 1]; per cent by unit or by a value above 1."""
    phi = finite(col(phi))
    name = (unit or "").strip().lower()
    percent = any(x in name for x in ("%", "pct", "percent", "pu"))
    value = phi / 100.0 if percent else F.when(phi > 1.0, phi / 100.0).otherwise(phi)
    return F.when((phi >= 0) & (value <= 1.0), value)


def velocity_by_unit(v: C, unit: str | None) -> Column:
    """m/s by unit alone: feet or kilometres per second, else as given."""
    v, name = finite(col(v)), (unit or "").strip().lower().replace(" ", "")
    if "ft/s" in name:
        return v * 0.3048
    return v * 1000.0 if "km/s" in name else v


def slowness_by_unit(s: C, unit: str | None) -> Column:
    """As ``slowness_to_velocity``, but a unit of microseconds per metre or foot decides first."""
    s, name = finite(col(s)), (unit or "").strip().lower().replace(" ", "")
    if "us/m" in name or "us/ft" in name:
        return F.when(s > 0, (1e6 if "us/m" in name else 304800.0) / s)
    return slowness_to_velocity(s)


def density_by_unit(rho: C, unit: str | None) -> Column:
    """g/cc by unit, else as given."""
    rho, name = finite(col(rho)), (unit or "").strip().lower().replace(" ", "")
    return rho / 1000.0 if "kg/m3" in name or "kg/m^3" in name else rho


#: Depth units by their spellings (fixed values), and their metres.
DEPTH_UNITS = {"FT": ("FT", "F", "FEET", "FOOT"), "M": ("M", "METER", "METERS", "METRE", "METRES"), ".1IN": (".1IN", "0.1IN", ".1INCH", "0.1INCH")}
METRES = {"FT": 0.3048, "M": 1.0, ".1IN": 0.00254}


def depth_unit(unit: str | None) -> str | None:
    """FT, M or .1IN; None for other units."""
    name = (unit or "").strip().upper()
    return next((u for u, names in DEPTH_UNITS.items() if name in names), None)


def index_in_metres(x: C, unit: str) -> Column:
    return col(x) * METRES[depth_unit(unit)]


def index_in_feet(x: C, unit: str) -> Column:
    return col(x) / 120.0 if depth_unit(unit) == ".1IN" else col(x) * (METRES[depth_unit(unit)] / 0.3048)


# --- elastic attributes


def vp_vs_ratio(vp: C, vs: C) -> Column:
    vp, vs = col(vp), col(vs)
    return F.when((vp > 0) & (vs > 0), vp / vs)


def acoustic_impedance(vp: C, rho: C, unit: str | None = None) -> Column:
    """Velocity times density in g/cc; the velocity's sign isn't checked."""
    return col(vp) * density_gcc(rho, unit)


shear_impedance = acoustic_impedance


def lambda_rho(vp: C, vs: C, rho: C, unit: str | None = None) -> Column:
    """rho (Vp^2 - 2 Vs^2) with velocities in km/s."""
    vp, vs, r = col(vp) / 1000.0, col(vs) / 1000.0, density_gcc(rho, unit)
    return F.when((vp > 0) & (vs > 0), r * (vp * vp - 2.0 * vs * vs))


def mu_rho(vs: C, rho: C, unit: str | None = None) -> Column:
    vs = col(vs) / 1000.0
    return F.when(vs > 0, density_gcc(rho, unit) * vs * vs)


def poisson_ratio(vp: C, vs: C) -> Column:
    vp, vs = col(vp), col(vs)
    square = (vp / vs) * (vp / vs)
    below = 2.0 * (square - 1.0)
    return F.when((vp > 0) & (vs > 0) & (F.abs(below) > EPSILON), (square - 2.0) / below)


def elastic_impedance(vp: C, vs: C, rho: C, terms: tuple[C, C, C, C], angle: float = 0.0) -> Column:
    """Normalised elastic impedance at an angle in [0, 90) degrees; terms are mean Vp, Vs, rho and (Vs/Vp)^2."""
    if not 0.0 <= angle < 90.0:
        raise ValueError("the angle is in [0, 90)")
    sine, tangent = F.sin(F.radians(F.lit(angle))), F.tan(F.radians(F.lit(angle)))
    vp, vs, r, (vp0, vs0, r0, k) = col(vp), col(vs), density_gcc(rho), map(col, terms)
    a, b, c = 1.0 + tangent * tangent, -8.0 * k * sine * sine, 1.0 - 4.0 * k * sine * sine
    value = F.pow(vp, a) * F.pow(vs, b) * F.pow(r, c) * F.pow(vp0, 1.0 - a) * F.pow(vs0, -b) * F.pow(r0, 1.0 - c)
    return F.when((vp > 0) & (vs > 0) & (r > 0), value)


def extended_elastic_impedance(vp: C, vs: C, rho: C, terms: tuple[C, C, C, C], chi: float = 0.0) -> Column:
    """Extended elastic impedance at a rotation chi in [-90, 90] degrees."""
    if not -90.0 <= chi <= 90.0:
        raise ValueError("chi is in [-90, 90]")
    sine, cosine = F.sin(F.radians(F.lit(chi))), F.cos(F.radians(F.lit(chi)))
    vp, vs, r, (vp0, vs0, r0, k) = col(vp), col(vs), density_gcc(rho), map(col, terms)
    value = vp0 * r0 * F.pow(vp / vp0, cosine + sine) * F.pow(vs / vs0, -8.0 * k * sine) * F.pow(r / r0, cosine - 4.0 * k * sine)
    return F.when((vp > 0) & (vs > 0) & (r > 0), value)


@dataclass(frozen=True)
class Fluids:
    """Mineral and fluid moduli (GPa) and fluid densities (g/cc) of a substitution."""

    mineral_k: float = 37.0
    k_before: float = 2.3
    k_after: float = 0.05
    rho_before: float = 1.0
    rho_after: float = 0.2


def with_gassmann(rows: DataFrame, vp: C, vs: C, rho: C, phi: C, fluids: Fluids = Fluids(), names: tuple[str, str, str] = ("density", "vp_after", "vs_after")) -> DataFrame:
    """rows with density, Vp and Vs after fluid substitution; NULL where a modulus loses its sense.

    Moduli are named columns, stage by stage, so that none is computed twice.
    """
    own = [c for c in rows.columns if c not in names]
    rows = rows.withColumns({"__vp": col(vp), "__vs": col(vs), "__r": density_gcc(rho), "__f": porosity_fraction(phi)})
    p, s, r, f = (F.col(f"__{n}") for n in ("vp", "vs", "r", "f"))
    rows = rows.withColumns({"__g": r * s * s * 1e-6, "__d": r - f * fluids.rho_before + f * fluids.rho_after})
    rows = rows.withColumn("__k", r * p * p * 1e-6 - 4.0 / 3.0 * F.col("__g"))
    k, g, d = F.col("__k"), F.col("__g"), F.col("__d")
    before, after = fluids.mineral_k - fluids.k_before, fluids.mineral_k - fluids.k_after
    sound = (p > 0) & (s > 0) & (f > 0) & (g > 0) & (k > 0) & (d > 0) & (F.abs(fluids.mineral_k - k) > EPSILON) & F.lit(min(abs(before), abs(after)) > EPSILON)
    ratio = F.try_divide(k, fluids.mineral_k - k) - F.try_divide(F.lit(fluids.k_before), f * before) + F.try_divide(F.lit(fluids.k_after), f * after)
    rows = rows.withColumn("__t", F.when(sound, ratio))
    t = F.col("__t")
    rows = rows.withColumn("__after", F.when(F.abs(1.0 + t) > EPSILON, t * fluids.mineral_k / (1.0 + t)))
    stiff = F.col("__after") > 0
    values = (F.when(d > 0, d), F.when(stiff, F.sqrt((F.col("__after") + 4.0 / 3.0 * g) / d) * 1000.0), F.when(stiff, F.sqrt(g / d) * 1000.0))
    return rows.select(*own, *[v.alias(n) for v, n in zip(values, names, strict=True)])


def chi_projection(intercept: C, gradient: C, chi: float) -> Column:
    return col(intercept) * F.cos(F.radians(F.lit(chi))) + col(gradient) * F.sin(F.radians(F.lit(chi)))


def fluid_factor(intercept: C, gradient: C, slope: float) -> Column:
    return col(gradient) - slope * col(intercept)


def strict(value: Column, *inputs: C, what: str = "attribute") -> Column:
    """value, or an error where an input is missing, not finite or not positive (the array variants)."""
    sound = F.lit(True)
    for x in inputs:
        sound = sound & F.coalesce(finite(col(x)) > 0, F.lit(False))
    return F.when(sound, value).otherwise(F.raise_error(F.lit(f"{what}: inputs must be finite and positive")))


# --- structured families and texts


def normalise_azimuth(x: C) -> Column:
    """Degrees in [0, 360)."""
    return F.pmod(col(x), F.lit(360.0))


def normalise_phase(x: C) -> Column:
    return F.upper(F.trim(col(x)))


def normalise_event_kind(x: C) -> Column:
    return F.translate(F.upper(F.trim(col(x))), " -", "__")


#: Depth domains by their codes and synonyms (fixed values).
DEPTH_DOMAINS = {
    "md": ("md", "measured_depth", "measured depth"),
    "tvd": ("tvd", "true_vertical_depth", "true vertical depth"),
    "tvdss": ("tvdss", "tvdss_m", "true_vertical_depth_subsea", "true vertical depth subsea"),
    "elevation": ("elev", "elevation"),
}
#: Datums by their codes and synonyms (fixed values).
DEPTH_DATUMS = {
    "kb": ("kb", "kelly_bushing", "kelly bushing"),
    "rt": ("rt", "rotary_table", "rotary table"),
    "df": ("df", "drill_floor", "drill floor"),
    "gl": ("gl", "ground_level", "ground level"),
    "msl": ("msl", "mean_sea_level", "mean sea level", "sea level"),
}
#: Reference points that imply measured depth (fixed values).
MEASURED_FROM = ("kb", "kelly bushing", "rt", "rotary table", "df", "drill floor", "gl", "ground level")


def _code(x: C, table: dict[str, tuple[str, ...]]) -> Column:
    pairs = [F.lit(v) for code, names in table.items() for name in names for v in (name, code)]
    return F.element_at(F.create_map(*pairs), F.lower(F.trim(col(x))))


def depth_datum(text: C, reference: C | None = None) -> Column:
    """The datum of a code or synonym, else that of the free reference text."""
    own = _code(text, DEPTH_DATUMS)
    return own if reference is None else F.coalesce(own, _code(reference, DEPTH_DATUMS))


def depth_domain(text: C, datum: C | None = None, reference: C | None = None) -> Column:
    """The domain of a code or synonym, else that of the reference text; a datum alone implies measured depth."""
    out = _code(text, DEPTH_DOMAINS)
    if reference is not None:
        out = F.coalesce(out, F.when(F.lower(F.trim(col(reference))).isin(*MEASURED_FROM), "md"), _code(reference, DEPTH_DOMAINS))
    if datum is not None:
        out = F.coalesce(out, F.when(depth_datum(datum, reference).isNotNull(), "md"))
    return out


def set_reference(rows: DataFrame, keys: list[str], domain: str = "depth_domain", datum: str = "depth_datum") -> DataFrame:
    """(keys, reference, datum) of row sets: 'unknown' where the rows disagree or one has no depth domain."""
    d, z = F.when(F.col(domain).isin("md", "tvd", "tvdss"), F.col(domain)), _code(datum, DEPTH_DATUMS)
    given = F.col(datum).isNotNull() & (F.trim(datum) != "") & z.isNotNull()
    s = rows.groupBy(*keys).agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.count_if(d.isNull()).alias("odd"), F.min(F.when(given, z)).alias("dlo"), F.max(F.when(given, z)).alias("dhi"))
    return s.select(*keys, F.when((F.col("odd") == 0) & (F.col("lo") == F.col("hi")), F.col("lo")).otherwise("unknown").alias("reference"), F.when(F.col("dlo") == F.col("dhi"), F.col("dlo")).when(F.col("dlo").isNotNull(), "unknown").alias("datum"))


#: Mnemonics of the curve kinds (fixed values).
CURVE_KINDS = {
    "depth": ("DEPT", "DEPTH"), "time": ("TIME", "ETIM"),
    "gamma_ray": ("GR", "GAMN", "GRC", "GRAX", "GR1AX"), "bulk_density": ("RHOB", "RHO", "RHOZ", "DEN", "DENS", "BDCX"), "neutron_porosity": ("NPHI", "NPLX", "CNL"),
    "sonic": ("DT", "DTC", "DTCO", "AC"), "shear_sonic": ("DTS", "DTSM", "DTSH"), "p_velocity": ("VP", "PVEL", "P_VEL"), "s_velocity": ("VS", "SVEL", "S_VEL"),
    "deep_resistivity": ("ILD", "RESD"), "medium_resistivity": ("ILM", "RESM"), "shallow_resistivity": ("SFLA", "RESS", "MSFL", "RX0", "RXO"),
    "vp_vs_ratio": ("VPVS", "VP_VS", "VP/VS"), "acoustic_impedance": ("AI", "AIMP"), "elastic_impedance": ("EI", "ELASTIC_IMPEDANCE", "ELASTIC-IMPEDANCE"),
    "extended_elastic_impedance": ("EEI", "EXTENDED_ELASTIC_IMPEDANCE", "EXTENDED-ELASTIC-IMPEDANCE"), "shear_impedance": ("SI", "SIMP"),
    "lambda_rho": ("LRHO", "LAMBDA_RHO", "LAMBDA-RHO"), "mu_rho": ("MRHO", "MU_RHO", "MU-RHO"), "poissons_ratio": ("PR", "NU", "POISSON"),
    "effective_porosity": ("PHIE", "EFFECTIVE_POROSITY"), "water_saturation": ("SW", "SWT", "WATER_SATURATION"),
}


def curve_kind(mnemonic: C, unit: C | None = None) -> Column:
    """The kind of a curve by its mnemonic, else by a telling unit with a fitting mnemonic, else 'unknown'."""
    key = F.upper(F.trim(col(mnemonic)))
    pairs = [F.lit(v) for kind, names in CURVE_KINDS.items() for n in names for v in (n, kind)]
    found = F.element_at(F.create_map(*pairs), key)
    if unit is not None:
        u = F.lower(F.trim(F.coalesce(col(unit), F.lit(""))))
        slow = u.rlike("us/ft|us/m")
        by_unit = F.when(key.startswith("GR") & u.contains("api"), "gamma_ray").when(u.rlike(r"g/cc|g/cm\^?3|kg/m\^?3") & (key.rlike("RHO|DEN") | key.startswith("BDC")), "bulk_density")
        found = F.coalesce(found, by_unit.when(key.startswith("DTS") & slow, "shear_sonic").when(slow, "sonic"))
    return F.coalesce(found, F.lit("unknown"))
