"""Registered queries over the driver's tables, with the equivalent DuckDB SQL.

The tables hold no subsurface data, so their columns play the roles: ``events`` are logs (well = user),
``lineitem`` rows carry elastic properties, ``orders`` are tops, ``embeddings`` are traces on a grid of 25
crosslines and gathers by label.  Computed doubles are rounded alike on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borespark.functions import avo, petro

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            # a rounded value is never -0.0, on either side
            ORACLES[name] = re.sub(r"(?<=, )ROUND\(|(?<=SELECT )ROUND\(", "CAST(0 AS DOUBLE) + ROUND(", sql)
        return function

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without negative zeros."""
    return F.round(x, digits) + F.lit(0.0)


def rounded(x: Column, digits: int) -> Column:
    """As ROUND of the SQL: the scaled number goes to the next whole one, halves away from zero; without negative zeros.

    ``F.round`` rounds the shortest decimal form instead, which differs where scaling itself rounds to a half.
    """
    scale = float(10**digits)
    y = F.abs(x) * scale
    down = F.floor(y)
    near = (down + (y - down >= 0.5).cast("long")) / scale
    return F.when(y < 2.0**52, F.when(x < 0, -near).otherwise(near)).otherwise(x) + F.lit(0.0)


# --- roles


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(well, id, ts, v): every seventh value is missing."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("well"), F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"), "event_type")


LOGS = "logs AS (SELECT user_id AS well, event_id AS id, ts, CASE WHEN event_id % 7 <> 0 THEN value END AS v, event_type FROM events)"


def elastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ok, ln, well, vp, vs, rho, phi, gr, dt) with gaps and unusable values."""
    x = table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    vp = 1500.0 + F.col("l_extendedprice") / 40.0
    return x.select(
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_suppkey").alias("well"),
        F.when(n % 11 != 0, vp).alias("vp"), F.when(n % 13 != 0, vp * (0.45 + F.col("l_discount"))).otherwise(-1.0).alias("vs"),
        F.when(n % 5 == 0, (2.0 + F.col("l_tax") * 5.0) * 1000.0).otherwise(2.0 + F.col("l_tax") * 5.0).alias("rho"),
        F.when(n % 3 == 0, F.col("l_quantity")).otherwise(0.02 + F.col("l_discount")).alias("phi"),
        F.when(n % 17 != 0, F.col("l_quantity") * 3.0).alias("gr"), F.when(n % 4 == 0, F.col("l_quantity") * 40.0).otherwise(F.col("l_quantity") * 4.0 - 8.0).alias("dt"),
    )


ELASTIC = """elastic AS (SELECT l_orderkey AS ok, l_linenumber AS ln, l_suppkey AS well,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 11 <> 0 THEN 1500.0 + l_extendedprice / 40.0 END AS vp,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 13 <> 0 THEN (1500.0 + l_extendedprice / 40.0) * (CAST(0.45 AS DOUBLE) + l_discount) ELSE CAST(-1 AS DOUBLE) END AS vs,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 5 = 0 THEN (2.0 + l_tax * 5.0) * 1000.0 ELSE 2.0 + l_tax * 5.0 END AS rho,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 3 = 0 THEN l_quantity ELSE CAST(0.02 AS DOUBLE) + l_discount END AS phi,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 17 <> 0 THEN l_quantity * 3.0 END AS gr,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 4 = 0 THEN l_quantity * 40.0 ELSE l_quantity * 4.0 - 8.0 END AS dt FROM lineitem)"""
_RHO = "CASE WHEN rho > 10 THEN rho / 1000.0 WHEN rho > 0 THEN rho END"
_PHI = "CASE WHEN phi >= 0 AND (CASE WHEN phi > 1 THEN phi / 100.0 ELSE phi END) <= 1 THEN CASE WHEN phi > 1 THEN phi / 100.0 ELSE phi END END"


def formula(name: str, value: Callable[[], Column], sql: str, digits: int = 6) -> None:
    """A query of one value per elastic row."""

    def run(spark, sf_dir):
        return elastic(spark, sf_dir).select("ok", "ln", r6(value(), digits).alias("value"))

    register(name, f"WITH {ELASTIC} SELECT ok, ln, ROUND({sql}, {digits}) AS value FROM elastic")(run)


def _clamp(x: str) -> str:
    return f"GREATEST(CAST(0 AS DOUBLE), LEAST(CAST(1 AS DOUBLE), {x}))"


_I = "((gr - 30.0) / 70.0)"
formula("p04_gap_flag", lambda: petro.gap_flag("gr"), "CASE WHEN gr IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END")
formula("p05_vshale_linear", lambda: petro.vshale_linear("gr"), f"CASE WHEN gr IS NOT NULL THEN {_clamp(_I)} END")
formula("p06_vshale_clavier", lambda: petro.vshale_clavier("gr"), f"CASE WHEN gr IS NULL THEN NULL WHEN 3.38 - ({_I} + 0.7) * ({_I} + 0.7) < 0 THEN CAST(1 AS DOUBLE) ELSE {_clamp(f'1.7 - SQRT(3.38 - ({_I} + 0.7) * ({_I} + 0.7))')} END")
formula("p07_vshale_steiber", lambda: petro.vshale_steiber("gr"), f"CASE WHEN gr IS NOT NULL THEN {_clamp(_I)} / (3.0 - 2.0 * {_clamp(_I)}) END")
formula("p08_sonic_velocity", lambda: petro.slowness_to_velocity("dt"), "CASE WHEN dt > 1000 THEN 1000000.0 / dt WHEN dt > 0 THEN 304800.0 / dt END")
formula("p09_shear_sonic_velocity", lambda: petro.slowness_to_velocity(F.col("dt") * 1.7), "CASE WHEN dt * CAST(1.7 AS DOUBLE) > 1000 THEN 1000000.0 / (dt * CAST(1.7 AS DOUBLE)) WHEN dt * CAST(1.7 AS DOUBLE) > 0 THEN 304800.0 / (dt * CAST(1.7 AS DOUBLE)) END")
formula("p10_vp_vs_ratio", lambda: petro.vp_vs_ratio("vp", "vs"), "CASE WHEN vp > 0 AND vs > 0 THEN vp / vs END")
formula("p11_acoustic_impedance", lambda: petro.acoustic_impedance("vp", "rho"), f"vp * ({_RHO})", 9)
formula("p14_shear_impedance", lambda: petro.shear_impedance("vs", "rho"), f"vs * ({_RHO})", 9)
formula("p15_lambda_rho", lambda: petro.lambda_rho("vp", "vs", "rho"), f"CASE WHEN vp > 0 AND vs > 0 THEN ({_RHO}) * ((vp / 1000.0) * (vp / 1000.0) - 2.0 * (vs / 1000.0) * (vs / 1000.0)) END")
formula("p16_mu_rho", lambda: petro.mu_rho("vs", "rho"), f"CASE WHEN vs > 0 THEN ({_RHO}) * (vs / 1000.0) * (vs / 1000.0) END")
formula("p17_poisson", lambda: petro.poisson_ratio("vp", "vs"), "CASE WHEN vp > 0 AND vs > 0 AND ABS(2.0 * ((vp / vs) * (vp / vs) - 1.0)) > 2.3e-16 THEN ((vp / vs) * (vp / vs) - 2.0) / (2.0 * ((vp / vs) * (vp / vs) - 1.0)) END")
formula("p21_density_gcc", lambda: petro.density_gcc("rho"), _RHO)
formula("p22_porosity_fraction", lambda: petro.porosity_fraction("phi"), _PHI)
_GASS = f"""CASE WHEN vp > 0 AND vs > 0 THEN (SELECT CASE WHEN f > 0 AND g > 0 AND k > 0 AND a > 0 AND d > 0 THEN %s END FROM (SELECT *, t * 37.0 / (1.0 + t) AS a FROM (SELECT *, k / (37.0 - k) - CAST(2.3 AS DOUBLE) / (f * (37.0 - CAST(2.3 AS DOUBLE))) + CAST(0.05 AS DOUBLE) / (f * (37.0 - CAST(0.05 AS DOUBLE))) AS t FROM
 (SELECT *, r * vp * vp * 1e-6 - CAST(4 AS DOUBLE) / 3.0 * g AS k, r - f * 1.0 + f * CAST(0.2 AS DOUBLE) AS d FROM (SELECT *, r * vs * vs * 1e-6 AS g FROM (SELECT {_RHO} AS r, {_PHI} AS f)))))) END"""


def _gassmann(name: str, column: str, sql: str, digits: int) -> None:
    def run(spark, sf_dir):
        return petro.with_gassmann(elastic(spark, sf_dir), "vp", "vs", "rho", "phi").select("ok", "ln", r6(column, digits).alias("value"))

    register(name, f"WITH {ELASTIC} SELECT ok, ln, ROUND({sql}, {digits}) AS value FROM elastic")(run)


_gassmann("p18_gassmann_density", "density", f"(SELECT CASE WHEN r - f + f * CAST(0.2 AS DOUBLE) > 0 THEN r - f + f * CAST(0.2 AS DOUBLE) END FROM (SELECT {_RHO} AS r, {_PHI} AS f))", 6)
_gassmann("p19_gassmann_vp", "vp_after", _GASS % "SQRT((a + CAST(4 AS DOUBLE) / 3.0 * g) / d) * 1000.0", 4)
_gassmann("p20_gassmann_vs", "vs_after", _GASS % "SQRT(g / d) * 1000.0", 4)
formula("p23_azimuth", lambda: petro.normalise_azimuth(F.col("gr") * 5.0 - 300.0), "CAST(((gr * 5.0 - 300.0) - 360.0 * FLOOR((gr * 5.0 - 300.0) / 360.0)) AS DOUBLE)")
formula("p27_chi_projection", lambda: petro.chi_projection(F.col("vp") / 1000.0, F.col("vs") / 1000.0, 25.0), "(vp / 1000.0) * COS(RADIANS(25.0)) + (vs / 1000.0) * SIN(RADIANS(25.0))")
formula("p28_fluid_factor", lambda: petro.fluid_factor(F.col("vp"), F.col("vs"), 1.16), "vs - CAST(1.16 AS DOUBLE) * vp", 9)
formula("p29_depth_feet", lambda: petro.index_in_metres("dt", "FT"), "dt * CAST(0.3048 AS DOUBLE)")


def _terms(spark, sf_dir):
    from borespark.operators.frames import impedance_terms

    return impedance_terms(elastic(spark, sf_dir), ["well"], "vp", "vs", "rho")


_TERMS = f"terms AS (SELECT well, AVG(vp) AS vp0, AVG(vs) AS vs0, AVG({_RHO}) AS rho0, AVG((vs / vp) * (vs / vp)) AS k FROM elastic WHERE vp > 0 AND vs > 0 AND ({_RHO}) IS NOT NULL GROUP BY well)"


@register("a03_impedance_terms", f"WITH {ELASTIC}, {_TERMS} SELECT well, ROUND(vp0, 4) AS vp0, ROUND(vs0, 4) AS vs0, ROUND(rho0, 6) AS rho0, ROUND(k, 6) AS k FROM terms")
def a03_impedance_terms(spark, sf_dir):
    return _terms(spark, sf_dir).select("well", r6("vp0", 4).alias("vp0"), r6("vs0", 4).alias("vs0"), r6("rho0").alias("rho0"), r6("k").alias("k"))


_EI = "POW(vp, 1.0 + POW(TAN(RADIANS(30.0)), 2)) * POW(vs, -8.0 * k * POW(SIN(RADIANS(30.0)), 2)) * POW(r, 1.0 - 4.0 * k * POW(SIN(RADIANS(30.0)), 2)) * POW(vp0, -POW(TAN(RADIANS(30.0)), 2)) * POW(vs0, 8.0 * k * POW(SIN(RADIANS(30.0)), 2)) * POW(rho0, 4.0 * k * POW(SIN(RADIANS(30.0)), 2))"
_EEI = "vp0 * rho0 * POW(vp / vp0, COS(RADIANS(20.0)) + SIN(RADIANS(20.0))) * POW(vs / vs0, -8.0 * k * SIN(RADIANS(20.0))) * POW(r / rho0, COS(RADIANS(20.0)) - 4.0 * k * SIN(RADIANS(20.0)))"


def _impedance(name, value, sql):
    def run(spark, sf_dir):
        rows = elastic(spark, sf_dir).join(_terms(spark, sf_dir), "well", "left")
        return rows.select("ok", "ln", r6(value(), 3).alias("value"))

    register(name, f"WITH {ELASTIC}, {_TERMS} SELECT ok, ln, ROUND(CASE WHEN vp > 0 AND vs > 0 AND r > 0 THEN {sql} END, 3) AS value FROM (SELECT *, {_RHO} AS r FROM elastic) LEFT JOIN terms USING (well)")(run)


_NAMES = ("vp0", "vs0", "rho0", "k")
_impedance("p12_elastic_impedance", lambda: petro.elastic_impedance("vp", "vs", "rho", _NAMES, 30.0), _EI)
_impedance("p13_extended_elastic_impedance", lambda: petro.extended_elastic_impedance("vp", "vs", "rho", _NAMES, 20.0), _EEI)


@register("p24_phase", "SELECT o_orderkey, UPPER(TRIM(' ' || o_orderpriority || ' ')) AS phase FROM orders")
def p24_phase(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", petro.normalise_phase(F.concat(F.lit(" "), "o_orderpriority", F.lit(" "))).alias("phase"))


@register("p25_event_kind", "SELECT o_orderkey, REPLACE(REPLACE(UPPER(TRIM(o_orderpriority)), ' ', '_'), '-', '_') AS kind FROM orders")
def p25_event_kind(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", petro.normalise_event_kind("o_orderpriority").alias("kind"))


@register("p31_curve_kind", "SELECT event_type, kind, COUNT(*) AS n FROM (SELECT event_type, CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'gamma_ray' WHEN 1 THEN 'bulk_density' WHEN 2 THEN 'sonic' WHEN 3 THEN 'gamma_ray' ELSE 'unknown' END AS kind FROM events) GROUP BY 1, 2")
def p31_curve_kind(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("event_id") % 5 + 1).cast("int"))
    kind = petro.curve_kind(pick("GR", "rhob ", "XYZ", "GR_EDT", "FOO"), pick("GAPI", "G/CC", "US/FT", "gAPI", "OHMM")).alias("kind")
    return e.select("event_type", kind).groupBy("event_type", "kind").agg(F.count("*").alias("n"))


# --- reflectivity: adjacent line items of an order are the two half-spaces


def interfaces(spark, sf_dir):
    """Every line item of an order with the next one; l_linenumber is that of the upper one."""
    x = table(spark, sf_dir, "lineitem")

    def side(k):
        r = x.select("l_orderkey", (F.col("l_linenumber") - (k - 1)).alias("l_linenumber"), "l_extendedprice", "l_quantity", "l_tax")
        return r.select("l_orderkey", "l_linenumber", (2000.0 + F.col("l_extendedprice") / 100.0).alias(f"vp{k}"), (900.0 + F.col("l_extendedprice") / 200.0 + F.col("l_quantity")).alias(f"vs{k}"), (2.0 + F.col("l_tax") * 4.0).alias(f"rho{k}"))

    return side(1).join(side(2), ["l_orderkey", "l_linenumber"])


_SIDE = "SELECT l_orderkey, l_linenumber - {k} + 1 AS l_linenumber, 2000.0 + l_extendedprice / 100.0 AS vp{k}, 900.0 + l_extendedprice / 200.0 + l_quantity AS vs{k}, 2.0 + l_tax * 4.0 AS rho{k} FROM lineitem"
_AVO = f"""WITH i AS (SELECT * FROM ({_SIDE.format(k=1)}) JOIN ({_SIDE.format(k=2)}) USING (l_orderkey, l_linenumber)),
 m AS (SELECT *, 0.5 * (vp1 + vp2) AS vp, 0.5 * (vs1 + vs2) AS vs, 0.5 * (rho1 + rho2) AS rho FROM i),
 c AS (SELECT *, (vp2 - vp1) / vp AS p, (vs2 - vs1) / vs AS s, (rho2 - rho1) / rho AS r, (vs / vp) * (vs / vp) AS g2 FROM m),
 a AS (SELECT *, RADIANS(angle) AS t, POW(SIN(RADIANS(angle)), 2) AS sin2, POW(TAN(RADIANS(angle)), 2) AS tan2 FROM c, (SELECT CAST(UNNEST([0, 10, 20, 30]) AS DOUBLE) AS angle)),
 b AS (SELECT *, CASE WHEN ABS(vp2 / vp1 * SIN(t)) <= 1 THEN 0.5 * (t + ASIN(CASE WHEN ABS(vp2 / vp1 * SIN(t)) <= 1 THEN vp2 / vp1 * SIN(t) END)) END AS mid FROM a)
 SELECT l_orderkey, l_linenumber, angle, ROUND(%s, 6) AS reflectivity FROM b"""
_G = "(0.5 * p - 2.0 * g2 * (r + 2.0 * s))"
_AVO_SQL = {
    "shuey_two_term": f"0.5 * (p + r) + {_G} * sin2",
    "shuey_three_term": f"0.5 * (p + r) + {_G} * sin2 + 0.5 * p * (tan2 - sin2)",
    "aki_richards": "0.5 * r - 2.0 * (vs / vp1) * (vs / vp1) * r * sin2 + 0.5 * p / POW(COS(mid), 2) - 4.0 * (vs / vp1) * (vs / vp1) * s * sin2",
    "aki_richards_mean_angle": f"0.5 * (p + r) + {_G} * POW(SIN(mid), 2) + 0.5 * p * (POW(TAN(mid), 2) - POW(SIN(mid), 2))",
    "fatti": "(1.0 + tan2) * (vp2 * rho2 - vp1 * rho1) / (vp2 * rho2 + vp1 * rho1) - 8.0 * g2 * sin2 * (vs2 * rho2 - vs1 * rho1) / (vs2 * rho2 + vs1 * rho1) - (0.5 * tan2 - 2.0 * g2 * sin2) * r",
    "bortfeld": "0.5 * (p + r) + 0.5 * (p - 4.0 * g2 * r - 8.0 * g2 * s) * sin2 + 0.5 * p * tan2 * sin2",
    "hilterman": "(vp2 * rho2 - vp1 * rho1) / (vp2 * rho2 + vp1 * rho1) * POW(COS(t), 2) + ((vp2 * vp2 - 2 * vs2 * vs2) / (2 * (vp2 * vp2 - vs2 * vs2)) - (vp1 * vp1 - 2 * vs1 * vs1) / (2 * (vp1 * vp1 - vs1 * vs1))) / POW(1.0 - 0.5 * ((vp2 * vp2 - 2 * vs2 * vs2) / (2 * (vp2 * vp2 - vs2 * vs2)) + (vp1 * vp1 - 2 * vs1 * vs1) / (2 * (vp1 * vp1 - vs1 * vs1))), 2) * sin2",
}
# the exact coefficient in SQL: the same equations on one row's terms
_ZOEPP = """(SELECT (f * (kb * one - kc * two) - h * q * q * (ka + kd * one * stwo)) / (e * f + g * h * q * q) FROM (SELECT *, kb * one + kc * two AS e, kb * sone + kc * stwo AS f, ka - kd * one * stwo AS g, ka - kd * two * sone AS h FROM
 (SELECT *, w2 - w1 AS ka, w2 + 2 * rho1 * f1 AS kb, w1 + 2 * rho2 * f2 AS kc, 2 * (rho2 * vs2 * vs2 - rho1 * vs1 * vs1) AS kd FROM (SELECT *, rho1 * (1 - 2 * f1) AS w1, rho2 * (1 - 2 * f2) AS w2, COS(t) / vp1 AS one, SQRT(1 - POW(q * vp2, 2)) / vp2 AS two, SQRT(1 - f1) / vs1 AS sone, SQRT(1 - f2) / vs2 AS stwo FROM
 (SELECT SIN(t) / vp1 AS q, POW(SIN(t) / vp1 * vs1, 2) AS f1, POW(SIN(t) / vp1 * vs2, 2) AS f2 WHERE ABS(SIN(t) / vp1 * vp2) <= 1)))))"""
_AVO_SQL["zoeppritz_real"] = _ZOEPP
for _i, _name in enumerate(avo.METHODS, 1):

    def _reflect(spark, sf_dir, method=_name):
        return avo.reflectivity(interfaces(spark, sf_dir), [0, 10, 20, 30], method).select("l_orderkey", "l_linenumber", "angle", r6("reflectivity").alias("reflectivity"))

    register(f"v{_i:02d}_{_name}", _AVO % _AVO_SQL[_name])(_reflect)


@register("v09_zoeppritz", _AVO % _ZOEPP + " WHERE ABS(SIN(t) / vp1 * vp2) <= 1")
def v09_zoeppritz(spark, sf_dir):
    rows = avo.reflectivity(interfaces(spark, sf_dir), [0, 10, 20, 30], "zoeppritz")
    return rows.where(F.abs(F.sin(F.radians("angle")) / F.col("vp1") * F.col("vp2")) <= 1).select("l_orderkey", "l_linenumber", "angle", r6("re").alias("reflectivity"))


# beyond the critical angle the roots turn imaginary: the same equations on pairs of real and imaginary parts
_POST = _AVO.split(" SELECT l_orderkey")[0].replace("[0, 10, 20, 30]", "[50, 70, 85]") + """,
 k AS (SELECT *, POW(SIN(t) / vp1, 2) AS pp, vs1 * vs1 AS m1, vs2 * vs2 AS m2 FROM b),
 l AS (SELECT *, rho2 * (1 - 2 * m2 * pp) - rho1 * (1 - 2 * m1 * pp) AS ka, rho2 * (1 - 2 * m2 * pp) + 2 * rho1 * m1 * pp AS kb, rho1 * (1 - 2 * m1 * pp) + 2 * rho2 * m2 * pp AS kc, 2 * (rho2 * m2 - rho1 * m1) AS kd,
  SQRT(GREATEST(0.0, 1 / (vp1 * vp1) - pp)) AS one, SQRT(GREATEST(0.0, 1 / (vp2 * vp2) - pp)) AS zr, SQRT(GREATEST(0.0, pp - 1 / (vp2 * vp2))) AS zi, SQRT(GREATEST(0.0, 1 / m1 - pp)) AS ur, SQRT(GREATEST(0.0, pp - 1 / m1)) AS ui, SQRT(GREATEST(0.0, 1 / m2 - pp)) AS wr, SQRT(GREATEST(0.0, pp - 1 / m2)) AS wi FROM k),
 n AS (SELECT *, kb * one + kc * zr AS er, kc * zi AS ei, kb * one - kc * zr AS ar, -kc * zi AS ai, kb * ur + kc * wr AS fr, kb * ui + kc * wi AS fi, ka - kd * one * wr AS gr, -kd * one * wi AS gi, ka + kd * one * wr AS cr, kd * one * wi AS ci, ka - kd * (zr * ur - zi * ui) AS hr, -kd * (zr * ui + zi * ur) AS hi FROM l),
 o AS (SELECT *, fr * ar - fi * ai - pp * (hr * cr - hi * ci) AS tr, fr * ai + fi * ar - pp * (hr * ci + hi * cr) AS ti, er * fr - ei * fi + pp * (gr * hr - gi * hi) AS dr, er * fi + ei * fr + pp * (gr * hi + gi * hr) AS di FROM n)
 SELECT l_orderkey, l_linenumber, angle, ROUND((tr * dr + ti * di) / (dr * dr + di * di), 6) AS re, ROUND((ti * dr - tr * di) / (dr * dr + di * di), 6) AS im FROM o"""


@register("v09_zoeppritz_post_critical", _POST)
def v09_zoeppritz_post_critical(spark, sf_dir):
    rows = avo.reflectivity(interfaces(spark, sf_dir), [50, 70, 85], "zoeppritz")
    return rows.select("l_orderkey", "l_linenumber", "angle", r6("re").alias("re"), r6("im").alias("im"))


def intercept_gradient(spark, sf_dir):
    i = interfaces(spark, sf_dir)
    a = avo.Interface()
    return i.select("l_orderkey", "l_linenumber", r6(a.intercept()).alias("intercept"), r6(a.gradient()).alias("gradient"))


register("v01_intercept_gradient", _AVO.replace("angle, ROUND(%s, 6) AS reflectivity FROM b", f"ROUND(0.5 * (p + r), 6) AS intercept, ROUND({_G}, 6) AS gradient FROM c"))(intercept_gradient)
