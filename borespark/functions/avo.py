"""Reflectivity of P waves at an interface against the angle of incidence, as Column expressions.

A model is a half-space pair (vp1, vs1, rho1) over (vp2, vs2, rho2); angles are in degrees, in [0, 90).
Every function gives NULL where the medium or the angle makes no sense (missing, non-positive, beyond the
critical angle); ``strict`` of the caller turns that into an error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borespark.functions.petro import EPSILON, C, col

NAMES = ("vp1", "vs1", "rho1", "vp2", "vs2", "rho2")


class Interface:
    """Contrasts and means of a half-space pair."""

    def __init__(self, *columns: C):
        self.vp1, self.vs1, self.rho1, self.vp2, self.vs2, self.rho2 = (col(c) for c in (columns or NAMES))
        self.vp1, self.vp2 = (F.nullif(v, F.lit(0.0)) for v in (self.vp1, self.vp2))
        self.vp, self.vs, self.rho = (0.5 * (a + b) for a, b in ((self.vp1, self.vp2), (self.vs1, self.vs2), (self.rho1, self.rho2)))
        # relative contrasts
        self.p, self.s, self.r = (self.vp2 - self.vp1) / self.vp, (self.vs2 - self.vs1) / self.vs, (self.rho2 - self.rho1) / self.rho
        self.g2 = (self.vs / self.vp) * (self.vs / self.vp)
        self.sound = (self.vp > 0) & (self.vs > 0) & (self.rho > 0)

    def intercept(self) -> Column:
        return 0.5 * (self.p + self.r)

    def gradient(self) -> Column:
        return 0.5 * self.p - 2.0 * self.g2 * (self.r + 2.0 * self.s)


def _sin2(a: Column) -> Column:
    return F.sin(a) * F.sin(a)


def _tan2(a: Column) -> Column:
    return F.tan(a) * F.tan(a)


def _asin(x: Column) -> Column:
    """The arc sine, NULL beyond 1 but for rounding."""
    return F.when(F.abs(x) <= 1.0 + 1e-12, F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))


def shuey_two_term(i: Interface, angle: Column) -> Column:
    return F.when(i.sound, i.intercept() + i.gradient() * _sin2(F.radians(angle)))


def shuey_three_term(i: Interface, angle: Column) -> Column:
    a = F.radians(angle)
    return F.when(i.sound, i.intercept() + i.gradient() * _sin2(a) + 0.5 * i.p * (_tan2(a) - _sin2(a)))


def aki_richards(i: Interface, angle: Column) -> Column:
    """Angle at the boundary by Snell's law; the shear terms use Vs over the upper Vp."""
    a = F.radians(angle)
    mean = 0.5 * (a + _asin(i.vp2 / i.vp1 * F.sin(a)))
    cos2, ratio = F.cos(mean) * F.cos(mean), (i.vs / i.vp1) * (i.vs / i.vp1)
    value = 0.5 * i.r - 2.0 * ratio * i.r * _sin2(a) + 0.5 * i.p / cos2 - 4.0 * ratio * i.s * _sin2(a)
    return F.when(i.sound & (i.vp1 > 0) & (cos2 > EPSILON), value)


def aki_richards_mean_angle(i: Interface, angle: Column) -> Column:
    a = F.radians(angle)
    mean = 0.5 * (a + _asin(i.vp2 / i.vp1 * F.sin(a)))
    return F.when(i.sound & (i.vp1 > 0), i.intercept() + i.gradient() * _sin2(mean) + 0.5 * i.p * (_tan2(mean) - _sin2(mean)))


def fatti(i: Interface, angle: Column) -> Column:
    a = F.radians(angle)
    z1, z2, s1, s2 = i.vp1 * i.rho1, i.vp2 * i.rho2, i.vs1 * i.rho1, i.vs2 * i.rho2
    value = (1.0 + _tan2(a)) * (z2 - z1) / (z2 + z1) - 8.0 * i.g2 * _sin2(a) * (s2 - s1) / (s2 + s1) - (0.5 * _tan2(a) - 2.0 * i.g2 * _sin2(a)) * i.r
    return F.when(i.sound & (F.abs(z1 + z2) > EPSILON) & (F.abs(s1 + s2) > EPSILON), value)


def bortfeld(i: Interface, angle: Column) -> Column:
    a, k = F.radians(angle), 4.0 * i.g2
    return F.when(i.sound, i.intercept() + 0.5 * (i.p - k * i.r - 2.0 * k * i.s) * _sin2(a) + 0.5 * i.p * _tan2(a) * _sin2(a))


def _poisson(vp: Column, vs: Column) -> Column:
    below = 2.0 * (vp * vp - vs * vs)
    return F.when(F.abs(below) > EPSILON, (vp * vp - 2.0 * vs * vs) / below)


def hilterman(i: Interface, angle: Column) -> Column:
    a, z1, z2 = F.radians(angle), i.vp1 * i.rho1, i.vp2 * i.rho2
    n1, n2 = _poisson(i.vp1, i.vs1), _poisson(i.vp2, i.vs2)
    rest = 1.0 - 0.5 * (n1 + n2)
    value = (z2 - z1) / (z2 + z1) * F.cos(a) * F.cos(a) + (n2 - n1) / (rest * rest) * _sin2(a)
    return F.when((F.abs(z1 + z2) > EPSILON) & (rest * rest > EPSILON), value)


def zoeppritz_real(i: Interface, angle: Column) -> Column:
    """The exact PP coefficient below every critical angle."""
    a = F.radians(angle)
    p = F.sin(a) / i.vp1
    p2 = p * p
    t2, f1, f2 = _asin(p * i.vp2), _asin(p * i.vs1), _asin(p * i.vs2)
    one, two = F.cos(a) / i.vp1, F.cos(t2) / i.vp2
    sone, stwo = F.try_divide(F.cos(f1), i.vs1), F.try_divide(F.cos(f2), i.vs2)
    w1, w2 = i.rho1 * (1.0 - 2.0 * _sin2(f1)), i.rho2 * (1.0 - 2.0 * _sin2(f2))
    ka, kb, kc = w2 - w1, w2 + 2.0 * i.rho1 * _sin2(f1), w1 + 2.0 * i.rho2 * _sin2(f2)
    kd = 2.0 * (i.rho2 * i.vs2 * i.vs2 - i.rho1 * i.vs1 * i.vs1)
    e, f = kb * one + kc * two, kb * sone + kc * stwo
    g, h = ka - kd * one * stwo, ka - kd * two * sone
    below = e * f + g * h * p2
    return F.when(F.abs(below) > EPSILON, (f * (kb * one - kc * two) - h * p2 * (ka + kd * one * stwo)) / below)


class Complex:
    """A complex number of two Columns; just what the exact coefficient needs."""

    def __init__(self, re: Column, im: Column | None = None):
        self.re, self.im = re, F.lit(0.0) if im is None else im

    def __add__(self, o):
        return Complex(self.re + o.re, self.im + o.im)

    def __sub__(self, o):
        return Complex(self.re - o.re, self.im - o.im)

    def __mul__(self, o):
        return Complex(self.re * o.re - self.im * o.im, self.re * o.im + self.im * o.re)

    def __truediv__(self, o):
        size = o.re * o.re + o.im * o.im
        return Complex((self.re * o.re + self.im * o.im) / size, (self.im * o.re - self.re * o.im) / size)

    @staticmethod
    def root(x: Column) -> Complex:
        """The principal square root of a real number."""
        return Complex(F.when(x >= 0, F.sqrt(F.abs(x))).otherwise(0.0), F.when(x < 0, F.sqrt(F.abs(x))).otherwise(0.0))


def with_zoeppritz(rows: DataFrame, angle: str = "angle") -> DataFrame:
    """rows with re and im of the exact PP coefficient at any angle; a fluid's shear velocity counts as 0.1.

    Terms are named columns, stage by stage, so that none is computed (or compiled) twice.
    """
    i = Interface()
    own = rows.columns
    vs1, vs2 = (F.when(v <= 1e-6, 0.1).otherwise(v) for v in (i.vs1, i.vs2))
    rows = rows.withColumns({"__m1": vs1 * vs1, "__m2": vs2 * vs2, "__p2": F.pow(F.sin(F.radians(angle)) / i.vp1, F.lit(2.0))})
    m1, m2, p2 = F.col("__m1"), F.col("__m2"), F.col("__p2")
    w1, w2 = i.rho1 * (1.0 - 2.0 * m1 * p2), i.rho2 * (1.0 - 2.0 * m2 * p2)
    stage = {"__a": w2 - w1, "__b": w2 + 2.0 * i.rho1 * m1 * p2, "__c": w1 + 2.0 * i.rho2 * m2 * p2, "__d": 2.0 * (i.rho2 * m2 - i.rho1 * m1)}
    for name, square in (("z1", i.vp1 * i.vp1), ("z2", i.vp2 * i.vp2), ("j1", m1), ("j2", m2)):
        stage[f"__{name}"] = 1.0 / square - p2  # its root is real or imaginary
    rows = rows.withColumns(stage)
    a, b, c, d = (Complex(F.col(f"__{n}")) for n in "abcd")
    z1, z2, j1, j2 = (Complex.root(F.col(f"__{n}")) for n in ("z1", "z2", "j1", "j2"))
    rows = _named(rows, {"bz": b * z1, "cz": c * z2, "f": b * j1 + c * j2, "dzj": d * z1 * j2, "h": a - d * z2 * j1})
    bz, cz, f, dzj, h = (_pair(n) for n in ("bz", "cz", "f", "dzj", "h"))
    rows = _named(rows, {"below": (bz + cz) * f + (a - dzj) * h * Complex(p2), "top": (bz - cz) * f - (a + dzj) * h * Complex(p2)})
    below = _pair("below")
    out, sound = _pair("top") / below, (F.abs(below.re) > EPSILON) | (F.abs(below.im) > EPSILON)
    return rows.select(*own, F.when(sound, out.re).alias("re"), F.when(sound, out.im).alias("im"))


def _named(rows: DataFrame, values: dict[str, Complex]) -> DataFrame:
    return rows.withColumns({f"__{n}_{part}": getattr(v, part) for n, v in values.items() for part in ("re", "im")})


def _pair(name: str) -> Complex:
    return Complex(F.col(f"__{name}_re"), F.col(f"__{name}_im"))


METHODS: dict[str, Callable[[Interface, Column], Column]] = {
    "shuey_two_term": shuey_two_term, "shuey_three_term": shuey_three_term, "aki_richards": aki_richards, "aki_richards_mean_angle": aki_richards_mean_angle,
    "fatti": fatti, "bortfeld": bortfeld, "hilterman": hilterman, "zoeppritz_real": zoeppritz_real,
}


def reflectivity(interfaces: DataFrame, angles: list[float], method: str = "shuey_two_term", strict: bool = False) -> DataFrame:
    """interfaces with a row per angle: angle, reflectivity (re and im for ``zoeppritz``)."""
    if any(not 0.0 <= a < 90.0 for a in angles):
        raise ValueError("angles are in [0, 90)")
    rows = interfaces.withColumn("angle", F.explode(F.array(*[F.lit(float(a)) for a in angles])))
    if method == "zoeppritz":
        return with_zoeppritz(rows)
    value = METHODS[method](Interface(), F.col("angle"))
    if strict:
        value = F.when(value.isNull(), F.raise_error(F.lit(f"{method}: no reflectivity for this medium and angle"))).otherwise(value)
    return rows.withColumn("reflectivity", value)
