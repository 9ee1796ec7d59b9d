"""Projected coordinates: a catalogue of transverse Mercator systems by rule, and reprojection as Column arithmetic.

Datums count as equal: between WGS 84 and ETRS89 the difference is below a metre.  Grid shifts and other projections
need a library that isn't there.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening (fixed values).
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)
SCALE, EASTING, SOUTHING = 0.9996, 500_000.0, 10_000_000.0


@dataclass(frozen=True)
class System:
    """A geographic (zone 0) or universal transverse Mercator system."""

    code: int
    name: str
    ellipsoid: tuple[float, float]
    zone: int = 0
    south: bool = False

    @property
    def meridian(self) -> float:
        return self.zone * 6.0 - 183.0


def _systems() -> dict[int, System]:
    out = [System(4326, "WGS 84", WGS84), System(4258, "ETRS89", GRS80), System(4269, "NAD83", GRS80)]
    for zone in range(1, 61):
        out += [System(32600 + zone, f"WGS 84 / UTM zone {zone}N", WGS84, zone), System(32700 + zone, f"WGS 84 / UTM zone {zone}S", WGS84, zone, True)]
    out += [System(25800 + zone, f"ETRS89 / UTM zone {zone}N", GRS80, zone) for zone in range(28, 39)]
    out += [System(26900 + zone, f"NAD83 / UTM zone {zone}N", GRS80, zone) for zone in range(1, 24)]
    return {s.code: s for s in out}


SYSTEMS = _systems()


def resolve(code: int | str) -> System:
    """The system of a code such as 32631 or 'EPSG:32631'."""
    number = int(str(code).strip().upper().removeprefix("EPSG:"))
    if number not in SYSTEMS:
        raise KeyError(f"no system EPSG:{number}")
    return SYSTEMS[number]


def catalogue(spark: SparkSession) -> DataFrame:
    """(code, name, kind, zone, south) of all systems."""
    rows = [(s.code, s.name, "projected" if s.zone else "geographic", s.zone, s.south) for s in SYSTEMS.values()]
    return spark.createDataFrame(rows, "code int, name string, kind string, zone int, south boolean")


def search(systems: DataFrame, text: str) -> DataFrame:
    """Systems whose name has every word of the text, or whose code it is; by code."""
    words = text.lower().removeprefix("epsg:").split()
    hit = F.lit(True)
    for w in words:
        hit = hit & (F.lower("name").contains(w) | (F.col("code").cast("string") == w))
    return systems.where(hit).orderBy("code")


def _series(ellipsoid: tuple[float, float]) -> tuple[float, float, list[float], list[float], list[float]]:
    """Third flattening, rectifying radius, and Krueger's series (forward, inverse, conformal to geographic latitude)."""
    a, f = ellipsoid[0], 1 / ellipsoid[1]
    n = f / (2 - f)
    n2, n3, n4 = n * n, n**3, n**4
    alpha = [n / 2 - 2 * n2 / 3 + 5 * n3 / 16 + 41 * n4 / 180, 13 * n2 / 48 - 3 * n3 / 5 + 557 * n4 / 1440, 61 * n3 / 240 - 103 * n4 / 140, 49561 * n4 / 161280]
    beta = [n / 2 - 2 * n2 / 3 + 37 * n3 / 96 - n4 / 360, n2 / 48 + n3 / 15 - 437 * n4 / 1440, 17 * n3 / 480 - 37 * n4 / 840, 4397 * n4 / 161280]
    delta = [2 * n - 2 * n2 / 3 - 2 * n3 + 116 * n4 / 45, 7 * n2 / 3 - 8 * n3 / 5 - 227 * n4 / 45, 56 * n3 / 15 - 136 * n4 / 35, 4279 * n4 / 630]
    return n, a / (1 + n) * (1 + n2 / 4 + n4 / 64), alpha, beta, delta


def project(rows: DataFrame, system: System, lon: str, lat: str, x: str, y: str) -> DataFrame:
    """rows with x and y (m) of longitude and latitude (degrees) in a transverse Mercator system."""
    n, radius, alpha, _, _ = _series(system.ellipsoid)
    c = 2 * n**0.5 / (1 + n)
    sine = F.sin(F.radians(lat))
    rows = rows.withColumns({"__t": F.sinh(F.atanh(sine) - c * F.atanh(c * sine)), "__l": F.radians(F.col(lon) - system.meridian)})
    t, away = F.col("__t"), F.col("__l")
    rows = rows.withColumns({"__u": F.atan2(t, F.cos(away)), "__v": F.atanh(F.sin(away) / F.sqrt(1 + t * t))})
    u, v = F.col("__u"), F.col("__v")
    east, north = v, u
    for j, k in enumerate(alpha, 1):
        east, north = east + k * F.cos(2 * j * u) * F.sinh(2 * j * v), north + k * F.sin(2 * j * u) * F.cosh(2 * j * v)
    rows = rows.withColumns({x: EASTING + SCALE * radius * east, y: (SOUTHING if system.south else 0.0) + SCALE * radius * north})
    return rows.drop("__t", "__l", "__u", "__v")


def unproject(rows: DataFrame, system: System, x: str, y: str, lon: str, lat: str) -> DataFrame:
    """rows with longitude and latitude (degrees) of x and y (m)."""
    _, radius, _, beta, delta = _series(system.ellipsoid)
    rows = rows.withColumns({"__v": (F.col(x) - EASTING) / (SCALE * radius), "__u": (F.col(y) - (SOUTHING if system.south else 0.0)) / (SCALE * radius)})
    u, v = F.col("__u"), F.col("__v")
    a, b = u, v
    for j, k in enumerate(beta, 1):
        a, b = a - k * F.sin(2 * j * u) * F.cosh(2 * j * v), b - k * F.cos(2 * j * u) * F.sinh(2 * j * v)
    rows = rows.withColumns({"__a": a, "__b": b}).withColumn("__c", F.asin(F.sin("__a") / F.cosh("__b")))
    latitude = F.col("__c")
    for j, k in enumerate(delta, 1):
        latitude = latitude + k * F.sin(2 * j * F.col("__c"))
    rows = rows.withColumns({lon: system.meridian + F.degrees(F.atan2(F.sinh("__b"), F.cos("__a"))), lat: F.degrees(latitude)})
    return rows.drop("__u", "__v", "__a", "__b", "__c")


def reproject(rows: DataFrame, source: int | str, target: int | str, x: str = "x", y: str = "y") -> DataFrame:
    """rows with x and y (longitude and latitude in geographic systems) moved from one system to another."""
    a, b = resolve(source), resolve(target)
    if a == b:
        return rows
    if a.zone:
        rows = unproject(rows, a, x, y, x, y)
    return project(rows, b, x, y, x, y) if b.zone else rows


