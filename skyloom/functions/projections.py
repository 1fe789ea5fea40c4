"""Map projections by EPSG code, as column expressions.

Transverse Mercator of any meridian, Lambert conic with two parallels, polar
stereographic and Mercator.  Codes beyond the table are an error.  Each system
is reduced to a few constants beforehand.  With one code the expressions are
those of its family alone; rows of many systems meet their constants in a broadcast
join with the table of systems, which has a fixed number of rows.  ETRS89, NAD83 and GDA94 are taken
as WGS84, which they equal to within a metre or two; their ellipsoid's axis differs by a
tenth of a millimetre.  Null in gives null out; a pole, or a longitude opposite
to the meridian, gives what the formulas give there (for Mercator: infinity).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import ECCENTRICITY, RECTIFYING, UTM_E0, UTM_K0, UTM_N0_SOUTH, WGS84_A, geodetic, inverse_transverse, isometric, transverse

# Defining parameters of the systems.
# code: (central meridian, latitude of origin, scale, false easting, false northing)
TRANSVERSE = {
    2193: (173.0, 0.0, 0.9996, 1_600_000.0, 10_000_000.0),
    3006: (15.0, 0.0, 0.9996, 500_000.0, 0.0),
    3763: (-8.133108333333334, 39.66825833333333, 1.0, 0.0, 0.0),
    5179: (127.5, 38.0, 0.9996, 1_000_000.0, 2_000_000.0),
}
# code: (central meridian, latitude of origin, first and second parallel, false easting, false northing)
CONIC = {
    2154: (3.0, 46.5, 49.0, 44.0, 700_000.0, 6_600_000.0),
    3034: (10.0, 52.0, 35.0, 65.0, 4_000_000.0, 2_800_000.0),
    3347: (-91.86666666666666, 63.390675, 49.0, 77.0, 6_200_000.0, 3_000_000.0),
    7755: (80.0, 24.0, 12.472955, 35.1728044444444, 4_000_000.0, 4_000_000.0),
}
# code: (meridian, latitude of true scale, false easting, false northing)
POLAR = {3031: (0.0, -71.0, 0.0, 0.0), 3413: (-45.0, 70.0, 0.0, 0.0), 3995: (0.0, 71.0, 0.0, 0.0)}
# code: (meridian, pole, scale at the pole, false easting, false northing)
UNIVERSAL_POLAR = {32661: (0.0, 1, 0.994, 2_000_000.0, 2_000_000.0), 32761: (0.0, -1, 0.994, 2_000_000.0, 2_000_000.0)}
# code: whether the ellipsoid counts
MERCATOR = {3395: True, 3857: False}
# zones: (first code, last code, first zone, false northing)
ZONES = ((32601, 32660, 1, 0.0), (32701, 32760, 1, UTM_N0_SOUTH), (25828, 25838, 28, 0.0), (26901, 26923, 1, 0.0), (28348, 28358, 48, UTM_N0_SOUTH))


@dataclass(frozen=True)
class System:
    """kind, meridian, offsets, and the constants a, b, c of its kind.

    tm: a = scale in metres, b = ordinate of the origin in those.
    lcc: a = exponent, b = radius at the equator, c = radius at the origin.
    polar: a = 1 or -1 for the pole, b = metres for each exp(-isometric latitude).
    mercator: a = 1 on the ellipsoid, 0 on the sphere.
    """

    kind: str
    meridian: float
    e0: float
    n0: float
    a: float
    b: float = 0.0
    c: float = 0.0


def _psi(lat: float) -> float:
    s = math.sin(math.radians(lat))
    return math.atanh(s) - ECCENTRICITY * math.atanh(ECCENTRICITY * s)


def _parallel(lat: float) -> float:
    """Radius of a parallel in semi-major axes."""
    s = math.sin(math.radians(lat))
    return math.cos(math.radians(lat)) / math.sqrt(1 - (ECCENTRICITY * s) ** 2)


def _meridian_ordinate(lat: float) -> float:
    from .geo import _ALPHA

    xi = math.atan(math.sinh(_psi(lat)))
    return xi + sum(a * math.sin(2 * j * xi) for j, a in enumerate(_ALPHA, 1))


def _conic(meridian, lat0, lat1, lat2, e0, n0) -> System:
    n = (math.log(_parallel(lat1)) - math.log(_parallel(lat2))) / (_psi(lat2) - _psi(lat1))
    radius = WGS84_A * _parallel(lat1) / n * math.exp(n * _psi(lat1))
    return System("lcc", meridian, e0, n0, n, radius, radius * math.exp(-n * _psi(lat0)))


def _polar_unit() -> float:
    """Metres for each exp(-isometric latitude) at scale one at the pole."""
    e = ECCENTRICITY
    return 2 * WGS84_A / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))


def _systems() -> dict[int, System]:
    out = {code: System("tm", m, e0, n0, k * RECTIFYING, _meridian_ordinate(lat0)) for code, (m, lat0, k, e0, n0) in TRANSVERSE.items()}
    for first, last, zone, n0 in ZONES:
        out |= {code: System("tm", 6.0 * (zone + code - first) - 183, UTM_E0, n0, UTM_K0 * RECTIFYING) for code in range(first, last + 1)}
    out |= {code: _conic(*p) for code, p in CONIC.items()}
    for code, (m, lat, e0, n0) in POLAR.items():
        out[code] = System("polar", m, e0, n0, math.copysign(1, lat), WGS84_A * _parallel(lat) * math.exp(_psi(abs(lat))))
    out |= {code: System("polar", m, e0, n0, pole, k * _polar_unit()) for code, (m, pole, k, e0, n0) in UNIVERSAL_POLAR.items()}
    out |= {code: System("mercator", 0.0, 0.0, 0.0, float(on)) for code, on in MERCATOR.items()}
    return out


SYSTEMS = _systems()


CONSTANTS = ("meridian", "e0", "n0", "a", "b", "c")


def turned(degrees: Column) -> Column:
    """Degrees within -180 and 180."""
    return F.when(degrees.between(-180.0, 180.0), degrees).otherwise(F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0)


def _system(epsg: int) -> tuple[str, dict[str, Column]]:
    if epsg not in SYSTEMS:
        raise ValueError(f"no projection of this code: {epsg}")
    return SYSTEMS[epsg].kind, {n: F.lit(float(getattr(SYSTEMS[epsg], n))) for n in CONSTANTS}


def _forward(kind: str, d: Column, lat: Column, k: dict[str, Column]) -> tuple[Column, Column]:
    """Metres, without the false origin, of radians from the meridian and degrees."""
    psi = isometric(lat)
    if kind == "tm":
        x, y = transverse(d, psi)
        return k["a"] * x, k["a"] * (y - k["b"])
    if kind == "mercator":
        return WGS84_A * d, WGS84_A * F.when(k["a"] > 0, psi).otherwise(F.atanh(F.sin(F.radians(lat))))
    radius = k["b"] * F.exp(-k["a"] * psi)  # of a cone, or of a polar plane
    if kind == "lcc":
        return radius * F.sin(k["a"] * d), k["c"] - radius * F.cos(k["a"] * d)
    return radius * F.sin(d), -k["a"] * radius * F.cos(d)


def _inverse(kind: str, e: Column, n: Column, k: dict[str, Column]) -> tuple[Column, Column]:
    """Radians from the meridian, and degrees of latitude."""
    if kind == "tm":
        d, chi = inverse_transverse(e / k["a"], n / k["a"] + k["b"])
        return d, geodetic(chi)
    if kind == "mercator":
        chi = F.atan(F.sinh(n / WGS84_A))
        return e / WGS84_A, F.when(k["a"] > 0, geodetic(chi)).otherwise(F.degrees(chi))
    if kind == "lcc":
        down, sign = k["c"] - n, F.signum(k["a"])
        psi = F.log(F.sqrt(e * e + down * down) / F.abs(k["b"])) / -k["a"]
        return F.atan2(sign * e, sign * down) / k["a"], geodetic(F.atan(F.sinh(psi)))
    psi = F.log(F.sqrt(e * e + n * n) / k["b"]) * -k["a"]
    return F.atan2(e, -k["a"] * n), geodetic(F.atan(F.sinh(psi)))


def project(lon: Column, lat: Column, epsg: int) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees."""
    kind, k = _system(epsg)
    x, y = _forward(kind, F.radians(turned(lon - k["meridian"])), lat, k)
    return k["e0"] + x, k["n0"] + y


def unproject(easting: Column, northing: Column, epsg: int) -> tuple[Column, Column]:
    """(lon, lat) in degrees of metres."""
    kind, k = _system(epsg)
    d, lat = _inverse(kind, easting - k["e0"], northing - k["n0"], k)
    return turned(k["meridian"] + F.degrees(d)), lat


def _with_system(df: DataFrame, epsg: str) -> tuple[DataFrame, Column, dict[str, Column]]:
    """Rows with their system in __s; a code that has none is an error."""
    rows = [(code, (s.kind, *(float(getattr(s, n)) for n in CONSTANTS))) for code, s in SYSTEMS.items()]
    systems = df.sparkSession.createDataFrame(rows, f"__code int, __s struct<kind:string,{','.join(f'{n}:double' for n in CONSTANTS)}>")
    joined = df.join(F.broadcast(systems), F.col(epsg).cast("int") == F.col("__code"), "left")
    unknown = F.raise_error(F.concat(F.lit("no projection of this code: "), F.coalesce(F.col(epsg).cast("string"), F.lit("null"))))
    return joined, F.coalesce(F.col("__s.kind"), unknown.cast("string")), {n: F.col(f"__s.{n}") for n in CONSTANTS}


def _chosen(kind: Column, cases: dict[str, tuple[Column, Column]], i: int) -> Column:
    out = F
    for name, c in cases.items():
        out = out.when(kind == name, c[i])
    return out


KINDS = ("tm", "lcc", "polar", "mercator")


def project_rows(df: DataFrame, lon: str, lat: str, epsg: str, east: str = "easting", north: str = "northing") -> DataFrame:
    """df with metres, each row in the system of its own code."""
    joined, kind, k = _with_system(df, epsg)
    joined = joined.withColumns({"__kind": kind, "__d": F.radians(turned(F.col(lon) - k["meridian"]))})
    cases = {name: _forward(name, F.col("__d"), F.col(lat), k) for name in KINDS}
    metres = joined.withColumns({east: k["e0"] + _chosen(F.col("__kind"), cases, 0), north: k["n0"] + _chosen(F.col("__kind"), cases, 1)})
    return metres.drop("__code", "__s", "__kind", "__d")


def unproject_rows(df: DataFrame, east: str, north: str, epsg: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """df with degrees, each row from the system of its own code."""
    joined, kind, k = _with_system(df, epsg)
    joined = joined.withColumns({"__kind": kind, "__e": F.col(east) - k["e0"], "__n": F.col(north) - k["n0"]})
    cases = {name: _inverse(name, F.col("__e"), F.col("__n"), k) for name in KINDS}
    degrees = joined.withColumns({lon: turned(k["meridian"] + F.degrees(_chosen(F.col("__kind"), cases, 0))), lat: _chosen(F.col("__kind"), cases, 1)})
    return degrees.drop("__code", "__s", "__kind", "__e", "__n")
