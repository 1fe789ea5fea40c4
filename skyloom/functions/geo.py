"""Distances and map projections."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in metres, WGS84 ellipsoid, UTM scale and offsets, valid EPSG range.
EARTH_RADIUS_M = 6_371_008.8
WGS84_A, WGS84_F = 6_378_137.0, 1 / 298.257223563
UTM_K0, UTM_E0, UTM_N0_SOUTH = 0.9996, 500_000.0, 10_000_000.0
EPSG_RANGE = (1024, 32767)

_N = WGS84_F / (2 - WGS84_F)
ECCENTRICITY = 2 * math.sqrt(_N) / (1 + _N)
RECTIFYING = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Krüger's series up to the fourth power of the third flattening.
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres between points in degrees."""
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), F.lit(2)) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2))
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.when(a > 1, F.lit(1.0)).otherwise(F.sqrt(a)))  # least() would skip a null


def utm_zone(lon: Column) -> Column:
    """UTM zone 1..60 of a longitude; regular zones everywhere."""
    return (F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + utm_zone(lon)).cast("int")


def checked_epsg(epsg: Column) -> Column:
    """epsg, or an error outside the valid range."""
    return F.when(epsg.between(*EPSG_RANGE), epsg).otherwise(F.raise_error(F.concat(F.lit("EPSG code out of range: "), epsg.cast("string"))).cast("int"))


def _utm_frame(epsg: Column) -> tuple[Column, Column]:
    """Central meridian in degrees and false northing; errors for any EPSG that is not WGS84 UTM."""
    zone = epsg % 100
    is_utm = (epsg.between(32601, 32660)) | (epsg.between(32701, 32760))
    meridian = F.when(is_utm, zone * 6 - 183).otherwise(F.raise_error(F.concat(F.lit("not a WGS84 UTM code: "), F.coalesce(epsg.cast("string"), F.lit("null")))).cast("int"))
    return meridian.cast("double"), F.when(epsg >= 32700, F.lit(UTM_N0_SOUTH)).otherwise(F.lit(0.0))


def isometric(lat: Column) -> Column:
    """Isometric latitude of degrees on the ellipsoid; infinite at the poles."""
    s = F.sin(F.radians(lat))
    return F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s)


def geodetic(chi: Column) -> Column:
    """Degrees of a conformal latitude in radians."""
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(lat)


def transverse(d: Column, psi: Column) -> tuple[Column, Column]:
    """(x, y) in rectifying radii of a longitude from the meridian, in radians, and an isometric latitude."""
    t = F.sinh(psi)
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return x, y


def inverse_transverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude from the meridian and conformal latitude, in radians."""
    xi, eta = y, x
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * y) * F.cosh(2 * j * x)
        eta = eta - b * F.cos(2 * j * y) * F.sinh(2 * j * x)
    return F.atan2(F.sinh(eta), F.cos(xi)), F.asin(F.sin(xi) / F.cosh(eta))


def project_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres."""
    meridian, north0 = _utm_frame(epsg)
    x, y = transverse(F.radians(lon - meridian), isometric(lat))
    return F.lit(UTM_E0) + UTM_K0 * RECTIFYING * x, north0 + UTM_K0 * RECTIFYING * y


def unproject_utm(easting: Column, northing: Column, epsg: Column) -> tuple[Column, Column]:
    """(lon, lat) in degrees."""
    meridian, north0 = _utm_frame(epsg)
    scale = UTM_K0 * RECTIFYING
    d, chi = inverse_transverse((easting - UTM_E0) / scale, (northing - north0) / scale)
    return meridian + F.degrees(d), geodetic(chi)


def dms_to_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees of an EXIF triple; south and west are negative."""
    value = d + m / 60 + s / 3600
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)
