"""Coordinate transforms as column expressions: WGS84, spherical Mercator, UTM (Krueger series), tiles, distances."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH = 6378137.0
MEAN_EARTH_KM = 6371.0088
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_A = EARTH / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Coefficients of the third-order series (fixed values, from the flattening).
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:4326 to EPSG:3857."""
    return F.radians(lon) * EARTH, F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * EARTH


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """EPSG:3857 to EPSG:4326."""
    return F.degrees(x / EARTH), F.degrees(2 * F.atan(F.exp(y / EARTH)) - F.lit(math.pi / 2))


def utm_zone(lon: Column) -> Column:
    """Number of the UTM zone of a longitude."""
    return (F.floor((lon + 180) / 6) + 1).cast("int")


def utm(lon: Column, lat: Column, zone: int | Column, south: bool | Column = False) -> tuple[Column, Column]:
    """EPSG:4326 to UTM easting and northing; zone and south are values or columns."""
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(_N) / (1 + _N)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    false_north = F.when(south, 10_000_000).otherwise(0) if isinstance(south, Column) else 10_000_000 if south else 0
    return 500_000 + 0.9996 * _A * x, false_north + 0.9996 * _A * y


def from_utm(east: Column, north: Column, zone: int, south: bool = False) -> tuple[Column, Column]:
    """UTM to EPSG:4326 longitude and latitude."""
    xi, eta = (north - (10_000_000 if south else 0)) / (0.9996 * _A), (east - 500_000) / (0.9996 * _A)
    x, y = eta, xi
    for j, b in enumerate(_BETA, 1):
        x = x - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    chi = F.asin(F.sin(y) / F.cosh(x))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return (zone * 6 - 183) + F.degrees(F.atan2(F.sinh(x), F.cos(y))), F.degrees(phi)


def to_lon_lat(epsg: int, x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude from EPSG:4326, 3857, 326zz, 327zz or 258zz."""
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return from_mercator(x, y)
    if epsg // 100 in (326, 327, 258) and 1 <= epsg % 100 <= 60:
        return from_utm(x, y, epsg % 100, epsg // 100 == 327)
    raise ValueError(f"unsupported coordinate system: EPSG:{epsg}")


def from_lon_lat(epsg: int, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude to EPSG:4326, 3857, 326zz, 327zz or 258zz."""
    if epsg == 4326:
        return lon, lat
    if epsg == 3857:
        return mercator(lon, lat)
    if epsg // 100 in (326, 327, 258) and 1 <= epsg % 100 <= 60:
        return utm(lon, lat, epsg % 100, epsg // 100 == 327)
    raise ValueError(f"unsupported coordinate system: EPSG:{epsg}")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * MEAN_EARTH_KM * F.asin(F.sqrt(a))


def tile_key(lon: Column, lat: Column, zoom: Column | int) -> tuple[Column, Column]:
    """x and y of the map tile at a zoom, kept inside the square of tiles."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n)
    keep = lambda v: F.greatest(F.lit(0), F.least((n - 1).cast("long"), v))
    return keep(x), keep(y)


def metres_tolerance(radius: Column | float, y: Column) -> Column:
    """A radius in metres as Mercator units at y."""
    return radius * F.cosh(y / EARTH)
