"""EPSG:4326, 3857 and UTM (326xx, 327xx) in closed form, for numbers and for Columns."""

from __future__ import annotations

import math
from types import SimpleNamespace

from pyspark.sql import functions as F

from ..errors import CrsMismatch
from ..sources.extent import parse_crs

_NUMBERS = SimpleNamespace(sin=math.sin, cos=math.cos, tan=math.tan, atan=math.atan, atan2=math.atan2, asin=math.asin, sinh=math.sinh, cosh=math.cosh, atanh=math.atanh, asinh=math.asinh, exp=math.exp, log=math.log)
_COLUMNS = SimpleNamespace(sin=F.sin, cos=F.cos, tan=F.tan, atan=F.atan, atan2=F.atan2, asin=F.asin, sinh=F.sinh, cosh=F.cosh, atanh=F.atanh, asinh=F.asinh, exp=F.exp, log=F.log)

# WGS 84, the UTM scale and offsets, and the Krueger series of third order in the third flattening.
A, FLAT = 6378137.0, 1 / 298.257223563
K0, EAST, SOUTH = 0.9996, 500000.0, 10000000.0
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _utm_zone(epsg: int) -> tuple[float, float] | None:
    """(central meridian in radians, false northing) of a UTM code."""
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return math.radians((epsg % 100) * 6 - 183), SOUTH if epsg >= 32700 else 0.0
    return None


def to_geographic(x, y, crs: object, m=_NUMBERS):
    """(longitude, latitude) in degrees."""
    epsg = parse_crs(crs)
    if epsg == 4326:
        return x, y
    if epsg == 3857:
        return x * (180 / math.pi / A), m.atan(m.sinh(y * (1 / A))) * (180 / math.pi)
    zone = _utm_zone(epsg)
    if not zone:
        raise CrsMismatch(f"EPSG:{epsg} is not supported")
    xi, eta = (y - zone[1]) * (1 / (K0 * _RADIUS)), (x - EAST) * (1 / (K0 * _RADIUS))
    xi1, eta1 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi1 = xi1 - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        eta1 = eta1 - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    chi = m.asin(m.sin(xi1) / m.cosh(eta1))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + m.sin(chi * (2 * j)) * d
    lam = m.atan2(m.sinh(eta1), m.cos(xi1)) + zone[0]
    return lam * (180 / math.pi), phi * (180 / math.pi)


def from_geographic(lon, lat, crs: object, m=_NUMBERS):
    epsg = parse_crs(crs)
    if epsg == 4326:
        return lon, lat
    lam, phi = lon * (math.pi / 180), lat * (math.pi / 180)
    if epsg == 3857:
        return lam * A, m.asinh(m.tan(phi)) * A
    zone = _utm_zone(epsg)
    if not zone:
        raise CrsMismatch(f"EPSG:{epsg} is not supported")
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = m.sinh(m.atanh(m.sin(phi)) - m.atanh(m.sin(phi) * e) * e)
    xi1, eta1 = m.atan2(t, m.cos(lam - zone[0])), m.asinh(m.sin(lam - zone[0]) / (m.cos(lam - zone[0]) * m.cos(lam - zone[0]) + t * t) ** 0.5)
    xi, eta = xi1, eta1
    for j, a in enumerate(_ALPHA, 1):
        xi = xi + m.sin(xi1 * (2 * j)) * m.cosh(eta1 * (2 * j)) * a
        eta = eta + m.cos(xi1 * (2 * j)) * m.sinh(eta1 * (2 * j)) * a
    return eta * (K0 * _RADIUS) + EAST, xi * (K0 * _RADIUS) + zone[1]


def project(x: float, y: float, source: object, target: object) -> tuple[float, float]:
    if parse_crs(source) == parse_crs(target):
        return x, y
    return from_geographic(*to_geographic(x, y, source), target)


def project_columns(x, y, source: object, target: object):
    if parse_crs(source) == parse_crs(target):
        return x, y
    return from_geographic(*to_geographic(x, y, source, _COLUMNS), target, _COLUMNS)


def project_bbox(bbox: dict, crs: object) -> tuple[float, float, float, float]:
    """(west, south, east, north) of the bbox's corners in ``crs``."""
    corners = [project(x, y, bbox.get("crs", 4326), crs) for x in (bbox["west"], bbox["east"]) for y in (bbox["south"], bbox["north"])]
    xs, ys = zip(*corners, strict=True)
    return min(xs), min(ys), max(xs), max(ys)
