"""Transverse Mercator by its series, as expressions (no projection library is needed).

Defaults: GRS 80 ellipsoid, central meridian 127, origin latitude 38, scale 1, false easting
200 000 m and false northing 600 000 m (a Korean central-belt zone)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLATTENING = 6378137.0, 1 / 298.257222101
LON0, LAT0, K0, EAST0, NORTH0 = 127.0, 38.0, 1.0, 200000.0, 600000.0
E2 = FLATTENING * (2 - FLATTENING)
EP2 = E2 / (1 - E2)
#: Coefficients of the meridian arc.
ARC = (1 - E2 / 4 - 3 * E2**2 / 64 - 5 * E2**3 / 256, 3 * E2 / 8 + 3 * E2**2 / 32 + 45 * E2**3 / 1024, 15 * E2**2 / 256 + 45 * E2**3 / 1024, 35 * E2**3 / 3072)


def _arc(lat: float) -> float:
    return A * (ARC[0] * lat - ARC[1] * math.sin(2 * lat) + ARC[2] * math.sin(4 * lat) - ARC[3] * math.sin(6 * lat))


M0 = _arc(math.radians(LAT0))


def transverse_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    p = F.radians(lat)
    s, c, t = F.sin(p), F.cos(p), F.tan(p) ** 2
    n, g, a = A / F.sqrt(1 - E2 * s * s), EP2 * c * c, F.radians(lon - LON0) * c
    m = A * (ARC[0] * p - ARC[1] * F.sin(2 * p) + ARC[2] * F.sin(4 * p) - ARC[3] * F.sin(6 * p))
    east = EAST0 + K0 * n * (a + (1 - t + g) * a**3 / 6 + (5 - 18 * t + t * t + 72 * g - 58 * EP2) * a**5 / 120)
    north = NORTH0 + K0 * (m - M0 + n * F.tan(p) * (a * a / 2 + (5 - t + 9 * g + 4 * g * g) * a**4 / 24 + (61 - 58 * t + t * t + 600 * g - 330 * EP2) * a**6 / 720))
    return east, north


#: Third flattening and the series of the footpoint latitude.
E1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
FOOT = (3 * E1 / 2 - 27 * E1**3 / 32, 21 * E1**2 / 16 - 55 * E1**4 / 32, 151 * E1**3 / 96, 1097 * E1**4 / 512)


def inverse_mercator(east: Column, north: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a place in metres: the series for the footpoint's latitude. Off by
    5e-7 degrees at 6 degrees from the meridian; inverse_mercator_far goes on from it."""
    mu = (M0 + (north - NORTH0) / K0) / (A * ARC[0])
    p = mu + FOOT[0] * F.sin(2 * mu) + FOOT[1] * F.sin(4 * mu) + FOOT[2] * F.sin(6 * mu) + FOOT[3] * F.sin(8 * mu)
    s, c, t = F.sin(p), F.cos(p), F.tan(p) ** 2
    g, n, r = EP2 * c * c, A / F.sqrt(1 - E2 * s * s), A * (1 - E2) / (1 - E2 * s * s) ** 1.5
    d = (east - EAST0) / (n * K0)
    lat = p - n * F.tan(p) / r * (d**2 / 2 - (5 + 3 * t + 10 * g - 4 * g * g - 9 * EP2) * d**4 / 24 + (61 + 90 * t + 298 * g + 45 * t * t - 252 * EP2 - 3 * g * g) * d**6 / 720)
    lon = (d - (1 + 2 * t + g) * d**3 / 6 + (5 - 2 * g + 28 * t - 3 * g * g + 8 * EP2 + 24 * t * t) * d**5 / 120) / c
    return LON0 + F.degrees(lon), F.degrees(lat)


#: Newton steps of the inverse: 5 give 1e-11 degrees 36 degrees off the meridian, 8 some 50 off.
STEPS = 8


def _newton(east: pd.Series, north: pd.Series) -> pd.DataFrame:
    """Steps on transverse_mercator from the footpoint series. Derivatives are those of a conformal
    map."""
    mu = (M0 + (north.to_numpy() - NORTH0) / K0) / (A * ARC[0])
    p = mu + sum(f * np.sin(2 * k * mu) for k, f in enumerate(FOOT, 1))
    t, w = np.tan(p) ** 2, 1 - E2 * np.sin(p) ** 2
    d = (east.to_numpy() - EAST0) / K0 * np.sqrt(w) / A
    l = (d - (1 + 2 * t) * d**3 / 6 + (5 + 28 * t + 24 * t * t) * d**5 / 120) / np.cos(p)
    p = p - w / (1 - E2) * np.tan(p) * (d**2 / 2 - (5 + 3 * t) * d**4 / 24 + (61 + 90 * t + 45 * t * t) * d**6 / 720)
    for _ in range(STEPS):
        s, c, t = np.sin(p), np.cos(p), np.tan(p) ** 2
        g, a, w = EP2 * c * c, l * c, 1 - E2 * s * s
        n = A / np.sqrt(w)
        e1, e3, e5 = n, n * (1 - t + g) / 2, n * (5 - 18 * t + t * t + 72 * g - 58 * EP2) / 24
        n2, n4, n6 = n * np.tan(p), n * np.tan(p) * (5 - t + 9 * g + 4 * g * g) / 6, n * np.tan(p) * (61 - 58 * t + t * t + 600 * g - 330 * EP2) / 120
        m = A * (ARC[0] * p - ARC[1] * np.sin(2 * p) + ARC[2] * np.sin(4 * p) - ARC[3] * np.sin(6 * p))
        off_e = (east.to_numpy() - EAST0) / K0 - (e1 * a + e3 * a**3 / 3 + e5 * a**5 / 5)
        off_n = (north.to_numpy() - NORTH0) / K0 - (m - M0 + n2 * a**2 / 2 + n4 * a**4 / 4 + n6 * a**6 / 6)
        u, v = c * (e1 + e3 * a**2 + e5 * a**4), c * (n2 * a + n4 * a**3 + n6 * a**5)
        size = u * u + v * v
        l, p = l + (u * off_e + v * off_n) / size, p + (u * off_n - v * off_e) / size * c * w / (1 - E2)
    return pd.DataFrame({"lon": LON0 + np.degrees(l), "lat": np.degrees(p)})


def inverse_mercator_far(east: Column, north: Column) -> Column:
    """lon and lat (a struct) of a place in metres, far from the meridian, too."""
    return F.pandas_udf(_newton, "lon double, lat double")(east, north)


def reproject(geometry: Column, project: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A geometry (type and coordinates: polygons of rings, or lines, of points x, y, z) with
    every point projected; heights stay, null geometries and empty parts, too."""

    def point(p: Column) -> Column:
        x, y = project(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"), p["z"].alias("z"))

    moved = F.transform(geometry["coordinates"], lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point)))
    return F.when(geometry.isNotNull(), F.struct(geometry["type"].alias("type"), moved.alias("coordinates")))


#: The same series for the oracle: east, north and the columns they use.
TM_SQL = (
    f"{EAST0}::DOUBLE + {K0} * tn * (ta + (1 - tt + tg) * ta ** 3 / 6 + (5 - 18 * tt + tt * tt + 72 * tg - 58 * {EP2!r}::DOUBLE) * ta ** 5 / 120)",
    f"{NORTH0}::DOUBLE + {K0} * (tm - {M0!r}::DOUBLE + tn * tan(tp) * (ta * ta / 2 + (5 - tt + 9 * tg + 4 * tg * tg) * ta ** 4 / 24 + (61 - 58 * tt + tt * tt + 600 * tg - 330 * {EP2!r}::DOUBLE) * ta ** 6 / 720))",
    f"radians(lat) AS tp, {A}::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * sin(radians(lat)) * sin(radians(lat))) AS tn, {EP2!r}::DOUBLE * cos(radians(lat)) * cos(radians(lat)) AS tg, radians(lon - {LON0}::DOUBLE) * cos(radians(lat)) AS ta, tan(radians(lat)) * tan(radians(lat)) AS tt, "
    f"{A}::DOUBLE * ({ARC[0]!r}::DOUBLE * radians(lat) - {ARC[1]!r}::DOUBLE * sin(2 * radians(lat)) + {ARC[2]!r}::DOUBLE * sin(4 * radians(lat)) - {ARC[3]!r}::DOUBLE * sin(6 * radians(lat))) AS tm",
)
