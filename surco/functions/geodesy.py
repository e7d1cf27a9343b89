"""Map projection, tiles, bearings and distances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col
from .fixed_values import COMPASS, EARTH_RADIUS_M, MERCATOR_HALF_M, WGS84_A, WGS84_F


def to_mercator(lat: Column | str, lng: Column | str) -> tuple[Column, Column]:
    """Web mercator metres (x, y)."""
    lat, lng = col(lat), col(lng)
    half_turn = F.lit(MERCATOR_HALF_M)
    y = F.log(F.tan((lat + 90) * F.pi() / 360)) / F.pi() * half_turn
    return lng / 180 * half_turn, y


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Degrees (lat, lng)."""
    lat = F.degrees(F.atan(F.exp(y / MERCATOR_HALF_M * F.pi())) * 2 - F.pi() / 2)
    return lat, x / MERCATOR_HALF_M * 180


def from_mercator_rings(rings: Column | str) -> Column:
    """Rings of [x, y] metres as rings of [lng, lat] degrees."""

    def point(p):
        lat, lng = from_mercator(p[0], p[1])
        return F.array(lng, lat)

    return F.transform(col(rings), lambda ring: F.transform(ring, point))


def tile_of_metres(x: Column, y: Column, zoom: int | Column) -> tuple[Column, Column]:
    """Tile column and row, rows counted from the south."""
    tiles = F.pow(F.lit(2.0), zoom) if isinstance(zoom, Column) else F.lit(float(1 << zoom))
    side = F.lit(2 * MERCATOR_HALF_M) / tiles
    tx = F.floor((x + MERCATOR_HALF_M) / side)
    ty_north = F.floor((F.lit(MERCATOR_HALF_M) - y) / side)
    return tx, tiles.cast("bigint") - 1 - ty_north


def tile_key(lat: Column | str, lng: Column | str, zoom: int) -> tuple[Column, Column]:
    return tile_of_metres(*to_mercator(lat, lng), zoom)


def compass_sector(dlat: Column | str, dlon: Column | str) -> Column:
    """One of eight sectors, by the angle of (dlon, dlat) from east."""
    angle = F.degrees(F.atan2(col(dlat), col(dlon)))
    octant = F.floor(F.pmod(angle + 22.5, F.lit(360.0)) / 45).cast("int") % 8
    return F.get(F.array(*[F.lit(c) for c in COMPASS]), octant)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on the mean sphere."""
    dphi = F.radians(lat2 - lat1) / 2
    dlmb = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dphi), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlmb), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


@F.pandas_udf(T.DoubleType())
def _geodesic_m(lat1: pd.Series, lon1: pd.Series, lat2: pd.Series, lon2: pd.Series) -> pd.Series:
    """Metres on the WGS-84 ellipsoid (Vincenty's inverse formula), for points that are not antipodal."""
    b = WGS84_A * (1 - WGS84_F)
    u1 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat1.to_numpy(float))))
    u2 = np.arctan((1 - WGS84_F) * np.tan(np.radians(lat2.to_numpy(float))))
    span = np.radians(lon2.to_numpy(float) - lon1.to_numpy(float))
    lam = span
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(100):
            sin_s = np.hypot(
                np.cos(u2) * np.sin(lam),
                np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam),
            )
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a == 0, 0.0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2_a)
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            step = sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1))
            nxt = span + (1 - c) * WGS84_F * sin_a * step
            done = np.nanmax(np.abs(nxt - lam), initial=0.0) < 1e-13
            lam = nxt
            if done:
                break
        k = cos2_a * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        big_b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        tail = cos_s * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)
        arc = sigma - big_b * sin_s * (mid + big_b / 4 * tail)
    return pd.Series(b * big_a * arc)


# Marked so that a filter on the distance is not moved below it, which would compute it twice.
geodesic_m = _geodesic_m.asNondeterministic()
