"""Geometry as Column expressions: distances, projections, cells, scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from countygeo.functions.scalar import METERS_PER_DEG_LAT, _col

# Fixed values.
EARTH_R = 6371008.8
CHINA_BBOX = (73.0, 18.0, 135.0, 54.0)
GAME_DECAY_KM = 150.0
GAME_MAX_SCORE = 5000.0

_DEG_M = math.radians(1.0) * EARTH_R


def grid_x(lng: Column | str, lat: Column | str, size_m: float) -> Column:
    """East-west cell at the point's own latitude, truncated toward zero (SC6)."""
    shrink = F.greatest(F.cos(F.radians(_col(lat))), F.lit(1e-6))
    return (_col(lng) * METERS_PER_DEG_LAT * shrink / size_m).cast("bigint")


def grid_y(lat: Column | str, size_m: float) -> Column:
    """North-south cell, truncated toward zero (SC6)."""
    return (_col(lat) * METERS_PER_DEG_LAT / size_m).cast("bigint")


def normalize_lng(lng: Column | str) -> Column:
    """Longitude to [0, 1] in the box (SC9)."""
    west, _, east, _ = CHINA_BBOX
    return (_col(lng) - west) / (east - west)


def normalize_lat(lat: Column | str) -> Column:
    """Latitude to [0, 1] in the box (SC9)."""
    _, south, _, north = CHINA_BBOX
    return (_col(lat) - south) / (north - south)


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def denormalize_x(x: Column | str) -> Column:
    """Clipped inverse of ``normalize_lng`` (SC10)."""
    west, _, east, _ = CHINA_BBOX
    return _clip01(_col(x)) * (east - west) + west


def denormalize_y(y: Column | str) -> Column:
    """Clipped inverse of ``normalize_lat`` (SC10)."""
    _, south, _, north = CHINA_BBOX
    return _clip01(_col(y)) * (north - south) + south


def haversine_m(lng1, lat1, lng2, lat2) -> Column:
    """Great-circle distance in metres (SC11)."""
    a1, a2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    half_lat = (a2 - a1) / 2
    half_lng = (F.radians(_col(lng2)) - F.radians(_col(lng1))) / 2
    chord = F.sin(half_lat) * F.sin(half_lat) + F.cos(a1) * F.cos(a2) * F.sin(half_lng) * F.sin(half_lng)
    return F.asin(F.sqrt(_clip01(chord))) * (2 * EARTH_R)


def haversine_km(lng1, lat1, lng2, lat2) -> Column:
    return haversine_m(lng1, lat1, lng2, lat2) / 1000.0


def local_x(lng, lng0, lat0) -> Column:
    """Metres east of (lng0, lat0) on the local plane (SC12)."""
    return (_col(lng) - _col(lng0)) * _DEG_M * F.cos(F.radians(_col(lat0)))


def local_y(lat, lat0) -> Column:
    return (_col(lat) - _col(lat0)) * _DEG_M


def plane_lng(x, lng0, lat0) -> Column:
    """Inverse of ``local_x``."""
    return _col(lng0) + _col(x) / (F.cos(F.radians(_col(lat0))) * _DEG_M)


def plane_lat(y, lat0) -> Column:
    return _col(lat0) + _col(y) / _DEG_M


def game_score(km, decay_km: float = GAME_DECAY_KM, max_score: float = GAME_MAX_SCORE) -> Column:
    """Guessing-game score that decays with distance (SC29)."""
    return F.exp(-_col(km) / decay_km) * max_score


def valid_lnglat(lng, lat) -> Column:
    """Finite and inside the globe (FIL6)."""
    x, y = _col(lng), _col(lat)
    ok = ~F.isnan(x) & ~F.isnan(y) & x.between(-180.0, 180.0) & y.between(-90.0, 90.0)
    return F.coalesce(ok, F.lit(False))
