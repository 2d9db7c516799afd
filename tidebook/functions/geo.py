"""Geographic column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidebook.functions.scalar import col

EARTH_RADIUS_KM = 6371.0
MERCATOR_RADIUS_M = 6378137.0

# Bounding rectangle of Brazil.
BRAZIL_BOX = {
    "lat_max": 5.27438888,
    "lat_min": -33.75116944,
    "lng_min": -73.98283055,
    "lng_max": -34.79314722,
}


def haversine_km(lng1: Column | str, lat1: Column | str, lng2: Column | str, lat2: Column | str) -> Column:
    """Great-circle distance in kilometres."""
    half = lambda a, b: F.sin((F.radians(col(b)) - F.radians(col(a))) / 2)
    h = half(lat1, lat2) ** 2 + F.cos(F.radians(col(lat1))) * F.cos(F.radians(col(lat2))) * half(lng1, lng2) ** 2
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def mercator_x(lng: Column | str) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(col(lng))


def mercator_y(lat: Column | str) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(col(lat)) / 2))


def inside_box(lat: Column | str, lng: Column | str, box: dict[str, float] = BRAZIL_BOX) -> Column:
    return col(lat).between(box["lat_min"], box["lat_max"]) & col(lng).between(box["lng_min"], box["lng_max"])
