"""Distances between points in degrees."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Kilometres of a degree of latitude.
DEGREE_KM = math.pi * EARTH_KM / 180


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (F-05)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def flat_distance2(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Squared equirectangular distance, good enough to compare near points (F-06)."""
    x = (lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return x * x + (lat2 - lat1) * (lat2 - lat1)
