"""Distances, bearings and travel times as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EARTH_RADIUS_KM, TSUNAMI_SPEED_KM_S


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    a = F.least(F.lit(1.0), a)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def travel_time_sec(km: Column) -> Column:
    return km / F.lit(TSUNAMI_SPEED_KM_S)


def initial_bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    turn = F.radians(lon2 - lon1)
    east = F.sin(turn) * F.cos(F.radians(lat2))
    north = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def strike_distance_deg(a: Column, b: Column) -> Column:
    """Angle between two strikes, which repeat every 180 degrees."""
    turn = F.pmod(a - b, F.lit(180.0))
    return F.least(turn, F.lit(180.0) - turn)


# Ordered zone boxes, first match wins (name, lat from, lat to, lon from, lon to).
ZONE_BOXES = (
    ("japan", 30.0, 50.0, 130.0, 160.0),
    ("kuril", 44.0, 56.0, 145.0, 165.0),
    ("kamchatka", 50.0, 62.0, 155.0, 175.0),
    ("alaska_aleutian", 50.0, 65.0, -180.0, -140.0),
    ("alaska_aleutian", 50.0, 65.0, 170.0, 180.0),
    ("cascadia", 40.0, 52.0, -130.0, -120.0),
    ("maule", -45.0, -30.0, -80.0, -68.0),
    ("peru_chile", -30.0, 0.0, -85.0, -68.0),
    ("central_america", 5.0, 20.0, -110.0, -75.0),
    ("tonga_kermadec", -35.0, -15.0, -180.0, -170.0),
    ("solomon_islands", -12.0, -4.0, 150.0, 165.0),
    ("indonesia", -10.0, 5.0, 95.0, 140.0),
    ("philippines", 5.0, 20.0, 118.0, 130.0),
    ("new_zealand", -50.0, -33.0, 165.0, 180.0),
)
RIM_MAX_LAT, RIM_WEST_LON, RIM_EAST_LON = 60.0, 100.0, -60.0


def classify_zone(lat: Column, lon: Column) -> Column:
    boxes = [
        F.when(lat.between(south, north) & lon.between(west, east), F.lit(name))
        for name, south, north, west, east in ZONE_BOXES
    ]
    rim = F.when((F.abs(lat) <= RIM_MAX_LAT) & ((lon > RIM_WEST_LON) | (lon < RIM_EAST_LON)), F.lit("pacific_rim"))
    return F.coalesce(*boxes, rim, F.lit("unknown"))
