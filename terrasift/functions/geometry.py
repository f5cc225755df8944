"""Grids, areas, densities and shapes of cells."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EARTH_RADIUS_KM, PV_ALTITUDE, PV_DECLINATION, PV_GROUND_COVER, PV_KW, PV_LENGTH_M, PV_TILT, PV_WIDTH_M, WIND_KM2_PER_GW


def clip(x: Column, low: float, high: float | None = None) -> Column:
    x = F.greatest(x, F.lit(float(low)))
    return x if high is None else F.least(x, F.lit(float(high)))


def fine_latitude(y: Column, step: float = 0.05) -> Column:
    return 90 - y * step


def fine_longitude(x: Column, step: float = 0.05) -> Column:
    return x * step - 180


def snap(value: Column, step: float) -> Column:
    return F.floor(value / step) * step


def coarse_latitude(y: Column, per_cell: int = 20) -> Column:
    """floor of the fine latitude, in whole numbers so that no edge is lost to rounding."""
    return (90 - F.ceil(y / per_cell)).cast("double")


def coarse_longitude(x: Column, per_cell: int = 20) -> Column:
    return (F.floor(x / per_cell) - 180).cast("double")


def cell_area_km2(latitude: Column, step: float = 1.0) -> Column:
    return EARTH_RADIUS_KM**2 * math.radians(step) * F.abs(F.sin(F.radians(latitude + step)) - F.sin(F.radians(latitude)))


def wind_density(scale: float = 1.0, km2_per_gw: float = WIND_KM2_PER_GW) -> Column:
    return F.lit(1000.0 / km2_per_gw * scale)


def _solar(latitude: Column) -> Column:
    away = F.abs(latitude)
    tilt, altitude = F.radians(clip(away, *PV_TILT)), F.radians(clip(90.0 - away - PV_DECLINATION, *PV_ALTITUDE))
    pitch = clip(PV_LENGTH_M * (F.sin(tilt) + F.cos(tilt) / F.tan(altitude)), PV_LENGTH_M)
    cover = clip(PV_WIDTH_M / pitch, *PV_GROUND_COVER)
    return 1_000_000.0 / (PV_WIDTH_M * PV_LENGTH_M / (PV_KW / 1000.0) / cover)


def solar_density(latitude: Column, scale: float = 1.0, km2_per_mw: float | None = None) -> Column:
    """MW of photovoltaics a square kilometre holds; with km2_per_mw, scaled so that the equator needs just that."""
    if km2_per_mw is None:
        return _solar(latitude) * scale
    if km2_per_mw <= 0:
        raise ValueError("km2_per_mw must be positive")
    return _solar(latitude) * (1.0 / km2_per_mw) / _solar(F.lit(0.0)) * scale


def cell_id(latitude: Column, longitude: Column) -> Column:
    return F.format_string("%.2f_%.2f", latitude, longitude)


def cell_geojson(latitude: Column, longitude: Column, half: float = 0.5) -> Column:
    """The cell's outline, five points, as GeoJSON text."""
    west, east, south, north = longitude - half, longitude + half, latitude - half, latitude + half
    ring = F.array(*(F.array(x, y) for x, y in ((west, south), (east, south), (east, north), (west, north), (west, south))))
    return F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")))


def raster_index(value: Column, least: Column, size: float) -> Column:
    return F.bround((value - least) / size).cast("int")
