"""Geometry and radio propagation as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radius in km, km per degree, refraction factor, speed of light in m/s.
EARTH_KM = 6371.0088
KM_PER_LAT, KM_PER_LON = 110.574, 111.320
REFRACTION = 4.0 / 3.0
LIGHT = 299_792_458.0


@dataclass(frozen=True)
class Radio:
    """Propagation parameters: MHz, dBm, dB and metres."""

    frequency_mhz: float = 868.0
    tx_power_dbm: float = 22.0
    tx_gain_db: float = 3.0
    rx_gain_db: float = 0.0
    rx_sensitivity_dbm: float = -124.0
    fade_margin_db: float = 20.0
    antenna_m: float = 1.0
    rx_height_m: float = 2.0
    max_range_km: float = 100.0
    green_db: float = 15.0

    @property
    def budget_db(self) -> float:
        return self.tx_power_dbm + self.tx_gain_db + self.rx_gain_db - self.rx_sensitivity_dbm - self.fade_margin_db

    def range_km(self) -> float:
        """Where free space alone uses up the budget, capped when the cap is positive."""
        d = 10 ** ((self.budget_db - 20 * math.log10(self.frequency_mhz) - 32.44) / 20)
        return min(d, self.max_range_km) if self.max_range_km > 0 else d


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def free_space_db(km: Column, mhz: float) -> Column:
    return 20 * F.log10(F.greatest(km, F.lit(0.001))) + (20 * math.log10(mhz) + 32.44)


def knife_edge_db(v: Column) -> Column:
    return F.when(v <= -0.78, 0.0).otherwise(6.9 + 20 * F.log10(F.sqrt(F.pow(v - 0.1, 2) + 1) + v - 0.1))


def tile_x(lon: Column, zoom: int) -> Column:
    return (lon + 180) / 360 * float(2**zoom)


def tile_y(lat: Column, zoom: int) -> Column:
    return (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * float(2**zoom)


def raster_height(width: int, south: Column, north: Column, west: Column, east: Column) -> Column:
    """Rows of a raster with square pixels; 0 where the box or the width is degenerate."""
    width_km = (east - west) * KM_PER_LON * F.cos(F.radians((south + north) / 2))
    height_km = (north - south) * KM_PER_LAT
    return F.when((width_km <= 0) | (height_km <= 0) | (F.lit(width) <= 0), 0).otherwise(F.greatest(F.lit(1), F.round(width * height_km / width_km))).cast("int")


def colour(margin: Column, green_db: float) -> Column:
    """Red, green and blue between orange at 0 dB and green at green_db; null where uncovered."""
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), margin / green_db))
    mix = lambda a, b: F.floor(a + (b - a) * t).cast("int")
    return F.when(margin.isNotNull() & (margin >= 0), F.struct(mix(249, 34).alias("r"), mix(115, 197).alias("g"), mix(22, 94).alias("b")))


def bearing_margin(radio: Radio, km: Column, worst_v: Column) -> Column:
    """Received margin in dB over a path whose worst obstruction has the Fresnel parameter worst_v."""
    loss = free_space_db(km, radio.frequency_mhz) + F.when(worst_v > -0.78, knife_edge_db(worst_v)).otherwise(0.0)
    return radio.budget_db - loss


def los_class(km: Column, margin: Column, range_km: float, green_db: float) -> Column:
    return F.when(km > range_km, "out_of_range").when(margin < 0, "blocked").when(margin < green_db, "marginal").otherwise("clear")
