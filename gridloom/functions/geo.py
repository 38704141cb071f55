"""Geometry and tile arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, KM_PER_DEGREE, ZOOM, TILE_PIXELS = 6371.0, 111.0, 12, 256


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def project_km(lat: Column, lon: Column, mean_lat: Column) -> tuple[Column, Column]:
    """Equirectangular (x, y) around a mean latitude."""
    return lon * KM_PER_DEGREE * F.cos(F.radians(mean_lat)), lat * KM_PER_DEGREE


def tile_fraction(lat: Column, lon: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    n = float(2**zoom)
    phi = F.radians(lat)
    return (lon + 180.0) / 360.0 * n, (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / F.pi()) / 2.0 * n


def tile_of(lat: Column, lon: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    return tuple(v.cast("long") for v in tile_fraction(lat, lon, zoom))


def pixel_of(lat: Column, lon: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    """Pixel inside the tile, 255 at most."""
    return tuple(F.least(((v - F.floor(v)) * TILE_PIXELS).cast("long"), F.lit(TILE_PIXELS - 1)) for v in tile_fraction(lat, lon, zoom))


def tile_center(x: Column, y: Column, zoom: int = ZOOM) -> tuple[Column, Column]:
    """(lat, lon) of a tile's middle."""
    n = float(2**zoom)
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * (y + 0.5) / n)))), (x + 0.5) / n * 360.0 - 180.0


def slope_degrees(west: Column, east: Column, south: Column, north: Column, lat: Column, delta: float) -> Column:
    """Slope of the plane through four neighbours ``delta`` degrees away; 0 where there is no extent."""
    dy = F.lit(delta) * 111320.0
    dx = dy * F.cos(F.radians(lat))
    dzdx = F.coalesce(F.try_divide(east - west, 2.0 * dx), F.lit(0.0))
    dzdy = F.coalesce(F.try_divide(north - south, 2.0 * dy), F.lit(0.0))
    return F.degrees(F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy)))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over a closed ring, array<struct<lon, lat>>: true inside, false outside, for points off the border."""
    edges = F.zip_with(F.slice(ring, F.lit(1), F.size(ring) - 1), F.slice(ring, F.lit(2), F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > y) != (b["lat"] > y)
        at = F.try_divide((b["lon"] - a["lon"]) * (y - a["lat"]), b["lat"] - a["lat"]) + a["lon"]
        return F.when(spans & (x < at), 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def portable_hash(x: Column) -> Column:
    """A hash of an integer, 0 to 2^32 - 1, that any SQL engine can evaluate; integers of 2^31 and more are taken modulo that, so nothing overflows."""
    return (F.pmod(x.cast("long"), F.lit(2147483648)) * 2654435761) % 4294967296
