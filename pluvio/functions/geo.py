"""Mercator tiles, analysis grids and distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvio.config import Grid

EARTH_KM = 6371.0


def tile_position(lat: Column, lon: Column, zoom: Column | int) -> tuple[Column, Column]:
    """x and y of a place in tiles, with fractions."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))
    phi = F.radians(lat)
    x = (lon + 180.0) / 360.0 * n
    y = (1.0 - F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0 * n
    return x, y


def tile_xy(lat: Column, lon: Column, zoom: Column | int) -> tuple[Column, Column]:
    x, y = tile_position(lat, lon, zoom)
    return x.cast("int"), y.cast("int")


def tile_bounds(x: Column, y: Column, zoom: int) -> dict[str, Column]:
    """The box of a tile: lat_min, lat_max, lon_min, lon_max."""
    n = float(2**zoom)

    def lat(row: Column) -> Column:
        return F.degrees(F.atan(F.sinh(math.pi * (1.0 - 2.0 * row / n))))

    return {"lat_min": lat(y + 1), "lat_max": lat(y), "lon_min": x / n * 360.0 - 180.0, "lon_max": (x + 1) / n * 360.0 - 180.0}


def analysis_tiles(lat: Column, lon: Column, zoom: int) -> Column:
    """The 2 x 2 tiles around the corner nearest to a place, as an array of structs (tx, ty)."""
    fx, fy = tile_position(lat, lon, zoom)
    cx, cy = fx.cast("int"), fy.cast("int")
    x0 = F.when(fx - cx < 0.5, cx - 1).otherwise(cx)
    y0 = F.when(fy - cy < 0.5, cy - 1).otherwise(cy)
    return F.array(*[F.struct((x0 + dx).alias("tx"), (y0 + dy).alias("ty")) for dy in (0, 1) for dx in (0, 1)])


def location_pixel(lat: Column, lon: Column, grid: Grid) -> tuple[Column, Column]:
    """Row and column of a place, cut off towards zero; may lie outside the grid."""
    b = grid.bounds
    row = ((b.lat_max - lat) / (b.lat_max - b.lat_min) * grid.height).cast("int")
    col = ((lon - b.lon_min) / (b.lon_max - b.lon_min) * grid.width).cast("int")
    return row, col


def pixel_location(row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
    b = grid.bounds
    return b.lat_max - row / grid.height * (b.lat_max - b.lat_min), b.lon_min + col / grid.width * (b.lon_max - b.lon_min)


def pixel_size_km(lat_min: Column, lat_max: Column, lon_min: Column, lon_max: Column, width: int, height: int) -> tuple[Column, Column]:
    middle = F.cos(F.radians((lat_min + lat_max) / 2))
    return (lat_max - lat_min) * 111.0 / height, (lon_max - lon_min) * 111.0 * middle / width


def km_per_pixel(lat: Column, zoom: Column | int) -> Column:
    z = zoom if isinstance(zoom, Column) else F.lit(zoom)
    return F.lit(40075.0) / (256 * F.pow(F.lit(2.0), z)) * F.cos(F.radians(lat))


def map_zoom(lat: Column, radius_km: Column, size: int = 640) -> Column:
    """The zoom from 1 to 18 at which twice the radius is nearest to ``size`` pixels; the first of equals."""
    tried = F.transform(F.sequence(F.lit(1), F.lit(18)), lambda z: F.struct(F.abs(2 * radius_km / km_per_pixel(lat, z) - size).alias("off"), z.alias("zoom")))
    return F.array_min(tried)["zoom"]


def global_pixel(lat: Column, lon: Column, zoom: Column | int) -> tuple[Column, Column]:
    x, y = tile_position(lat, lon, zoom)
    return x * 256, y * 256


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))
