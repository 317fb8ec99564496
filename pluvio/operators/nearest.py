"""The nearest of many points on the globe, by a tree of cells.

Points are on the unit sphere, so that neither poles nor the date line are special, and lie in cells
of a cube that halve from level to level; a cell that holds points knows one of them. A search goes
down the levels with a few cells: of their occupied children those stay whose nearest corner is no
farther than the nearest of the points that the children know. Each level is an equi-join on the
cell; no place meets all points, however they cluster."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.functions.geo import haversine_km
from pluvio.sources.state import stage

#: Levels at most: cells of some hundred metres.
DEEPEST = 16
_BITS = 20
#: More than is lost in rounding, in units of the sphere's radius.
_SLACK = 1e-9


def _on_sphere(lat: str, lon: str) -> dict[str, Column]:
    a, b = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(b), "y": F.cos(a) * F.sin(b), "z": F.sin(a)}


def _cell(level: int) -> Column:
    """The cell of a point (x, y, z) at a level, as one number."""
    n = 1 << level
    at = [F.least(F.floor((F.col(c) + 1) / 2 * n), F.lit(n - 1)).cast("long") for c in ("x", "y", "z")]
    return F.shiftleft(at[0], 2 * _BITS).bitwiseOR(F.shiftleft(at[1], _BITS)).bitwiseOR(at[2])


def _gap(level: int, cell: str) -> Column:
    """The distance of the point x, y, z from a cell's box."""
    size, mask = 2.0 / (1 << level), (1 << _BITS) - 1
    total = F.lit(0.0)
    for i, c in enumerate(("x", "y", "z")):
        low = F.shiftright(F.col(cell), (2 - i) * _BITS).bitwiseAND(F.lit(mask)) * size - 1
        away = F.greatest(low - F.col(c), F.col(c) - (low + size), F.lit(0.0))
        total = total + away * away
    return F.sqrt(total)


def nearest(places: DataFrame, points: DataFrame, place: str, point: str, levels: int | None = None) -> DataFrame:
    """``place``, ``point`` and km of the nearest of ``points`` (s_lat, s_lon) to each of ``places`` (lat, lon), of
    equal distances the lesser; rows without coordinates take no part."""
    p = stage(points.filter("s_lat is not null and s_lon is not null").select(point, "s_lat", "s_lon", *[c.alias(n) for n, c in _on_sphere("s_lat", "s_lon").items()]))
    if levels is None:
        levels = min(DEEPEST, max(1, math.ceil(math.log(max(p.count(), 1), 4)) + 1))
    wanted = places.filter("lat is not null and lon is not null").select(place, "lat", "lon").dropDuplicates([place])
    found = wanted.withColumns(_on_sphere("lat", "lon")).withColumn("cell", F.lit(0).cast("long"))
    for level in range(1, levels + 1):
        here = p.groupBy(_cell(level - 1).alias("cell"), _cell(level).alias("child")).agg(F.min(F.struct(point, "x", "y", "z")).alias("one"))
        met = found.join(here, "cell")
        apart = [F.col(c) - F.col(f"one.{c}") for c in ("x", "y", "z")]
        met = met.withColumn("far", F.sqrt(sum((d * d for d in apart), F.lit(0.0)))).withColumn("near", _gap(level, "child"))
        best = met.groupBy(place).agg(F.min("far").alias("best"))
        found = met.join(best, place).filter(F.col("near") <= F.col("best") + _SLACK).select(place, "lat", "lon", "x", "y", "z", F.col("child").alias("cell"))
        if level < levels and level % 4 == 0:
            found = stage(found)
    leaf = p.select(_cell(levels).alias("cell"), point, "s_lat", "s_lon")
    # points that share coordinates are as near as each other
    leaf = leaf.groupBy("cell", "s_lat", "s_lon").agg(F.min(point).alias(point))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    best = found.join(leaf, "cell").groupBy(place).agg(F.min(F.struct(km.alias("km"), F.col(point))).alias("_b"))
    return best.select(place, F.col(f"_b.{point}").alias(point), F.col("_b.km").alias("km"))
