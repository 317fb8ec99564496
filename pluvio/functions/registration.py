"""Functions of the engine under names for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pluvio.functions.palette import DETECTOR_DISTANCE, TIERS

_POSITION = "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * power(2, zoom)"
_LAT = "degrees(atan(sinh(pi() * (1 - 2 * ({0}) / power(2, zoom)))))"
_NEAR = "array_min(array(" + ", ".join(f"struct((r - {r}) * (r - {r}) + (g - {g}) * (g - {g}) + (b - {b}) * (b - {b}) as d2, {i} as tier, {float(v)}D as intensity)" for i, (r, g, b, v) in enumerate(TIERS)) + "))"
_MEAN = "aggregate(angles, 0D, (s, x) -> s + {0}(x)) / size(angles)"

#: name: (arguments, type, body)
FUNCTIONS = {
    "rain_intensity": ("r int, g int, b int, alpha int", "double", f"if(alpha >= 10 and {_NEAR}.d2 <= {DETECTOR_DISTANCE**2}, {_NEAR}.intensity, 0D)"),
    "tile_x": ("lon double, zoom int", "int", "cast((lon + 180) / 360 * power(2, zoom) as int)"),
    "tile_y": ("lat double, zoom int", "int", f"cast({_POSITION} as int)"),
    "tile_box": (
        "x int, y int, zoom int",
        "struct<lat_min: double, lat_max: double, lon_min: double, lon_max: double>",
        f"named_struct('lat_min', {_LAT.format('y + 1')}, 'lat_max', {_LAT.format('y')}, 'lon_min', x / power(2, zoom) * 360 - 180, 'lon_max', (x + 1) / power(2, zoom) * 360 - 180)",
    ),
    "pop_multiplier": ("pop double", "double", "case when pop is null then 1D when pop < 5 then 3D when pop < 30 then 2D else 1D end"),
    "cloud_multiplier": ("fraction double", "double", "case when fraction is null then 1D when fraction < 0.1 then 3D else 1D end"),
    "intensity_label": ("value double", "string", "case when value <= 0 then 'none' when value <= 0.2 then 'light' when value <= 0.45 then 'moderate' when value <= 0.75 then 'heavy' else 'extreme' end"),
    "circular_variance": ("angles array<double>", "double", f"1 - sqrt(power({_MEAN.format('sin')}, 2) + power({_MEAN.format('cos')}, 2))"),
}


def register(spark: SparkSession, prefix: str = "pluvio_") -> list[str]:
    """Makes FUNCTIONS temporary SQL functions of a session, each a plain SQL expression that
    the optimizer sees through; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {prefix}{name}({arguments}) returns {result} return {body}")
    return [prefix + name for name in FUNCTIONS]
