"""Colours of radar tiles to intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Red, green, blue and intensity of the tiers of the radar tiles.
TIERS = (
    (218, 204, 147, 0.09),
    (81, 197, 232, 0.10),
    (0, 154, 213, 0.18),
    (0, 119, 170, 0.28),
    (0, 91, 142, 0.38),
    (255, 224, 0, 0.50),
    (255, 170, 0, 0.63),
    (255, 68, 0, 0.77),
    (193, 0, 0, 0.88),
    (255, 119, 255, 1.00),
)
DETECTOR_DISTANCE = 60
RENDERER_DISTANCE = 30


def tiers(spark: SparkSession) -> DataFrame:
    """The palette as a relation: tier, pr, pg, pb, intensity."""
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TIERS)], "tier int, pr int, pg int, pb int, intensity double")


def nearest(r: Column, g: Column, b: Column) -> Column:
    """struct(d2, tier, intensity) of the nearest tier; of equal distances the first."""
    def one(i: int, t: tuple) -> Column:
        d2 = (r - t[0]) * (r - t[0]) + (g - t[1]) * (g - t[1]) + (b - t[2]) * (b - t[2])
        return F.struct(d2.cast("int").alias("d2"), F.lit(i).alias("tier"), F.lit(float(t[3])).alias("intensity"))

    return F.array_min(F.array(*[one(i, t) for i, t in enumerate(TIERS)]))


def intensity(r: Column, g: Column, b: Column, alpha: Column, distance: int = DETECTOR_DISTANCE) -> Column:
    """The detector's intensity of a pixel: 0 where transparent (alpha below 10) or of no tier."""
    near = nearest(r, g, b)
    return F.when((alpha >= 10) & (near["d2"] <= distance * distance), near["intensity"]).otherwise(F.lit(0.0))


def quantised(value: Column) -> Column:
    """An intensity as it comes out of an 8-bit grid: cut off to 255ths."""
    return F.floor(value * 255) / F.lit(255.0)


def band(d2: Column, alpha: Column) -> Column:
    """By which of detector and renderer a pixel is kept."""
    return (
        F.when(alpha <= 10, "transparent")
        .when(d2 <= RENDERER_DISTANCE**2, "both_keep")
        .when(d2 <= DETECTOR_DISTANCE**2, "renderer_drops")
        .otherwise("both_drop")
    )


def decode_by_colour(pixels: DataFrame, distance: int = DETECTOR_DISTANCE) -> DataFrame:
    """``pixels`` (r, g, b, alpha) with ``intensity``, found once for each distinct colour.

    Real tiles have few colours, so the lookup runs on the distinct ones and comes back by a join."""
    colours = pixels.select("r", "g", "b").distinct()
    near = nearest(F.col("r"), F.col("g"), F.col("b"))
    known = colours.withColumn("_n", near).select("r", "g", "b", F.when(F.col("_n.d2") <= distance * distance, F.col("_n.intensity")).otherwise(0.0).alias("_i"))
    met = pixels.join(known, ["r", "g", "b"])
    return met.withColumn("intensity", F.when(F.col("alpha") >= 10, F.col("_i")).otherwise(0.0)).drop("_i")
