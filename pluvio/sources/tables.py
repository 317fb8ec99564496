"""Radar relations derived from the star-schema tables of a folder.

Days of ``events`` are sessions of eight frames ten minutes apart on a 64 x 64 grid. Every
twentieth event seeds a moving 3 x 3 cell, the others are single pixels of speckle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 8
SIZE = 64
DAY0 = "2024-01-01"
EPOCH0 = 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _session(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit(DAY0).cast("date")).cast("long")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, frame_idx, r, c, inten: pixels with echo; an absent pixel is 0."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    i, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    steps = [F.explode(F.sequence(F.lit(0), F.lit(n))).alias(a) for n, a in ((FRAMES - 1, "f"), (2, "dr"), (2, "dc"))]
    seeds = e.filter(i % 20 == 0).select("event_id", _session(F.col("ts")).alias("session_id"), "value")
    for s in steps:
        seeds = seeds.select("*", s)
    tier = F.when(v < 10, 0.10).when(v < 25, 0.18).when(v < 50, 0.38).when(v < 100, 0.63).when(v < 200, 0.88).otherwise(1.0)
    part = F.expr("event_id div 20")
    blobs = seeds.select(
        "session_id",
        F.col("f").cast("long").alias("frame_idx"),
        ((i * 37) % 56 + (part % 3 - 1) * F.col("f") + F.col("dr")).alias("r"),
        ((i * 53) % 40 + (part % 4) * F.col("f") + F.col("dc")).alias("c"),
        tier.alias("inten"),
    )
    noise = e.filter(i % 20 != 0).select(
        _session(F.col("ts")).alias("session_id"),
        (F.expr("event_id div 7") % FRAMES).alias("frame_idx"),
        ((i * 37 + u * 11) % SIZE).alias("r"),
        ((i * 53 + u * 29) % SIZE).alias("c"),
        F.lit(0.18).alias("inten"),
    )
    inside = F.col("r").between(0, SIZE - 1) & F.col("c").between(0, SIZE - 1)
    return blobs.unionByName(noise).filter(inside).groupBy("session_id", "frame_idx", "r", "c").agg(F.max("inten").alias("inten"))


def frame_epoch(session: Column, frame: Column) -> Column:
    """Seconds since 1970 of a frame."""
    return (F.lit(EPOCH0) + session * 86_400 + frame * 600).cast("long")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location_id, name, row, col: points of interest on the grid."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(k.cast("long").alias("location_id"), F.col("n_name").alias("name"), ((k * 13) % SIZE).cast("long").alias("row"), ((k * 29) % SIZE).cast("long").alias("col"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location_id, lat, lon: spread over the latitudes that Mercator tiles cover."""
    k = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("location_id"))
    i = F.col("location_id")
    return k.select("location_id", ((i * 6.37) - 70.0).alias("lat"), ((i * 13.7) - 160.0).alias("lon"))


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hour (seconds since 1970), pop: an hourly probability of precipitation."""
    e = table(spark, sf_dir, "events")
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return e.groupBy(hour.alias("hour")).agg(F.max("value").alias("_v")).select("hour", (F.floor("_v") % 101).cast("double").alias("pop"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, obs (seconds since 1970), rain_mm: sums that end a quarter of an hour."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "purchase")
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    return e.select((F.col("user_id") % 25).alias("station"), (F.ceil(s / 900) * 900).cast("long").alias("obs"), (F.col("value") / 100).alias("rain_mm"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """station, t (seconds since 1970), predicted."""
    e = table(spark, sf_dir, "events").filter(F.col("event_type") == "click")
    return e.select("event_id", (F.col("user_id") % 25).alias("station"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), (F.col("value") > 50).alias("predicted"))


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_idx, row, col, r, g, b, alpha: coloured pixels near and off the palette, two frames."""
    e = table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id")
    both = e.select("event_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("frame_idx"))
    f = F.col("frame_idx")
    return both.select(
        "frame_idx",
        F.expr("event_id div 256").cast("int").alias("row"),
        (i % 256).cast("int").alias("col"),
        ((i * 7 + f * 13) % 8 * 36).cast("int").alias("r"),
        ((i * 11 + f * 5) % 6 * 51).cast("int").alias("g"),
        ((i * 5 + f * 3) % 4 * 85).cast("int").alias("b"),
        F.when(i % 9 == 0, i % 20).otherwise(255).cast("int").alias("alpha"),
    )
