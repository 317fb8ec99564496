"""Scans of manifests, forecasts, observations and tiles as DataFrames, and the layered layout."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.config import Bounds
from pluvio.functions import geo
from pluvio.functions.palette import DETECTOR_DISTANCE, TIERS
from pluvio.operators import mosaic

MANIFEST = "version string, generated long, host string, radar struct<past:array<struct<time:long,path:string>>,nowcast:array<struct<time:long,path:string>>>"
FORECAST = "hourly struct<time:array<string>,precipitation_probability:array<double>>, current struct<precipitation:double>"
TILE_NAME = r"/(\d+)/(\d+)_(\d+)_(\d+)_s(\d+)\.png$"


def frames(spark: SparkSession, path: str, last: int = 8, nowcast: bool = False) -> DataFrame:
    """manifest, frame_ts, path of the last frames of each manifest file, oldest first."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("manifest", F.input_file_name())
    lists = F.concat(F.col("radar.past"), F.coalesce("radar.nowcast", F.array().cast("array<struct<time:long,path:string>>"))) if nowcast else F.col("radar.past")
    n = F.size(lists)
    kept = F.slice(F.array_sort(lists), F.greatest(n - last + 1, F.lit(1)), F.lit(last))
    each = m.select("manifest", F.explode(kept).alias("f"))
    return each.select("manifest", F.timestamp_seconds("f.time").alias("frame_ts"), F.col("f.path").alias("path"))


def hourly_forecast(spark: SparkSession, path: str) -> DataFrame:
    """file, valid_ts, pop."""
    j = spark.read.schema(FORECAST).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    each = j.select("file", F.explode(F.arrays_zip(F.col("hourly.time").alias("t"), F.col("hourly.precipitation_probability").alias("p"))).alias("x"))
    return each.select("file", F.to_timestamp("x.t").alias("valid_ts"), F.col("x.p").alias("pop"))


def current_precipitation(spark: SparkSession, path: str) -> DataFrame:
    j = spark.read.schema(FORECAST).option("multiLine", True).json(path)
    return j.select(F.input_file_name().alias("file"), F.col("current.precipitation").alias("mm"))


def observations(spark: SparkSession, path: str) -> DataFrame:
    """station_id, obs_utc, rain_mm from JSON lines."""
    return spark.read.schema("station_id string, obs_utc timestamp, rain_mm double").json(path)


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """epoch, zoom, x, y, scheme, width, height, data of PNG tiles, by Spark's image source;
    files that don't decode have no row. Bytes are blue, green, red, alpha."""
    t = spark.read.format("image").option("dropInvalid", True).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).load(path)
    origin = F.col("image.origin")
    parts = [F.regexp_extract(origin, TILE_NAME, i).try_cast("long").alias(n) for i, n in enumerate(("epoch", "zoom", "x", "y", "scheme"), 1)]
    named = t.select(*parts, F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    return named.filter("epoch is not null")  # other files are no tiles


PIXELS = "epoch long, x long, y long, row int, col int, r int, g int, b int, alpha int"
_PIXELS = pa.schema([*((n, pa.int64()) for n in ("epoch", "x", "y")), *((n, pa.int32()) for n in ("row", "col", "r", "g", "b", "alpha"))])


def _pixels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for t in batch.to_pylist():
            four = np.frombuffer(t["data"], np.uint8).reshape(-1, 4).astype(np.int32)
            at = np.arange(len(four), dtype=np.int32)
            where = [pa.array(np.full(len(at), t[n])) for n in ("epoch", "x", "y")]
            values = [at // t["width"], at % t["width"], four[:, 2], four[:, 1], four[:, 0], four[:, 3]]
            yield pa.RecordBatch.from_arrays([*where, *(pa.array(v.astype(np.int32)) for v in values)], schema=_PIXELS)


def tile_pixels(tile_rows: DataFrame) -> DataFrame:
    """Each pixel of four-channel tiles: epoch, x, y, row, col, r, g, b, alpha."""
    return tile_rows.filter(F.col("channels") == 4).select("epoch", "x", "y", "width", "data").mapInArrow(_pixels, PIXELS)


LEVELS = "epoch long, x long, y long, width int, height int, levels binary"
_LEVELS = pa.schema([*((n, pa.int64()) for n in ("epoch", "x", "y")), ("width", pa.int32()), ("height", pa.int32()), ("levels", pa.binary())])


def levels_of(data: bytes, distance: int = DETECTOR_DISTANCE) -> np.ndarray:
    """The intensity of each pixel (blue, green, red, alpha) in 255ths, cut off. A tile has few
    colours, so the palette is asked once for each; transparent pixels and unknown colours are 0."""
    four = np.frombuffer(data, np.uint8).reshape(-1, 4)
    packed = four.view("<u4")[:, 0]
    out = np.zeros(len(packed), np.uint8)
    seen = np.flatnonzero(four[:, 3] >= 10)
    if not len(seen):
        return out
    colour = packed[seen] & 0xFFFFFF
    change = np.flatnonzero(colour[1:] != colour[:-1]) + 1  # runs of one colour, so that few are sorted
    first = np.concatenate(([0], change))
    distinct, which = np.unique(colour[first], return_inverse=True)
    rgb = np.stack([distinct >> 16 & 255, distinct >> 8 & 255, distinct & 255], 1).astype(np.int64)
    tiers = np.array([t[:3] for t in TIERS], np.int64)
    d2 = ((rgb[:, None] - tiers[None]) ** 2).sum(2)
    level = np.array([int(t[3] * 255) for t in TIERS], np.uint8)[d2.argmin(1)]
    level[d2.min(1) > distance * distance] = 0
    out[seen] = np.repeat(level[which], np.diff(np.append(first, len(colour))))
    return out


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        levels = [levels_of(d).tobytes() for d in batch.column("data").to_pylist()]
        same = [batch.column(n).cast(_LEVELS.field(n).type) for n in _LEVELS.names[:-1]]
        yield pa.RecordBatch.from_arrays([*same, pa.array(levels, pa.binary())], schema=_LEVELS)


def tile_levels(tile_rows: DataFrame) -> DataFrame:
    """Decoded tiles: epoch, x, y, width, height and one byte of intensity for each pixel."""
    return tile_rows.filter(F.col("channels") == 4).select("epoch", "x", "y", "width", "height", "data").mapInArrow(_decoded, LEVELS)


def stitched(decoded: DataFrame, zoom: int, bounds: Bounds, width: int, height: int) -> DataFrame:
    """epoch, r, c, inten of the pixels with echo of the box ``bounds``, from the tiles around its centre
    that overlap it."""
    box = decoded.sparkSession.createDataFrame([(0, bounds.lat_min, bounds.lat_max, bounds.lon_min, bounds.lon_max)], "view_id long, lat_min double, lat_max double, lon_min double, lon_max double")
    return stitched_at(decoded, box, zoom, width, height).drop("view_id")


def stitched_at(decoded: DataFrame, boxes: DataFrame, zoom: int, width: int, height: int, side: int | None = None) -> DataFrame:
    """The same of many boxes (view_id, lat_min, lat_max, lon_min, lon_max): view_id, epoch, r, c, inten.
    Tiles of another size than ``side`` (by default that of most) are brought to it first."""
    if side is None:
        most = decoded.groupBy("width").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width").first()  # one row
        side = most["width"] if most else 256
    views = mosaic.analysis_views(boxes, zoom, width, height, side)
    images = mosaic.mosaic(decoded.withColumnRenamed("levels", "data"), views, 1, side)
    return mosaic.pixels(images, 1).filter("level > 0").select("view_id", "epoch", F.col("row").alias("r"), F.col("col").alias("c"), (F.col("level") / 255.0).alias("inten"))


def tile_at(lat: float, lon: float, zoom: int) -> tuple[int, int]:
    """Column and row of the Mercator tile that holds a place."""
    n = 1 << zoom
    return int((lon + 180) / 360 * n), int((1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n)


def tile_box(x: int, y: int, zoom: int) -> Bounds:
    n = 1 << zoom
    north, south = (math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * k / n)))) for k in (y, y + 1))
    return Bounds(south, north, x / n * 360 - 180, (x + 1) / n * 360 - 180)


def write_layers(frames_df: DataFrame, folder: str, classify) -> None:
    """Bronze rows as they come, and silver ones with a class, both by frame."""
    frames_df.write.mode("overwrite").partitionBy("frame_idx").parquet(f"{folder}/bronze")
    frames_df.withColumn("classification", classify).write.mode("overwrite").partitionBy("frame_idx").parquet(f"{folder}/silver")


def png(rgba: np.ndarray) -> bytes:
    """An image of four channels as a PNG file."""
    h, w, _ = rgba.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgba.reshape(h, -1)], 1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


TILE_FILE = "epoch long, zoom long, x long, y long, scheme long, content binary"


def write_tiles(tile_files: DataFrame, folder: str) -> None:
    """Files of tiles (TILE_FILE) under ``folder``/epoch, named as the scan expects. A task that runs again writes
    the same files."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for t in batch.to_pylist():
                system.create_dir(f"{root}/{t['epoch']}", recursive=True)
                with system.open_output_stream(tile_file(root, t)) as f:
                    f.write(t["content"])
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    tile_files.select(*[c.split()[0] for c in TILE_FILE.split(", ")]).mapInArrow(write, "n long").agg(F.sum("n")).collect()  # one number


TILE_KEY = ("epoch", "zoom", "x", "y", "scheme")


def tile_file(root: str, t: dict) -> str:
    return f"{root}/{t['epoch']}/{t['zoom']}_{t['x']}_{t['y']}_s{t['scheme']}.png"


def fetched(spark: SparkSession, folder: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` tiles (TILE_KEY) with status (ok, absent, empty or unreadable) and, where ok, their image.
    A file that is cut off or isn't an image costs its own tile and no more. Spark's scans pass over empty
    files, so the tasks ask for the size of each."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            found = system.get_file_info([tile_file(root, t) for t in batch.to_pylist()])
            sizes = [f.size if f.type == fs.FileType.File else None for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64())], names=[*TILE_KEY, "length"])

    key = [F.col(c).cast("long").alias(c) for c in TILE_KEY]
    there = wanted.select(*key).mapInArrow(sized, ", ".join(f"{c} long" for c in (*TILE_KEY, "length")))
    images = tiles(spark, folder).dropDuplicates(list(TILE_KEY)).withColumn("_read", F.lit(True))
    met = there.join(images, list(TILE_KEY), "left")
    status = F.when(F.col("length").isNull(), "absent").when(F.col("length") == 0, "empty").when(F.col("_read").isNull(), "unreadable").otherwise("ok")
    return met.withColumn("status", status).drop("_read", "length")


def frame_fetches(fetched_tiles: DataFrame) -> DataFrame:
    """Per frame how many of its tiles are there, and whether it counts (a frame of which nothing came
    does not; its grid is one of zeros)."""
    n = fetched_tiles.groupBy("epoch").agg(F.count(F.lit(1)).alias("n_tiles"), F.count_if(F.col("status") == "ok").alias("n_ok"))
    return n.withColumn("fetch_ok", F.col("n_ok") > 0)


CAPTURE = "location struct<lat:double,lon:double,name:string>, capture_time_utc string, zoom int, center_tile struct<x:int,y:int>, grid_half int, tile_coords array<struct<x:int,y:int>>, detection_colour_scheme int, render_colour_scheme int, frame_count int, past_frame_count int, nowcast_frame_count int"


def capture_info(places: DataFrame, zoom: int, half: int = 2, schemes: tuple[int, int] = (6, 2)) -> DataFrame:
    """What was captured of each place (location_id, name, lat, lon, captured, past, nowcast): its document (CAPTURE)."""
    x, y = geo.tile_xy(F.col("lat"), F.col("lon"), zoom)
    around = F.sequence(F.lit(-half), F.lit(half))
    tiles_of = F.flatten(F.transform(around, lambda dy: F.transform(around, lambda dx: F.struct((F.col("_x") + dx).alias("x"), (F.col("_y") + dy).alias("y")))))
    p = places.withColumn("_x", x).withColumn("_y", y)
    return p.select(
        "location_id", F.struct("lat", "lon", "name").alias("location"), F.date_format("captured", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("capture_time_utc"), F.lit(zoom).alias("zoom"),
        F.struct(F.col("_x").alias("x"), F.col("_y").alias("y")).alias("center_tile"), F.lit(half).alias("grid_half"), tiles_of.alias("tile_coords"), F.lit(schemes[0]).alias("detection_colour_scheme"),
        F.lit(schemes[1]).alias("render_colour_scheme"), (F.col("past") + F.col("nowcast")).cast("int").alias("frame_count"), F.col("past").cast("int").alias("past_frame_count"), F.col("nowcast").cast("int").alias("nowcast_frame_count"))


def write_capture_info(info: DataFrame, folder: str) -> None:
    """One JSON document for each place, in a folder of its own."""
    fields = [c for c in info.columns if c != "location_id"]
    info.select("location_id", F.to_json(F.struct(*fields)).alias("value")).repartition("location_id").write.mode("overwrite").partitionBy("location_id").text(folder)
