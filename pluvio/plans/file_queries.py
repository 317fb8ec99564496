"""Queries that go through files, state and streams; results follow from tables, so most have a twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.operators import arrival, filters
from pluvio.plans import detect, pixel_queries
from pluvio.plans.oracle import GEO, PX, D, sql
from pluvio.plans.scalar_queries import _X, _Y
from pluvio.sources import files, manifest_source, state, tables
from pluvio.streaming import clutter, frames, tracks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: As many files as there are, in one micro-batch.
ALL_FILES = 2**31 - 1


def query(twin: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if twin:
            SQL[f.__name__] = twin
        return f

    return add


def _folder(spark: SparkSession) -> str:
    return f"{state.shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """location_id (the session), path, frame_ts, n_echo of every frame with echo."""
    p = tables.pixels(spark, sf_dir).groupBy("session_id", "frame_idx").agg(F.count(F.lit(1)).alias("n_echo"))
    ts = F.timestamp_seconds(tables.frame_epoch(F.col("session_id"), F.col("frame_idx")))
    path = F.concat_ws("/", F.col("session_id").cast("string"), F.col("frame_idx").cast("string"))
    return p.select(F.col("session_id").alias("location_id"), path.alias("path"), ts.alias("frame_ts"), "n_echo")


_F = ", f as (select session_id as location_id, frame_idx, 1704067200 + session_id*86400 + frame_idx*600 as e, count(*) as n_echo from pixels group by all)"


@query(sql("p", f"{_F} select location_id, count(*) as n, sum(n_echo)::bigint as n_echo from f group by all"))
def stream_frames_dedupe(spark, sf_dir):
    """Frames come twice; each counts once."""
    folder = _folder(spark)
    f = _frames(spark, sf_dir)
    f.write.parquet(f"{folder}/in")
    f.write.mode("append").parquet(f"{folder}/in")
    frames.run_to_end(frames.new_frames(frames.read_frames(spark, f"{folder}/in", 1000)), f"{folder}/out", f"{folder}/cp")
    out = spark.read.schema(frames.FRAME).parquet(f"{folder}/out")
    return out.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_echo").alias("n_echo"))


@query(sql("p", f"""{_F}, w as (select location_id, e - e%600 - k*600 as start, n_echo from f, range(8) x(k))
select location_id, start::bigint as start, count(*) as n_frames, sum(n_echo)::bigint as n_echo from w where start + 4800 <= (select max(e) from f) - 4800 group by all"""))
def stream_sliding(spark, sf_dir):
    """Windows that the watermark has closed. One micro-batch reads all files, so that no order of theirs makes a frame late."""
    folder = _folder(spark)
    _frames(spark, sf_dir).write.parquet(f"{folder}/in")
    frames.run_to_end(frames.sliding_windows(frames.read_frames(spark, f"{folder}/in", ALL_FILES)), f"{folder}/out", f"{folder}/cp")
    out = spark.read.schema("location_id long, start timestamp, end timestamp, n_frames long, n_echo long").parquet(f"{folder}/out")
    return out.select("location_id", F.unix_seconds("start").alias("start"), "n_frames", "n_echo")


def _polled(spark: SparkSession, sf_dir: str, folder: str, files_per_trigger: int) -> DataFrame:
    """A stream of frames with their pixels: in files that mix sessions and frames, each of them twice."""
    f = tracks.frames(tables.pixels(spark, sf_dir))
    f.repartition(3, "session_id", "frame_idx").write.parquet(f"{folder}/in")
    f.repartition(2, "frame_idx").write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(tracks.FRAME).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/in")


def _to_end(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None]) -> None:
    with state.rocksdb(stream.sparkSession):
        q = stream.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()


@query(pixel_queries.SQL["tracks"])
def stream_tracks(spark, sf_dir, files_per_trigger=2):
    """Tracks as frames arrive, out of order and twice, from a bounded store of frames."""
    folder = _folder(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.select("session_id", "frame_idx", "seq", "label", "root_frame", "root_label").write.mode("append").parquet(f"{folder}/out")

    _to_end(tracks.track_stream(_polled(spark, sf_dir, folder, files_per_trigger)), folder, keep)
    rows = spark.read.parquet(f"{folder}/out")
    last = rows.groupBy("session_id", "frame_idx").agg(F.max_by(F.arrays_zip("label", "root_frame", "root_label"), "seq").alias("m"))
    return last.select("session_id", "frame_idx", F.explode("m").alias("x")).select("session_id", "frame_idx", "x.label", "x.root_frame", "x.root_label")


@query(pixel_queries.SQL["detect"])
def stream_detect(spark, sf_dir, files_per_trigger=2):
    """Detection as frames arrive: pixels come with the stream, and each micro-batch detects from the frames,
    cells and tracks that the state holds of the sessions it changes."""
    folder = _folder(spark)
    places, d = pixel_queries._places(spark, sf_dir), pixel_queries.D

    def detected(batch: DataFrame, number: int) -> None:
        held = state.stage(batch)  # several branches read it, and the state is asked once
        sessions = held.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_frames"), F.max("seq").alias("seq"))
        out = detect.detect_analysed(tracks.analysis_of(held, d), places, sessions.drop("seq"), d)
        out.join(sessions.select("session_id", "seq"), "session_id").write.mode("append").parquet(f"{folder}/out")

    _to_end(tracks.track_stream(_polled(spark, sf_dir, folder, files_per_trigger)), folder, detected)
    rows = spark.read.parquet(f"{folder}/out")
    kept = [c for c in rows.columns if c not in ("session_id", "location_id", "seq")]
    last = rows.groupBy("session_id", "location_id").agg(F.max_by(F.struct(*kept), "seq").alias("m")).select("session_id", "location_id", "m.*")
    return last.withColumns({c: F.round(c, 6) for c in ("arrival_s", "max_intensity")})


@query(sql("pl", f"select location_id, max(1704067200 + session_id*86400 + frame_idx*600)::bigint as last_rain_epoch from pixels join places on abs(r-loc_row) <= {int(PX)} and abs(c-loc_col) <= {int(PX)} where inten >= {D.intensity} group by all"))
def stream_last_rain(spark, sf_dir, files_per_trigger=2):
    """When it last rained near each place, kept as state of the stream."""
    folder = _folder(spark)
    each = _polled(spark, sf_dir, folder, files_per_trigger).select("session_id", "frame_idx", F.explode(F.arrays_zip("r", "c", "inten")).alias("x"))
    pixels = filters.threshold(each.select("session_id", "frame_idx", "x.r", "x.c", "x.inten"), D.intensity)
    near = pixels.join(F.broadcast(arrival.squares(pixel_queries._places(spark, sf_dir), D)), ["r", "c"])  # the configured places of a run
    hits = near.select("location_id", tables.frame_epoch(F.col("session_id"), F.col("frame_idx")).alias("epoch"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(f"{folder}/out")

    _to_end(tracks.last_rain_stream(hits), folder, keep)
    return spark.read.schema("location_id long, epoch long").parquet(f"{folder}/out").groupBy("location_id").agg(F.max("epoch").alias("last_rain_epoch"))


def _cycles(spark, sf_dir):
    p = tables.pixels(spark, sf_dir)
    return p.select(F.col("session_id").alias("location_id"), F.col("frame_idx").cast("long").alias("cycle"), "r", "c", "inten")


_STATE = "select session_id as location_id, r, c, round(sum(pow(0.99966, l - frame_idx)),6) as echo_count from (select *, max(frame_idx) over (partition by session_id, r, c) as l from pixels where inten > 0.01) group by all"


@query(sql("p", _STATE))
def stream_clutter(spark, sf_dir):
    folder = _folder(spark)
    _cycles(spark, sf_dir).repartition("cycle").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema("location_id long, cycle long, r long, c long, inten double").parquet(f"{folder}/in")
    out = clutter.clutter_stream(stream)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    q = out.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(clutter.OUT + ", batch long").parquet(f"{folder}/out")
    last = rows.groupBy("location_id", "r", "c").agg(F.max(F.struct("batch", "echo_count")).alias("m"))
    return last.select("location_id", "r", "c", F.round("m.echo_count", 6).alias("echo_count"))


@query(sql("p", _STATE))
def clutter_cycle_store(spark, sf_dir):
    """The state folded in two parts, saved and loaded in between, equals one pass."""
    folder = _folder(spark)
    p = _cycles(spark, sf_dir)
    first = state.fold_clutter(state.load_clutter(spark, f"{folder}/none"), p.filter("cycle < 4"))
    state.save_clutter(first, f"{folder}/state")
    out = state.fold_clutter(state.load_clutter(spark, f"{folder}/state"), p.filter("cycle >= 4"))
    return out.select("location_id", "r", "c", F.round("echo_count", 6).alias("echo_count"))


@query(sql("p", f"{_F} select location_id, count(*) as n, sum(n_echo)::bigint as n_echo, count(*) filter (where n_echo > 50) as n_rain from f group by all"))
def medallion_capture(spark, sf_dir):
    folder = _folder(spark)
    f = _frames(spark, sf_dir).withColumn("frame_idx", F.split("path", "/")[1].cast("int"))
    files.write_layers(f, folder, F.when(F.col("n_echo") > 50, "rain").otherwise("none"))
    s = spark.read.parquet(f"{folder}/silver")
    return s.groupBy("location_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_echo").alias("n_echo"), F.count_if(F.col("classification") == "rain").alias("n_rain"))


@query("select epoch(date_trunc('hour', ts))::bigint as valid, (floor(max(value))::bigint % 101)::double as pop from events group by 1")
def forecast_scan(spark, sf_dir):
    """The forecast as the service's JSON, written and read back."""
    folder = _folder(spark)
    f = tables.forecast(spark, sf_dir).withColumn("day", F.floor(F.col("hour") / 86_400))
    rows = F.array_sort(F.collect_list(F.struct(F.date_format(F.timestamp_seconds("hour"), "yyyy-MM-dd'T'HH:mm").alias("t"), F.col("pop").alias("p"))))
    j = f.groupBy("day").agg(rows.alias("x")).select(F.to_json(F.struct(F.struct(F.col("x.t").alias("time"), F.col("x.p").alias("precipitation_probability")).alias("hourly"))).alias("value"))
    j.repartition(31, "value").write.option("maxRecordsPerFile", 1).text(f"{folder}/in")
    out = files.hourly_forecast(spark, f"{folder}/in")
    return out.select(F.unix_seconds("valid_ts").alias("valid"), "pop")


def _manifests(spark: SparkSession, sf_dir: str, folder: str, which: Column | None = None) -> str:
    """A manifest file for each session: all frames with echo, the newest again as a nowcast."""
    f = tables.pixels(spark, sf_dir).select("session_id", "frame_idx").distinct().filter(F.lit(True) if which is None else which)
    each = F.struct(tables.frame_epoch(F.col("session_id"), F.col("frame_idx")).alias("time"), F.concat_ws("/", F.lit(""), F.col("session_id").cast("string"), F.col("frame_idx").cast("string")).alias("path"))
    past = F.array_sort(F.collect_list(each))
    m = f.groupBy("session_id").agg(past.alias("past"))
    j = F.to_json(F.struct(F.lit("2.0").alias("version"), F.struct("past", F.slice("past", -1, 1).alias("nowcast")).alias("radar")))
    m.select("session_id", j.alias("value")).write.mode("append").partitionBy("session_id").option("maxRecordsPerFile", 1).text(f"{folder}/in")
    return f"{folder}/in/*/"


def _listed(f: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return f.select(parts[1].cast("long").alias("session_id"), parts[2].cast("long").alias("frame_idx"), F.unix_seconds("frame_ts").alias("epoch"))


_LISTED = ", f as (select distinct session_id, frame_idx from pixels), k as (select *, row_number() over (partition by session_id order by frame_idx desc) as back from f)"
_EPOCH = "(1704067200 + session_id*86400 + frame_idx*600)::bigint as epoch"


@query(sql("p", f"{_LISTED} select session_id, frame_idx, {_EPOCH} from k where back <= 5"))
def manifest_frames(spark, sf_dir):
    """The last five frames that each manifest file names."""
    return _listed(files.frames(spark, _manifests(spark, sf_dir, _folder(spark)), 5))


@query(sql("p", f"{_LISTED} select session_id, frame_idx, {_EPOCH} from (select * from k union all select * from k where back = 1)"))
def manifest_with_nowcast(spark, sf_dir):
    """Past frames and then those of the nowcast; one that both name stands twice."""
    return _listed(files.frames(spark, _manifests(spark, sf_dir, _folder(spark)), 100, nowcast=True))


def _named(f: DataFrame) -> DataFrame:
    parts = F.split("path", "/")
    return f.select("kind", "place", parts[1].cast("long").alias("session_id"), parts[2].cast("long").alias("frame_idx"), "epoch")


_NAMED = sql("p", f"""{_LISTED} select 'past' as kind, (row_number() over (partition by session_id order by frame_idx) - 1)::int as place, session_id, frame_idx, {_EPOCH} from k
union all select 'nowcast', 0::int, session_id, frame_idx, {_EPOCH} from k where back = 1""")


@query(_NAMED)
def manifest_source_scan(spark, sf_dir):
    """All that manifests name, by the data source, one partition a file."""
    folder = _folder(spark)
    _manifests(spark, sf_dir, folder)
    manifest_source.register(spark)
    return _named(spark.read.format(manifest_source.NAME).option("path", f"{folder}/in").option("pattern", "*.txt").load())


@query(_NAMED)
def manifest_stream(spark, sf_dir):
    """The same as manifests arrive: half of the sessions, a stop, then the rest; each counts once."""
    folder = _folder(spark)
    manifest_source.register(spark)

    def poll() -> None:
        stream = spark.readStream.format(manifest_source.NAME).option("path", f"{folder}/in").option("pattern", "*.txt").option("log", f"{folder}/log").load()
        q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    for half in (0, 1):
        _manifests(spark, sf_dir, folder, F.col("session_id") % 2 == half)
        poll()
    return _named(spark.read.schema(manifest_source.SCHEMA).parquet(f"{folder}/out"))


@query(sql("p", f""", n as (select count(distinct (session_id, frame_idx)) as past from pixels), {GEO}, t as (select location_id, lat, lon, trunc({_X})::int as x, trunc({_Y})::int as y from geod)
select location_id, round(lat,6) as lat, round(lon,6) as lon, n_name as name, x as center_x, y as center_y, (select past from n)::int as past, (select past from n)::int + 2 as frames, 25 as n_tiles, (x-2) || '/' || (y-2) || ' ' || (x+2) || '/' || (y-2) || ' ' || (x+2) || '/' || (y+2) as corners from t join nation on n_nationkey = location_id"""))
def capture_documents(spark, sf_dir):
    """What was captured of each place, written as documents and read back."""
    folder = _folder(spark)
    past = tables.pixels(spark, sf_dir).select("session_id", "frame_idx").distinct().agg(F.count(F.lit(1)).alias("past"))
    named = tables.places(spark, sf_dir).join(tables.locations(spark, sf_dir).select("location_id", "name"), "location_id")
    captured = named.crossJoin(F.broadcast(past)).withColumns({"captured": F.lit("2026-04-10 20:40:00").cast("timestamp"), "nowcast": F.lit(2)})  # one row
    files.write_capture_info(files.capture_info(captured, 7), f"{folder}/info")
    j = spark.read.schema(files.CAPTURE).option("recursiveFileLookup", True).json(f"{folder}/info").withColumn("location_id", F.regexp_extract(F.input_file_name(), "location_id=(\\d+)", 1).cast("long"))

    def corner(i: int):
        t = F.col("tile_coords")[i]
        return F.concat_ws("/", t["x"].cast("string"), t["y"].cast("string"))

    return j.select("location_id", F.round("location.lat", 6).alias("lat"), F.round("location.lon", 6).alias("lon"), "location.name", F.col("center_tile.x").alias("center_x"), F.col("center_tile.y").alias("center_y"),
                    F.col("past_frame_count").alias("past"), F.col("frame_count").alias("frames"), F.size("tile_coords").alias("n_tiles"), F.concat_ws(" ", corner(0), corner(4), corner(24)).alias("corners"))


@query("select epoch(date_trunc('hour', ts))::bigint as hour, case when (floor(max(value))::bigint % 4) <> 0 then ((floor(max(value))::bigint % 101)/10.0)::double end as mm from events group by 1")
def current_precipitation(spark, sf_dir):
    """What falls now, from the service's JSON; null where the answer lacks it."""
    folder = _folder(spark)
    e = tables.table(spark, sf_dir, "events")
    hour = F.unix_seconds(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    v = e.groupBy(hour.alias("hour")).agg(F.floor(F.max("value")).alias("v"))
    mm = F.when(F.col("v") % 4 != 0, F.col("v") % 101 / 10.0)
    j = F.to_json(F.struct(F.struct(mm.alias("precipitation")).alias("current")))
    v.select("hour", j.alias("value")).repartition("hour").write.partitionBy("hour").text(f"{folder}/in")
    out = files.current_precipitation(spark, f"{folder}/in/*/")
    return out.select(F.regexp_extract("file", "hour=(\\d+)", 1).cast("long").alias("hour"), F.col("mm"))
