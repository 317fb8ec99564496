"""Operators one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.functions import gates, palette
from pluvio.operators import components, filters, frames, qc, scans, tracking, verify
from pluvio.sources import files, state
from pluvio.streaming import clutter

PIXEL = "session_id long, frame_idx long, r long, c long, inten double"


def pixels(spark, rows):
    return spark.createDataFrame(rows, PIXEL)


def test_threshold_is_inclusive(spark):
    got = filters.threshold(pixels(spark, [(0, 0, 0, 0, 0.1), (0, 0, 0, 1, 0.09)])).collect()
    assert [r.c for r in got] == [0]


def test_components_join_at_edges_and_number_in_raster_order(spark):
    at = [(0, 5), (1, 5), (1, 4), (3, 0), (3, 1), (4, 2)]
    got = {(r.r, r.c): r.label for r in components.label(pixels(spark, [(0, 0, r, c, 0.5) for r, c in at])).collect()}
    assert got == {(0, 5): 1, (1, 5): 1, (1, 4): 1, (3, 0): 2, (3, 1): 2, (4, 2): 3}


def test_components_of_a_spiral(spark):
    at = [(0, c) for c in range(9)] + [(r, 8) for r in range(9)] + [(8, c) for c in range(9)] + [(r, 0) for r in range(2, 9)] + [(2, c) for c in range(7)]
    labels = {r.label for r in components.label(pixels(spark, [(0, 0, r, c, 0.5) for r, c in set(at)])).collect()}
    assert labels == {1}


def test_matching_is_one_to_one_and_inclusive(spark):
    rows = [(0, 0, 1, 10.0, 10.0), (0, 0, 2, 10.0, 12.0), (0, 1, 1, 10.0, 11.0), (0, 1, 2, 10.0, 28.0)]
    cells = spark.createDataFrame(rows, "session_id long, frame_idx long, label int, row_c double, col_c double")
    got = {(r.l0, r.l1) for r in tracking.match(cells, 16.0).collect()}
    assert got == {(1, 1), (2, 2)}


@pytest.mark.parametrize(("moves", "want"), [([(0, 1), (0, -1)], False), ([(0, 1), (1, 0)], True), ([(0, 1)], True), ([(0, 0), (0, 0)], False)])
def test_coherence(spark, moves, want):
    rows = [(0, 0, 1, i, 600, y / 600, x / 600) for i, (y, x) in enumerate(moves)]
    steps = spark.createDataFrame(rows, "session_id long, root_frame long, root_label int, frame_idx long, dt int, vy double, vx double")
    assert tracking.coherence(steps).first().coherent is want


def test_texture_of_a_corner_mirrors(spark):
    full = [(0, 0, r, c, 0.5) for r in range(5) for c in range(5)]
    got = {(r.r, r.c): r.texture for r in qc.texture(pixels(spark, full)).collect()}
    assert got[(0, 0)] == pytest.approx(1.0) and got[(4, 4)] < 0.1


def test_temporal_counts_up(spark):
    rows = [(0, f, 0, 0, 0.5) for f in (0, 2, 5)]
    got = [r.temporal for r in qc.temporal(pixels(spark, rows)).orderBy("frame_idx").collect()]
    assert got == pytest.approx([1 / 3, 2 / 3, 1.0])


def test_gates(spark):
    v = spark.createDataFrame([(x,) for x in (None, 0.0, 4.99, 5.0, 29.99, 30.0, 100.0)], "p double")
    assert [r[0] for r in v.select(gates.pop_multiplier(F.col("p"))).collect()] == [1, 3, 3, 2, 2, 1, 1]
    v = spark.createDataFrame([(x,) for x in (None, 0.0, 0.09, 0.1, 1.0)], "p double")
    assert [r[0] for r in v.select(gates.cloud_multiplier(F.col("p"))).collect()] == [1, 3, 3, 1, 1]


def test_next_poll_is_strictly_later(spark):
    minutes = {9: 11, 10: 11, 11: 21, 21: 31, 55: 61}
    v = spark.createDataFrame([(m * 60,) for m in minutes], "s long")
    assert [r[0] for r in v.select(gates.next_poll(F.col("s"))).collect()] == [m * 60 for m in minutes.values()]


def test_palette_ties_and_distance(spark):
    v = spark.createDataFrame([(81, 197, 232, 255), (170, 158, 121, 255), (193, 0, 0, 9)], "r int, g int, b int, a int")
    i = palette.intensity(F.col("r"), F.col("g"), F.col("b"), F.col("a"))
    assert [r[0] for r in v.select(i).collect()] == [0.1, 0.0, 0.0]


def test_published_scores(spark):
    c = spark.createDataFrame([(5698, 893, 1437, 17970)], "hits long, misses long, false_alarms long, correct_negatives long")
    r = verify.scores(c).first()
    assert (round(r.pod, 3), round(r.far, 3), round(r.csi, 3)) == (0.865, 0.201, 0.710)


def test_forward_window_excludes_its_start(spark):
    p = spark.createDataFrame([(1, 0, 1000, True)], "event_id long, station long, t long, predicted boolean")
    for obs, want in ((1000, False), (1001, True), (1900, True), (1901, False)):
        o = spark.createDataFrame([(0, obs, 1.0)], "station long, obs long, rain_mm double")
        assert verify.observed(p, o, 900).first().observed is want


def test_as_of_takes_the_latest_at_or_before(spark):
    e = spark.createDataFrame([(1, 10), (1, 5), (2, 10)], "k long, t long")
    s = spark.createDataFrame([(1, 6, 0.5), (1, 10, 0.7), (1, 11, 0.9)], "k long, t long, v double")
    got = {(r.k, r.t): r.v for r in scans.as_of(e, s, "k", "t", "t", "v").collect()}
    assert got == {(1, 10): 0.7, (1, 5): None, (2, 10): None}


def test_clutter_folds_like_one_pass(spark):
    rows = [(0, c, 1, 1, 0.5) for c in (0, 3, 4)] + [(0, 9, 2, 2, 0.5)]
    p = spark.createDataFrame(rows, "location_id long, cycle long, r long, c long, inten double")
    empty = state.load_clutter(spark, "/nowhere")
    two = state.fold_clutter(state.fold_clutter(empty, p.filter("cycle < 4")), p.filter("cycle >= 4"))
    one = state.fold_clutter(empty, p)
    a, b = ({(r.r, r.c): round(r.echo_count, 9) for r in x.collect()} for x in (two, one))
    assert a == b and a[(1, 1)] == pytest.approx(1 + 0.99966 + 0.99966**4)


def test_manifest_scan(spark, tmp_path):
    past = ",".join(f'{{"time": {1000 + 600 * i}, "path": "/p{i}"}}' for i in range(13))
    (tmp_path / "m.json").write_text(f'{{"version": "2", "radar": {{"past": [{past}], "nowcast": []}}}}')
    got = [r.path for r in files.frames(spark, str(tmp_path), 8).orderBy("frame_ts").collect()]
    assert got == [f"/p{i}" for i in range(5, 13)]


def test_tile_scan(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + bytes([81, 197, 232, 255]) * 2 for _ in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    folder = tmp_path / "1700000000"
    folder.mkdir()
    (folder / "7_3_4_s2.png").write_bytes(png)
    (folder / "7_3_5_s2.png").write_bytes(b"not a picture")
    got = files.tile_pixels(files.tiles(spark, str(tmp_path))).collect()
    assert len(got) == 4 and {(r.epoch, r.x, r.y, r.r, r.g, r.b, r.alpha) for r in got} == {(1700000000, 3, 4, 81, 197, 232, 255)}


def test_every_minute_of_events_has_a_multiplier(spark, sf_dir):
    from pluvio.plans import registry

    minutes = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("now")).distinct()
    got = registry.QUERIES["pop_multiplier"](spark, sf_dir)
    assert sorted(r.now for r in got.collect()) == sorted(r.now for r in minutes.collect())


def test_detection_by_micro_batches(spark, sf_dir):
    from pluvio.plans import file_queries, registry

    cols = ["session_id", "location_id", "rain_expected", "arrival_s", "max_intensity", "rain_at_location", "n_cells", "confidence"]
    got = file_queries.stream_detect(spark, sf_dir, files_per_trigger=2).select(cols).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, registry.QUERIES["detect"](spark, sf_dir).select(cols).collect()))


def test_windows_are_written_by_more_than_one_task(spark, sf_dir, monkeypatch):
    import os

    from pluvio.plans import file_queries

    used = []
    folder = file_queries._folder
    monkeypatch.setattr(file_queries, "_folder", lambda s: used.append(folder(s)) or used[-1])
    monkeypatch.setattr(file_queries, "_frames", lambda s, d, f=file_queries._frames: f(s, d).repartition(3, "path"))
    got = file_queries.stream_sliding(spark, sf_dir)
    assert sum(n.startswith("part-") for n in os.listdir(f"{used[0].removeprefix('file:')}/in")) == 3
    rows = file_queries._frames(spark, sf_dir)
    ends = F.window("frame_ts", "80 minutes", "10 minutes")
    late = rows.agg(F.max("frame_ts") - F.expr("interval 80 minutes")).first()[0]
    want = rows.groupBy("location_id", ends.alias("w")).agg(F.count("*").alias("n"), F.sum("n_echo").alias("e")).filter(F.col("w.end") <= F.lit(late))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("location_id", F.unix_seconds("w.start"), "n", "e").collect()))


def _tiles(spark, tiles):
    return spark.createDataFrame([(1, x, y, w, w, 4, bytearray(data)) for x, y, w, data in tiles], "epoch long, x long, y long, width int, height int, channels int, data binary")


def test_tiles_decode_by_their_colours(spark):
    from pluvio.functions.palette import TIERS
    from pluvio.sources import files

    r = np.random.default_rng(3)
    colours = [*(t[:3] for t in TIERS), (0, 0, 0), (90, 200, 230)]
    at = r.integers(0, len(colours), 64 * 64)
    rgba = np.array([(*colours[i][::-1], 255) for i in at], np.uint8)
    rgba[r.random(len(at)) < 0.2, 3] = 9
    got = np.frombuffer(files.tile_levels(_tiles(spark, [(3, 4, 64, rgba.tobytes())])).first().levels, np.uint8)

    def level(b, g, red, alpha):
        d, i = min(((red - t[0]) ** 2 + (g - t[1]) ** 2 + (b - t[2]) ** 2, i) for i, t in enumerate(TIERS))
        return int(TIERS[i][3] * 255) if alpha >= 10 and d <= 3600 else 0

    assert got.tolist() == [level(*map(int, x)) for x in rgba]
    px = files.tile_pixels(_tiles(spark, [(3, 4, 64, rgba.tobytes())])).orderBy("row", "col").collect()
    assert [(p.b, p.g, p.r, p.alpha) for p in px] == [tuple(map(int, x)) for x in rgba]


def test_a_large_tile_decodes_fast():
    import time


    from pluvio.sources import files

    rgba = np.zeros((256 * 256, 4), np.uint8)
    rgba[20000:40000] = (232, 197, 81, 255)
    files.levels_of(rgba.tobytes())
    best = min(_seconds(time, lambda: files.levels_of(rgba.tobytes())) for _ in range(10))
    assert best < 0.02


def _seconds(time, f):
    t = time.perf_counter()
    f()
    return time.perf_counter() - t


def test_tiles_stitch_to_a_grid(spark):
    from pluvio.config import Bounds
    from pluvio.sources import files

    zoom, x, y, side = 7, 117, 76, 16
    west, east = files.tile_box(x, y, zoom), files.tile_box(x + 1, y, zoom)
    blank = np.zeros((side * side, 4), np.uint8)
    echo = blank.copy()
    echo[5 * side + 3] = (213, 154, 0, 255)
    tiles = [(x, y, side, echo.tobytes()), (x + 1, y, side, blank.tobytes()), (x + 9, y, side, echo.tobytes())]
    bounds = Bounds(west.lat_min, west.lat_max, west.lon_min + 1e-9, east.lon_max - 1e-9)
    decoded = files.tile_levels(_tiles(spark, tiles))
    (p,) = files.stitched(decoded, zoom, bounds, 2 * side - 1, side).collect()
    assert (p.r, p.c, p.inten) == (5, 3, 45 / 255)
    half = files.stitched(decoded, zoom, bounds, side, side).collect()
    assert {(q.r, q.c) for q in half} <= {(5, 1), (5, 2)} and max(q.inten for q in half) < 45 / 255


def test_resizing_keeps_even_surfaces():
    from pluvio.operators import mosaic as files

    even = np.full((10, 14), 96, np.uint8)
    assert (files.resized(even, 7, 5) == 96).all() and (files.resized(even, 23, 31) == 96).all()
    assert files.resized(even, 10, 14) is not None and (files.resized(even, 10, 14) == even).all()


def test_an_unknown_map_style_is_an_error(spark):
    styles = spark.createDataFrame([("voyager",), ("none",)], "style string")
    assert styles.filter("style = 'voyager'").select(gates.known_style(F.col("style")).alias("s")).first().s == "voyager"
    with pytest.raises(Exception, match="unknown map style: none"):
        styles.select(gates.known_style(F.col("style")).alias("s")).collect()


def test_late_echoes_of_a_square_count_as_in_time():
    counts, cycles = np.zeros(4), np.zeros(4, np.int64)
    clutter.folded(counts, cycles, np.array([1, 1, 2]), np.array([3, 5, 4]), 0.5)
    clutter.folded(counts, cycles, np.array([1, 2, 2]), np.array([4, 4, 6]), 0.5)
    assert counts.tolist() == [0.0, 0.25 + 1 + 0.5, 0.25 + 0.25 + 1, 0.0] and cycles.tolist() == [0, 5, 6, 0]


def test_functions_have_sql_names(spark):
    from pluvio.functions import registration

    assert "pluvio_rain_intensity" in registration.register(spark)
    got = spark.sql("select pluvio_rain_intensity(255, 68, 0, 255) a, pluvio_rain_intensity(255, 68, 0, 9) b, pluvio_intensity_label(0.5) c, pluvio_circular_variance(array(0D, pi())) d").first()
    assert (got.a, got.b, got.c) == (0.77, 0.0, "heavy") and got.d == pytest.approx(1.0)
