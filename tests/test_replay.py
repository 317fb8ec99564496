"""Replay of all windows against detection on each window alone."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pluvio.config import Detector
from pluvio.operators import tracking
from pluvio.plans import detect, replay

PIXEL = "session_id long, frame_idx long, r long, c long, inten double"
SPOT = "location_id long, loc_row long, loc_col long"


def history(seed=1, frames=14, sessions=2):
    """Blocks that drift, turn, appear and vanish; one frame is missing."""
    r = random.Random(seed)
    rows = {}
    for s in range(sessions):
        cells = [(r.uniform(0, 60), r.uniform(0, 60), r.uniform(-3, 3), r.uniform(-3, 4), r.choice([0.15, 0.38, 0.88]), r.randrange(frames), r.randrange(3, 14)) for _ in range(25)]
        for f in range(frames):
            if (s, f) == (1, 6):
                continue
            for y, x, vy, vx, value, born, age in cells:
                if born <= f < born + age:
                    jitter = r.uniform(-1, 1)
                    for i in range(2):
                        for j in range(3):
                            at = int(y + vy * (f - born) + jitter) + i, int(x + vx * (f - born)) + j
                            if 0 <= at[0] < 64 and 0 <= at[1] < 64:
                                rows[s, f, *at] = max(value, rows.get((s, f, *at), 0))
    return [(*k, v) for k, v in rows.items()]


def columns(df, *names):
    out = []
    for row in df.select(*names).collect():
        out.append(tuple(round(v, 6) if isinstance(v, float) else v for v in row))
    return sorted(out, key=str)


NAMES = ("location_id", "rain_expected", "arrival_s", "max_intensity", "rain_at_location", "n_cells", "confidence")


@pytest.mark.parametrize(("length", "settings"), [(8, {}), (3, {}), (5, {"accelerate": True}), (4, {"min_area": 4})])
def test_each_window_is_as_detected_alone(spark, length, settings):
    d = replace(Detector(), **settings)
    rows, last = history(), 13
    pixels = spark.createDataFrame(rows, PIXEL)
    places = spark.createDataFrame([(k, (k * 13) % 64, (k * 29) % 64) for k in range(6)], SPOT)
    ends = replay.windows(pixels, length, 0, last)
    got = replay.replay(pixels, places, ends, d, length).withColumn("session_id", F.col("session_id") * 100 + F.col("end_frame"))
    # each window as a session whose last frame has the number length - 1
    e = F.explode(F.sequence(F.col("frame_idx"), F.least(F.col("frame_idx") + length - 1, F.lit(last))))
    alone = pixels.withColumn("e", e).select((F.col("session_id") * 100 + F.col("e")).alias("session_id"), (F.col("frame_idx") - F.col("e") + length - 1).alias("frame_idx"), "r", "c", "inten")
    sessions = ends.select((F.col("session_id") * 100 + F.col("end_frame")).alias("session_id"), "n_frames")
    want = detect.detect(alone, places, sessions, d, frames=length)
    have = columns(got, "session_id", *NAMES)
    assert have == columns(want, "session_id", *NAMES)
    assert {r[3] is None for r in have} == {True, False} and len({r[7] for r in have}) > 1


def test_settings_share_one_analysis(spark):
    rows, d = history(2, 8, 1), Detector()
    pixels = spark.createDataFrame(rows, PIXEL)
    places = spark.createDataFrame([(k, (k * 13) % 64, (k * 29) % 64) for k in range(6)], SPOT)
    ends = replay.windows(pixels, 8, 7, 7)
    settings = [(0, 15.0, 1800), (1, 5.0, 1800), (2, 5.0, 600), (3, 2.5, 3600)]
    out = replay.replay(pixels, places, ends, d, 8, variants=spark.createDataFrame(settings, "variant int, proximity_km double, lookahead_s int"))
    for variant, km, ahead in settings:
        want = detect.detect(pixels, places, ends.select("session_id", "n_frames"), replace(d, proximity_km=km, lookahead_s=ahead))
        assert columns(out.filter(F.col("variant") == variant), *NAMES) == columns(want, *NAMES)


def block(row, col):
    return [(row + i, col + j) for i in range(3) for j in range(3)]


def test_a_gate_is_of_one_place_and_window(spark):
    frames = [block(30, c) for c in (14, 18, 22, 26)]
    rows = [(0, f, r, c, 0.15) for f, at in enumerate(frames) for r, c in at]
    pixels = spark.createDataFrame(rows, PIXEL)
    places = spark.createDataFrame([(1, 32, 32), (2, 32, 32)], SPOT)
    gates = spark.createDataFrame([(0, 2, 1, 2.0), (0, 3, 1, 2.0), (0, 3, 2, 3.0)], "session_id long, end_frame long, location_id long, multiplier double")
    out = replay.replay(pixels, places, replay.windows(pixels, 8, 0, 3), Detector(), 8, gates)
    got = {(r.end_frame, r.location_id): r.rain_expected for r in out.collect()}
    # place 1 asks for four frames at ends 2 and 3; place 2 for six at end 3
    assert got == {(0, 1): False, (0, 2): False, (1, 1): True, (1, 2): True, (2, 1): False, (2, 2): True, (3, 1): True, (3, 2): False}


def test_what_came_is_looked_for_after_the_window(spark):
    place = [(32, 32)]
    frames = [[(1, 1)], [(1, 1)], [(1, 1)], [(1, 1)], place, [(1, 1)], [(1, 1)], [(1, 1)], place]
    rows = [(0, f, r, c, 0.5) for f, at in enumerate(frames) for r, c in at]
    pixels = spark.createDataFrame(rows, PIXEL)
    places = spark.createDataFrame([(1, 32, 32)], SPOT)
    out = replay.replay(pixels, places, replay.windows(pixels, 3, 0, 8), Detector(), 3)
    got = {r.end_frame: r.actual_s for r in out.collect()}
    assert got == {0: None, 1: 1800.0, 2: 1200.0, 3: 600.0, 4: None, 5: 1800.0, 6: 1200.0, 7: 600.0, 8: None}


@pytest.mark.parametrize(("length", "peak", "multiplier", "want"), [(2, 0.1, 1.0, "accepted"), (3, 0.1, 1.0, "accepted"), (4, 0.1, 1.0, "accepted"), (2, 0.1, 2.0, "too_short"), (3, 0.1, 2.0, "too_short"), (3, 0.5, 2.0, "bypass"), (4, 0.1, 2.0, "accepted"), (1, 0.9, 1.0, "too_short")])
def test_reasons_follow_the_gate(spark, length, peak, multiplier, want):
    s = spark.createDataFrame([(length, 7, peak), (length, 6, peak)], "length int, last_frame int, track_peak double")
    ended, early = sorted(tracking.diagnosed(s, Detector(), 7, multiplier).collect(), key=lambda r: -r.last_frame)
    assert ended.status == ("accepted" if want == "accepted" else "dropped") and ended.accepted_by_bypass is (want == "bypass")
    assert ended.reason == (None if want == "accepted" else "too_short")
    assert early.reason == ("ended_early" if want == "accepted" else "too_short") and not early.accepted_by_bypass
