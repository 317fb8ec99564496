"""Detection on synthetic grids: 64 x 64, frames ten minutes apart."""

import pytest

from pluvio.config import Detector
from pluvio.plans import detect

PLACE = (32, 32)
BLOCK = [(r, c) for r in range(3) for c in range(3)]


def run(spark, frames, value=0.6, multiplier=1.0, **settings):
    """frames: per frame the pixels with echo, or (pixels, value)."""
    n = len(frames)
    pixels = [(0, f, r, c, value) for f, at in enumerate(frames) for r, c in at]
    df = spark.createDataFrame(pixels, "session_id long, frame_idx long, r long, c long, inten double")
    places = spark.createDataFrame([(0, *PLACE)], "location_id long, loc_row long, loc_col long")
    sessions = spark.createDataFrame([(0, n)], "session_id long, n_frames long")
    (row,) = detect.detect(df, places, sessions, Detector(**settings), frames=n, multiplier=multiplier).collect()
    return row


def block(row, col):
    return [(row + r, col + c) for r, c in BLOCK]


def test_confidence_by_frame_count(spark):
    assert run(spark, [block(1, 1)]).confidence == "unavailable"
    assert run(spark, [block(1, 1)] * 2).confidence == "degraded"
    assert run(spark, [block(1, 1)] * 3).confidence == "normal"


def test_overhead_pixel_arrives_now(spark):
    row = run(spark, [[PLACE]] * 3, value=0.8)
    assert row.rain_expected and row.rain_at_location and row.arrival_s == 0.0 and row.max_intensity == 0.8


def test_approaching_cell_arrives_later(spark):
    row = run(spark, [block(30, c) for c in (18, 22, 26)])
    assert row.rain_expected and row.arrival_s > 0 and not row.rain_at_location
    assert row.max_intensity == pytest.approx(0.6)


@pytest.mark.parametrize("frames", [[block(30, c) for c in (36, 40, 44)], [block(5, c) for c in (20, 24, 28)]])
def test_receding_and_passing_cells_do_not(spark, frames):
    assert not run(spark, frames).rain_expected


def test_outside_lookahead(spark):
    assert not run(spark, [block(30, c) for c in (5, 6, 7)], lookahead_s=300).rain_expected


@pytest.mark.parametrize(("value", "n", "multiplier", "want"), [(0.15, 3, 1.0, True), (0.15, 3, 2.0, False), (0.8, 3, 2.0, True), (0.8, 2, 2.0, False)])
def test_required_frames_and_bypass(spark, value, n, multiplier, want):
    frames = [block(30, c) for c in (18, 22, 26)][-n:]
    assert run(spark, frames, value=value, multiplier=multiplier).rain_expected is want


def test_too_fast_cells_are_dropped(spark):
    assert not run(spark, [block(30, c) for c in (2, 12, 22)]).rain_expected


def test_empty_session(spark):
    row = run(spark, [[], [], []])
    assert not row.rain_expected and row.n_cells == 0


def under_qc(spark, frames, conf, **settings):
    """frames: per frame pixels and value; conf: per frame the confidence of all its pixels."""
    pixels = [(0, f, r, c, v) for f, (at, v) in enumerate(frames) for r, c in at]
    df = spark.createDataFrame(pixels, "session_id long, frame_idx long, r long, c long, inten double")
    known = spark.createDataFrame([(*p[:4], conf[p[1]]) for p in pixels if conf[p[1]] is not None] or [], "session_id long, frame_idx long, r long, c long, conf double")
    places = spark.createDataFrame([(0, 0, *PLACE)], "session_id long, location_id long, loc_row long, loc_col long")
    sessions = spark.createDataFrame([(0, len(frames))], "session_id long, n_frames long")
    (row,) = detect.detect(df, places, sessions, Detector(**settings), frames=len(frames), confidence=known).collect()
    return row


APPROACH = [(block(30, c), 0.6) for c in (18, 22, 26)]


def test_confidence_decides_on_cells_and_not_on_their_intensity(spark):
    row = under_qc(spark, APPROACH, [0.5, 0.5, 0.5])
    assert row.rain_expected and row.max_intensity == pytest.approx(0.6)  # as measured, not halved
    assert not under_qc(spark, APPROACH, [0.1, 0.1, 0.1]).rain_expected  # 0.06 is below the threshold


def test_doubtful_cells_are_tracked_but_do_not_arrive(spark):
    row = under_qc(spark, APPROACH, [0.6, 0.6, 0.3])
    assert not row.rain_expected and row.n_cells == 1


def test_frames_without_confidence_keep_their_values(spark):
    row = under_qc(spark, APPROACH, [None, None, None])
    assert row.rain_expected and row.max_intensity == pytest.approx(0.6)


def test_a_doubtful_newest_frame_gives_way_to_the_one_before(spark):
    overhead = [(block(31, 31), 0.9)] * 3
    sure, doubtful = under_qc(spark, overhead, [0.9, 0.9, 0.9]), under_qc(spark, overhead, [0.9, 0.9, 0.3])
    assert sure.rain_at_location and sure.arrival_s == 0.0
    assert doubtful.rain_at_location and doubtful.arrival_s == -600.0


def test_strong_bypass_goes_by_measured_intensity(spark):
    frames = [(at, 0.25) for at, _ in APPROACH]
    pixels = under_qc(spark, frames, [0.5, 0.5, 0.5], min_frames=4)
    assert pixels.rain_expected  # 0.125 effective, 0.25 measured


def test_acceleration_brings_the_arrival_forward(spark):
    frames = [block(30, c) for c in (12, 14, 18, 24)]
    plain, faster = run(spark, frames), run(spark, frames, accelerate=True)
    assert faster.arrival_s < plain.arrival_s


def test_each_session_meets_its_own_places(spark):
    pixels = [(s, f, r, c, 0.6) for s in (0, 1) for f, at in enumerate([block(30, c) for c in (18, 22, 26)]) for r, c in at]
    df = spark.createDataFrame(pixels, "session_id long, frame_idx long, r long, c long, inten double")
    places = spark.createDataFrame([(0, 7, *PLACE), (1, 8, 60, 60)], "session_id long, location_id long, loc_row long, loc_col long")
    sessions = spark.createDataFrame([(0, 3), (1, 3)], "session_id long, n_frames long")
    got = {(r.session_id, r.location_id): r.rain_expected for r in detect.detect(df, places, sessions, frames=3).collect()}
    assert got == {(0, 7): True, (1, 8): False}
