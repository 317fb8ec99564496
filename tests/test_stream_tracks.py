"""The bounded store of frames against tracks made at once, as frames come late, twice and after a restart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvio.config import Detector
from pluvio.operators import components, filters, tracking
from pluvio.plans import file_queries
from pluvio.streaming import tracks
from tests.test_replay import history

D = Detector()


def arrays(rows, frame):
    at = np.array([(r, c, v) for _, f, r, c, v in rows if f == frame]).reshape(-1, 3)
    return at[:, 0].astype(np.int64), at[:, 1].astype(np.int64), at[:, 2]


def whole(spark, rows):
    df = spark.createDataFrame(rows, "session_id long, frame_idx long, r long, c long, inten double")
    cells = components.cells(components.label(filters.threshold(df, D.intensity)))
    made = tracking.tracks(cells, D.max_match_px)
    return {(r.session_id, r.frame_idx, r.label): (r.root_frame, r.root_label, round(r.row_c, 9), round(r.col_c, 9), r.area, r.peak, r.r_min, r.r_max, r.c_min, r.c_max) for r in made.collect()}


def held(store, session):
    out = {}
    for at, f in store.frames.items():
        for i, label in enumerate(f["label"].tolist()):
            out[session, at, label] = (int(f["root_frame"][i]), int(f["root_label"][i]), round(float(f["row_c"][i]), 9), round(float(f["col_c"][i]), 9), int(f["area"][i]), float(f["peak"][i]), int(f["r_min"][i]), int(f["r_max"][i]), int(f["c_min"][i]), int(f["c_max"][i]))
    return out


@pytest.mark.parametrize("order", [range(14), [3, 1, 2, 0, 5, 4, 7, 6, 9, 8, 11, 10, 13, 12], [2, 2, 0, 1, 1, 3, 4, 6, 5, 7, 8, 9, 9, 10, 12, 11, 13]])
def test_a_store_keeps_eight_frames_and_the_roots_of_all(spark, order):
    rows = [r for r in history(5, 14, 1)]
    want = whole(spark, rows)
    store = tracks.Store({}, 8, D.max_match_px)
    for at in order:
        store.add(at, tracks.frame_of(*arrays(rows, at), D.intensity, at))
    assert sorted(store.frames) == list(range(6, 14)) and set(store.gone) == set(range(6))
    assert held(store, 0) == {k: v for k, v in want.items() if k[1] >= 6}
    assert not store.add(2, tracks.frame_of(*arrays(rows, 2), D.intensity, 2))  # too late


def test_pairs_are_matched_once(monkeypatch):
    rows = history(5, 8, 1)
    seen, real = [], tracks.matched
    monkeypatch.setattr(tracks, "matched", lambda a, b, most: (seen.append(1), real(a, b, most))[1])
    store = tracks.Store({}, 8, D.max_match_px)
    for at in [4, 0, 7, 2, 1, 5, 3, 6, 4, 0]:
        store.add(at, tracks.frame_of(*arrays(rows, at), D.intensity, at))
    assert len(seen) == 7


def test_one_file_a_batch_late_twice_and_after_a_restart(spark, tmp_path):
    rows = [r for r in history(7, 5, 2)]
    want = whole(spark, rows)
    frames = tracks.frames(spark.createDataFrame(rows, "session_id long, frame_idx long, r long, c long, inten double"))
    keys = [(r.session_id, r.frame_idx) for r in frames.select("session_id", "frame_idx").collect()]
    order = keys + keys[:3]
    random.Random(3).shuffle(order)

    def arrive(some):
        for s, f in some:
            frames.filter((F.col("session_id") == s) & (F.col("frame_idx") == f)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def poll():
        stream = spark.readStream.schema(tracks.FRAME).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        file_queries._to_end(tracks.track_stream(stream), str(tmp_path), lambda b, n: b.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out")))

    arrive(order[:5])
    poll()
    arrive(order[5:])
    poll()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.countDistinct("batch")).first()[0] == len(keys)  # nothing comes of a frame that is known
    last = out.groupBy("session_id", "frame_idx").agg(F.max_by(F.arrays_zip("label", "root_frame", "root_label"), "seq").alias("m"))
    got = {(r.session_id, r.frame_idx, x.label): (x.root_frame, x.root_label) for r in last.collect() for x in r.m}
    assert got == {k: v[:2] for k, v in want.items()}


def test_an_empty_frame_holds_its_place(spark):
    none = np.empty(0, np.int64)
    store = tracks.Store({}, 3, 16.0)
    one = [np.array([5]), np.array([5]), np.array([0.5])]
    for at, pixels in enumerate([one, [none, none, none.astype(float)], one]):
        assert store.add(at, tracks.frame_of(*pixels, 0.1, at))
    assert store.frames[2]["root_frame"].tolist() == [2] and store.frames[1]["label"].size == 0
