"""Files of tiles and of state that are damaged or absent."""

import numpy as np

from pluvio.sources import files, state


def write(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_each_tile_has_a_status_and_damage_stays_its_own(spark, tmp_path):
    rgba = np.random.default_rng(0).integers(0, 256, (9, 7, 4), dtype=np.uint8)
    rgba[..., 3] = 255
    good = files.png(rgba)
    for x, data in ((0, good), (1, good[: len(good) // 2]), (2, b""), (3, b"no image at all"), (5, good[:20])):
        write(tmp_path / "600" / f"7_{x}_4_s2.png", data)
    write(tmp_path / "600" / "notes.png", good)
    wanted = spark.createDataFrame([(600, 7, x, 4, 2) for x in range(6)] + [(1200, 7, 0, 4, 2)], "epoch long, zoom long, x long, y long, scheme long")
    rows = files.fetched(spark, str(tmp_path), wanted).collect()
    assert {(r.epoch, r.x): r.status for r in rows} == {(600, 0): "ok", (600, 1): "unreadable", (600, 2): "empty", (600, 3): "unreadable", (600, 4): "absent", (600, 5): "unreadable", (1200, 0): "absent"}
    (ok,) = [r for r in rows if r.status == "ok"]
    assert (ok.width, ok.height, ok.channels) == (7, 9, 4)
    assert (np.frombuffer(ok.data, np.uint8).reshape(9, 7, 4)[..., [2, 1, 0, 3]] == rgba).all()
    frames = {r.epoch: (r.n_tiles, r.n_ok, r.fetch_ok) for r in files.frame_fetches(files.fetched(spark, str(tmp_path), wanted)).collect()}
    assert frames == {600: (6, 1, True), 1200: (1, 0, False)}


def test_clutter_that_cannot_be_read_is_none_with_a_warning(spark, tmp_path):
    folder = str(tmp_path / "state")
    none, warned = state.clutter_or_warning(spark, folder)
    assert none.count() == 0 and warned.count() == 0
    saved = spark.createDataFrame([(1, 2, 3, 0.5, 7)], state.CLUTTER)
    state.save_clutter(saved, folder)
    whole, warned = state.clutter_or_warning(spark, folder)
    assert whole.collect() == saved.collect() and warned.count() == 0
    state.save_clutter(saved.limit(0), folder)
    whole, warned = state.clutter_or_warning(spark, folder)
    assert whole.count() == 0 and warned.count() == 0
    (tmp_path / "state" / "part-x.parquet").write_bytes(b"PAR1 cut off")
    broken, warned = state.clutter_or_warning(spark, folder)
    assert broken.count() == 0 and [r.path.rsplit("/", 1)[1] for r in warned.collect()] == ["part-x.parquet"]
