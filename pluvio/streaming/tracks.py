"""Polling with a bounded store: the newest frames of each location, their cells and open tracks, as state.

A new frame is labelled once and matched with the frames before and after it, where those are held;
no pair of frames is matched twice. A frame that comes again is passed over, one that comes late is
put in its place, and roots of tracks are carried on from there. A location holds ``keep`` frames: as
newer ones come, the oldest leave, while the roots of their tracks stay with the cells that go on.

Each change gives the held frames with their cells, tracks and pixels, which is what a detection needs:
neither pixels nor matches of earlier polls are read or made again."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pluvio.config import Detector
from pluvio.operators.components import _roots
from pluvio.operators.tracking import _greedy, _near
from pluvio.plans.detect import Analysis
from pluvio.operators import tracking

CELL = ("label", "row_c", "col_c", "area", "peak", "r_min", "r_max", "c_min", "c_max", "root_frame", "root_label")
_CELL_SQL = "label int, row_c double, col_c double, area long, peak double, r_min long, r_max long, c_min long, c_max long, root_frame long, root_label int"
_ARRAYS = "r array<long>, c array<long>, inten array<double>, pixel_label array<int>, " + ", ".join(f"{x.split()[0]} array<{x.split()[1]}>" for x in _CELL_SQL.split(", ")) + ", before array<int>"
HELD = [x.split()[0] for x in _ARRAYS.split(", ")]
#: One row for each frame that a location holds.
OUT = f"session_id long, frame_idx long, seq long, {_ARRAYS.rpartition(', ')[0]}"

Frame = dict[str, np.ndarray]


def frame_of(r: np.ndarray, c: np.ndarray, inten: np.ndarray, least: float, frame: int) -> Frame:
    """The pixels of a frame that are strong enough, and its cells; each is its own track as yet."""
    kept = inten >= least
    order = np.lexsort((c[kept], r[kept]))
    r, c, inten = r[kept][order], c[kept][order], inten[kept][order]
    root = _roots(r, c) if len(r) else np.empty(0, np.int64)
    label = np.unique(root, return_inverse=True)[1] if len(r) else root
    n = int(label.max(initial=-1)) + 1
    area = np.bincount(label, minlength=n)

    def ends(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(low, label, x)
        np.maximum.at(high, label, x)
        return low, high

    peak = np.zeros(n)
    np.maximum.at(peak, label, inten)
    (r_min, r_max), (c_min, c_max) = ends(r), ends(c)
    numbers = np.arange(1, n + 1)
    return {
        "r": r, "c": c, "inten": inten, "pixel_label": label + 1, "label": numbers, "row_c": np.bincount(label, r, n) / np.maximum(area, 1), "col_c": np.bincount(label, c, n) / np.maximum(area, 1),
        "area": area, "peak": peak, "r_min": r_min, "r_max": r_max, "c_min": c_min, "c_max": c_max, "root_frame": np.full(n, frame), "root_label": numbers, "before": np.full(n, -1),
    }


def matched(first: Frame, second: Frame, most: float) -> np.ndarray:
    """For each cell of ``second`` the place of its match in ``first``, or -1."""
    i, j, d2 = _near(np.stack([first["row_c"], first["col_c"]], 1), np.stack([second["row_c"], second["col_c"]], 1), most)
    kept = _greedy(first["label"][i], second["label"][j], d2)
    out = np.full(len(second["label"]), -1)
    out[j[kept]] = i[kept]
    return out


class Store:
    """The frames of one location."""

    def __init__(self, frames: dict[int, Frame], keep: int, most: float) -> None:
        self.frames, self.keep, self.most = frames, keep, most
        self.changed: set[int] = set()
        self.gone: list[int] = []

    def add(self, at: int, frame: Frame) -> bool:
        """Whether the frame is new and not older than what is held."""
        if at in self.frames or (len(self.frames) >= self.keep and at < min(self.frames)):
            return False
        self.frames[at] = frame
        self.changed.add(at)
        if at - 1 in self.frames:
            frame["before"] = matched(self.frames[at - 1], frame, self.most)
        if at + 1 in self.frames:
            self.frames[at + 1]["before"] = matched(frame, self.frames[at + 1], self.most)
        now = at
        while now in self.frames:  # roots go on as far as frames follow one another
            f = self.frames[now]
            if now - 1 in self.frames:
                goes_on = f["before"] >= 0
                for name, own in (("root_frame", np.full(len(goes_on), now)), ("root_label", f["label"])):
                    earlier = self.frames[now - 1][name]
                    f[name] = np.where(goes_on, earlier[np.maximum(f["before"], 0)] if len(earlier) else own, own)
            self.changed.add(now)
            now += 1
        while len(self.frames) > self.keep:
            oldest = min(self.frames)
            del self.frames[oldest]
            self.gone.append(oldest)
        return True


class Tracks(StatefulProcessor):
    """The store as state: a map of frames, and how often it has changed."""

    def __init__(self, d: Detector, keep: int) -> None:
        self.d, self.keep = d, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.frames = handle.getMapState("frames", "frame_idx long", _ARRAYS)
        self.seq = handle.getValueState("seq", "seq long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        held = {int(k[0]): {n: np.asarray(x) for n, x in zip(HELD, v, strict=True)} for k, v in self.frames.iterator()}
        store = Store(held, self.keep, self.d.max_match_px)
        new = False
        for batch in rows:
            for f in batch.sort_values("frame_idx").itertuples():  # rows of a batch in their order, so that fewer roots move
                at = int(f.frame_idx)
                if at not in store.frames:
                    made = frame_of(np.asarray(f.r, np.int64), np.asarray(f.c, np.int64), np.asarray(f.inten, float), self.d.intensity, at)
                    new |= store.add(at, made)
        if not new:
            return
        seq = (self.seq.get()[0] if self.seq.exists() else 0) + 1
        self.seq.update((seq,))
        for at in store.gone:
            if self.frames.containsKey((at,)):
                self.frames.removeKey((at,))
        out = []
        for at, f in sorted(store.frames.items()):
            values = tuple(f[n].tolist() for n in HELD)
            if at in store.changed:
                self.frames.updateValue((at,), values)
            out.append((int(key[0]), at, seq, *values[:-1]))
        yield pd.DataFrame(out, columns=["session_id", "frame_idx", "seq", *HELD[:-1]])

    def close(self) -> None:
        pass


FRAME = "session_id long, frame_idx long, r array<long>, c array<long>, inten array<double>"


def frames(pixels: DataFrame) -> DataFrame:
    """One row for each frame, with its pixels."""
    p = F.collect_list(F.struct(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("inten").cast("double").alias("inten")))
    held = pixels.groupBy(F.col("session_id").cast("long").alias("session_id"), F.col("frame_idx").cast("long").alias("frame_idx")).agg(p.alias("p"))
    return held.select("session_id", "frame_idx", "p.r", "p.c", "p.inten")


def track_stream(stream: DataFrame, d: Detector | None = None, keep: int = 8) -> DataFrame:
    """The frames that each location holds after each change (``OUT``); ``stream`` has rows of FRAME.
    The session's state store must be RocksDB's."""
    return stream.groupBy("session_id").transformWithStateInPandas(Tracks(d or Detector(), keep), OUT, "Update", "None")


def analysis_of(held: DataFrame, d: Detector) -> Analysis:
    """What a detection needs, from the held frames of some locations."""
    cells = F.arrays_zip(*CELL)
    entries = held.select("session_id", "frame_idx", F.explode(cells).alias("x")).select("session_id", "frame_idx", *[f"x.{n}" for n in CELL])
    pixels = F.arrays_zip("r", "c", "inten", "pixel_label")
    labelled = held.select("session_id", "frame_idx", F.explode(pixels).alias("x")).select("session_id", "frame_idx", "x.r", "x.c", "x.inten", F.col("x.pixel_label").alias("label"))
    return Analysis(labelled, entries, tracking.steps(entries, d.frame_s))


class LastRain(StatefulProcessor):
    """Per place the time of the newest frame with rain near it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "epoch long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        before = self.last.get()[0] if self.last.exists() else None
        newest = max([int(b["epoch"].max()) for b in rows if len(b)], default=None)
        if newest is not None and (before is None or newest > before):
            self.last.update((newest,))
            yield pd.DataFrame({"location_id": [int(key[0])], "epoch": [newest]})

    def close(self) -> None:
        pass


def last_rain_stream(hits: DataFrame) -> DataFrame:
    """location_id and epoch whenever the newest rain of a place changes; ``hits``: location_id, epoch."""
    return hits.groupBy("location_id").transformWithStateInPandas(LastRain(), "location_id long, epoch long", "Update", "None")
