"""Matching of cells between frames, tracks, and their motion.

The cells of a session, some frames of a raster, fit one group. There the cells of consecutive
frames are matched, the closest pairs first, and the matches linked to tracks, in one exchange."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from pluvio.config import Detector

MATCH = "session_id long, frame_idx long, l0 int, l1 int, d2 double"
_MATCH = pa.schema([("session_id", pa.int64()), ("frame_idx", pa.int64()), ("l0", pa.int32()), ("l1", pa.int32()), ("d2", pa.float64())])


def _near(at0: np.ndarray, at1: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of centroids (row, col) at most ``most`` pixels apart, with their squared distance: only
    those of a band of rows are looked at."""
    order = np.argsort(at1[:, 0], kind="stable")
    rows = at1[order, 0]
    low = np.searchsorted(rows, at0[:, 0] - most - 1e-6, "left")
    count = np.searchsorted(rows, at0[:, 0] + most + 1e-6, "right") - low
    i = np.repeat(np.arange(len(at0)), count)
    j = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
    d = at0[i] - at1[j]
    d2 = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]
    near = d2 <= most * most
    return i[near], j[near], d2[near]


def _greedy(l0: np.ndarray, l1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Closest pairs first, each cell once: rounds that accept all pairs which are the best of
    both their cells give the same as one pair at a time."""
    order = np.lexsort((l1, l0, d2))
    taken = [order[:0]]
    while len(order):
        a, b = l0[order], l1[order]
        best = np.zeros(len(order), int)
        best[np.unique(a, return_index=True)[1]] += 1
        best[np.unique(b, return_index=True)[1]] += 1
        now = order[best == 2]
        taken.append(now)
        order = order[~np.isin(a, l0[now]) & ~np.isin(b, l1[now])]
    return np.concatenate(taken)


def _matches(frame: np.ndarray, label: np.ndarray, at: np.ndarray, most: float) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of one session: frame, places of the cells matched in it and in the next frame, squared distances."""
    out = []
    for f in np.unique(frame):
        first, second = np.flatnonzero(frame == f), np.flatnonzero(frame == f + 1)
        i, j, d2 = _near(at[first], at[second], most)
        kept = _greedy(label[first[i]], label[second[j]], d2)
        out.append((int(f), first[i[kept]], second[j[kept]], d2[kept]))
    return out


def _columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.stack([table.column(c).to_numpy() for c in ("row_c", "col_c")], 1)
    return table.column("frame_idx").to_numpy(), table.column("label").to_numpy(), at


def match(cells: DataFrame, most: float = 16.0) -> DataFrame:
    """One-to-one matches: frame_idx, l0 with the next frame's l1."""

    def run(table: pa.Table) -> pa.Table:
        frame, label, at = _columns(table)
        session = table.column("session_id")[0].as_py()
        out = []
        for f, i, j, d2 in _matches(frame, label, at, most):
            out.append(pa.table([pa.array(np.full(len(i), session)), pa.array(np.full(len(i), f)), pa.array(label[i]), pa.array(label[j]), pa.array(d2)], schema=_MATCH))
        return pa.concat_tables(out)

    return cells.select(F.col("session_id").cast("long"), F.col("frame_idx").cast("long"), "label", "row_c", "col_c").groupBy("session_id").applyInArrow(run, MATCH)


def _linked(most: float) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        frame, label, at = _columns(table)
        root = np.arange(len(frame))
        for _, i, j, _ in _matches(frame, label, at, most):  # frames in their order
            root[j] = root[i]
        return table.append_column("root_frame", pa.array(frame[root])).append_column("root_label", pa.array(label[root]))

    return run


def tracks(cells: DataFrame, most: float = 16.0) -> DataFrame:
    """``cells`` with the first cell of their track (root_frame, root_label)."""
    schema = StructType([*cells.schema.fields]).add("root_frame", LongType()).add("root_label", IntegerType())
    return cells.groupBy("session_id").applyInArrow(_linked(most), schema)


TRACK = ["session_id", "root_frame", "root_label"]


def steps(entries: DataFrame, frame_s: int = 600) -> DataFrame:
    """Velocities between consecutive entries of a track, in pixels a second; south and east positive."""
    by = Window.partitionBy(*TRACK).orderBy("frame_idx")
    dt = (F.lead("frame_idx").over(by) - F.col("frame_idx")) * frame_s
    out = entries.withColumn("dt", dt).withColumn("vy", (F.lead("row_c").over(by) - F.col("row_c")) / dt).withColumn("vx", (F.lead("col_c").over(by) - F.col("col_c")) / dt)
    return out.filter(F.col("dt") > 0).select(*TRACK, "frame_idx", "dt", "vy", "vx")


def velocity(stepped: DataFrame, d: Detector) -> DataFrame:
    """Per track: mean velocity, speed and bearing."""
    ky, kx = d.grid.km_per_row, d.grid.km_per_col
    v = stepped.groupBy(*TRACK).agg(F.avg("vy").alias("vy"), F.avg("vx").alias("vx"), F.count(F.lit(1)).alias("n_steps"))
    y, x = F.col("vy") * ky, F.col("vx") * kx
    bearing = F.when((y == 0) & (x == 0), 180.0).otherwise(F.pmod(F.degrees(F.atan2(x, -y)), F.lit(360.0)))  # standing still counts as south
    return v.withColumn("speed_kmh", F.sqrt(y * y + x * x) * 3600).withColumn("bearing", bearing)


def acceleration(stepped: DataFrame) -> DataFrame:
    """Per track: mean change of velocity, 0 with fewer than two steps."""
    by = Window.partitionBy(*TRACK).orderBy("frame_idx")
    nxt = stepped.withColumn("ay", (F.lead("vy").over(by) - F.col("vy")) / F.lead("dt").over(by)).withColumn("ax", (F.lead("vx").over(by) - F.col("vx")) / F.lead("dt").over(by))
    return nxt.groupBy(*TRACK).agg(F.coalesce(F.avg("ay"), F.lit(0.0)).alias("ay"), F.coalesce(F.avg("ax"), F.lit(0.0)).alias("ax"))


def coherence(stepped: DataFrame, most: float = 0.5) -> DataFrame:
    """Per track: circular variance of the directions of its moves, and whether it is coherent."""
    moving = (F.abs("vy") > 1e-9) | (F.abs("vx") > 1e-9)
    angle = F.when(moving, F.atan2("vy", "vx"))
    v = stepped.groupBy(*TRACK).agg(F.count(angle).alias("n_moving"), F.avg(F.sin(angle)).alias("_s"), F.avg(F.cos(angle)).alias("_c"))
    variance = 1 - F.sqrt(F.col("_s") * F.col("_s") + F.col("_c") * F.col("_c"))
    coherent = F.when(F.col("n_moving") == 0, False).when(F.col("n_moving") == 1, True).otherwise(variance <= most)
    return v.select(*TRACK, "n_moving", variance.alias("variance"), coherent.alias("coherent"))


def summary(entries: DataFrame) -> DataFrame:
    """Per track: length, first and last frame, greatest intensity, intensity of both ends, last cell."""
    box = ("r_min", "r_max", "c_min", "c_max")
    end = F.struct("frame_idx", "label", "row_c", "col_c", "peak", *box)
    s = entries.groupBy(*TRACK).agg(F.count(F.lit(1)).alias("length"), F.max("frame_idx").alias("last_frame"), F.max("peak").alias("track_peak"), F.min(end).alias("_a"), F.max(end).alias("_z"))
    return s.select(*TRACK, "length", "last_frame", "track_peak", F.col("_a.peak").alias("first_peak"), F.col("_z.peak").alias("last_peak"), F.col("_z.label").alias("last_label"), F.col("_z.row_c").alias("row_c"), F.col("_z.col_c").alias("col_c"), *[F.col(f"_z.{x}").alias(x) for x in box])


def gate(summaries: DataFrame, d: Detector, last_frame: int, multiplier: float = 1.0) -> DataFrame:
    """Tracks that reach the last frame and are long enough, or strong and nearly so."""
    need = F.ceil(F.lit(d.min_frames * multiplier))
    strong = (F.col("length") >= d.bypass_frames) & (F.col("track_peak") >= d.bypass_intensity)
    return summaries.filter((F.col("last_frame") == last_frame) & ((F.col("length") >= need) | strong))


def diagnosed(summaries: DataFrame, d: Detector, last_frame: int, multiplier: float | Column = 1.0) -> DataFrame:
    """``summaries`` with status and reason: too short for the frames that the gate asks for, else ended
    before the last frame, else accepted; and whether a short one counts all the same, as it is strong."""
    need = F.ceil(F.lit(d.min_frames) * (multiplier if isinstance(multiplier, Column) else F.lit(multiplier)))
    short, early = F.col("length") < need, F.col("last_frame") != last_frame
    strong = (F.col("length") >= d.bypass_frames) & (F.col("track_peak") >= d.bypass_intensity)
    status = F.when(short | early, "dropped").otherwise("accepted")
    reason = F.when(short, "too_short").when(early, "ended_early")
    return summaries.withColumns({"status": status, "reason": reason, "accepted_by_bypass": ~early & short & strong})
