"""Connected components of frames and statistics of the cells they make.

A frame has at most as many pixels as its raster, so a group of one frame always fits a task;
all frames are labelled in parallel, however they spread over sessions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.operators.filters import FRAME

LABELLED = "session_id long, frame_idx long, r long, c long, inten double, label int"
_SCHEMA = pa.schema([("session_id", pa.int64()), ("frame_idx", pa.int64()), ("r", pa.int64()), ("c", pa.int64()), ("inten", pa.float64()), ("label", pa.int32())])
#: Wider than any raster, so that neighbours in a row are neighbours in this order.
_STRIDE = 1 << 20


def _roots(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For pixels sorted by row and column: the first pixel of each one's component, by
    lowering every pixel to its least neighbour and then following what it points at."""
    place = r * _STRIDE + c
    n = len(place)
    pairs = []
    for step in (1, _STRIDE):
        at = np.searchsorted(place, place + step)
        met = np.flatnonzero(place[np.minimum(at, n - 1)] == place + step)
        pairs.append(np.stack([met, at[met]]))
    a, b = np.concatenate(pairs, 1)
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _label(table: pa.Table) -> pa.Table:
    table = table.sort_by([("r", "ascending"), ("c", "ascending")])
    root = _roots(table.column("r").to_numpy(), table.column("c").to_numpy())
    label = np.unique(root, return_inverse=True)[1] + 1
    return pa.table([*(table.column(f.name) for f in _SCHEMA if f.name != "label"), pa.array(label.astype(np.int32))], schema=_SCHEMA)


def label(pixels: DataFrame) -> DataFrame:
    """``pixels`` with the label of their 4-connected component, numbered within the frame in
    the raster order of first pixels."""
    cols = [F.col("session_id").cast("long"), F.col("frame_idx").cast("long"), F.col("r").cast("long"), F.col("c").cast("long"), F.col("inten").cast("double")]
    return pixels.select(*cols).groupBy(*FRAME).applyInArrow(_label, LABELLED)


def cells(labelled: DataFrame) -> DataFrame:
    """Per component: centroid, area, greatest intensity and bounds."""
    return labelled.groupBy(*FRAME, "label").agg(
        F.avg("r").alias("row_c"), F.avg("c").alias("col_c"), F.count(F.lit(1)).alias("area"), F.max("inten").alias("peak"),
        F.min("r").alias("r_min"), F.max("r").alias("r_max"), F.min("c").alias("c_min"), F.max("c").alias("c_max"),
    )


def mean_confidence(labelled: DataFrame, confidence: DataFrame) -> DataFrame:
    """Per component the mean confidence of its pixels; 1 where no pixel has one."""
    met = labelled.join(confidence.select(*FRAME, "r", "c", "conf"), [*FRAME, "r", "c"], "left")
    return met.groupBy(*FRAME, "label").agg(F.coalesce(F.avg("conf"), F.lit(1.0)).alias("mean_conf"), F.max("inten").alias("peak"), F.count(F.lit(1)).alias("area"))
