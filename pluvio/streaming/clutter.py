"""The clutter statistic as keyed state of a stream.

A key is a square of pixels of a location. Its state is one array of decayed counts and one of the
cycles of the last echoes; the decay since then is applied when a pixel is met again, so that
pixels without echo cost nothing and a micro-batch calls Python once for a square."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SIDE = 16
OUT = "location_id long, r long, c long, echo_count double, last_cycle long"
STATE = "counts array<double>, cycles array<long>"


def folded(counts: np.ndarray, cycles: np.ndarray, at: np.ndarray, cycle: np.ndarray, decay: float) -> None:
    """Adds echoes of pixels ``at`` in ``cycle`` to a square's arrays, in place. A late echo counts
    as if it had come in time."""
    last = cycles.copy()
    np.maximum.at(last, at, cycle)
    counts *= decay ** (last - cycles).astype(float)
    np.add.at(counts, at, decay ** (last[at] - cycle).astype(float))
    cycles[:] = last


def update_with(decay: float) -> Any:
    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        location, top, left = key
        stored = state.get if state.exists else ([0.0] * SIDE * SIDE, [0] * SIDE * SIDE)
        counts, cycles = np.array(stored[0], float), np.array(stored[1], np.int64)
        touched = np.zeros(SIDE * SIDE, bool)
        for b in batches:
            at = ((b["r"] - top * SIDE) * SIDE + b["c"] - left * SIDE).to_numpy(np.int64)
            folded(counts, cycles, at, b["cycle"].to_numpy(np.int64), decay)
            touched[at] = True
        state.update((counts.tolist(), cycles.tolist()))
        at = np.flatnonzero(touched)
        yield pd.DataFrame({"location_id": location, "r": top * SIDE + at // SIDE, "c": left * SIDE + at % SIDE, "echo_count": counts[at], "last_cycle": cycles[at]})

    return update


def clutter_stream(pixels: DataFrame, decay: float = 0.99966, echo: float = 0.01) -> DataFrame:
    """The state of every pixel that a micro-batch changes; ``pixels``: location_id, cycle, r, c, inten."""
    seen = pixels.filter(pixels["inten"] > echo).select("location_id", F.floor(F.col("r") / SIDE).alias("top"), F.floor(F.col("c") / SIDE).alias("left"), "cycle", "r", "c")
    return seen.groupBy("location_id", "top", "left").applyInPandasWithState(update_with(decay), OUT, STATE, "update", GroupStateTimeout.NoTimeout)
