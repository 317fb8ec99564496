"""Words and rolling hashes of many texts at once, as numpy arrays over Arrow's buffers.

Functions here run inside Spark tasks on one Arrow batch or one bounded group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text whose words are hashed at a time; about 30 times as much memory is used.
SLICE_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_STEP = 0xD1342543DE82EF95
_ROLL = (0xC6BC279692B5CC83, 0xA0761D6478BD642F)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


@dataclass
class Words:
    """Words of ``rows`` texts: byte spans, a 64-bit hash each, and where each text's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # rows + 1 entries
    text_at: np.ndarray  # rows + 1 entries: byte offsets

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.n)

    def windows(self, k: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Of every window of ``k`` words of one text: the ordinal of its first word, and its hash."""
        m = len(self.hash)
        if m < k:
            return np.empty(0, np.int64), np.empty(0, U64)
        h = self.hash if which == 0 else mix(self.hash + U64(0x632BE59BD9B4E019))
        out = np.zeros(m - k + 1, U64)
        for j in range(k):
            out *= U64(_ROLL[which])
            out += h[j : m - k + 1 + j]
        row = self.row
        at = np.flatnonzero(row[: m - k + 1] == row[k - 1 :])
        return at, mix(out[at])


def text_buffers(column: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and their offsets; null is empty; ``lower`` folds A-Z alone."""
    a = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) and column.num_chunks else (pa.array([], column.type) if isinstance(column, pa.ChunkedArray) else column)
    a = a.cast(pa.large_string()).fill_null("")
    _, offsets, data = a.buffers()
    at = np.frombuffer(offsets, np.int64, len(a) + 1, a.offset * 8) if len(a) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and len(a) else np.zeros(0, np.uint8)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    return raw, at - at[0]


def _spans(data: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    start = solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


#: Bytes whose prefix sums are taken together.
_CHUNK = 1 << 20


@lru_cache(1)
def _powers_and_inverses() -> tuple[np.ndarray, np.ndarray]:
    return _powers(_STEP, _CHUNK), _powers(pow(_STEP, -1, 1 << 64), _CHUNK)


def _hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of words that lie within ``_CHUNK`` bytes, or of one word: the sum of its bytes' values by
    powers of ``_STEP``, as the difference of two prefix sums."""
    begin, size = int(start[0]), int(end[-1] - start[0])
    up, down = _powers_and_inverses() if size <= _CHUNK else (_powers(_STEP, size), np.ones(1, U64))
    total = np.zeros(size + 1, U64)
    np.cumsum(_BYTE[data[begin : begin + size]] * up[:size], out=total[1:])
    value = (total[end - begin] - total[start - begin]) * down[start - begin]
    return mix(value + (end - start).astype(U64))


def hash_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each of some spans of bytes, which follow one another."""
    h = np.empty(len(start), U64)
    done = 0
    while done < len(start):  # one span at least, however long
        stop = max(done + 1, int(np.searchsorted(end, start[done] + _CHUNK, "right")))
        h[done:stop] = _hash_words(data, start[done:stop], end[done:stop])
        done = stop
    return h


def split_words(column: pa.Array | pa.ChunkedArray, lower: bool = False, solid: np.ndarray | None = None) -> Words:
    """``solid`` has for each byte whether it belongs to words; white space alone doesn't by default."""
    data, at = text_buffers(column, lower)
    start, end = _spans(data, at, ~_SPACE if solid is None else solid) if len(data) else (np.empty(0, np.int64), np.empty(0, np.int64))
    return Words(data, start, end, hash_spans(data, start, end), np.searchsorted(start, at), at)


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes, and the byte where each begins (one more at the end)."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80) if len(points) < len(data) else np.arange(len(data))
    return points, np.append(at, len(data))


def slices(table: pa.Table | pa.RecordBatch, column: str, size: int) -> Iterator[pa.Table | pa.RecordBatch]:
    """``table`` in runs of rows of about ``size`` bytes of text, one row at least."""
    n = table.num_rows
    if not n:
        return
    _, at = text_buffers(table.column(column))
    done = 0
    while done < n:
        stop = max(done + 1, int(np.searchsorted(at, at[done] + size, "right")) - 1)
        yield table.slice(done, stop - done)
        done = stop


# Packed rows: what one task has for one partition or bucket travels as one row of bytes, so
# that an entry costs its fingerprint and about two bytes more instead of a row of its own.


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Whole numbers, compressed by planes of bytes, after differences if they mostly grow."""
    v = np.ascontiguousarray(values)
    v = np.diff(v, prepend=v.dtype.type(0)) if delta and len(v) else v
    planes = v.view(np.uint8).reshape(len(v), v.dtype.itemsize).T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(v).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True) if raw else (0).to_bytes(8, "little")


def unpack(data: bytes, dtype: np.dtype | type, delta: bool = False) -> np.ndarray:
    dtype = np.dtype(dtype)
    n = int.from_bytes(data[:8], "little")
    if not n:
        return np.empty(0, dtype)
    raw = pa.decompress(data[8:], decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    v = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype)[:, 0]
    return np.cumsum(v, dtype=dtype) if delta else v


def fingerprints(h: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each hash; ``part_of`` takes its number from the high ones."""
    return np.ascontiguousarray(h.view(np.uint8).reshape(len(h), 8)[:, :width]).tobytes()


def read_fingerprints(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view(U64)[:, 0]


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> U64(40)) % U64(parts)).astype(np.int32)


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(sorted_values):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
