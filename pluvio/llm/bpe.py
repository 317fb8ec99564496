"""Byte-level BPE encoding and decoding with a pair occurrence index (operator 8).

A task reads its partition in chunks of bounded size. Texts are cut into pre-tokens as arrays;
each distinct pre-token of a chunk is merged once. For the merging an index maps each pair that
has a rank to all its positions in the chunk. The active ranks are taken in ascending order; all
positions of a pair merge at once, and only the lists of the pairs beside them are updated.

A pair's rank is higher than that of the merge that makes its parts, so taking ranks in
ascending order over the whole chunk gives each word the merges that it would get alone.

Vocabulary and merges have a fixed size; the driver reads them from the path it is given and
broadcasts them. Nothing is shuffled, and no text is cut short.

Defined results: a null text counts as empty and has no tokens; rows keep their order and all
their columns but those named like a result column; repeated rows repeat the result; an empty
table gives an empty one. Special tokens inside a text are encoded as such and decoded back.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm import textblocks as tb

#: Bytes of text whose distinct pre-tokens are merged together, and that are cut at a time.
CHUNK_BYTES = 24 << 20
SLICE_BYTES = 2 << 20
#: Classes of code points for the cutting into pre-tokens.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character by which a byte-level vocabulary file writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(hidden)) for b in range(256)]


@dataclass
class Vocabulary:
    """What the tasks need of a tokenizer file."""

    byte_id: np.ndarray  # id of each byte
    pair: np.ndarray  # sorted keys (left << 32 | right)
    rank: np.ndarray  # rank of each of them
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    token: list[bytes]  # by id
    special: dict[str, int]
    classes: np.ndarray
    text: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.text = [str(i) for i in range(len(self.token))]


# White space of Unicode, and ranges that hold nothing but letters in all its versions since 4.0.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288)
ALL_LETTERS = ((0x3400, 0x4DB6), (0x4E00, 0x9FA6), (0xAC00, 0xD7A4), (0x20000, 0x2A6D7))


def code_point_classes(pre_tokenizer: object) -> np.ndarray:
    """One byte for each code point, as the tokenizer's own pre-tokenizer sees it: a letter joins
    a letter before it, a number joins a number after it."""
    classes = np.zeros(0x110000, np.uint8)
    ask = np.ones(0x33480, bool)
    ask[0xD800:0xE000] = False
    for lo, hi in ALL_LETTERS:
        classes[lo:hi] = LETTER
        ask[lo:hi] = False
    points = np.concatenate((np.flatnonzero(ask), np.arange(0xE0000, 0xE0200)))
    for begin in range(0, len(points), 4096):
        some = points[begin : begin + 4096]
        cut = np.array([x[1] for x in pre_tokenizer.pre_tokenize_str("".join(f"\na{chr(p)}1" for p in some))])
        pair = cut[cut[:, 1] - cut[:, 0] == 2, 0]
        classes[some[pair[pair % 4 == 1] // 4]] = LETTER
        classes[some[pair[pair % 4 == 2] // 4]] = NUMBER
    classes[list(WHITE_SPACE)] = SPACE
    return classes


def load(path: str) -> Vocabulary:
    """Reads a byte-level BPE file of the tokenizers library, on the driver."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids, letters = spec["model"]["vocab"], byte_letters()
    byte_of = {c: b for b, c in enumerate(letters)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    left, right, made = (np.array([ids[x] for x in side], np.int64) for side in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges]))
    key = left << 32 | right
    order = np.argsort(key, kind="stable")
    token = [b""] * (max([*ids.values(), *special.values()]) + 1)
    for t, i in ids.items():
        token[i] = bytes(byte_of[c] for c in t)
    for t, i in special.items():
        token[i] = t.encode()
    return Vocabulary(np.array([ids[c] for c in letters], np.int32), key[order], order.astype(np.int32), left, right, made, token, special, code_point_classes(Tokenizer.from_file(path).pre_tokenizer))


# Cutting texts into pre-tokens


def _starts(points: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point. ``first`` marks where segments begin."""
    n = len(points)
    head = np.zeros(n + 1, bool)
    head[first] = True
    head[n] = True
    begin, stop = head[:n], head[1:]  # first and last code point of a segment
    before = np.empty(n, np.uint8)
    before[0], before[1:] = 255, cls[:-1]
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = 255, cls[1:]
    start = begin | (cls != before)
    space = cls == SPACE
    # The last white space before something else stands alone, or leads it if it is a blank.
    last = space & ~stop & (after != SPACE)
    start |= last
    blank = points == 32
    led = np.zeros(n, bool)
    led[1:] = (last & blank)[:-1]
    start &= ~led | begin
    # Contractions: an apostrophe that starts a pre-token, and the letters that belong to it.
    at = np.flatnonzero((points == 39) & start & ~stop)
    if len(at):
        one = points[at + 1]
        two = np.where(at + 2 < n, points[np.minimum(at + 2, n - 1)], 0)
        two = np.where(stop[at + 1], 0, two)
        short = np.isin(one, [ord(c) for c in "stmd"])
        pairs = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            pairs |= (one == ord(a)) & (two == ord(b))
        for found, size in ((short, 2), (pairs & ~short, 3)):
            p = at[found]
            start[p + 1] = False
            end = p + size
            end = end[end < n]
            start[end] = True
    return start


def _segments(data: np.ndarray, at: np.ndarray, special: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts of segments and the special id of each (-1: ordinary text)."""
    starts, kinds = [at[:-1]], [np.full(len(at) - 1, -1, np.int64)]
    raw = data.tobytes()
    for text, i in special.items():
        mark = text.encode()
        p = raw.find(mark)
        while p >= 0:
            row = int(np.searchsorted(at, p, "right")) - 1
            if p + len(mark) <= at[row + 1]:  # not across two texts
                starts.append(np.array([p, p + len(mark)]))
                kinds.append(np.array([i, -1]))
                p = raw.find(mark, p + len(mark))
            else:
                p = raw.find(mark, p + 1)
    starts, kinds = np.concatenate(starts), np.concatenate(kinds)
    if len(starts) > len(at) - 1:
        order = np.lexsort((kinds, starts))  # where two begin, the one with an id is the longer
        starts, kinds = starts[order], kinds[order]
        last = np.append(starts[1:] != starts[:-1], True)
        starts, kinds = starts[last], kinds[last]
    else:
        keep = np.append(starts[1:] != starts[:-1], True)
        starts, kinds = starts[keep], kinds[keep]
    inside = starts < len(data)
    return starts[inside], kinds[inside]


def cut_texts(data: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all pre-tokens, and the special id of each or -1."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    first, kind = _segments(data, at, vocabulary.special)
    points, byte = tb.code_points(data)
    begin = np.searchsorted(byte, first)
    start = _starts(points, vocabulary.classes[points], begin)
    own = np.full(len(points), -1, np.int64)
    ends = np.append(begin[1:], len(points))
    for s in np.flatnonzero(kind >= 0):
        start[begin[s] + 1 : ends[s]] = False
        own[begin[s]] = kind[s]
    where = np.flatnonzero(start)
    return byte[where], np.append(byte[where[1:]], len(data)), own[where]


# Merging


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left.astype(np.int64) << 32 | right.astype(np.int64)
    at = np.minimum(np.searchsorted(v.pair, key), len(v.pair) - 1)
    return np.where(v.pair[at] == key, v.rank[at], _NONE)


class PairIndex:
    """Positions of every pair that has a rank, and the ranks that are active."""

    def __init__(self) -> None:
        self.at: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, rank: np.ndarray, position: np.ndarray) -> None:
        known = rank != _NONE
        rank, position = rank[known], position[known]
        if not len(rank):
            return
        order = np.argsort(rank, kind="stable")
        rank, position = rank[order], position[order]
        ends = np.append(tb.runs(rank), len(rank)).tolist()
        for lo, hi in zip(ends[:-1], ends[1:], strict=True):
            r = int(rank[lo])
            if r not in self.at:
                self.at[r] = []
                heapq.heappush(self.active, r)
            self.at[r].append(position[lo:hi])

    def pop(self) -> tuple[int, np.ndarray]:
        r = heapq.heappop(self.active)
        parts = self.at.pop(r)
        return r, np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]


def merge_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (byte spans of ``data``), one after another, and where each word's begin."""
    length = end - start
    first = np.concatenate(([0], np.cumsum(length)))
    n = int(first[-1])
    if not n:
        return np.empty(0, np.int32), first
    raw = data[np.repeat(start - first[:-1], length) + np.arange(n)]
    symbol = v.byte_id[raw].astype(np.int32)
    after = np.arange(1, n + 1, dtype=np.int32)
    after[first[1:][length > 0] - 1] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[first[:-1][length > 0]] = -1
    index = PairIndex()
    left = np.flatnonzero(after >= 0)
    index.add(_byte_pair_ranks(v)[raw[left].astype(np.int64) << 8 | raw[left + 1]], left)
    while index.active:
        r, p = index.pop()
        a, b, made = v.left[r], v.right[r], v.made[r]
        p = p[symbol[p] == a]
        q = after[p]
        fits = q >= 0
        p, q = p[fits], q[fits]
        fits = symbol[q] == b
        p, q = p[fits], q[fits]
        if a == b and len(p) > 1:  # in a run of one symbol every second pair merges
            p = np.sort(p)
            q = after[p]
            linked = np.concatenate(([False], p[1:] == q[:-1]))
            begin = np.flatnonzero(~linked)
            place = np.arange(len(p)) - np.repeat(begin, np.diff(np.append(begin, len(p))))
            p, q = p[place % 2 == 0], q[place % 2 == 0]
        if not len(p):
            continue
        nxt = after[q]
        symbol[p] = made
        symbol[q] = -1
        after[p] = nxt
        has = nxt >= 0
        before[nxt[has]] = p[has]
        index.add(_ranks(v, symbol[p[has]], symbol[nxt[has]]), p[has])
        prev = before[p]
        has = prev >= 0
        index.add(_ranks(v, symbol[prev[has]], symbol[p[has]]), prev[has])
    alive = symbol >= 0
    return symbol[alive], np.concatenate(([0], np.cumsum(alive)))[first]


def _byte_pair_ranks(v: Vocabulary) -> np.ndarray:
    ids = v.byte_id.astype(np.int64)
    return _ranks(v, np.repeat(ids, 256), np.tile(ids, 256))


@dataclass
class Encoded:
    """Token ids of some texts, one text after another."""

    ids: np.ndarray
    first: np.ndarray


def _keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, known: dict[bytes, int] | None) -> np.ndarray:
    """What tells pre-tokens apart: their hashes or, where those have failed, their numbers in ``known``."""
    if known is None:
        return tb.hash_spans(data, start, end)
    raw = data.tobytes()
    return np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(start.tolist(), end.tolist(), strict=True)], np.uint64)


#: Bytes that are compared at once.
COMPARED = 4 << 20


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> bool:
    """Whether the spans of ``length`` bytes at ``a`` and ``b`` hold the same."""
    other = np.flatnonzero(a != b)
    a, b, length = a[other], b[other], length[other]
    ends = np.cumsum(length)
    low = 0
    while low < len(a):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + COMPARED, "right")))
        n = length[low:high]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a[low:high], n) + inside] != data[np.repeat(b[low:high], n) + inside]).any():
            return False
        low = high
    return True


def encode_chunk(texts: list[pa.Array], v: Vocabulary, known: dict[bytes, int] | None = None) -> Iterator[Encoded]:
    """Each of some arrays of texts encoded; their distinct pre-tokens are merged together."""
    cuts: list[tuple[np.ndarray, np.ndarray]] = []
    seen_h, seen_bytes, seen_len = [], [], []
    offset = 0
    for column in texts:
        data, at = tb.text_buffers(column)
        start, end, special = cut_texts(data, at, v)
        h = _keys(data, start, end, known)
        if len(h):
            h = np.where(special >= 0, special.astype(np.uint64), h | np.uint64(1 << 63))
        unique, where, which = np.unique(h, return_index=True, return_inverse=True)
        s, length = start[where], (end - start)[where]
        total = np.cumsum(length) - length
        seen_bytes.append(data[np.repeat(s - total, length) + np.arange(int(length.sum()))])
        seen_h.append(unique)
        seen_len.append(length)
        if (length[which] != end - start).any() or not same_bytes(data, start, s[which], end - start):  # two pre-tokens have one hash
            yield from encode_chunk(texts, v, {})
            return
        cuts.append((np.searchsorted(start, at), which.astype(np.int64) + offset))
        offset += len(unique)
    h, length, raw = np.concatenate(seen_h), np.concatenate(seen_len), np.concatenate(seen_bytes)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    begin = np.cumsum(length) - length
    if (length[where][which] != length).any() or not same_bytes(raw, begin, begin[where][which], length):
        yield from encode_chunk(texts, v, {})
        return
    ids, first = merge_words(raw, begin[where], (begin + length)[where], v)
    count = np.diff(first)
    ordinary = h[where] >> np.uint64(63) == 1
    if not ordinary.all():  # special tokens are one id each
        keep = np.repeat(ordinary, count)
        at = np.repeat(np.where(ordinary, 0, h[where].astype(np.int64)), count)
        lead = np.zeros(len(ids), bool)
        lead[first[:-1][~ordinary]] = True
        ids = np.where(keep, ids, at)[keep | lead]
        count = np.where(ordinary, count, 1)
        first = np.concatenate(([0], np.cumsum(count)))
    for rows, local in cuts:
        word = which[local]
        size = count[word]
        ends = np.concatenate(([0], np.cumsum(size)))
        flat = ids[np.repeat(first[word] - ends[:-1], size) + np.arange(int(ends[-1]))]
        yield Encoded(flat, ends[rows])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for batch in batches:
        for part in tb.slices(batch, "text", SLICE_BYTES):
            held.append(part)
            size += len(tb.text_buffers(part.column("text"))[0])
            if size >= CHUNK_BYTES:
                yield held
                held, size = [], 0
    if held:
        yield held


def _with_text(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    carry = [c for c in docs.columns if c not in names]
    if "text" not in carry:
        raise ValueError("a column named text is needed")
    return docs.select(*carry), carry


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids``, the tokens of each whole text."""
    rows, carry = _with_text(docs, ("ids",))
    held = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _chunks(batches):
            for part, e in zip(parts, encode_chunk([p.column("text") for p in parts], held.value), strict=True):
                ids = pa.ListArray.from_arrays(pa.array(e.first, pa.int32()), pa.array(e.ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=[*carry, "ids"])

    return rows.mapInArrow(run, rows.withColumn("ids", F.array(F.lit(0))).schema)


def decode_ids(ids: np.ndarray, v: Vocabulary) -> bytes:
    return b"".join(map(v.token.__getitem__, ids.tolist()))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``, the text that its ``ids`` stand for (null: empty)."""
    carry = [c for c in encoded.columns if c != "decoded"]
    rows = encoded.select(*carry)
    held = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.array(x or [], np.int64), held.value).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*carry, "decoded"])

    return rows.mapInArrow(run, rows.withColumn("decoded", F.lit("")).schema)


RESULT = ("n_tokens", "ids_sha256", "decoded_sha256")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with the number of tokens of each whole text, the digest of their ids (decimal,
    joined by commas) and the digest of what those ids decode to."""
    rows, carry = _with_text(docs, RESULT)
    held = docs.sparkSession.sparkContext.broadcast(load(path))
    schema = rows.withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = held.value
        for parts in _chunks(batches):
            for part, e in zip(parts, encode_chunk([p.column("text") for p in parts], v), strict=True):
                written, back, bounds = [], [], e.first.tolist()
                for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                    ids = e.ids[lo:hi].tolist()
                    written.append(hashlib.sha256(",".join(map(v.text.__getitem__, ids)).encode()).hexdigest())
                    text = b"".join(map(v.token.__getitem__, ids)).decode("utf-8", "replace")
                    back.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(e.first).astype(np.int64)), pa.array(written, pa.string()), pa.array(back, pa.string())], names=[*carry, *RESULT])

    return rows.mapInArrow(run, schema)
