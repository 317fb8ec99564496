"""Removal of passages that repeat, by fixed-block anchors (operator 10).

A window is ``window`` consecutive words. Words are removed where a window whose word
sequence also starts anywhere else covers them.

1. Every text is cut into non-overlapping blocks of ``(window + 1) // 2`` words. These blocks
   are the index. Any window holds one whole block, so if a window starts twice, each place
   holds a run of words that equals a block of the other.
2. Every rolling run of that length probes the index. A probe hits where a block of another
   place has its words. Probes and blocks meet in partitions of a hash of the run.
3. Hits are extended: the windows around a hit are candidates; those whose whole word sequence
   is found twice are exact repeats, and overlapping ones form the maximal repeats.

Each bucket of texts sends one entry for each distinct run, however often it holds it, so that
what meets in a partition never grows with the number of documents that share a passage. The
entries of a bucket for a partition travel as one row of sorted hashes, without places; the
partition answers with two bits for each, and the bucket finds the places again from its texts.

Copies of a text are joined early: each task keeps one text of each kind and its number, so that
a group of copies is one row a batch. A text that is there once keeps its row's other columns
beside it through the one exchange of the texts. Of a text with copies every window repeats, so
that fewer than ``window`` words stay: that little meets the copies' rows in a join. A text is
its 128-bit hash; nothing depends on ``doc_id``. The numbers of partitions and buckets follow
the bytes of text, so that a group is of bounded size. No pair of texts is ever formed.

Defined results: a null text has no words; texts shorter than a window stay as they are but
for white space; repeated rows repeat each other's windows; a row keeps all its columns, and
``text`` becomes the kept words joined by one space. Columns of the input named like a result
column are replaced by it. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from pluvio.llm import textblocks as tb
from pluvio.llm.shared import cut, text_key

#: Bytes of text for each bucket and each partition of hashes.
BUCKET_BYTES = 8 << 20
#: Bits of a run's hash that travel. A partition holds about 2 ** 16 distinct blocks, so that one probe in
#: some thousands meets a block by chance; that only makes a candidate.
RUN_BITS = 28
U64 = np.uint64
RESULTS = ("n_words", "n_removed")


def buckets_for(docs: DataFrame) -> int:
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(total // BUCKET_BYTES) + 1


def join_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each text of a batch, with its number ``m``."""
    for batch in batches:
        keys = np.stack([batch.column("t1").to_numpy(), batch.column("t2").to_numpy()], 1)
        _, first, m = np.unique(keys, axis=0, return_index=True, return_counts=True)
        kept = batch.take(pa.array(first))
        yield kept.set_column(kept.schema.get_field_index("m"), "m", pa.array(m, pa.int64()))


def _by_text(table: pa.Table) -> pa.Table:
    """The same for a whole bucket, in which copies from several batches meet."""
    keys = np.stack([table.column("t1").to_numpy(), table.column("t2").to_numpy()], 1)
    _, first, which = np.unique(keys, axis=0, return_index=True, return_inverse=True)
    m = np.bincount(which.ravel(), table.column("m").to_numpy(), len(first)).astype(np.int64)
    kept = table.take(pa.array(first))
    return kept.set_column(kept.schema.get_field_index("m"), "m", pa.array(m))


@dataclass
class Places:
    """Places of a bucket (ordinals of words) where runs of words begin, and which of the distinct
    runs stands there. Distinct runs are sorted by partition and hash; ``ends`` bounds partitions."""

    at: np.ndarray
    which: np.ndarray
    value: np.ndarray
    part: np.ndarray
    ends: np.ndarray

    def per_run(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.which, weight, len(self.value)).astype(np.int64)

    def slices(self) -> Iterator[tuple[int, slice]]:
        for lo, hi in zip(self.ends[:-1].tolist(), self.ends[1:].tolist(), strict=True):
            yield int(self.part[lo]), slice(lo, hi)


def _places(at: np.ndarray, part: np.ndarray, value: np.ndarray) -> Places:
    # one key sorts faster than two
    small = not len(value) or int(value.max()) < 1 << RUN_BITS
    order = np.argsort((part.astype(U64) << U64(RUN_BITS)) | value) if small else np.lexsort((value, part))
    part, value = part[order], value[order]
    new = np.ones(len(order), bool)
    new[1:] = (part[1:] != part[:-1]) | (value[1:] != value[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    part, value = part[new], value[new]
    return Places(at, which, value, part, np.append(tb.runs(part), len(part)))


class Bucket:
    """The distinct texts of a bucket and their words."""

    def __init__(self, table: pa.Table, window: int, parts: int) -> None:
        self.id = int(table.column("b")[0].as_py())
        self.texts = _by_text(table)
        self.words = tb.split_words(self.texts.column("text"))
        self.copies = np.minimum(self.texts.column("m").to_numpy(), 2)
        self.window, self.block, self.parts = window, (window + 1) // 2, parts

    def weight(self, at: np.ndarray) -> np.ndarray:
        return self.copies[self.words.row[at]]

    def runs(self) -> Places:
        """Every rolling run as long as a block."""
        at, h = self.words.windows(self.block)
        return _places(at, tb.part_of(h, self.parts), h & U64((1 << RUN_BITS) - 1))

    def is_block(self, at: np.ndarray) -> np.ndarray:
        return (at - self.words.first[self.words.row[at]]) % self.block == 0

    def candidates(self, flags: pa.Table) -> Places:
        """The windows that hold a hit; ``flags`` has the answers about runs."""
        runs = self.runs()
        one, two = _answers(runs, flags, "runs")
        marks = np.zeros(len(self.words.hash) + 1, np.int64)
        marks[runs.at] = np.where(self.is_block(runs.at), two[runs.which], one[runs.which])
        total = np.concatenate(([0], np.cumsum(marks)))
        at, h = self.words.windows(self.window, which=1)
        near = total[at + self.window - self.block + 1] > total[at]
        part = tb.part_of(self.words.windows(self.window)[1][near], self.parts)  # of another hash, so that both decide
        return _places(at[near], part, h[near])


SENT = "part int, b int, value binary, count binary"
_SENT = pa.schema([("part", pa.int32()), ("b", pa.int32()), ("value", pa.binary()), ("count", pa.binary())])
FLAGS = "b int, kind string, part int, one binary, two binary"
_FLAGS = pa.schema([("b", pa.int32()), ("kind", pa.string()), ("part", pa.int32()), ("one", pa.binary()), ("two", pa.binary())])


def _bits(flags: np.ndarray) -> bytes:
    return tb.pack(np.packbits(flags))


def _answers(places: Places, flags: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct run the two bits that its partition answered; no answer is none."""
    said = {r["part"]: r for r in flags.to_pylist() if r["kind"] == kind}
    one, two = np.zeros(len(places.value), bool), np.zeros(len(places.value), bool)
    for part, own in places.slices():
        if part in said:
            for flag, name in ((one, "one"), (two, "two")):
                flag[own] = np.unpackbits(tb.unpack(said[part][name], np.uint8), count=own.stop - own.start)
    return one, two


def probes(window: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Every distinct rolling run of a bucket for its partition, with what it adds to the index in
    two bits: 0 no block, 1 one block and no other place, 2 one block and more, 3 two blocks or more."""

    def emit(table: pa.Table) -> pa.Table:
        bucket = Bucket(table, window, parts)
        runs = bucket.runs()
        weight = bucket.weight(runs.at)
        blocks, places = runs.per_run(weight * bucket.is_block(runs.at)), runs.per_run(weight)
        code = np.where(blocks == 0, 0, np.where(blocks > 1, 3, np.where(places == 1, 1, 2)))
        value = (runs.value << U64(2) | code.astype(U64)).astype(np.uint32)
        return pa.Table.from_pylist([{"part": p, "b": bucket.id, "value": tb.pack(value[own], delta=True)} for p, own in runs.slices()], schema=_SENT)

    return emit


def _summed(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each entry the weight of all entries of its value."""
    _, which = np.unique(value, return_inverse=True)
    return np.bincount(which, weight)[which]


def _reply(rows: list[dict], sizes: list[int], kind: str, one: np.ndarray, two: np.ndarray) -> pa.Table:
    out, at = [], 0
    for r, size in zip(rows, sizes, strict=True):
        if one[at : at + size].any():
            out.append({"b": r["b"], "kind": kind, "part": r["part"], "one": _bits(one[at : at + size]), "two": _bits(two[at : at + size])})
        at += size
    return pa.Table.from_pylist(out, schema=_FLAGS)


def match_blocks(table: pa.Table) -> pa.Table:
    """Of one partition: which runs equal a block of another place. A place that is no block needs
    one block (``one``), a block another one (``two``)."""
    rows = table.to_pylist()
    each = [tb.unpack(r["value"], np.uint32, delta=True) for r in rows]
    v = np.concatenate(each)
    code = v & np.uint32(3)
    blocks = _summed(v >> np.uint32(2), np.array([0, 1, 1, 2])[code])
    return _reply(rows, list(map(len, each)), "runs", blocks > (code == 1), blocks > 1)


def extend(window: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The distinct windows that hold a hit, with the hash of their whole word sequence."""

    def candidates(texts: pa.Table, flags: pa.Table) -> pa.Table:
        if not texts.num_rows or not flags.num_rows:
            return pa.Table.from_pylist([], schema=_SENT)
        bucket = Bucket(texts, window, parts)
        found = bucket.candidates(flags)
        twice = found.per_run(bucket.weight(found.at)) > 1
        return pa.Table.from_pylist([{"part": p, "b": bucket.id, "value": tb.pack(found.value[own], delta=True), "count": _bits(twice[own])} for p, own in found.slices()], schema=_SENT)

    return candidates


def match_windows(table: pa.Table) -> pa.Table:
    """Of one partition: which windows start in two places or more."""
    rows = table.to_pylist()
    each = [tb.unpack(r["value"], U64, delta=True) for r in rows]
    weight = np.concatenate([1 + np.unpackbits(tb.unpack(r["count"], np.uint8), count=len(v)) for r, v in zip(rows, each, strict=True)])
    repeated = _summed(np.concatenate(each), weight) > 1
    return _reply(rows, list(map(len, each)), "windows", repeated, repeated)


def removal(window: int, parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The rows of texts that are there once, without the words that a repeated window covers."""

    def clean(texts: pa.Table, flags: pa.Table) -> pa.Table:
        bucket = Bucket(texts, window, parts)
        w, n = bucket.words, bucket.words.n
        gone = np.zeros(len(w.hash), bool)
        if flags.num_rows:
            found = bucket.candidates(flags)
            repeated, _ = _answers(found, flags, "windows")
            marks = np.zeros(len(w.hash) + 1, np.int64)
            starts = found.at[repeated[found.which]]
            marks[starts] += 1
            np.subtract.at(marks, starts + window, 1)
            gone = np.cumsum(marks)[:-1] > 0
        total = np.concatenate(([0], np.cumsum(gone)))
        removed = total[w.first[1:]] - total[w.first[:-1]]
        done = pa.table([pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), _joined(w, ~gone), in_utc(bucket.texts.column("rest"))], ["n_words", "n_removed", "kept", "rest"])
        return done.filter(pa.array(bucket.copies == 1))

    return clean


def _utc_type(t: pa.DataType) -> pa.DataType:
    if pa.types.is_timestamp(t) and t.tz:
        return pa.timestamp(t.unit, "UTC")
    if pa.types.is_struct(t):
        return pa.struct([f.with_type(_utc_type(f.type)) for f in t])
    if pa.types.is_list(t):
        return pa.list_(t.value_field.with_type(_utc_type(t.value_type)))
    if pa.types.is_map(t):
        return pa.map_(_utc_type(t.key_type), t.item_field.with_type(_utc_type(t.item_type)))
    return t


def in_utc(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The same instants: Spark hands out timestamps in the session's zone and takes them back in UTC."""
    wanted = _utc_type(column.type)
    return column if wanted == column.type else column.cast(wanted)


COPIES = "t1 long, t2 long, n_words long, n_removed long, kept string"
_COPIES = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def repeated_texts(window: int) -> Callable[[pa.Table], pa.Table]:
    """Texts that are there more than once: every window of theirs repeats."""

    def run(table: pa.Table) -> pa.Table:
        texts = _by_text(table)
        texts = texts.filter(pa.array(texts.column("m").to_numpy() > 1))
        w = tb.split_words(texts.column("text"))
        n = w.n.astype(np.int64)
        return pa.table([texts.column("t1"), texts.column("t2"), pa.array(n), pa.array(np.where(n >= window, n, 0)), _joined(w, np.repeat(n < window, n))], schema=_COPIES)

    return run


def _joined(w: tb.Words, keep: np.ndarray) -> pa.Array:
    """The kept words of each text, joined by one space."""
    start, end = w.start[keep], w.end[keep]
    length = end - start + 1  # with a space after it
    row = w.row[keep]
    begin = np.cumsum(length) - length
    out = np.full(int(length.sum()), 32, np.uint8)
    inside = np.ones(len(out), bool)
    inside[begin + length - 1] = False
    chosen = np.zeros(len(w.data) + 1, np.int8)
    np.add.at(chosen, start, 1)
    np.add.at(chosen, end, -1)
    out[inside] = w.data[np.cumsum(chosen[:-1]).astype(bool)]
    each = np.bincount(row, length, len(w.first) - 1).astype(np.int64)
    stop = np.cumsum(each)
    last = np.ones(len(out), bool)
    last[stop[each > 0] - 1] = False  # no space after the last word
    out = out[last]
    sizes = each - (each > 0)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out.tobytes())])


def remove_repeats(docs: DataFrame, window: int = 35, buckets: int | None = None) -> DataFrame:
    """``docs`` with ``text`` cleaned, and n_words and n_removed beside the other columns."""
    if window < 3:
        raise ValueError("a window has three words at least")
    parts = buckets or buckets_for(docs)
    others = [c for c in docs.columns if c not in ("text", *RESULTS)]
    rest = F.struct(*[F.col(f"`{c}`") for c in others], F.lit(0).alias("_pluvio")).alias("rest")
    base = docs.select(*text_key(F.col("text")), F.lit(1).cast("long").alias("m"), F.coalesce("text", F.lit("")).alias("text"), rest)
    once = base.mapInArrow(join_copies, base.schema).withColumn("b", F.pmod("t1", F.lit(parts)).cast("int"))
    texts = once.groupBy("b")  # one exchange of the texts, which all uses below share

    runs = texts.applyInArrow(probes(window, parts), SENT).groupBy("part").applyInArrow(match_blocks, FLAGS)
    hits = cut(runs)  # two bits for each distinct run
    windows = texts.cogroup(hits.groupBy("b")).applyInArrow(extend(window, parts), SENT).groupBy("part").applyInArrow(match_windows, FLAGS)
    schema = StructType().add("n_words", LongType()).add("n_removed", LongType()).add("kept", StringType()).add(base.schema["rest"])
    of_one = texts.cogroup(hits.union(windows).groupBy("b")).applyInArrow(removal(window, parts), schema)

    copies = texts.applyInArrow(repeated_texts(window), COPIES)
    of_copies = base.select("t1", "t2", "rest").join(copies, ["t1", "t2"]).select(of_one.columns)
    done = of_one.union(of_copies)
    kept = [F.col("kept").alias("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns if c not in RESULTS]
    return done.select(*kept, *RESULTS)


def length_of(column: str) -> Column:
    """Code points of a text, 0 for null."""
    return F.length(F.coalesce(F.col(column), F.lit(""))).cast("long")


#: The rows of the registered query in DuckDB's SQL, for windows of 35 words.
REPEATS_SQL = r"""
with split as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
starts as (select doc_id, unnest(range(1, len(ws) - 33)) as i from split where len(ws) >= 35),
windows as (select doc_id, i, array_to_string(ws[i:i+34], ' ') as seq from starts join split using (doc_id)),
twice as (select seq from windows group by seq having count(*) > 1),
hit as (select doc_id, i from windows semi join twice using (seq)),
gone as (select distinct doc_id, i + k as p from hit, range(35) r(k)),
each as (select doc_id, unnest(range(1, len(ws) + 1)) as p, unnest(ws) as word from split),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as text from each anti join gone using (doc_id, p) group by doc_id)
select s.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(k.n, 0))::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256 from split s left join kept k using (doc_id)
"""
