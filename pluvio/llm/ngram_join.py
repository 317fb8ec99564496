"""N-gram Jaccard join by filtering under several global token orders (operator 7).

A document is the set of its word shingles. Two sets link where their Jaccard similarity is
``percent`` / 100 or more. If they do, then under *any* order of all shingles the two prefixes
(the first ``n - ceil(t n) + 1`` shingles of each) share one. Candidates must pass under several
orders: lists of the shared prefix shingles of the first order, rare shingles first, give pairs;
of these only pairs remain whose prefixes also share a shingle under each of the hash orders (a
join of the pairs with the prefixes of both). Only then are texts read and sets compared whole.

Equal sets are one node, so exact copies never multiply. Pairs are formed where sizes and bounds
leave a link open. Of two sets, all that the prefix that ends first in the order shares with the
other set is in the other's prefix; so a shingle there that no other prefix has is not common.
In a list of many members a pair is formed as if the list's shingle were the first that both
have: whatever comes before it in either set is then not common, nor is what has a short list
later on, since pairs that share a short list are formed there. A linking pair meets this bound
at its first common shingle, so that no link is lost; two near copies of one text that miss the
threshold seldom do, as the differences of each, being rare, come first.

The list of a shingle is not paired out: runs of members of like size are compared with one
leader, the member that may have most in common with others. The components of these links go back
to the lists, and a second pass compares every pair of a list that lies in two components and
that sizes and bounds leave open.
The result is the components of all links; no link between different components is left out, and
links inside one component need no comparison.

Commonness comes from a count sketch of fixed size, summed over all documents. Any function of
a shingle gives a valid order; its accuracy only moves how long the lists are.

Defined results: words fold A-Z alone; with fewer than ``k`` words the whole sequence is the one
shingle; a text without words, or null, has an empty set and is its own component; rows with a
null ``doc_id`` take part, and a component's id is the least id that is not null; repeated rows
share a component; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from pluvio.llm import textblocks as tb
from pluvio.llm.components import connected
from pluvio.llm.shared import cut, shared_dir, shuffle_partitions

U64 = np.uint64
BUCKET_BYTES = 8 << 20
SKETCH_BITS = 20
_SEEDS = [U64(0x243F6A8885A308D3), U64(0x13198A2E03707344), U64(0xA4093822299F31D0), U64(0x082EFA98EC4E6C89)]


@dataclass
class Sets:
    """Distinct shingles of many texts: ``h[first[i]:first[i + 1]]`` in the order of ``rank``."""

    h: np.ndarray
    rank: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> np.ndarray:
        return np.diff(self.first)


def order_rank(h: np.ndarray, order: int, classes: np.ndarray | None = None) -> np.ndarray:
    """Place of a shingle in a global order: its class of commonness, if given, then a hash."""
    rank = tb.mix(h ^ _SEEDS[order])
    if classes is not None:
        rank = (rank >> U64(8)) | (classes[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)].astype(U64) << U64(56))
    return rank


def _sorted_by(row: np.ndarray, rank: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by row and rank. One key of 20 and 44 bits sorts fast; where that can't tell two
    shingles of a row apart, both keys are used."""
    if len(row) and int(row.max()) < 1 << 20:
        key = (row.astype(U64) << U64(44)) | (rank >> U64(20))
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
        if not ((key[1:] == key[:-1]) & (h[1:] != h[:-1])).any():
            return order
    return np.lexsort((rank, row))


def shingle_sets(column: pa.ChunkedArray, k: int, classes: np.ndarray | None = None) -> Sets:
    w = tb.split_words(column, lower=True)
    at, h = w.windows(k)
    row = w.row[at]
    for short in range(1, k):
        few = np.flatnonzero(w.n == short)
        if len(few):
            begin = w.first[few]
            whole = np.full(len(few), short, U64)
            for j in range(short):
                whole = tb.mix(whole + w.hash[begin + j])
            row, h = np.concatenate((row, few)), np.concatenate((h, whole))
    rank = order_rank(h, 0, classes)
    order = _sorted_by(row, rank, h)
    row, h, rank = row[order], h[order], rank[order]
    new = np.ones(len(h), bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    row, h, rank = row[new], h[new], rank[new]
    return Sets(h, rank, np.searchsorted(row, np.arange(len(w.first))))


def _sum_by_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)))
    return total[first[1:]] - total[first[:-1]]


def set_keys(s: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, whatever the order of its shingles."""
    return tuple(tb.mix(_sum_by_row(tb.mix(s.h + seed), s.first) + s.n.astype(U64)).view(np.int64) for seed in _SEEDS[:2])  # type: ignore[return-value]


MEMBER = "doc_id long, s1 long, s2 long, n long, slice int, counts binary, size long"


def members(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per row its set's key and size; at the end the task's share of the sketch, in slices."""
    schema = pa.schema([("doc_id", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("slice", pa.int32()), ("counts", pa.binary()), ("size", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, size = np.zeros(1 << SKETCH_BITS, np.uint32), 0
        for batch in batches:
            for part in tb.slices(batch, "text", tb.SLICE_BYTES):
                s = shingle_sets(part.column("text"), k)
                s1, s2 = set_keys(s)
                sketch += np.bincount((s.h >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch)).astype(np.uint32)
                size += len(tb.text_buffers(part.column("text"))[0])
                none = [pa.nulls(part.num_rows, t) for t in (pa.int32(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(s1), pa.array(s2), pa.array(s.n.astype(np.int64)), *none], schema=schema)
        if size:
            cells = sketch.reshape(16, -1)
            yield pa.RecordBatch.from_pylist([{"slice": i, "counts": tb.pack(c), "size": size if i == 0 else 0} for i, c in enumerate(cells)], schema=schema)

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    total = np.zeros(len(tb.unpack(rows[0]["counts"], np.uint32)), np.uint64)
    for r in rows:
        total += tb.unpack(r["counts"], np.uint32)
    return pa.table({"slice": pa.array([rows[0]["slice"]], pa.int32()), "counts": pa.array([tb.pack(total)], pa.binary())})


def common_classes(sketch: DataFrame) -> np.ndarray:
    """One byte for each cell of the sketch (a fixed 1 MB): eight steps for each doubling of its count."""
    rows = sketch.select("slice", "counts").groupBy("slice").applyInArrow(_summed, "slice int, counts binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8)
    counts = np.concatenate([tb.unpack(bytes(r["counts"]), np.uint64) for r in sorted(rows, key=lambda r: r["slice"])]).astype(float)
    return np.minimum(8 * np.log2(np.maximum(counts, 1)), 255).astype(np.uint8)


NODE = "s1 long, s2 long, n long, text string"
NODE_ARROW = pa.schema([("s1", pa.int64()), ("s2", pa.int64()), ("n", pa.int64()), ("text", pa.string())])


def _first_of(s1: np.ndarray, s2: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([s1, s2], 1), axis=0, return_index=True)[1]


def join_equal(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One text for each set of a batch that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for part in tb.slices(batch, "text", tb.SLICE_BYTES):
                s = shingle_sets(part.column("text"), k)
                keys.append(np.stack([*set_keys(s), s.n]))
            if not keys:
                continue
            s1, s2, n = np.concatenate(keys, 1)
            one = _first_of(s1, s2)
            one = one[n[one] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(s1[one]), pa.array(s2[one]), pa.array(n[one]), batch.column("text").cast(pa.string()).take(pa.array(one))], schema=NODE_ARROW)

    return run


def _nodes(table: pa.Table) -> pa.Table:
    """The nodes of a bucket, each once, sorted by key."""
    return table.take(pa.array(_first_of(table.column("s1").to_numpy(), table.column("s2").to_numpy())))


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def node_ids(b: int, n: int) -> np.ndarray:
    """A node's id: its bucket, and its place in the bucket by key."""
    return (np.int64(b) << 32) | np.arange(n, dtype=np.int64)


def least_common(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that sets of sizes ``n`` and ``m`` share at least if they link."""
    return (percent * (n + m) + 99 + percent) // (100 + percent)


@dataclass
class Prefixes:
    """The prefix shingles of a bucket's nodes under the first order, by the part they go to: hashes,
    nodes, where parts begin; the rank at which each node's prefix ends; and the place of each
    entry among all, node by node and in the order."""

    h: np.ndarray
    who: np.ndarray
    ends: np.ndarray
    last: np.ndarray
    place: np.ndarray


def _prefix_entries(nodes: pa.Table, k: int, percent: int, parts: int, classes: np.ndarray) -> Prefixes:
    """The order of the entries is the same whenever they are computed."""
    h, who, last, done = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, U64)], 0
    for piece in tb.slices(nodes, "text", tb.SLICE_BYTES):
        s = shingle_sets(piece.column("text"), k, classes)
        within = np.arange(len(s.h)) - np.repeat(s.first[:-1], s.n)
        use = within < np.repeat(prefix_length(s.n, percent), s.n)
        h.append(s.h[use])
        who.append(np.repeat(np.arange(len(s.n)), s.n)[use] + done)
        last.append(s.rank[s.first[:-1] + prefix_length(s.n, percent) - 1])
        done += len(s.n)
    h, who = np.concatenate(h), np.concatenate(who)
    part = tb.part_of(h, parts)
    order = np.argsort(part, kind="stable")
    return Prefixes(h[order], who[order], np.append(tb.runs(part[order]), len(order)), np.concatenate(last), order)


PRINTS = "part int, b int, fp binary"
_PRINTS = pa.schema([("part", pa.int32()), ("b", pa.int32()), ("fp", pa.binary())])
#: A list of at most so many members is short.
SHORT = 16
FLAGS = "b int, part int, bits binary, long binary"
_FLAGS = pa.schema([("b", pa.int32()), ("part", pa.int32()), ("bits", pa.binary()), ("long", pa.binary())])
LISTED = "part int, b int, fp binary, who binary, n binary, c binary, last binary, rest binary, open binary"
_LISTED = pa.schema([("part", pa.int32()), ("b", pa.int32()), *((x, pa.binary()) for x in ("fp", "who", "n", "c", "last", "rest", "open"))])
#: Parts that are none: rows with the keys of a bucket's nodes, and rows with their prefixes under the hash orders.
KEYS_PART, PREFIX_PART = -1, -2
WIDTH = 5


def _bucket(table: pa.Table) -> int:
    return int(table.column("b")[0].as_py())


def shared_flags(table: pa.Table) -> pa.Table:
    """Of one part: which entries of each bucket stand in a list of two or more, and in a long one."""
    rows = table.to_pylist()
    fp = np.concatenate([tb.read_fingerprints(r["fp"], WIDTH) for r in rows])
    _, inverse, count = np.unique(fp, return_inverse=True, return_counts=True)
    shared, long, at, out = count[inverse] > 1, count[inverse] > SHORT, 0, []
    for r in rows:
        size = len(r["fp"]) // WIDTH
        out.append({"b": r["b"], "part": r["part"], "bits": np.packbits(shared[at : at + size]).tobytes(), "long": np.packbits(long[at : at + size]).tobytes()})
        at += size
    return pa.Table.from_pylist(out, schema=_FLAGS)


def shared_lists(nodes: pa.Table, flags: pa.Table, b: int, entries: Prefixes, parts: int, k: int, percent: int) -> pa.Table:
    """The entries that others share. Each node has its size, where its prefix ends, and ``c``, the
    most shingles that it has in common with any set whose prefix ends there or later. Each entry has
    the shingles from it on (``rest``), and those of them that may be common with a set that shares no
    short list and whose prefix ends there or later (``open``). Two more rows have the keys of the bucket's nodes
    and the prefixes, under the hash orders, of those that share an entry."""
    h, who, ends = entries.h, entries.who, entries.ends
    bits = {r["part"]: (r["bits"], r["long"]) for r in flags.to_pylist()}
    part_ids = tb.part_of(h[ends[:-1]], parts) if len(h) else np.empty(0, np.int32)
    shared, long = np.zeros(len(h), bool), np.zeros(len(h), bool)
    for p, lo, hi in zip(part_ids.tolist(), ends[:-1], ends[1:], strict=True):
        for flag, packed in zip((shared, long), bits[p], strict=True):
            flag[lo:hi] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo).astype(bool)
    n = nodes.column("n").to_numpy()
    c = n - np.bincount(who[~shared], minlength=len(n))
    size = prefix_length(n, percent)
    first = np.cumsum(size) - size
    rest = n[who] - (entries.place - first[who])
    closed = np.zeros(len(h) + 1, np.int64)  # entries before each place that are not in long lists
    closed[1 + entries.place] = ~long
    closed = np.cumsum(closed)
    open_ = rest - (closed[(first + size)[who]] - closed[entries.place + 1])
    rows = []
    for p, lo, hi in zip(part_ids.tolist(), ends[:-1], ends[1:], strict=True):
        keep = lo + np.flatnonzero(shared[lo:hi])
        if len(keep):
            used, local = np.unique(who[keep], return_inverse=True)
            rows.append({"part": p, "b": b, "fp": tb.fingerprints(h[keep], WIDTH), "who": tb.pack(used.astype(np.uint32)[local], delta=True), "n": tb.pack(n[used].astype(np.uint32)), "c": tb.pack(c[used].astype(np.uint32)), "last": tb.pack(entries.last[used]), "rest": tb.pack(rest[keep].astype(np.uint32)), "open": tb.pack(open_[keep].astype(np.uint32))})
    rows.append({"part": KEYS_PART, "b": b, "n": nodes.column("s1").to_numpy().tobytes(), "c": nodes.column("s2").to_numpy().tobytes()})
    alive = np.unique(who[shared])
    if len(alive):
        some = _slow_sets(nodes.take(pa.array(alive)), k)
        rows.append({"part": PREFIX_PART, "b": b, "who": alive.tobytes(), "n": prefix_length(some.n, percent).tobytes(), "fp": hash_prefixes(some, 1, percent).tobytes(), "rest": hash_prefixes(some, 2, percent).tobytes()})
    return pa.Table.from_pylist(rows, schema=_LISTED)


def hash_prefixes(s: Sets, order: int, percent: int) -> np.ndarray:
    """32 bits of each prefix shingle of each set under a hash order."""
    rank, row = order_rank(s.h, order), np.repeat(np.arange(len(s.n)), s.n)
    by = _sorted_by(row, rank, s.h)
    within = np.arange(len(by)) - np.repeat(s.first[:-1], s.n)
    use = within < np.repeat(prefix_length(s.n, percent), s.n)
    return s.h[by][use].astype(np.uint32).view(np.int32)


PREFIXES = "id long, o1 array<int>, o2 array<int>"


def read_prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            ids = np.frombuffer(r["who"], np.int64) | (np.int64(r["b"]) << 32)
            at = pa.array(np.concatenate(([0], np.cumsum(np.frombuffer(r["n"], np.int64)))).astype(np.int32))
            o1, o2 = (pa.ListArray.from_arrays(at, pa.array(np.frombuffer(r[x], np.int32))) for x in ("fp", "rest"))
            yield pa.RecordBatch.from_arrays([pa.array(ids), o1, o2], names=["id", "o1", "o2"])


KEYS = "id long, s1 long, s2 long"


def read_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            s1, s2 = (np.frombuffer(r[x], np.int64) for x in ("n", "c"))
            yield pa.RecordBatch.from_arrays([pa.array(node_ids(r["b"], len(s1))), pa.array(s1), pa.array(s2)], names=["id", "s1", "s2"])


PAIRS = "b int, member long, lead long"
_PAIRS = pa.schema([("b", pa.int32()), ("member", pa.int64()), ("lead", pa.int64())])


@dataclass
class Lists:
    """Entries of one part by list and size: node, size, end of the prefix, bounds on what is common
    with a set whose prefix ends no later (``rest``) or no sooner (``open``) and, in the second pass, component."""

    node: np.ndarray
    n: np.ndarray
    last: np.ndarray
    rest: np.ndarray
    open: np.ndarray
    comp: np.ndarray
    list: np.ndarray
    ends: np.ndarray


def _lists(table: pa.Table) -> Lists:
    columns: dict[str, list[np.ndarray]] = {x: [] for x in ("fp", "node", "n", "c", "last", "rest", "open", "comp")}
    for r in table.to_pylist():
        who = tb.unpack(r["who"], np.uint32, delta=True).astype(np.int64)
        _, local = np.unique(who, return_inverse=True)
        node = (np.int64(r["b"]) << 32) | who
        columns["fp"].append(tb.read_fingerprints(r["fp"], WIDTH))
        columns["node"].append(node)
        columns["last"].append(tb.unpack(r["last"], U64)[local])
        columns["comp"].append(tb.unpack(r["comp"], np.int64)[local] if "comp" in r else node)
        for x in ("n", "c"):
            columns[x].append(tb.unpack(r[x], np.uint32).astype(np.int64)[local])
        for x in ("rest", "open"):
            columns[x].append(tb.unpack(r[x], np.uint32).astype(np.int64))
    x = {k: np.concatenate(v) for k, v in columns.items()}
    order = np.lexsort((x["node"], x["n"], x["fp"]))
    x = {k: v[order] for k, v in x.items()}
    ends = np.append(tb.runs(x["fp"]), len(order))
    size = np.diff(ends)
    short = np.repeat(size <= SHORT, size)  # a pair may be formed in any short list that both have
    return Lists(x["node"], x["n"], x["last"], np.where(short, x["n"], x["rest"]), np.where(short, x["c"], x["open"]), x["comp"], np.repeat(np.arange(len(size)), size), ends)


def _may_link(x: Lists, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bounds leave a link of entries ``i`` and ``j`` open."""
    n, m = x.n[i], x.n[j]
    bound = np.minimum(np.where(x.last[i] <= x.last[j], x.open[i], x.rest[i]), np.where(x.last[j] <= x.last[i], x.open[j], x.rest[j]))
    return (bound >= least_common(n, m, percent)) & (percent * np.maximum(n, m) <= 100 * np.minimum(n, m))


def _counting(count: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of the counts in turn."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _as_pairs(lead: list[np.ndarray], member: list[np.ndarray]) -> pa.Table:
    both = np.stack([np.concatenate([np.empty(0, np.int64), *lead]), np.concatenate([np.empty(0, np.int64), *member])], 1)
    both = np.unique(both, axis=0)
    return pa.table([pa.array((both[:, 1] >> 32).astype(np.int32)), pa.array(both[:, 1]), pa.array(both[:, 0])], schema=_PAIRS)


def _smallest(n: np.ndarray, percent: int) -> np.ndarray:
    return (percent * n + 99) // 100


def _largest(n: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The largest set that may link with one of ``n`` shingles, if at most so many are common."""
    return np.minimum(n * 100 // percent, (100 + percent) * common // percent - n)


#: Beyond the size of any set.
_LIST = 1 << 32


def stars(percent: int) -> Callable[[pa.Table], pa.Table]:
    """First pass: the members of a list, by size, in runs that a factor of 100 / percent bounds; in
    each run all that may link with it meet its leader, the one with the greatest part of shingles
    that may be common (of a group of near copies, that which they are copies of)."""

    def run(table: pa.Table) -> pa.Table:
        x = _lists(table)
        key = x.list * _LIST + x.n
        begins = np.zeros(len(x.n), bool)
        at = x.ends[:-1]
        while len(at):  # the next run of every list that has one
            begins[at] = True
            stop = np.searchsorted(key, x.list[at] * _LIST + x.n[at] * 100 // percent, "right")
            more = stop < x.ends[1:][x.list[at]]
            at = stop[more]
        run_of = np.cumsum(begins) - 1
        best = np.lexsort((x.node, -(x.open / x.n), run_of))
        lead = best[tb.runs(run_of[best])][run_of]
        member = np.arange(len(lead))
        may = (lead != member) & (x.node[lead] != x.node) & _may_link(x, member, lead, percent)
        return _as_pairs([x.node[lead[may]]], [x.node[may]])

    return run


#: Pairs that a part looks at together in the second pass.
LOOK = 1 << 20


def _pieces(count: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose counts come to about LOOK, one row at least."""
    total, begin = np.cumsum(count), 0
    while begin < len(count):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + LOOK, "right")))
        yield begin, end
        begin = end


def _outside(x: Lists) -> np.ndarray:
    """The entries that are not of the largest component of their list."""
    order = np.lexsort((x.comp, x.list))
    begin = np.flatnonzero(np.concatenate(([True], (x.list[order][1:] != x.list[order][:-1]) | (x.comp[order][1:] != x.comp[order][:-1]))))
    size = np.diff(np.append(begin, len(order)))
    of_list = x.list[order[begin]]
    by_size = np.lexsort((-size, of_list))
    top = by_size[tb.runs(of_list[by_size])]
    largest = np.zeros(len(begin), bool)
    largest[top] = True
    out = np.empty(len(order), bool)
    out[order] = ~np.repeat(largest, size)
    return np.flatnonzero(out)


def crossings(percent: int) -> Callable[[pa.Table], pa.Table]:
    """Second pass: every pair of a list that lies in two components and may link.

    Members of a list's largest component are not paired among themselves. Each other member looks
    at those of a size that its bound for prefixes that end no sooner leaves open, and, with its
    weaker bound, at those whose own bound leaves anything open."""

    def run(table: pa.Table) -> pa.Table:
        x = _lists(table)
        leads, others = [], []
        every, own = np.arange(len(x.n)), _outside(x)
        able = _largest(x.n, x.open, percent) >= _smallest(x.n, percent)
        for a, bound, among in ((own[able[own]], x.open, every), (own, x.rest, every[able])):
            key = x.list[among] * _LIST + x.n[among]
            most = np.maximum(_largest(x.n[a], bound[a], percent), 0)
            low = np.searchsorted(key, x.list[a] * _LIST + _smallest(x.n[a], percent), "left")
            count = np.maximum(np.searchsorted(key, x.list[a] * _LIST + most, "right") - low, 0)
            for begin, end in _pieces(count):
                i = np.repeat(a[begin:end], count[begin:end])
                j = among[np.repeat(low[begin:end], count[begin:end]) + _counting(count[begin:end])]
                fits = (x.comp[i] != x.comp[j]) & _may_link(x, i, j, percent)
                i, j = x.node[i[fits]], x.node[j[fits]]
                leads.append(np.minimum(i, j))
                others.append(np.maximum(i, j))
        return _as_pairs(leads, others)

    return run


ATTACHED = LISTED + ", comp binary"


def attach(listed: pa.Table, comps: pa.Table) -> pa.Table:
    """The lists of a bucket with the component of each node; a node without links is its own."""
    b = _bucket(listed) if listed.num_rows else 0
    known, name = (comps.column(c).to_numpy() for c in ("id", "comp")) if comps.num_rows else (np.empty(0, np.int64), np.empty(0, np.int64))
    order = np.argsort(known)
    known, name = known[order], name[order]
    out = []
    for r in listed.to_pylist():
        used = np.unique(tb.unpack(r["who"], np.uint32, delta=True)).astype(np.int64) | (np.int64(b) << 32)
        comp = used.copy()
        if len(known):
            at = np.minimum(np.searchsorted(known, used), len(known) - 1)
            comp = np.where(known[at] == used, name[at], used)
        out.append(r | {"comp": tb.pack(comp)})
    return pa.Table.from_pylist(out, schema=pa.schema([*_LISTED, ("comp", pa.binary())]))


WANTED = "lb int, b int, ids binary"
_WANTED = pa.schema([("lb", pa.int32()), ("b", pa.int32()), ("ids", pa.binary())])
LEADER = "b int, id long, text string"
_LEADER = pa.schema([("b", pa.int32()), ("id", pa.int64()), ("text", pa.string())])
LINK = "lead long, member long, linked boolean"
_LINK = pa.schema([("lead", pa.int64()), ("member", pa.int64()), ("linked", pa.bool_())])


def _read_pairs(table: pa.Table) -> np.ndarray:
    """Distinct (lead, member) ids of a bucket, sorted by leader."""
    return np.unique(np.stack([table.column(c).to_numpy() for c in ("lead", "member")], 1), axis=0)


def wanted(table: pa.Table) -> pa.Table:
    """Which leaders' texts a bucket needs, asked of the leaders' buckets."""
    leads = np.unique(table.column("lead").to_numpy())
    at = leads >> 32
    return pa.Table.from_pylist([{"lb": int(x), "b": _bucket(table), "ids": leads[at == x].tobytes()} for x in np.unique(at)], schema=_WANTED)


def send_leaders(texts: pa.Table, asked: pa.Table) -> pa.Table:
    if not texts.num_rows or not asked.num_rows:
        return pa.Table.from_pylist([], schema=_LEADER)
    nodes = _nodes(texts)
    out = []
    for row in asked.to_pylist():
        ids = np.frombuffer(row["ids"], np.int64)
        one = nodes.take(pa.array(ids & 0xFFFFFFFF))
        out.append(pa.table([pa.array(np.full(len(ids), row["b"], np.int32)), pa.array(ids), one.column("text").cast(pa.string())], schema=_LEADER))
    return pa.concat_tables(out)


def verify(k: int, percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pairs of a bucket, compared whole."""

    def run(texts: pa.Table, met: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        if not texts.num_rows or not met.num_rows:
            return pa.Table.from_pylist([], schema=_LINK)
        sent = met.filter(pc.is_valid(met.column("text"))).sort_by("id")
        pairs = _read_pairs(met.filter(pc.is_valid(met.column("member"))))
        need = np.unique(pairs[:, 1])
        members = _slow_sets(_nodes(texts).take(pa.array(need & 0xFFFFFFFF)), k)
        leads = _slow_sets(sent, k)
        a, b = np.searchsorted(sent.column("id").to_numpy(), pairs[:, 0]), np.searchsorted(need, pairs[:, 1])
        linked = np.zeros(len(pairs), bool)
        bounds = np.append(tb.runs(a), len(a))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            linked[lo:hi] = _compare(leads, int(a[lo]), members, b[lo:hi], percent)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(linked)], schema=_LINK)

    return run


def _slow_sets(table: pa.Table, k: int) -> Sets:
    h, n = [np.empty(0, U64)], [np.empty(0, np.int64)]
    for piece in tb.slices(table, "text", tb.SLICE_BYTES):
        s = shingle_sets(piece.column("text"), k)
        h.append(s.h)
        n.append(s.n)
    every = np.concatenate(h)
    return Sets(every, every, np.concatenate(([0], np.cumsum(np.concatenate(n)))))


def _compare(leads: Sets, lead: int, members: Sets, which: np.ndarray, percent: int) -> np.ndarray:
    """Whether one leader links with each of some members."""
    mine = np.sort(leads.h[leads.first[lead] : leads.first[lead + 1]])
    n = members.n[which]
    theirs = members.h[np.repeat(members.first[which], n) + _counting(n)]
    at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
    common = mine[at] == theirs
    both = np.add.reduceat(common.astype(np.int64), np.cumsum(n) - n)
    return 100 * both >= percent * (len(mine) + n - both)


def saved_nodes(docs: DataFrame, k: int, buckets: int) -> tuple[DataFrame, str]:
    """The nodes by bucket, dealt out once: a bucketed table in the shared folder, which every pass
    reads without another exchange."""
    spark = docs.sparkSession
    nodes = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(join_equal(k), NODE)
    placed = nodes.withColumn("b", F.pmod("s1", F.lit(buckets)).cast("int")).repartition(buckets, "b")
    path = shared_dir(spark)
    name = path.rpartition("/")[2].replace("-", "_")
    placed.write.bucketBy(buckets, "b").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
    return spark.table(name), name


def in_every_order(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs whose prefixes share a shingle under the hash orders as well."""
    of_member = prefixes.select(F.col("id").alias("member"), F.col("o1").alias("m1"), F.col("o2").alias("m2"))
    of_lead = prefixes.select(F.col("id").alias("lead"), F.col("o1").alias("l1"), F.col("o2").alias("l2"))
    met = pairs.distinct().join(of_member, "member").join(of_lead, "lead")
    return met.filter(F.arrays_overlap("m1", "l1") & F.arrays_overlap("m2", "l2")).select("b", "member", "lead")


def _verified(texts: GroupedData, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs that link; ``texts`` are the nodes by bucket."""
    asked = pairs.groupBy("b").applyInArrow(wanted, WANTED)
    sent = texts.cogroup(asked.groupBy("lb")).applyInArrow(send_leaders, LEADER)
    met = pairs.unionByName(sent, allowMissingColumns=True)
    links = texts.cogroup(met.groupBy("b")).applyInArrow(verify(k, percent), LINK)
    return cut(links.filter("linked").select(F.col("lead").alias("u"), F.col("member").alias("v")))


def link_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``; ``s1``, ``s2`` name its set."""
    spark = docs.sparkSession
    both = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(members(k), MEMBER))
    rows, sketch = both.filter("slice is null").select("doc_id", "s1", "s2", "n"), both.filter("slice is not null")
    buckets = int((sketch.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES) + 1
    classes = spark.sparkContext.broadcast(common_classes(sketch))

    def prefixes(nodes: pa.Table) -> Prefixes:
        return _prefix_entries(nodes, k, percent, buckets, classes.value)

    def prints(texts: pa.Table) -> pa.Table:
        found = prefixes(_nodes(texts))
        h, ends = found.h, found.ends
        part = tb.part_of(h[ends[:-1]], buckets) if len(h) else []
        return pa.Table.from_pylist([{"part": int(p), "b": _bucket(texts), "fp": tb.fingerprints(h[lo:hi], WIDTH)} for p, lo, hi in zip(part, ends[:-1], ends[1:], strict=True)], schema=_PRINTS)

    def lists(texts: pa.Table, flags: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], schema=_LISTED)
        nodes = _nodes(texts)
        return shared_lists(nodes, flags, _bucket(texts), prefixes(nodes), buckets, k, percent)

    def spread(rows: DataFrame) -> DataFrame:
        """By part into as many tasks as there are; the rows are few bytes and much work."""
        return rows.repartition(max(buckets, shuffle_partitions(spark)), "part")

    table, name = saved_nodes(docs, k, buckets)
    try:
        texts = table.groupBy("b")
        flags = texts.applyInArrow(prints, PRINTS).groupBy("part").applyInArrow(shared_flags, FLAGS)
        every = cut(texts.cogroup(flags.groupBy("b")).applyInArrow(lists, LISTED))
        listed, keys = every.filter("part >= 0"), every.filter(F.col("part") == KEYS_PART).select("b", "n", "c").mapInArrow(read_keys, KEYS)
        hashed = every.filter(F.col("part") == PREFIX_PART).select("b", "who", "n", "fp", "rest").mapInArrow(read_prefixes, PREFIXES)

        met = cut(in_every_order(spread(listed).groupBy("part").applyInArrow(stars(percent), PAIRS), hashed))
        links = _verified(texts, met, k, percent)
        comps = connected(links).withColumnRenamed("node", "id")
        # Lists whose members still lie in several components.
        placed = comps.withColumn("b", F.shiftright("id", 32).cast("int"))
        attached = listed.groupBy("b").cogroup(placed.groupBy("b")).applyInArrow(attach, ATTACHED)
        met = cut(in_every_order(spread(attached).groupBy("part").applyInArrow(crossings(percent), PAIRS), hashed))
        if not met.isEmpty():
            more = _verified(texts, met, k, percent)
            comps = connected(links.union(more)).withColumnRenamed("node", "id")
    finally:
        spark.sql(f"drop table {name}")

    named = comps.join(keys, "id").select("s1", "s2", "comp")
    per_set = rows.groupBy("s1", "s2").agg(F.min("doc_id").alias("least")).join(named, ["s1", "s2"], "left")
    alone = per_set.filter("comp is null").select("s1", "s2", F.col("least").alias("component_id"))
    joined = per_set.filter("comp is not null")
    least = joined.groupBy("comp").agg(F.min("least").alias("component_id"))
    ids = joined.join(least, "comp").select("s1", "s2", "component_id").union(alone)
    out = rows.join(ids.withColumnsRenamed({"s1": "_s1", "s2": "_s2"}), (F.col("s1") == F.col("_s1")) & (F.col("s2") == F.col("_s2")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "s1", "s2")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, one of each group of linked documents: that with the least id.

    Rows whose text is null or without words link with nothing and stay. Rows without an id stay
    too, as no other row can stand for them. Of rows that repeat an id one stays."""
    groups = cut(link_components(docs, k, percent).select("doc_id", "component_id"))
    least = groups.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("_least"))
    repeated = not least.groupBy("_least").count().filter("count > 1").isEmpty()
    kept = docs.join(least.distinct(), F.col("doc_id").cast("long") == F.col("_least"), "left_semi")
    if repeated:
        kept = kept.dropDuplicates(["doc_id"])
    return kept.union(docs.filter(F.col("doc_id").isNull()))
