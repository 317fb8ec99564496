"""A Merkle manifest of a dataset: digests of rows, roots of groups and of the whole, and proofs (operator 13).

The rows of a group are its leaves. While a group has several nodes, every ``ARITY`` consecutive
ones (of the last run fewer, even one) become their digest; what remains is the group's subroot.
The subroots, in the order of their groups, become the root in the same way.

The tree is built by events. A digest that arrives joins the partial parent it belongs to, in its
slot. How many children a parent has follows from the size of its group, so a parent knows when it
is whole; then its own digest is an event for the parent above. Rows are numbered by one range
shuffle of digests (texts never move), and combined first where they lie, in chunks of consecutive
leaves. What a chunk can't finish, the children of its partial parents, is its frontier: a few nodes
a level. Frontiers reshuffle by the ancestor that they share, some levels higher each round, until
one node of each group is left. The links go back the same way: a round knows its nodes' siblings
and gets the rest of their paths from the round above, so that a leaf's proof is made in its chunk.

Bounds: a chunk holds ``chunk`` leaves, a round's group the frontiers of 3^``first_height`` leaves, or
of 3^``height`` subtrees later; both are independent of the table, and a source with most rows is as
many groups as its size asks for. Only the size of the largest group comes to the driver.

Defined results: a null field counts as ``-``; leaves with equal or null ids (null first) are ordered
by their digests; rows that repeat are leaves of their own, each with its proof; a null source is a
group of its own, the first; a single leaf is its group's subroot, a single subroot the root, with
an empty proof; an empty table has no leaf and no root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.shared import cut

ARITY = 3


@dataclass(frozen=True)
class Settings:
    chunk: int = 4_096  # consecutive leaves that are combined together first
    first_height: int = 9  # levels under the nodes that the first round of frontiers shares
    height: int = 5  # further levels of each further round


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes of each level over ``n`` leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // ARITY))
    return out


class Parents:
    """Nodes of one group's tree as far as they are known here, and its partial parents."""

    def __init__(self, n: int) -> None:
        self.widths = widths(n)
        self.known: dict[tuple[int, int], str] = {}
        self.partial: dict[tuple[int, int], dict[int, str]] = {}

    def arity(self, level: int, at: int) -> int:
        return min(ARITY, self.widths[level - 1] - ARITY * at)

    def add(self, level: int, index: int, node: str) -> None:
        """One event; it may make a parent whole, that one the next, and so on."""
        while True:
            self.known[level, index] = node
            if level + 1 == len(self.widths):
                return
            up = (level + 1, index // ARITY)
            children = self.partial.setdefault(up, {})
            children[index % ARITY] = node
            if len(children) < self.arity(*up):
                return
            del self.partial[up]
            (level, index), node = up, digest("".join(children[k] for k in sorted(children)))

    def frontier(self) -> Iterator[tuple[int, int, str]]:
        """What others must go on with: children of partial parents, or the top."""
        for (level, at), children in self.partial.items():
            for k, node in children.items():
                yield level - 1, at * ARITY + k, node
        top = (len(self.widths) - 1, 0)
        if top in self.known:
            yield *top, self.known[top]

    def step(self, level: int, index: int) -> str:
        """The siblings of a node whose parent is whole: those before it, ``|``, those after it."""
        first = index - index % ARITY
        run = [self.known[level, i] for i in range(first, first + self.arity(level + 1, index // ARITY))]
        return "".join(run[: index - first]) + "|" + "".join(run[index - first + 1 :])

    def path(self, level: int, index: int, ends: dict[tuple[int, int], list[str]]) -> list[str]:
        """Steps from a node up; ``ends`` has the paths of the frontier, and keeps what is found."""
        way = []
        while (level, index) not in ends:
            way.append((level, index))
            level, index = level + 1, index // ARITY
        path = ends[level, index]
        for node in reversed(way):
            path = [self.step(*node), *path]
            if node[0]:  # leaves aren't met twice
                ends[node] = path
        return path


FRONT = "g string, n long, first long, a long, b long, level int, at long, start long, node string"
_FRONT = pa.schema([("g", pa.string()), *((c, pa.int64()) for c in ("n", "first", "a", "b")), ("level", pa.int32()), ("at", pa.int64()), ("start", pa.int64()), ("node", pa.string())])
ENDS = "g string, n long, first long, a long, b long, level int, at long, path array<string>, subroot string, root string"
_ENDS = pa.schema([("g", pa.string()), *((c, pa.int64()) for c in ("n", "first", "a", "b")), ("level", pa.int32()), ("at", pa.int64()), ("path", pa.list_(pa.string())), ("subroot", pa.string()), ("root", pa.string())])


def _frontier(p: Parents, g: str, n: int, first: int, a: int, b: int) -> pa.Table:
    rows = [(g, n, first, a, b, level, at, at * ARITY**level, node) for level, at, node in p.frontier()]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FRONT, strict=True)], schema=_FRONT)


def _added(n: int, events: Iterable[tuple[int, int, str]]) -> Parents:
    p = Parents(n)
    for e in events:
        p.add(*e)
    return p


def _of(table: pa.Table, *names: str) -> Iterator[tuple]:
    return zip(*(table.column(c).to_pylist() for c in names), strict=True)


def _combine_chunk(leaves: pa.Table, chunk: pa.Table) -> pa.Table:
    if not leaves.num_rows:
        return _FRONT.empty_table()
    ((g, a, b, n, first),) = _of(chunk, "g", "a", "b", "n", "first")
    nodes = leaves.sort_by("mid").column("leaf").to_pylist()
    return _frontier(_added(n, ((0, first + i, x) for i, x in enumerate(nodes))), g, n, first, a, b)


def _combine_fronts(key: tuple[pa.Scalar, ...], fronts: pa.Table) -> pa.Table:
    g, c = (k.as_py() for k in key)
    n = fronts.column("n")[0].as_py()
    return _frontier(_added(n, _of(fronts, "level", "at", "node")), g, n, 0, -1, c)


def _ends(ends: pa.Table) -> tuple[dict[tuple[int, int], list[str]], str, str]:
    found = {(level, at): path for level, at, path in _of(ends, "level", "at", "path")}
    return found, ends.column("subroot")[0].as_py(), ends.column("root")[0].as_py()


def _back(fronts: pa.Table, ends: pa.Table) -> pa.Table:
    """The paths of the nodes that a round got, from those of the nodes that it passed on."""
    if not fronts.num_rows:
        return _ENDS.empty_table()
    p = _added(fronts.column("n")[0].as_py(), _of(fronts, "level", "at", "node"))
    found, subroot, root = _ends(ends)
    paths = [p.path(level, at, found) for level, at in _of(fronts, "level", "at")]
    m = fronts.num_rows
    more = {"path": pa.array(paths, pa.list_(pa.string())), "subroot": pa.array([subroot] * m), "root": pa.array([root] * m)}
    return pa.table([more[f.name] if f.name in more else fronts.column(f.name) for f in _ENDS], schema=_ENDS)


#: Leaves whose proofs travel in one batch.
BATCH = 1_024


def _proofs(schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(leaves: pa.Table, ends: pa.Table) -> pa.Table:
        if not leaves.num_rows:
            return schema.empty_table()
        leaves = leaves.sort_by("mid")
        n, first = ends.column("n")[0].as_py(), ends.column("first")[0].as_py()
        p = _added(n, ((0, first + i, x) for i, x in enumerate(leaves.column("leaf").to_pylist())))
        found, subroot, root = _ends(ends)
        out = []
        for low in range(0, leaves.num_rows, BATCH):
            part = leaves.slice(low, BATCH)
            m = part.num_rows
            paths = [p.path(0, first + low + i, found) for i in range(m)]
            more = {"proof": pa.array(paths, pa.list_(pa.string())), "subroot": pa.array([subroot] * m), "root": pa.array([root] * m)}
            out.append(pa.table([more[f.name] if f.name in more else part.column(f.name).cast(f.type) for f in schema], schema=schema))
        return pa.concat_tables(out)

    return run


@dataclass
class Forest:
    """The trees of all groups: numbered leaves, the frontiers of each round, and the tops."""

    leaves: DataFrame  # g, the caller's columns, leaf, mid, a, b
    fronts: list[DataFrame]  # each written; c: the group of its round
    tops: DataFrame  # one row for each group


def build(leaves: DataFrame, order: list[str], s: Settings) -> Forest:
    """Trees over ``leaves`` (g, leaf and others) in the order of ``order`` and leaf within each g."""
    placed = leaves.repartitionByRange("g", *order, "leaf").sortWithinPartitions("g", *order, "leaf")
    mid = F.col("mid")
    # number of the partition, and of the chunk within it
    numbered = placed.withColumn("mid", F.monotonically_increasing_id())
    numbered = cut(numbered.withColumn("a", F.shiftright(mid, 33)).withColumn("b", F.floor(F.pmod(mid, F.lit(1 << 33)) / s.chunk)))
    counts = numbered.groupBy("g", "a", "b").agg(F.count(F.lit(1)).alias("rows"))
    parts = counts.groupBy("g", "a").agg(F.sum("rows").alias("rows"))  # a row for each group and partition
    by = Window.partitionBy("g")
    parts = parts.select("g", "a", F.sum("rows").over(by).alias("n"), (F.sum("rows").over(by.orderBy("a")) - F.col("rows")).alias("before"))
    within = Window.partitionBy("g", "a").orderBy("b")
    chunks = counts.withColumn("earlier", F.sum("rows").over(within) - F.col("rows")).join(parts, ["g", "a"])
    chunks = cut(chunks.select("g", "a", "b", "n", (F.col("before") + F.col("earlier")).alias("first")))
    largest = chunks.agg(F.max("n")).first()[0] or 0
    key = ["g", "a", "b"]
    front = numbered.select(*key, "mid", "leaf").groupBy(*key).cogroup(chunks.groupBy(*key)).applyInArrow(_combine_chunk, FRONT)
    fronts, height, top = [], s.first_height, len(widths(largest)) - 1
    while True:
        written = cut(front.withColumn("c", F.floor(F.col("start") / F.lit(ARITY**height))))
        fronts.append(written)
        front = written.groupBy("g", "c").applyInArrow(_combine_fronts, FRONT)
        if height >= top:
            return Forest(numbered, fronts, cut(front))
        height += s.height


def proofs(forest: Forest, roots: DataFrame) -> DataFrame:
    """The leaves with subroot, root and proof; ``roots``: g, root and the path from the subroot to it."""
    met = forest.tops.join(roots.select("g", "path", "root"), "g")
    ends = met.select("g", "n", "first", "a", "b", "level", "at", "path", F.col("node").alias("subroot"), "root")
    for written in reversed(forest.fronts):
        ends = written.groupBy("g", "c").cogroup(ends.groupBy("g", "b")).applyInArrow(_back, ENDS)
    kept = [f for f in forest.leaves.schema.fields if f.name not in ("mid", "a", "b")]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", subroot string, root string, proof array<string>"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    key = ["g", "a", "b"]
    return forest.leaves.groupBy(*key).cogroup(ends.groupBy(*key)).applyInArrow(_proofs(schema), ddl)


def _field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*fields: Column) -> Column:
    """The digest of a row: each field with its length in bytes before it."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def group_key(source: Column) -> Column:
    """A group as a string that is never null; null comes first, the others bytewise."""
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source.cast("string")))


def manifest(rows: DataFrame, source: str, order: list[str], settings: Settings | None = None) -> DataFrame:
    """``rows`` (with ``leaf``) and their subroot, root and proof (array<string>: for each level the
    siblings before and after, parted by ``|``). Columns named g, mid, a, b, subroot, root or proof are
    the operator's."""
    s = settings or Settings()
    forest = build(cut(rows.withColumn("g", group_key(F.col(source)))), order, s)
    above = build(forest.tops.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("node").alias("leaf")), ["group"], s)
    ends = above.tops.select("g", F.col("node").alias("root"), F.array().cast("array<string>").alias("path"))
    roots = proofs(above, ends).select(F.col("group").alias("g"), "root", F.col("proof").alias("path"))
    return proofs(forest, roots).drop("g")


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from a leaf and its proof."""

    def up(node: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.substring_index(step, "|", 1), node, F.substring_index(step, "|", -1)), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.replace(F.array_join(proof, ""), F.lit("|"), F.lit("")), 256)


def documents_manifest(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof of ``documents``, and ``tampered``: the leaf of the text
    without line ends, where the id's CRC-32 is even, else the same leaf."""
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    text = F.col("text")
    leaf = leaf_of(*fields, text)
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n"))
    tampered = F.when(changed, leaf_of(*fields, F.replace(text, F.lit("\n"), F.lit("")))).otherwise(leaf)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf.alias("leaf"), tampered.alias("tampered"))
    return manifest(rows, "source", ["doc_id"], settings)


def verified(made: DataFrame) -> DataFrame:
    """What the manifest says of each document, and whether the tampered leaf still folds to the root."""
    folded = made.withColumn("folded_root", fold(F.col("tampered"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(c: str) -> str:
    return f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c}::varchar end"


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(_sql_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_POLYNOMIAL = 0xEDB88320
_BIT = f"case when c % 2 = 1 then xor(c // 2, {_POLYNOMIAL}) else c // 2 end"


def _sql_tree(name: str, leaves: str) -> str:
    """Per group the lists of its nodes, level by level: ``leaves`` has g and nodes."""
    run = "list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3*i+1 : 3*i+3], '')))"
    return f"""{name} as (select g, 0 as level, nodes from ({leaves})
  union all select g, level + 1, {run} from {name} where len(nodes) > 1)"""


#: The same in DuckDB's SQL.
MANIFEST_SQL = f"""
with recursive bits as (
  select i, i::bigint as c, 0 as k from range(256) t(i) union all select i, {_BIT}, k + 1 from bits where k < 8
), crc_table as (
  select list(c order by i) as crc from bits where k = 8
), rows as (
  select doc_id, source, {_sql_leaf("text")} as leaf,
    case when list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint), lambda a, x: xor(a // 256, crc[xor(a % 256, x) + 1]), 4294967295::bigint) % 2 = 1
      then {_sql_leaf("replace(text, chr(10), '')")} else {_sql_leaf("text")} end as tampered
  from documents, crc_table
), placed as (
  select *, case when source is null then '-' else '=' || source end as g from rows
), numbered as (
  select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as i from placed
), {_sql_tree("low", "select g, list(leaf order by i) as nodes from numbered group by g")}
, subroots as (
  select g, nodes[1] as subroot, row_number() over (order by g) - 1 as i from low where len(nodes) = 1
), {_sql_tree("high", "select '' as g, list(subroot order by i) as nodes from subroots")}
, ways as (
  select n.doc_id, n.g, n.leaf, n.tampered, n.i as leaf_i, l.level, l.nodes, n.i // (3**l.level)::bigint as spot
  from numbered n join low l on l.g = n.g where len(l.nodes) > 1
  union all
  select n.doc_id, n.g, n.leaf, n.tampered, n.i, 1000 + h.level, h.nodes, s.i // (3**h.level)::bigint
  from numbered n join subroots s on s.g = n.g, high h where len(h.nodes) > 1
), steps as (
  select g, leaf_i, level, array_to_string(nodes[spot - spot%3 + 1 : spot], '') as before, array_to_string(nodes[spot + 2 : spot - spot%3 + 3], '') as after from ways
), proofs as (
  select g, leaf_i, list(before order by level) as before, list(after order by level) as after from steps group by all
), folded as (
  select n.g, n.i, n.tampered as node, 1 as k, coalesce(before, []) as before, coalesce(after, []) as after from numbered n left join proofs p on p.g = n.g and p.leaf_i = n.i
  union all select g, i, sha256(before[k] || node || after[k]), k + 1, before, after from folded where k <= len(before)
), ends as (
  select g, i, node as folded_root, sha256(array_to_string(list_transform(range(1, len(before) + 1), lambda j: before[j] || after[j]), '')) as proof_sha256 from folded where k = len(before) + 1
)
select n.doc_id, n.leaf, s.subroot, (select nodes[1] from high where len(nodes) = 1) as root, e.proof_sha256, e.folded_root,
  e.folded_root = (select nodes[1] from high where len(nodes) = 1) as verified
from numbered n join subroots s on s.g = n.g join ends e on e.g = n.g and e.i = n.i
"""
