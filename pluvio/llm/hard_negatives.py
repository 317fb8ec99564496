"""Hard negatives: per anchor and positive, the best rows of other labels in a window of scores (operator 11).

Rows become vectors of integers. They are indexed by product quantisation: the components are cut
into subspaces of ``width``, each subspace has a codebook, and a row keeps the code of its nearest
word in each subspace and the length of its residual, what the words together leave of it. An
anchor's products with all words are a table; the sum of the entries under a row's codes is the
product with the row's words, and the true score differs from it by at most the anchor's length times
the residual's length (Cauchy and Schwarz). So every row has a lower and an upper bound without its
vector being touched, and

* a row can be among an anchor's first positives only if its upper bound reaches the least of the
  ``positives`` greatest lower bounds of the anchor's label;
* a row can be in a window only if its bounds overlap it; and as soon as ``negatives`` rows lie in it for
  sure, only if its upper bound reaches the least of their greatest lower bounds.

The rows left are ranked by exact integer products, which complete the window. The bounds only leave
rows out that can't count, so results are those of brute force, whatever the codebooks.

Codebooks are fitted by k-means on about ``sample`` rows of each number of components, drawn by a hash
of the row (documented bound; every row is indexed). The index is written once. Groups of rows and
waves of anchors have bounded sizes, and anchors travel in packs; only the best of each anchor or
window leave a task.

Defined results: rows with a null id or label, a vector that is null or empty, or null or non-finite
components take no part; components and scores beyond 64 bits count as the last that fits; vectors meet those with as
many components; an id that repeats is an anchor once, by its least vector and label, while all of its
rows are positives and negatives for others; ties go to the smaller id, and a positive that repeats
has a window each time; an anchor without another row of its label, or a window without rows, has no
result (so all windows of a negative positive score); an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvio.llm.integer_vectors import best, integer_vectors, matrix, packs, pair_products, unpacked, wave
from pluvio.llm.shared import cut


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    negatives: int = 10
    low: int = 30  # a negative scores at least so many hundredths of the positive
    high: int = 90  # and at most so many
    width: int = 2  # components of a subspace
    words: int = 128  # of a codebook
    rounds: int = 5  # of k-means
    sample: int = 4_096
    most_block: int = 32_768  # rows of a group
    pack: int = 64  # anchors that travel together
    wave: int = 8_192  # anchors that one task holds
    seed: int = 23


def subspaces(dim: int, width: int) -> list[slice]:
    return [slice(i, min(i + width, dim)) for i in range(0, dim, width)]


def fit(v: np.ndarray, s: Settings) -> np.ndarray:
    """Codebooks (subspace, word, component) of some vectors; a last, narrower subspace has zeros behind."""
    r = np.random.default_rng(s.seed)
    parts = subspaces(v.shape[1], s.width)
    books = np.zeros((len(parts), min(s.words, len(v)), s.width))
    for book, at in zip(books, parts, strict=True):
        x = v[:, at]
        words = x[r.permutation(len(x))[: len(book)]].copy()
        for _ in range(s.rounds):
            code = nearest_word(x, words)
            n = np.bincount(code, minlength=len(words))
            for c in range(x.shape[1]):
                total = np.bincount(code, x[:, c], len(words))
                words[n > 0, c] = total[n > 0] / n[n > 0]
        book[:, : x.shape[1]] = words
    return books


def nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (words * words).sum(1) / 2
    for low in range(0, len(x), 8_192):
        out[low : low + 8_192] = (half[None] - x[low : low + 8_192] @ words.T).argmin(1)
    return out


def encode(v: np.ndarray, books: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (row, subspace) and the lengths of the residuals."""
    parts = subspaces(v.shape[1], width)
    codes, rest = np.empty((len(v), len(parts)), np.uint16), np.zeros(len(v))
    for j, (book, at) in enumerate(zip(books, parts, strict=True)):
        x, words = v[:, at], book[:, : at.stop - at.start]
        codes[:, j] = nearest_word(x, words)
        gap = x - words[codes[:, j]]
        rest += (gap * gap).sum(1)
    return codes, np.sqrt(rest)


class Indexed:
    """The indexed rows of a group, and bounds of their scores."""

    def __init__(self, table: pa.Table) -> None:
        self.ids, self.labels = table.column("vec_id").to_numpy(), table.column("label").to_numpy()
        self.v, self.residual = matrix(table.column("v")), table.column("residual").to_numpy()
        self.codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint16).reshape(len(self.ids), -1).T.astype(np.intp)
        self.longest = float(np.sqrt((self.v * self.v).sum(1)).max(initial=0)) + float(self.residual.max(initial=0))

    def bounds(self, anchors: np.ndarray, books: np.ndarray, width: int, rows: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the scores of ``rows`` with each anchor: (anchor, row)."""
        codes = self.codes[:, rows]
        score = np.zeros((codes.shape[1], len(anchors)))
        for code, book, at in zip(codes, books, subspaces(anchors.shape[1], width), strict=True):
            score += (book[:, : at.stop - at.start] @ anchors[:, at].T)[code]
        length = np.sqrt((anchors * anchors).sum(1))
        # a little more than what is lost in rounding
        spread = np.outer(self.residual[rows], length) * (1 + 1e-9) + length * self.longest * 1e-9 + 1e-6
        return (score - spread).T, (score + spread).T


def first_positives(group: Indexed, ids: np.ndarray, q: np.ndarray, labels: np.ndarray, books: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors (their places), ids and scores of the best rows of their labels."""
    of, at, score = [], [], []
    for label in np.intersect1d(labels, group.labels):
        asked, rows = np.flatnonzero(labels == label), np.flatnonzero(group.labels == label)
        low, high = group.bounds(q[asked], books, s.width, rows)
        own = group.ids[rows][None] == ids[asked][:, None]
        low[own], high[own] = -np.inf, -np.inf
        least = np.full(len(asked), -np.inf)
        if len(rows) > s.positives:
            least = np.partition(low, len(rows) - s.positives, 1)[:, len(rows) - s.positives]
        i, j = np.nonzero((high >= least[:, None]) & ~own)
        for a in range(0, len(i), 65_536):
            x, y = asked[i[a : a + 65_536]], rows[j[a : a + 65_536]]
            exact = pair_products(q[x], group.v[y])
            kept = best(x, exact, group.ids[y], s.positives)
            of.append(x[kept])
            at.append(y[kept])
            score.append(exact[kept])
    if not of:
        return (np.empty(0, np.int64),) * 3
    x, y, exact = np.concatenate(of), np.concatenate(at), np.concatenate(score)
    kept = best(x, exact, group.ids[y], s.positives)
    return x[kept], group.ids[y[kept]], exact[kept]


def window(group: Indexed, label: int, anchor: int, q: np.ndarray, low: np.ndarray, high: np.ndarray, positives: np.ndarray, s: Settings) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Of one anchor: for the place of each positive score, rows and scores of its window's best."""
    other = (group.labels != label) & (group.ids != anchor)
    need = np.zeros(len(low), bool)
    bounds = [(p * s.low / 100, p * s.high / 100) for p in positives.tolist()]
    for least, most in bounds:
        inside = other & (high >= least - 1e-6 * abs(least)) & (low <= most + 1e-6 * abs(most))
        sure = low[inside & (low >= least + 1e-6 * abs(least)) & (high <= most - 1e-6 * abs(most))]
        if len(sure) >= s.negatives:
            inside &= high >= np.partition(sure, len(sure) - s.negatives)[len(sure) - s.negatives]
        need |= inside
    rows = np.flatnonzero(need)
    exact = pair_products(np.broadcast_to(q, (len(rows), len(q))), group.v[rows])
    out = []
    for k, p in enumerate(positives.tolist()):
        # in integers, and without a product that leaves 64 bits
        least, most = -((-s.low * p) // 100), (s.high * p) // 100
        met = np.flatnonzero((exact >= least) & (exact <= most)) if least <= most else np.empty(0, int)
        kept = met[best(np.zeros(len(met), int), exact[met], group.ids[rows[met]], s.negatives)]
        out.append((k, rows[kept], exact[kept]))
    return out


POSITIVE = "anchor_id long, positive_id long, positive_score long"
_POSITIVE = pa.schema([(c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score")])
NEGATIVE = "anchor_id long, place int, negative_id long, negative_score long"
_NEGATIVE = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("negative_id", pa.int64()), ("negative_score", pa.int64())])


def whole(upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Integers of 64 bits from their halves, which travel as doubles."""
    return upper.astype(np.int64) * (1 << 32) + lower.astype(np.int64)


def halves(x: Column) -> tuple[Column, Column]:
    return F.shiftright(x, 32).cast("double"), F.pmod(x, F.lit(1 << 32)).cast("double")


def _books(table: pa.Table) -> np.ndarray:
    row = table.slice(0, 1).to_pylist()[0]
    return np.frombuffer(row["books"], np.float64).reshape(row["shape"])


def _positives(s: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows or not sent.num_rows:
            return _POSITIVE.empty_table()
        group, books, out = Indexed(rows), _books(sent), []
        for ids, q, extra in unpacked(sent):
            of, near, score = first_positives(group, ids, q, whole(extra[:, 0], extra[:, 1]), books, s)
            out.append(pa.table([pa.array(ids[of]), pa.array(near), pa.array(score)], schema=_POSITIVE))
        return pa.concat_tables(out)

    return run


def _negatives(s: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, sent: pa.Table) -> pa.Table:
        if not rows.num_rows or not sent.num_rows:
            return _NEGATIVE.empty_table()
        group, books, out = Indexed(rows), _books(sent), []
        for ids, q, extra in unpacked(sent):
            low, high = group.bounds(q, books, s.width)
            labels = whole(extra[:, 0], extra[:, 1])
            for j, anchor in enumerate(ids.tolist()):
                n = int(extra[j, 2])
                positives = whole(extra[j, 3 : 3 + n], extra[j, 3 + s.positives : 3 + s.positives + n])
                for k, at, score in window(group, int(labels[j]), anchor, q[j], low[j], high[j], positives, s):
                    m = len(at)
                    out.append(pa.table([pa.array(np.full(m, anchor)), pa.array(np.full(m, k, np.int32)), pa.array(group.ids[at]), pa.array(score)], schema=_NEGATIVE))
        return pa.concat_tables(out) if out else _NEGATIVE.empty_table()

    return run


def codebooks(every: DataFrame, s: Settings) -> DataFrame:
    """dim, books, shape: fitted on about ``sample`` rows of each number of components."""

    def fitted(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        books = fit(matrix(t.sort_by([("vec_id", "ascending"), ("hash", "ascending")]).column("v")), s)
        return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([books.tobytes()], pa.binary()), pa.array([list(books.shape)], pa.list_(pa.int32()))], names=["dim", "books", "shape"])

    n = every.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    hashed = every.withColumn("hash", F.xxhash64(F.lit(s.seed), "vec_id", "v")).join(F.broadcast(n), "dim")
    share = F.pmod("hash", F.lit(1 << 40)) * F.col("n") < F.lit(float(s.sample)) * (1 << 40)
    kept = hashed.filter(share | (F.col("n") <= s.sample)).select("dim", "vec_id", "hash", "v")
    return kept.groupBy("dim").applyInArrow(fitted, "dim long, books binary, shape array<int>")


INDEX = "dim long, part long, vec_id long, label long, v array<double>, codes binary, residual double"
_INDEX = pa.schema([("dim", pa.int64()), ("part", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.float64())), ("codes", pa.binary()), ("residual", pa.float64())])


def _indexed(s: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, books: pa.Table) -> pa.Table:
        if not rows.num_rows or not books.num_rows:
            return _INDEX.empty_table()
        codes, residual = encode(matrix(rows.column("v")), _books(books), s.width)
        more = {"codes": pa.array([c.tobytes() for c in codes], pa.binary()), "residual": pa.array(residual)}
        return pa.table([more[f.name] if f.name in more else rows.column(f.name).cast(f.type) for f in _INDEX], schema=_INDEX)

    return run


def index(vectors: DataFrame, books: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """Every row with its group, codes and the length of its residual, written to the shared folder."""
    each = sizes.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    placed = vectors.join(F.broadcast(sizes.select("dim", "parts")), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", "label", "v"), F.col("parts")))
    sent = books.join(each, "dim")
    key = ["dim", "part"]
    return cut(placed.select(*key, "vec_id", "label", "v").groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(_indexed(s), INDEX))


def _searched(indexed: DataFrame, books: DataFrame, sizes: DataFrame, anchors: DataFrame, run: Callable, schema: str, s: Settings) -> DataFrame:
    """``anchors`` (query_id, v, dim, more) against every group."""
    shape = sizes.select("dim", "n_queries", F.greatest(F.ceil(F.col("n_queries") / s.wave), F.lit(1)).alias("waves"), "parts")
    dealt = anchors.join(F.broadcast(shape.drop("parts")), "dim").withColumn("wave", wave(F.col("waves")))
    sent = packs(dealt, ["dim"], s.pack).join(books, "dim").join(F.broadcast(shape.select("dim", "parts")), "dim")
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = indexed.join(F.broadcast(shape.select("dim", "waves")), "dim").withColumn("wave", F.explode(F.sequence(F.lit(0).cast("long"), F.col("waves") - 1)))
    key = ["dim", "part", "wave"]
    left = rows.select(*key, "vec_id", "label", "v", "codes", "residual").groupBy(*key)
    return left.cogroup(sent.select(*key, "ids", "vectors", "extra", "books", "shape").groupBy(*key)).applyInArrow(run, schema)


def mine(vectors: DataFrame, is_anchor: Column, settings: Settings | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score for each row that
    ``is_anchor`` (a condition on vec_id) selects. Broadcast are only sizes, a row for each number of components."""
    s = settings or Settings()
    every = integer_vectors(vectors.filter("label is not null"), "label").withColumn("label", F.col("label").cast("long")).withColumn("dim", F.col("dim").cast("long"))
    every = every.filter("dim > 0 and label is not null")
    books = cut(codebooks(every, s))
    once = every.filter(is_anchor).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "label", "dim")).alias("q"))
    anchors = once.select("query_id", "q.v", "q.label", "q.dim")
    asked = anchors.groupBy("dim").agg(F.count(F.lit(1)).alias("n_queries"))
    rows = every.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / s.most_block).alias("parts"))
    sizes = cut(rows.join(asked, "dim"))
    indexed = index(every, books, sizes, s)

    found = _searched(indexed, books, sizes, anchors.withColumn("more", F.array(*halves(F.col("label")))), _positives(s), POSITIVE, s)
    by = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = found.withColumn("place", F.row_number().over(by) - 1).filter(F.col("place") < s.positives)
    first = cut(first)
    scores = F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x["positive_score"])
    listed = first.groupBy(F.col("anchor_id").alias("query_id")).agg(scores.alias("scores"))

    pad = F.array_repeat(F.lit(0.0), F.lit(s.positives) - F.size("scores"))
    upper = F.concat(F.transform("scores", lambda x: halves(x)[0]), pad)
    lower = F.concat(F.transform("scores", lambda x: halves(x)[1]), pad)
    more = F.concat(F.array(*halves(F.col("label")), F.size("scores").cast("double")), upper, lower)
    told = anchors.join(listed, "query_id").withColumn("more", more)
    near = _searched(indexed, books, sizes, told, _negatives(s), NEGATIVE, s)
    by = Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= s.negatives)
    return ranked.join(first, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: The same in DuckDB's SQL, for the registered query and vectors of one size.
NEGATIVES_SQL = """
with whole as (
  select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as anchor_id, c.vec_id, c.label = a.label as same, list_dot_product(a.v, c.v)::bigint as score from whole a join whole c on a.vec_id <> c.vec_id where a.vec_id % 100 = 0
), positives as (
  select *, row_number() over (partition by anchor_id order by score desc, vec_id) as place from scored where same
), windows as (
  select p.anchor_id, p.vec_id as positive_id, p.score as positive_score, n.vec_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)::int as rank
  from positives p join scored n on n.anchor_id = p.anchor_id and not n.same where p.place <= 5 and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from windows where rank <= 10
"""
