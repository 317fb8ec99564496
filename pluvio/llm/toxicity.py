"""Toxicity scores from non-negative positive-unlabelled learning (operator 5).

Classifiers are linear over hashed words and beginnings and endings of words (present or not)
and are trained with numpy by minimising the non-negative risk of positives and unlabelled texts,

    R = prior * E_pos[l(f)] + max(0, E_unl[l(-f)] - prior * E_pos[l(-f)]),

with the logistic loss: a toxic share of ``prior`` among the unlabelled is allowed for, and a
second part below zero counts as zero, which keeps the classifier from learning the unlabelled
texts by heart. Confirmed toxic rows are the only labels that train. The prior starts as the
toxic share of the labelled rows that may be learnt from; as the unlabelled may hold fewer, it is
lowered to the least ratio of the shares of both sets above any score of a first classifier.
Features enter only where their share among the positives is beyond chance higher or lower than
among the unlabelled.

Training reads a bounded sample (``positives`` and ``unlabelled``, chosen by hash, are the
bounds), which is written once; tasks count its features and reduce its texts to the few that
enter before anything travels. The weights have a fixed size and are broadcast; every whole text
is scored where it lies, without a shuffle.

Defined results: a null or empty text has no words and gets the score of the bias; ties in the
sample go by id; repeated rows score alike; labels without a document play no part; with no
positive to learn from all scores are 0; columns named like a result column are replaced; an
empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvio.llm import textblocks as tb
from pluvio.llm.shared import cut

RESULT = ("held_out", "score", "predicted")


@dataclass(frozen=True)
class Training:
    """Bounds of the sample and settings of the learner."""

    positives: int = 8_000
    unlabelled: int = 24_000
    bits: int = 20
    least: int = 4  # positives that have a feature, at least
    deviations: float = 4.5  # standard errors between the two shares
    members: int = 3
    steps: int = 400
    rate: float = 0.1
    decay: float = 1e-6


U64 = np.uint64


def _letters() -> np.ndarray:
    """Bytes that belong to words: all but white space, control characters and ASCII marks."""
    solid = np.ones(256, bool)
    solid[:128] = [chr(b).isalnum() for b in range(128)]
    return solid


LETTERS = _letters()


#: Bytes at the beginning or the end of a longer word that are features of their own.
PARTS = (4, 5)


def features(column: pa.Array | pa.ChunkedArray, bits: int, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text (those ``chosen``), one text after another, and where
    each text's begin."""
    w = tb.split_words(column, lower=True, solid=LETTERS)
    row, length = w.row, w.end - w.start
    rows, numbers = [], []

    def take(h: np.ndarray, own: np.ndarray) -> None:
        number = (h >> U64(64 - bits)).astype(np.int64)
        if chosen is not None:
            hit = np.flatnonzero(chosen[number])
            number, own = number[hit], own[hit]
        rows.append(own)
        numbers.append(number)

    take(w.hash, row)
    for size in PARTS:
        long = np.flatnonzero(length > size)
        for kind, start in ((1, w.start[long]), (2, w.end[long] - size)):
            value = np.zeros(len(long), U64)
            for k in range(size):
                value = value << U64(8) | w.data[start + k].astype(U64)
            take(tb.mix(value + (U64(16 * size + kind) << U64(48))), row[long])
    key = np.unique(np.concatenate(rows).astype(U64) << U64(bits) | np.concatenate(numbers).astype(U64))
    row = (key >> U64(bits)).astype(np.int64)
    return (key & U64((1 << bits) - 1)).astype(np.int32), np.searchsorted(row, np.arange(len(w.first)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A task's numbers of texts that have each feature, by class."""
    counts, texts = np.zeros((2, 1 << bits), np.uint32), [0, 0]
    for batch in batches:
        for part in tb.slices(batch, "text", tb.SLICE_BYTES):
            toxic = part.column("toxic").to_numpy()
            numbers, first = features(part.column("text"), bits)
            own = np.repeat(toxic, np.diff(first))
            for k in (0, 1):
                counts[k] += np.bincount(numbers[own == k], minlength=1 << bits).astype(np.uint32)
                texts[k] += int((toxic == k).sum())
    if sum(texts):
        yield pa.RecordBatch.from_pylist([{"toxic": k, "n": texts[k], "counts": tb.pack(counts[k])} for k in (0, 1)], schema=_COUNTS)


_COUNTS = pa.schema([("toxic", pa.int32()), ("n", pa.int64()), ("counts", pa.binary())])


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    total = sum(tb.unpack(r["counts"], np.uint32).astype(np.uint64) for r in rows)
    return pa.Table.from_pylist([{"toxic": rows[0]["toxic"], "n": sum(r["n"] for r in rows), "counts": tb.pack(total.astype(np.uint32))}], schema=_COUNTS)


def choose(rows: DataFrame, t: Training) -> np.ndarray:
    """Which features enter, from counts of a fixed size over the sample."""
    each = rows.mapInArrow(lambda b: _counted(b, t.bits), "toxic int, n long, counts binary")
    sums = {r["toxic"]: (r["n"], tb.unpack(bytes(r["counts"]), np.uint32).astype(float)) for r in each.groupBy("toxic").applyInArrow(_summed, "toxic int, n long, counts binary").collect()}
    (n_u, u), (n_p, p) = sums.get(0, (0, None)), sums.get(1, (0, None))
    if not n_u or not n_p:
        return np.zeros(1 << t.bits, bool)
    both = (p + u) / (n_p + n_u)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    return (np.abs(p / n_p - u / n_u) > t.deviations * error) & (np.maximum(p, u * n_p / n_u) >= t.least)


def _packed(batches: Iterator[pa.RecordBatch], bits: int, chosen: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tb.slices(batch, "text", tb.SLICE_BYTES):
            numbers, first = features(part.column("text"), bits, chosen)
            rows = [numbers[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(rows, pa.binary())], names=["toxic", "words"])


@dataclass
class Sample:
    positive: list[np.ndarray]
    unlabelled: list[np.ndarray]
    prior: float
    chosen: np.ndarray


def once(rows: DataFrame) -> DataFrame:
    """One text of each id, the least, so that rows that repeat an id don't come without bound."""
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, t: Training) -> Sample | None:
    """Features of the positives and of the unlabelled texts, and the prior. The driver gets the
    few features that enter of at most about ``positives + unlabelled`` texts."""
    learn = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = learn.agg(F.count("toxic").alias("n"), F.sum(F.col("toxic").cast("int")).alias("toxic")).first()
    if not share["toxic"]:
        return None
    by = F.xxhash64(F.lit("sample"), F.col("doc_id"))
    picked = learn.filter(F.col("toxic") == 1).select("doc_id").distinct().orderBy(by, "doc_id").limit(t.positives)
    own = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    positive = once(own.join(F.broadcast(picked), "doc_id", "left_semi")).select("text", F.lit(1).alias("toxic"))
    rate = min(1.0, t.unlabelled / max(own.count(), 1))
    bound = F.lit(int(rate * 2**32))
    free = once(own.filter(F.pmod(F.xxhash64(F.lit("unlabelled"), F.col("doc_id")), F.lit(1 << 32)) < bound)).select("text", F.lit(0).alias("toxic"))
    rows = cut(positive.union(free))
    chosen = choose(rows, t)
    packed = rows.mapInArrow(lambda b: _packed(b, t.bits, chosen), "toxic int, words binary").collect()
    both = [[np.frombuffer(r["words"], np.int32) for r in packed if r["toxic"] == k] for k in (1, 0)]
    return Sample(both[0], both[1], share["toxic"] / share["n"], chosen) if both[0] and both[1] else None


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Rows:
    """Features of many texts, one text after another."""

    flat: np.ndarray
    owner: np.ndarray
    n: int

    @staticmethod
    def of(texts: list[np.ndarray]) -> Rows:
        return Rows(np.concatenate(texts).astype(np.int64), np.repeat(np.arange(len(texts)), [len(t) for t in texts]), len(texts))

    def score(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, w[self.flat], self.n)

    def gradient(self, by_score: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.flat, by_score[self.owner], size)


def fit(positive: Rows, unlabelled: Rows, prior: float, size: int, t: Training) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier, by Adam on the whole non-negative risk."""
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, t.steps + 1):
        fp, fu = positive.score(w) + bias, unlabelled.score(w) + bias
        sp, su = _sigmoid(fp), _sigmoid(fu)
        dp, du = prior * (sp - 1) / positive.n, np.zeros(unlabelled.n)
        if np.mean(np.logaddexp(0, fu)) > prior * np.mean(np.logaddexp(0, fp)):
            dp, du = dp - prior * sp / positive.n, su / unlabelled.n
        g = np.append(positive.gradient(dp, size) + unlabelled.gradient(du, size) + t.decay * w, dp.sum() + du.sum())
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        move = t.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= float(move[-1])
    return w, bias


def lowered_prior(prior: float, positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The least ratio of the shares of the unlabelled and of the positives above a score that a
    tenth of the positives reach, where that is below ``prior``."""
    scores = np.quantile(positive, np.linspace(0.0, 0.9, 46))
    up = 1 - np.searchsorted(np.sort(unlabelled), scores) / len(unlabelled)
    pos = 1 - np.searchsorted(np.sort(positive), scores) / len(positive)
    return float(max(min(prior, np.min(up / pos)), 1 / (1 + len(unlabelled))))


@dataclass
class Model:
    weights: np.ndarray  # members x 2^bits, single precision
    bias: np.ndarray
    bits: int
    chosen: np.ndarray

    def score(self, column: pa.Array | pa.ChunkedArray) -> np.ndarray:
        numbers, first = features(column, self.bits, self.chosen)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        each = [_sigmoid(np.bincount(owner, w[numbers], len(first) - 1) + b) for w, b in zip(self.weights, self.bias, strict=True)]
        return np.mean(each, 0)


def train(docs: DataFrame, labels: DataFrame, t: Training | None = None) -> Model | None:
    """The mean of ``members`` classifiers, each on a bootstrap of the sample; None without a
    positive to learn from."""
    t = t or Training()
    found = sample(docs, labels, t)
    if found is None:
        return None
    dense = np.cumsum(found.chosen) - 1  # the features that enter, numbered
    both = [[dense[r] for r in some] for some in (found.positive, found.unlabelled)]
    size = int(found.chosen.sum())
    first = fit(Rows.of(both[0]), Rows.of(both[1]), found.prior, size, t)[0]
    prior = lowered_prior(found.prior, *(Rows.of(x).score(first) for x in both))
    fitted = []
    for member in range(t.members):
        rng = np.random.default_rng(member)
        drawn = [Rows.of([x[i] for i in rng.integers(0, len(x), len(x))]) for x in both]
        fitted.append(fit(*drawn, prior, size, t))
    weights = np.zeros((t.members, 1 << t.bits), np.float32)
    weights[:, found.chosen] = np.stack([w for w, _ in fitted])
    return Model(weights, np.array([b for _, b in fitted]), t.bits, found.chosen)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    carry = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(*carry, held_out(F.col("doc_id")).alias("held_out"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.slices(batch, "text", tb.SLICE_BYTES):
                s = held.value.score(part.column("text")) if held.value else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*carry, *RESULT])

    return rows.mapInArrow(run, rows.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
