"""Token counts of a unigram model by dynamic programming over a trie (operator 3).

A task reads its partition in chunks of bounded size and inserts each distinct pre-token of a
chunk once in a trie. The forward score of a prefix (that of its best segmentation) depends on
nothing after it, so it is computed once, at the prefix's node, from the nodes above. Nodes at
which a pre-token ends store the number of pieces of their best segmentation, and a text's
count is the sum over its pre-tokens. Nothing is shuffled.

The vocabulary is a map from piece to log probability; ``sentencepiece_scores`` reads one from a
model file. Files of merge models have ranks in place of probabilities; a rank r then stands for
Zipf's law, log p = -log(r + shift). Pre-tokens are the words between white space, each with
the mark of a word's start; characters without a piece cost one token for each UTF-8 byte.

Defined results: a null or empty text has no pre-tokens and no tokens; ties between
segmentations of equal score go to the one with fewer tokens, then to the longer last piece;
repeated rows repeat the result; rows keep all columns but those named like a result column; an
empty table gives an empty one. Whole texts are counted, of any length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvio.llm import textblocks as tb

#: Bytes of text whose distinct pre-tokens share a trie.
CHUNK_BYTES = 16 << 20
SLICE_BYTES = 4 << 20
WORD_START = "▁"
#: Log probability of each byte of a character that has no piece.
BYTE_SCORE = -25.0
RESULT = ("n_pretokens", "n_tokens")


def sentencepiece_scores(path: str, shift: float = 2.7) -> dict[str, float]:
    """Piece to log probability from a sentencepiece model; a fixed-size vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scores = [model.get_score(i) for i in pieces]
    if all(s == round(s) for s in scores):  # ranks: 0, -1, -2, ...
        scores = [-math.log(shift - s) for s in scores]
    return dict(zip(map(model.id_to_piece, pieces), scores, strict=True))


_SHIFT = 21  # bits of a code point


class Pieces:
    """The vocabulary as a trie of its own: sorted transitions and the score at each state."""

    def __init__(self, scores: dict[str, float]) -> None:
        step: dict[tuple[int, str], int] = {}
        ends: dict[int, float] = {}
        for piece, score in scores.items():
            state = 0
            for c in piece:
                state = step.setdefault((state, c), len(step) + 1)
            if piece:
                ends[state] = score
        key = np.array([(s << _SHIFT) | ord(c) for s, c in step], np.int64)
        order = np.argsort(key)
        self.key, self.to = key[order], np.array(list(step.values()), np.int64)[order]
        self.score = np.full(len(step) + 1, -np.inf)
        self.score[list(ends)] = list(ends.values())
        self.longest = max(map(len, scores), default=1)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The next states; -1 where no piece goes on."""
        out = np.full(state.shape, -1, np.int64)
        alive = state >= 0
        if len(self.key) and alive.any():
            key = state[alive] << _SHIFT | np.broadcast_to(char, state.shape)[alive]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out[alive] = np.where(self.key[at] == key, self.to[at], -1)
        return out


def trie_counts(points: np.ndarray, first: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Tokens of the best segmentation of each of some distinct pre-tokens.

    The trie of the pre-tokens grows by one level at a time: the nodes of a level are the distinct
    pairs of a node above and a character. A node keeps the scores and counts of its nearest
    ancestors and the pieces that may go on from each, so its own are found once, for every
    pre-token that passes. Where a pre-token ends, its node's count is stored."""
    length = np.diff(first)
    out = np.zeros(len(length), np.int64)
    node = np.zeros(len(length), np.int64)
    m = pieces.longest
    best, tokens = np.full((1, m), -np.inf), np.zeros((1, m), np.int64)  # of the last m ancestors, nearest first
    best[0, 0] = 0.0
    state = np.full((1, m), -1, np.int64)  # of the pieces that began at each of them
    live = np.flatnonzero(length > 0)
    depth = 0
    while len(live):
        key, inverse = np.unique(node[live] << _SHIFT | points[first[live] + depth], return_inverse=True)
        above, char = key >> _SHIFT, (key & ((1 << _SHIFT) - 1))[:, None]
        b, t = best[above], tokens[above]
        s = pieces.step(np.concatenate((np.zeros((len(key), 1), np.int64), state[above][:, :-1]), 1), char)
        total = np.where(s >= 0, pieces.score[s], -np.inf) + b
        size = 1 + (char[:, 0] >= 0x80) + (char[:, 0] >= 0x800) + (char[:, 0] >= 0x10000)
        spelt = b[:, 0] + BYTE_SCORE * size
        top = np.maximum(total.max(1), spelt)
        few = np.where(total == top[:, None], t + 1, np.iinfo(np.int64).max).min(1)
        few = np.where(spelt == top, np.minimum(few, t[:, 0] + size), few)
        best = np.concatenate((top[:, None], b[:, :-1]), 1)
        tokens = np.concatenate((few[:, None], t[:, :-1]), 1)
        state = s
        node[live] = inverse
        depth += 1
        done = length[live] == depth
        out[live[done]] = few[inverse[done]]
        live = live[~done]
    return out


def _count_chunk(columns: list[pa.Array], pieces: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each array of texts: pre-tokens and tokens of each text."""
    cuts, hashes, sizes, raws = [], [], [], []
    offset = 0
    for column in columns:
        w = tb.split_words(column)
        unique, where, which = np.unique(w.hash, return_index=True, return_inverse=True)
        start, length = w.start[where], (w.end - w.start)[where]
        total = np.cumsum(length) - length
        raws.append(w.data[np.repeat(start - total, length) + np.arange(int(length.sum()))])
        hashes.append(unique)
        sizes.append(length)
        cuts.append((w.first, which.astype(np.int64) + offset))
        offset += len(unique)
    h, length, raw = np.concatenate(hashes), np.concatenate(sizes), np.concatenate(raws)
    _, where, which = np.unique(h, return_index=True, return_inverse=True)
    begin, length = (np.cumsum(length) - length)[where], length[where]
    data = raw[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))]
    points, byte = tb.code_points(data)
    first = np.searchsorted(byte, np.concatenate(([0], np.cumsum(length))))
    marked = np.insert(points.astype(np.int64), first[:-1], ord(WORD_START))
    tokens = trie_counts(marked, first + np.arange(len(first)), pieces)
    for words, local in cuts:
        total = np.concatenate(([0], np.cumsum(tokens[which[local]])))
        yield np.diff(words).astype(np.int64), total[words[1:]] - total[words[:-1]]


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens of each whole text."""
    carry = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(*carry)
    held = docs.sparkSession.sparkContext.broadcast(Pieces(scores))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, found in zip(parts, _count_chunk([p.column("text") for p in parts], held.value), strict=True):
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, found)], names=[*carry, *RESULT])

        held_parts, size = [], 0
        for batch in batches:
            for part in tb.slices(batch, "text", SLICE_BYTES):
                held_parts.append(part)
                size += len(tb.text_buffers(part.column("text"))[0])
                if size >= CHUNK_BYTES:
                    yield from counted(held_parts)
                    held_parts, size = [], 0
        if held_parts:
            yield from counted(held_parts)

    return rows.mapInArrow(run, rows.withColumns({c: F.lit(0).cast("long") for c in RESULT}).schema)
