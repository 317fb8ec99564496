"""Near duplicates and repeated passages against brute force."""

import random

import pytest

from pluvio.llm import ngram_join, substring_dedup
from tests.llm import brute


def corpus(seed=5):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for size, copies in ((6, 3), (20, 30), (60, 30), (150, 12), (150, 1)):
        base = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randrange(5)):
                p = r.randrange(len(w))
                w[p : p + 1] = [r.choice(vocabulary)] * r.randrange(3)
            rows.append((len(rows), " ".join(w)))
    chain = [r.choice(vocabulary) for _ in range(200)]
    rows += [(len(rows) + i, " ".join(chain[3 * i : 100 + 4 * i])) for i in range(30)]
    edge = [None, "", " \t\n", "one two", "ONE two", "é日本 x", chr(0xA0) + "a b c d"]
    return rows + [(len(rows) + i, t) for i, t in enumerate(edge)]


@pytest.mark.parametrize(("k", "percent", "bucket"), [(4, 85, 8 << 20), (5, 80, 2000)])
def test_components(spark, monkeypatch, k, percent, bucket):
    monkeypatch.setattr(ngram_join, "BUCKET_BYTES", bucket)
    rows = corpus()
    got = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.components(rows, k, percent)


def test_one_of_each_group_with_repeated_and_missing_ids(spark):
    text = " ".join(f"a{i}" for i in range(30))
    rows = [(3, text), (2, text), (2, text), (None, text), (7, None), (8, "other words here")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == [(False, 2), (False, 7), (False, 8), (True, 0)]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_components(empty).count() == 0
    assert ngram_join.keep_one(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize(("window", "buckets"), [(5, 1), (8, 4), (35, 3)])
def test_repeats(spark, window, buckets):
    r = random.Random(window)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(60):
        w = [r.choice("abcdefgh") + str(r.randrange(50)) for _ in range(r.randrange(90))]
        if i % 3 == 0:
            a = r.randrange(20)
            w[10:10] = passage[a : a + r.randrange(3, 45)]
        rows.append((i, " ".join(w)))
    rows += [(60, rows[0][1]), (61, None), (62, ""), (63, " ".join(["x"] * 100)), (63, "same id"), (64, " ".join(passage + ["y"] + passage))]
    docs = spark.createDataFrame([(*x, 7) for x in rows], "doc_id long, text string, n_words int")
    got = substring_dedup.remove_repeats(docs, window, buckets)
    assert got.columns == ["doc_id", "text", "n_words", "n_removed"]
    want = [(i, *x) for (i, _), x in zip(rows, brute.without_repeats(rows, window), strict=True)]
    assert sorted((x.doc_id, x.n_words, x.n_removed, x.text) for x in got.collect()) == sorted(want)
