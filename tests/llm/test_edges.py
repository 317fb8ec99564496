"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pluvio.llm import ann, bpe, chat_format, html_wrappers, ngram_join, quality_rules, substring_dedup, toxicity, unigram_counts
from pluvio.llm.queries import vocabulary
from pluvio.llm.shared import cut
from tests.llm import brute

CLASHES = ("n_words", "n_removed", "kept", "t1", "m", "b", "rest", "part", "n_shingles", "component_id", "s1", "slice", "score", "predicted", "held_out", "n_tokens", "n_pretokens", "ids_sha256", "base_failed", "h")
R = random.Random(9)
LONG = " ".join(f"w{R.randrange(3000)}" for _ in range(20_000))
TEXTS = [None, "", " \n", "one two three", LONG, LONG, LONG + " more", "x" * 100_000, " ".join(f"a{i}" for i in range(80)), " ".join(f"A{i}" for i in range(80))]


@pytest.fixture(scope="module")
def rows():
    return [*enumerate(TEXTS), (4, LONG), (50, "é " * 60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, None if i % 2 else "en", None if i % 3 == 0 else "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    return made.withColumns({c: F.lit("clash") for c in CLASHES}).withColumn("n_chars", F.length("text").cast("long"))


def test_join_of_odd_rows(docs, rows):
    got = ngram_join.link_components(docs, 5, 80).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.components(rows, 5, 80)
    assert len(got) == len(rows) and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)


def test_repeats_of_odd_rows(docs, rows):
    got = substring_dedup.remove_repeats(docs, 35, 2)
    assert set(got.columns) == set(docs.columns)
    want = sorted((i, *x) for (i, _), x in zip(rows, brute.without_repeats(rows, 35), strict=True))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in got.collect()) == want
    assert got.filter("t1 <> 'clash' or rest <> 'clash' or m <> 'clash'").count() == 0


def test_repeats_keep_columns_of_all_types(spark):
    text = " ".join(f"a{i}" for i in range(40))
    made = spark.sql("select 1 as doc_id, timestamp'2020-01-01 00:00:00' as at, array(timestamp'2021-01-01 00:00:00') as ats, map('k', 1.5D) as m, binary('z') as bin, cast(1.5 as decimal(9,2)) as d")
    docs = made.withColumn("text", F.lit(text)).union(made.withColumn("text", F.lit("b c")))
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = substring_dedup.remove_repeats(docs).drop("n_words", "n_removed")
        assert sorted(map(str, got.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_quality_of_odd_rows(docs, rows):
    got = quality_rules.judge(docs)
    have = sorted((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got.select("doc_id", *quality_rules.BASE, "base_failed").collect())
    assert have == sorted((i, *brute.quality(t)) for i, t in rows)


def test_tokens_of_odd_rows(spark, docs, rows):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.round_trip(docs, path).collect())
    ids = {x: t.encode(x or "", add_special_tokens=False).ids for x in set(TEXTS) | {rows[-1][1]}}
    assert got == sorted((i, len(ids[x]), brute.sha(",".join(map(str, ids[x])))) for i, x in rows)
    counted = unigram_counts.count_tokens(docs, unigram_counts.sentencepiece_scores(vocabulary("piece_bpe_32k.model"))).collect()
    assert sorted((r.doc_id, r.n_pretokens) for r in counted) == sorted((i, len(brute.words(x))) for i, x in rows)


def test_pre_tokens_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    v = bpe.load(vocabulary("byte_bpe_50k.json"))
    texts = [pa.array(["one two three", "ab", "cd", "ab cd"]), pa.array(["three four", None]), pa.array(["cd"]), pa.array(["ab"])]
    want = [(e.ids.tolist(), e.first.tolist()) for e in bpe.encode_chunk(texts, v)]
    monkeypatch.setattr(bpe.tb, "hash_spans", lambda data, start, end: np.ones(len(start), np.uint64))
    assert [(e.ids.tolist(), e.first.tolist()) for e in bpe.encode_chunk(texts, v)] == want


def test_toxicity_of_odd_rows_and_empty_tables(spark, docs, rows):
    labels = spark.createDataFrame([(i, int(i == 4)) for i in range(8)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    nothing = toxicity.train(docs.limit(0), labels.limit(0))
    assert toxicity.score(docs.limit(0), nothing).count() == 0
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.0}


def test_long_turns_and_pages(spark):
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", "[INST]" + LONG)], "conv_id long, turn long, role string, text string")
    (got,) = chat_format.digests(turns).collect()
    assert got.turns_sha256 == brute.sha(f"user\n{LONG}\nassistant\n[INST]{LONG}\n") and got.loss_sha256 == brute.sha("[INST]" + LONG)
    page = f"<html><body><nav>menu</nav><article><p>{LONG}</p></article></body></html>"
    pages = spark.createDataFrame([(1, "http://a.b/c", page), (2, None, None)], "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    texts = {r.page_id: r.text for r in html_wrappers.extract_main_text(pages).collect()}
    assert texts == {1: LONG, 2: ""}


def test_streams_of_thousands_of_blocks_align():
    a = "<article>" + "".join(f"<p>a{i}</p><hr>text{i}<h2 class='k{i % 7}'>x</h2>" for i in range(2000)) + "</article>"
    b = "<article>" + "".join(f"<p>a{i}</p><b>z</b>text{i}<h2 class='k{i % 5}'>x</h2>" for i in range(2000)) + "</article>"
    alone = [html_wrappers.Reader(html_wrappers.page_wrapper(x)).text(x) for x in (a, b)]
    both = html_wrappers.Reader(html_wrappers.merged([html_wrappers.page_wrapper(x) for x in (a, b)]))
    assert [both.text(x) for x in (a, b)] == alone and "text1999" in alone[0]


@pytest.mark.parametrize("size", [3, 40, 300])
def test_alignment_is_a_common_subsequence(size):
    r = random.Random(size)
    for _ in range(20):
        a, b = ([r.choice("abcdefghij") + str(r.randrange(size // 3 + 1)) for _ in range(r.randrange(size))] for _ in range(2))
        found = html_wrappers._matches(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:], strict=False))


def test_vectors_with_clashing_columns(spark):
    r = random.Random(2)
    vectors = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)] + [(300, [1.0, 2.0]), (400, None), (401, [0.0] * 8), (402, [float("nan")] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("v", "dim", "b", "n", "q", "pack", "rank", "score", "query_id")})
    got = ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    exact = {i: v for i, v in vectors[:200]}
    for q in (0, 100):
        near = sorted((sum((x - y) ** 2 for x, y in zip(exact[q], v, strict=True)) ** 0.5, i) for i, v in exact.items() if i != q)[:10]
        mine = sorted((g.rank, g.vec_id) for g in got if g.query_id == q)
        assert len(mine) == 10 and len({i for _, i in mine} & {i for _, i in near}) >= 9
    assert {g.query_id for g in got} == {0, 100}


def test_pipeline_on_odd_rows_and_an_empty_table(spark, docs):
    made, r = docs, random.Random(5)
    more = [(1000 + i, " ".join(f"v{r.randrange(5000)}" for _ in range(90)), "en", "s") for i in range(60)]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(1).cast("long"))
    made = made.unionByName(extra, allowMissingColumns=True)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = cut(stage(spark, made, ""))
        if k < 4:
            assert made.columns == corpus_pipeline.COLUMNS
        if name == "n-gram Jaccard join":
            assert made.filter("doc_id in (4, 5, 6)").count() <= 1 and made.filter("doc_id >= 1000").count() == 60
    assert made.filter("text is null").count() == 0 if "text" in made.columns else True
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = cut(stage(spark, empty, ""))
    assert empty.count() == 0
