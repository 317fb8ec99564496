"""Tokens, chat, quality, mixing and toxicity."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pluvio.llm import bpe, chat_format, mixing, quality_rules, toxicity, unigram_counts
from pluvio.llm.queries import vocabulary
from tests.llm import brute

ODD = [None, "", " ", "\n\n", "don't 's'sand '", "aaaaaaa  aaaa", "x<|endoftext|><|endoftext|> y", "<|endoftext", "日本 é ½²", "\U0001f600͸​", "a" * 5000, " 　 x"]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(1)
    made = ["".join(r.choice("ab's'ret'lld  \n\t1²é日!.  x") for _ in range(r.randrange(40))) for _ in range(500)]
    return ODD + made


def test_bpe_is_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, x in enumerate(texts):
        want = t.encode(x or "", add_special_tokens=False).ids
        assert list(got[i].ids) == want
        assert got[i].decoded == (x or "")
    digests = {r.doc_id: r for r in bpe.round_trip(docs, path).collect()}
    for i, x in enumerate(texts):
        assert digests[i].ids_sha256 == brute.sha(",".join(map(str, got[i].ids))) and digests[i].n_tokens == len(got[i].ids)
        assert digests[i].decoded_sha256 == brute.sha(x or "")
    assert bpe.round_trip(docs.limit(0), path).count() == 0


def test_unigram_counts(spark, texts):
    scores = unigram_counts.sentencepiece_scores(vocabulary("piece_bpe_32k.model"))

    def tokens(word):
        w = "▁" + word
        best = [(0.0, 0)]
        for d in range(1, len(w) + 1):
            size = len(w[d - 1].encode())
            found = [(best[d - 1][0] + unigram_counts.BYTE_SCORE * size, best[d - 1][1] - size)]
            found += [(best[b][0] + scores[w[b:d]], best[b][1] - 1) for b in range(max(0, d - 16), d) if w[b:d] in scores]
            best.append(max(found))
        return -best[-1][1]

    some = [t for t in texts if t is None or len(t) < 1000]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in unigram_counts.count_tokens(docs, scores).collect()}
    assert got == {i: (len(brute.words(t)), sum(map(tokens, brute.words(t)))) for i, t in enumerate(some)}
    assert unigram_counts.count_tokens(docs.limit(0), scores).count() == 0


CONTROL = [*chat_format.CONTROL, "\\", "[", "<", "INST]", "\\N", "s>", "a", "\n", "<<", "|>"]


def test_chat_grammar_round_trip():
    r = random.Random(3)
    roles = ["user", "assistant", "system", None, "tool", "\\N", "\\\\N", "", "[INST]"]
    for _ in range(3000):
        turns = [(r.choice(roles), "".join(r.choice(CONTROL) for _ in range(r.randrange(8)))) for _ in range(r.randrange(5))]
        assert chat_format.parse("".join(chat_format.render(turns))) == turns
    assert chat_format.parse("[INST]open") is None and chat_format.parse("loose") is None


def test_chat_digests(spark):
    rows = [(1, 2, "assistant", "b</s>"), (1, 1, "user", None), (1, None, "system", "s"), (1, 3, "assistant", ""), (2, 1, None, "x"), (2, 1, None, "x"), (None, 1, "assistant", "é")]
    df = spark.createDataFrame([(*x, 0) for x in rows], "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat_format.digests(df).collect()}
    assert got[1].turns_sha256 == brute.sha("system\ns\nuser\n\nassistant\nb</s>\nassistant\n\n") and got[1].n_turns == 4
    assert got[1].loss_sha256 == brute.sha("b</s>") and got[1].loss_chars == 5
    assert got[2].n_turns == 2 and got[2].loss_chars == 0 and got[None].loss_chars == 1
    joined = "".join(r.formatted for r in chat_format.format_turns(df).filter("conv_id = 1").collect())
    assert len(joined) == got[1].formatted_chars
    assert chat_format.digests(df.limit(0)).count() == 0


def test_quality_statistics(spark, texts):
    r = random.Random(2)
    made = ["\n".join(" ".join(r.choice(["a", "b", "c#", "d"]) for _ in range(r.randrange(12))) for _ in range(r.randrange(9))) for _ in range(100)]
    every = texts + made
    docs = spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", "s") for i, t in enumerate(every)], "doc_id long, text string, lang string, source string")
    got = quality_rules.judge(docs)
    have = {x.doc_id: (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got.collect()}
    assert have == {i: brute.quality(t) for i, t in enumerate(every)}
    assert got.filter("base_failed and kept").count() == 0
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_quality_limits_follow_the_group(spark):
    r = random.Random(4)
    clean = [(i, " ".join(f"w{r.randrange(4000)}" for _ in range(120)), "en", "s") for i in range(200)]
    bad = [(900, " ".join(f"w{i} ###" for i in range(100)), "en", "s")]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert not got.pop(900) and all(got.values())


def test_sources_judge_by_their_own_distribution(spark):
    r = random.Random(5)

    def text(n, marks, copies=0):
        made = [f"w{r.randrange(4000)}" for _ in range(n - 3 * copies)] + ["same", "three", "words"] * copies
        return " ".join(w + "#" * (i < marks) for i, w in enumerate(made))

    rows = [(i, text(200, 0), "en", "plain") for i in range(200)]
    rows += [(1000 + i, text(200, r.randrange(20), r.randrange(8)), "en", "marked") for i in range(200)]
    rows += [(3000 + i, text(200, 200), "en", "marked") for i in range(20)]  # a bulk of junk doesn't move the fence
    symbols, repeats = text(200, 14), text(200, 0, 7)
    rows += [(n + i, x, "en", s) for n, x in ((5000, symbols), (6000, repeats)) for i, s in enumerate(("plain", "marked"))]
    got = {x.doc_id: x.kept for x in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i] for i in (5000, 5001, 6000, 6001)] == [False, True, False, True]
    assert all(got[i] for i in range(200)) and all(got[1000 + i] for i in range(200)) and not any(got[3000 + i] for i in range(20))


def _exact_fences(values, floor, limits):
    """The fences by exact quantiles; None where a step is so near its bound that the sketch may take it otherwise."""
    at = [sorted(values)[max(math.ceil(round(q * len(values), 9)), 1) - 1] for q in (0.5, *limits.ranks, *(1 - q for q in limits.ranks))]
    middle, n = at[0], len(limits.ranks)
    reach = [floor, floor]
    for side, found in enumerate(([middle - x for x in at[n + 1 :]], [x - middle for x in at[1 : n + 1]])):
        for d in found:
            if d > reach[side] and abs(d - limits.spread * reach[side]) <= 4 * limits.accuracy * (middle + d):
                return None
            if reach[side] < d <= limits.spread * reach[side]:
                reach[side] = d
    return middle - limits.spread * reach[0], middle + limits.spread * reach[1]


def test_kept_follows_exact_quantiles(spark, sf_dir):
    """Every document away from a fence by more than the sketch can err is judged as with exact quantiles."""
    limits = quality_rules.QualityLimits()
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    rows = quality_rules.judge(docs, carry=["doc_id", "lang", "source"]).collect()
    assert sorted((r.doc_id, r.kept) for r in quality_rules.judge(docs.repartition(7)).select("doc_id", "kept").collect()) == sorted((r.doc_id, r.kept) for r in rows)

    def metrics(r):
        n = max(r.n_words, 1)
        return r.n_symbols / n, r.n_dup_lines / n, r.n_repeat_words / n, r.word_chars / n

    by_group, by_lang, checked = {}, {}, 0
    for r in rows:
        if not r.base_failed:
            by_group.setdefault((r.lang, r.source), []).append(metrics(r))
            by_lang.setdefault(r.lang, []).append(metrics(r))
    fences = {}
    for (lang, source), own in by_group.items():
        used = own if len(own) >= limits.min_group else by_lang[lang]
        fences[lang, source] = [_exact_fences([v[i] for v in used], limits.floor[i], limits) for i in range(4)]
    for r in rows:
        if r.base_failed:
            assert not r.kept
            continue
        edges = fences[r.lang, r.source]
        if all(pair and all(abs(v - e) > 8 * limits.accuracy * (abs(e) + v) for e in pair) for v, pair in zip(metrics(r), edges, strict=True)):
            checked += 1
            assert r.kept == all(low <= v <= high for v, (low, high) in zip(metrics(r), edges, strict=True)), (r, edges)
    assert checked > 0.5 * sum(not r.base_failed for r in rows)


def test_mixing_meets_its_rates(spark):
    rows = [(i, "x" * 100, "big" if i % 10 else None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copy", F.lit("clash"))
    got = {r.source: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert got["big"] == pytest.approx(3000, abs=250) and got[None] == pytest.approx(1000, abs=150)
    given = mixing.mix(docs, weights={"big": 1.0}, size=2.0)
    assert given.filter("source is null").count() == 0 and given.count() == pytest.approx(8000, abs=400)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_poisson_of_a_small_source_is_not_capped(spark):
    rows = [(i, "x" * 1000, "big") for i in range(500)] + [(1000, "y", "small"), (None, None, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    n = mixing.copies(docs, weights={"big": 0.5, "small": 0.5}).filter("doc_id = 1000").first().n_copies
    assert n == pytest.approx(125_000, rel=0.05)


def test_toxicity_finds_held_out(spark):
    r = random.Random(6)
    vocabulary = [f"word{i}" for i in range(800)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(60)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(["zonkard", "zonkulous", "blarg"])
        rows.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == (i % 8 == 0) for i in held) / len(held) > 0.97
    assert got[5000].predicted == 0 and got[5000].score == got[5001].score
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {x.score for x in toxicity.score(docs, nothing).collect()} == {0.0}


def test_rows_that_repeat_an_id_are_sampled_once(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(300)] + [(None, "x")] * 50 + [(7, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in toxicity.once(docs.filter("doc_id is not null")).collect()) == [(0, "text 0"), (1, "text 1"), (2, "text 101"), (7, None)]


def test_an_output_that_does_not_parse_is_an_error():
    with pytest.raises(ValueError, match="turns"):
        chat_format._Digest(1).take("no turn at all")
