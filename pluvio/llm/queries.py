"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvio.llm import ann, bpe, chat_format, hard_negatives, html_wrappers, merkle, mixing, ngram_join, norm_buckets, quality_rules, substring_dedup, toxicity, unigram_counts
from pluvio.llm.shared import read


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract_main_text(read(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scores = unigram_counts.sentencepiece_scores(vocabulary("piece_bpe_32k.model"))
    return unigram_counts.count_tokens(docs, scores).drop("text")


#: A conversation whose texts hold control strings.
CONTROL_CONVERSATION = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(rows.union(spark.createDataFrame(CONTROL_CONVERSATION, "conv_id long, turn long, role string, text string")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return ngram_join.link_components(docs, k=4, percent=85).select("doc_id", "n_shingles", "component_id")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json")).drop("text")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"), carry=["doc_id", "lang", "source"])
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = substring_dedup.remove_repeats(docs)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


def op12_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm_buckets.top_products(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.documents_manifest(read(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_ann, op2_html, op3_token_counts, op4_chat_format, op5_toxicity, op6_mixing, op7_ngram_join, op8_bpe, op9_quality_rules, op10_substring_dedup, op11_hard_negatives, op12_top_products, op13_merkle)}

ORACLE_SQL: dict[str, str] = {"op6_mixing": mixing.MIX_SQL, "op10_substring_dedup": substring_dedup.REPEATS_SQL, "op11_hard_negatives": hard_negatives.NEGATIVES_SQL, "op12_top_products": norm_buckets.TOP_SQL, "op13_merkle": merkle.MANIFEST_SQL}
