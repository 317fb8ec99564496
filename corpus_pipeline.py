"""A corpus pipeline of five stages over documents, each Parquet in and Parquet out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents. Stages between two steps are written to the folder that the cluster
shares, so that a lost executor never costs more than the stage at hand.

Defined results: a document whose text is null or empty fails the quality rules and goes; null
``lang`` or ``source`` are groups of their own; of rows that repeat an id or a text one stays, ties
by the least id, and rows without an id stay; a text that the substring stage empties stays, empty, and counts as one character of
its source; columns other than those of documents are dropped; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pluvio.llm import bpe, mixing, ngram_join, quality_rules, substring_dedup
from pluvio.llm.queries import vocabulary
from pluvio.llm.shared import cut, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs).select(COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8 or more."""
    return ngram_join.keep_one(docs).select(COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat elsewhere; ``n_chars`` follows the text."""
    return substring_dedup.remove_repeats(docs).withColumn("n_chars", substring_dedup.length_of("text")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of their sources wants them, shuffled."""
    return mixing.mix(docs).select(COLUMNS)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the number of their tokens and digests of ids and of the decoded text."""
    return bpe.round_trip(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing sources", mixed),
    ("BPE", tokenized),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-level BPE and the components of similarity links are beyond SQL here; tests/llm compares
#: the rows with a brute-force version.
ORACLE_SQL: str | None = None
