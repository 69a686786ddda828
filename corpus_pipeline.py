"""A training corpus from `documents`: five stages, each over all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, to be written and read again as the next one's docs. An
empty table goes through all of them empty; columns beside doc_id, text and source are kept by all but the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, mixing, ngram_join, quality_rules, toxicity
from scriptorium.llm.common import cut, load
from scriptorium.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject; null texts are judged as empty ones, repeated rows alike.

    Without usable labels all texts get one score, that of the rate of toxic labels with one of each kind added."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep all quality rules: never null, empty or blank ones; very long texts are measured whole."""
    return quality_rules.keep(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id; texts without words are groups of their own.

    Rows of one id, or without one, are told apart by their texts."""
    return ngram_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them; a null source is a source, rows of one id draw alike,
    texts without words aren't taken."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, token ids as little-endian unsigned 32-bit integers, their number, and the decoded bytes' digest.

    Null and empty texts have no ids; repeated rows stay repeated."""
    back = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary(), public_tokenizers.PATTERN)
    return back.select("doc_id", "source", "ids", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("n-gram Jaccard join", one_of_each), ("mixing", mix), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the checkpoint folder before the next reads it.

    Rows: one for each time that the mix takes a document; none for an empty table."""
    docs = load(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The toxicity classifier and near duplicates are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
