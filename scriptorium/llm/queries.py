"""The registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import byte_bpe, chat_format, fill_middle, lm_scoring, mixing, ngram_join, quality_rules, site_quality, token_alignment, toxicity, url_filter, vector_dedup, vector_search
from scriptorium.llm.common import cut, load
from scriptorium.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: The vocabulary file of the production encoder.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def vocabulary() -> dict[bytes, int]:
    return byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))


def aligned_files() -> tuple[str, bytes, str]:
    """The contents of both tokenizers' files, and the first one's pattern."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return a.read(), b.read(), public_tokenizers.PATTERN


@query
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(load(spark, sf_dir, "documents"))


@query
def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(load(spark, sf_dir, "documents"), vocabulary(), public_tokenizers.PATTERN)


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.measure(load(spark, sf_dir, "documents"))
    return measured.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(load(spark, sf_dir, "documents"))
    return planned.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(load(spark, sf_dir, "pages"))
    return judged.select(F.col("row.page_id").alias("page_id"), "host", "path", "rule", "verdict", "trust", "distrust")


@query
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("select -1L as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role), '</s>[INST] ok [/INST]' as text")
    return chat_format.digests(chat_format.chat(rows.unionByName(own)))


@query
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(load(spark, sf_dir, "documents"))


@query
def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = cut(vector_search.pivot_table(load(spark, sf_dir, "embeddings")))
    return vector_search.search(table, F.col("vec_id") % 100 == 0)


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_ids(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@query
def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))
    return found.select(F.col("row.vec_id").alias("vec_id"), "n_links", "component_id", "kept")


@query
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(load(spark, sf_dir, "documents"))


@query
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.measure(load(spark, sf_dir, "documents"), *aligned_files())
