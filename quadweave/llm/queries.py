"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, lines, mixing, near_dups, neighbours, oracles, packing, quality, substrings, token_counts, urls
from ._common import table

#: The vocabulary files' names; their folder is the tokenizer package's.
PACKING_TOKENIZER, COUNTING_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACKING_TOKENIZER))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.drop_lines(docs).select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", "text")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(COUNTING_VOCABULARY))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns; the operator also tells the two distances."""
    return quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"]).drop("chars_distance", "common_distance")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id",))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op10_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_packing, op2_substrings, op3_neighbours, op4_line_dedup, op5_token_counts, op6_quality, op7_chat, op8_mixing, op9_urls, op10_near_dups)}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
