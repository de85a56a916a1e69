"""Registered queries of the pipeline operators: each runs one over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, host_text, middle, odd_sketch, passages, perspectives, pieces, repetition, secrets, simhash, token_files, toxicity, variants
from .common import table

WORD_MODEL = "word_bpe_49k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def op1_patched_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_MODEL))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives.digest(table(spark, sf_dir, "conversations"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.digest(table(spark, sf_dir, "documents"))


def op5_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op6_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op7_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_text.digest(table(spark, sf_dir, "pages"))


def op8_piece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op9_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.digest(table(spark, sf_dir, "documents"))


def op10_prefix_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_tiled_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.digest(table(spark, sf_dir, "documents"))


def op12_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.digest(table(spark, sf_dir, "documents"))


def op13_chunk_memo_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_patched_tokens, op2_perspectives, op3_toxicity, op4_suffix_repeats, op5_pivot_simhash, op6_randomness_secrets, op7_host_paths,
        op8_piece_scan, op9_chained_passages, op10_prefix_windows, op11_tiled_variants,
        op12_odd_sketches, op13_chunk_memo_fim,
    )
}
ORACLES: dict[str, str] = {"op2_perspectives": perspectives.ORACLE, "op12_odd_sketches": odd_sketch.ORACLE, "op13_chunk_memo_fim": middle.ORACLE}
