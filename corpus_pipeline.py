"""A training-data pipeline over ``documents``: each stage is one operator, written and read again.

Rejected, near-duplicate and contaminated documents go, secrets are masked in the text, and the
last stage returns the piece ids of what is left. Null and empty texts fail the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscan.llm import decontaminate, pieces, repetition, secrets, simhash
from folioscan.llm.common import column, free_name, table
from folioscan.session import write_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    name = free_name(docs, "_quality")
    return repetition.judged(docs, name).where(column(name)["kept"]).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    name = free_name(docs, "_hits")
    found = decontaminate.hits(docs, table(spark, sf_dir, "benchmark"), name=name)
    return found.where(F.size(column(name)["spans"]) == 0).drop(name)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and ``n_chars`` counted anew."""
    made = secrets.redacted(docs)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids, and whether they decode to the text."""
    return pieces.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_masks),
    ("sentencepiece", piece_ids),
]

#: suffix arrays, links of fingerprints and piece encoding are not SQL; the tests hold run() against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = write_table(docs, "stage-" + name.replace(" ", "-"))
    return docs
