"""Operational reports over documents, passages and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Passages per document, 0 for documents without any."""
    counts = chunks.groupBy(F.col("document_id").alias("id")).agg(F.count("*").alias("chunk_count"))
    return documents.join(counts, "id", "left").withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def embedding_coverage(chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return chunks.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"),
        F.count("embedding").alias("with_embedding"),
        (F.count("*") - F.count("embedding")).alias("missing_embedding"),
    )


def window_stats(attempts: DataFrame) -> DataFrame:
    """Chunk count and status of every page window.

    ``attempts``: document_id, window_no, n_chunks, chunk_error, store_error.
    """
    status = (
        F.when(F.col("chunk_error"), "chunk_failed")
        .when(F.col("n_chunks") == 0, "skipped")
        .when(F.col("store_error"), "failed")
        .otherwise("ok")
    )
    out = attempts.withColumn("status", status)
    return out.withColumn("chunks", F.when(F.col("status") == "ok", F.col("n_chunks")).otherwise(F.lit(0)))


def document_progress(stats: DataFrame) -> DataFrame:
    """Per document: windows, failed windows, stored passages, and its next status."""
    failed = F.col("status").isin("failed", "chunk_failed")
    return stats.groupBy("document_id").agg(
        F.count("*").alias("windows_total"),
        F.count_if(failed).alias("failed_windows"),
        F.sum("chunks").alias("chunk_count"),
    ).withColumn("status", F.when(F.col("failed_windows") == 0, "indexing").otherwise("partial"))


def ready_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("user_id").agg(F.count_if(F.col("status") == "ready").alias("ready_documents"))


def has_active(documents: DataFrame) -> DataFrame:
    return documents.groupBy("user_id").agg(
        F.bool_or(F.col("status").isin("processing", "indexing")).alias("has_active")
    )


def job_outcomes(jobs: DataFrame, minutes: int = 5) -> DataFrame:
    """Done and failed jobs per time bin."""
    return jobs.groupBy(F.window("ts", f"{minutes} minutes").alias("w")).agg(
        F.count("*").alias("jobs"),
        F.count_if(F.col("status") == "done").alias("done"),
        F.count_if(F.col("status") != "done").alias("failed"),
    ).select(F.col("w.start").alias("bin_start"), "jobs", "done", "failed")


def slow_jobs(jobs: DataFrame, slower_than_ms: float, limit: int = 20) -> DataFrame:
    """The slowest jobs above a duration; Spark keeps ``limit`` rows per task and merges those."""
    return (
        jobs.where(F.col("duration_ms") > slower_than_ms)
        .orderBy(F.col("duration_ms").desc_nulls_last(), F.col("job_id").asc())
        .limit(limit)
    )


def newest_errors(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return (
        jobs.where(F.col("status") == "error")
        .orderBy(F.col("ts").desc_nulls_last(), F.col("job_id").desc())
        .limit(limit)
    )
