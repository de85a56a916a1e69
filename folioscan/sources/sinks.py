"""Writers. Logs are appended; what holds now is a latest-row view of the log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.embedding import BATCH
from ..operators.conversations import evidence_of
from ..operators.toplists import best_row
from .keyed import KeyedTable
from .tables import BUCKETS_FOLDER, USER_BUCKETS, VECTORS_FOLDER, read_chunks, stored_buckets, user_bucket


def append_chunks(passages: DataFrame, path: str, buckets: int = USER_BUCKETS) -> None:
    """Append passages without vectors, one directory per user bucket.

    The rows are rebalanced by bucket: Spark joins small pieces and splits those
    of a user with very many passages, so files have an even size. Inside a file
    rows are sorted by user and document, which lets either filter skip row groups. The
    bucket count is kept with the store; another one is refused.
    """
    spark = passages.sparkSession
    stored = stored_buckets(spark, path)
    if stored is None:
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/{BUCKETS_FOLDER}")
    elif stored != buckets:
        raise ValueError(f"the store has {stored} user buckets, not {buckets}")
    rows = passages.withColumn("bucket", user_bucket(F.col("user_id"), buckets))
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    even = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "user_id", "document_id")
    even.write.mode("append").partitionBy("bucket").parquet(path)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append computed vectors (id, user_id, embedding) next to a passage store, in the same buckets."""
    buckets = stored_buckets(vectors.sparkSession, path)
    if buckets is None:
        raise ValueError(f"no passage store at {path}")
    rows = vectors.select("id", "user_id", "embedding", F.unix_millis(F.current_timestamp()).alias("written_ms")).withColumn("bucket", user_bucket(F.col("user_id"), buckets))
    rows.hint("rebalance", F.col("bucket")).write.mode("append").partitionBy("bucket").parquet(f"{path}/{VECTORS_FOLDER}")


def embed_stored(spark: SparkSession, path: str, embed: Callable) -> None:
    """Compute and store the vectors of the stored passages that have none yet; each text is embedded once."""
    chunks = read_chunks(spark, path)
    lacking = chunks.where(F.col("embedding").isNull())
    owners = lacking.select("id", "document_id", "user_id", "content")
    kinds = ", ".join(f"{c} {owners.schema[c].dataType.simpleString()}" for c in ("id", "user_id"))

    def run(parts):
        for part in parts:
            for at in range(0, len(part), BATCH):
                few = part.iloc[at : at + BATCH]
                yield few[["id", "user_id"]].assign(embedding=list(map(list, embed(few["content"].tolist()))))

    append_vectors(owners.mapInPandas(run, f"{kinds}, embedding array<float>"), path)


def current_status(log: DataFrame) -> DataFrame:
    """Newest status row of every document; ties go to the later sequence number."""
    return best_row(log, ["document_id"], F.struct("written_ms", "seq"))


def current_summaries(log: DataFrame) -> DataFrame:
    """One summary per source, the newest; the unused id of a source is NULL and counts as equal."""
    keys = ["user_id", "source_type", "conversation_id", "document_id"]
    return best_row(log, keys, F.struct("created_ms", "id"))


def current_results(log: DataFrame) -> DataFrame:
    """Newest result row of every job."""
    return best_row(log, ["job_id"], F.struct("written_ms", "seq"))


def status_table(spark: SparkSession, path: str) -> KeyedTable:
    """Status of every document: document_id, status, written_ms, seq."""
    return KeyedTable(spark, path, ("document_id",), ("written_ms", "seq"))


def summary_table(spark: SparkSession, path: str) -> KeyedTable:
    """One summary per source; the unused id of a source is NULL."""
    return KeyedTable(spark, path, ("user_id", "source_type", "conversation_id", "document_id"), ("created_ms", "id"))


def result_table(spark: SparkSession, path: str) -> KeyedTable:
    """Result of every job: job_id, status, written_ms, seq."""
    return KeyedTable(spark, path, ("job_id",), ("written_ms", "seq"))


def message_table(spark: SparkSession, path: str) -> KeyedTable:
    """Messages, each once; they lie with their conversation."""
    return KeyedTable(spark, path, ("conversation_id", "role", "created_ms"), by=("conversation_id",))


def conversation_tables(spark: SparkSession, path: str) -> tuple[KeyedTable, KeyedTable]:
    """(conversations, their links to documents)."""
    links = KeyedTable(spark, f"{path}/links", ("conversation_id", "document_id"), by=("conversation_id",))
    return KeyedTable(spark, f"{path}/conversations", ("id",), ("updated_ms",)), links


def message_rows(exchanges: DataFrame) -> DataFrame:
    """User and assistant row of each exchange; evidence is kept without vectors.

    ``exchanges``: conversation_id, user_id, question, answer, retrieved, asked_ms.
    """
    none = F.lit(None)
    evidence = evidence_of(F.col("retrieved"))
    user = F.struct(
        F.lit("user").alias("role"), F.col("question").alias("content"),
        F.when(F.lit(False), evidence).alias("retrieved_chunks"), F.col("asked_ms").alias("created_ms"),
    )
    assistant = F.struct(
        F.lit("assistant").alias("role"), F.col("answer").alias("content"), evidence.alias("retrieved_chunks"),
        (F.col("asked_ms") + 1).alias("created_ms"),
    )
    rows = exchanges.select("conversation_id", "user_id", F.explode(F.array(user, assistant)).alias("_m"))
    return rows.select(
        "conversation_id", "user_id", "_m.role", "_m.content", "_m.retrieved_chunks", "_m.created_ms",
        none.cast("string").alias("voice_url"), F.lit(False).alias("voice_used"),
    )


def conversation_rows(requests: DataFrame, title: Column) -> tuple[DataFrame, DataFrame]:
    """(conversation rows, one link row per selected document).

    The first selected document is also kept as the legacy document of the conversation.
    """
    made = requests.select(
        F.col("conversation_id").alias("id"), "user_id", title.alias("title"),
        F.get("document_ids", 0).alias("document_id"), F.col("created_ms"), F.col("created_ms").alias("updated_ms"),
    )
    links = requests.select(
        "conversation_id", F.posexplode("document_ids").alias("position", "document_id"), "created_ms"
    ).select("conversation_id", "document_id", F.col("position").cast("long"), F.col("created_ms").alias("added_ms"))
    return made, links
