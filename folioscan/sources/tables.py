"""Readers of stored tables and queued messages; batch and stream share the decoders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.keys import object_key_parts

MAX_UPLOAD_BYTES = 50 * 1024 * 1024
USER_BUCKETS = 64
VECTORS_FOLDER = "_vectors"
BUCKETS_FOLDER = "_buckets"  # readers of the store skip names that begin with an underscore


def user_bucket(user_id: Column, buckets: int = USER_BUCKETS) -> Column:
    """Partition value of a user; a literal user prunes the scan to one directory."""
    return F.pmod(F.xxhash64(user_id), F.lit(buckets)).cast("int")


def decoded_uploads(raw: DataFrame, body: str = "body") -> DataFrame:
    """Object-created notifications, plain or wrapped in an outer message: one row per record.

    A message without records keeps one row, with nulls. The key is URL-decoded; its parts name the user, the document and the file.
    """
    outer = F.from_json(F.col(body), schemas.UPLOAD_EVENT)
    inner = F.from_json(outer["Message"], schemas.UPLOAD_EVENT)
    record = F.coalesce(inner["Records"], outer["Records"])
    rows = raw.withColumn("_r", F.explode_outer(record)).withColumn("_o", F.col("_r.s3")).drop("_r").withColumn("object_key", F.url_decode(F.col("_o.object.key")))
    parts = object_key_parts(F.col("object_key"))
    return rows.withColumn("bucket", F.col("_o.bucket.name")).withColumns(parts).drop("_o")


def decoded_embed_jobs(raw: DataFrame, body: str = "body") -> DataFrame:
    """Embedding messages; a message without a type is an embed job."""
    job = F.from_json(F.col(body), schemas.EMBED_MESSAGE)
    rows = raw.withColumn("_j", job)
    return rows.select(
        *raw.columns, F.coalesce("_j.message_type", F.lit("embed")).alias("message_type"),
        F.col("_j.document_id").alias("document_id"),
        F.coalesce("_j.chunk_ids", F.array().cast("array<string>")).alias("chunk_ids"),
        F.coalesce("_j.batch_num", F.lit(0)).alias("batch_num"),
    )


def split_by_type(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(embed jobs, finalize jobs)."""
    return jobs.where(F.col("message_type") != "finalize"), jobs.where(F.col("message_type") == "finalize")


def decoded_query_jobs(raw: DataFrame, body: str = "body") -> DataFrame:
    """Question messages with their defaults filled in."""
    rows = raw.withColumn("_j", F.from_json(F.col(body), schemas.QUERY_JOB))
    return rows.select(
        *raw.columns, "_j.job_id", "_j.query", "_j.user_id", "_j.conversation_id",
        F.coalesce("_j.voice_mode", F.lit(False)).alias("voice_mode"),
        F.coalesce("_j.response_style", F.lit("explanatory")).alias("response_style"),
        F.coalesce("_j.document_ids", F.array().cast("array<string>")).alias("document_ids"),
    )


def stored_buckets(spark: SparkSession, path: str) -> int | None:
    """Bucket count of a passage store, None where nothing is stored yet or it was stored without."""
    try:
        row = spark.read.schema("buckets int").parquet(f"{path}/{BUCKETS_FOLDER}").first()
    except AnalysisException:
        return None
    return row.buckets if row else None


def _stored_vectors(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{VECTORS_FOLDER}")
    except AnalysisException:
        return None


def read_chunks(spark: SparkSession, path: str, user_id=None, document_ids=None, vectors: bool = True) -> DataFrame:
    """Stored passages. User and documents prune directories and reach the scan as filters.

    Vectors that were written back later are put in, the newest of a passage. The bucket count is the one that was stored with the passages; a store without it is
    filtered by user alone. Without ``vectors`` only those stored with the passages are there, and nothing is joined.
    """
    chunks = spark.read.parquet(path)
    buckets = stored_buckets(spark, path)
    written = _stored_vectors(spark, path) if vectors else None
    if written is not None:
        later = written.groupBy("bucket", "id").agg(F.max_by("embedding", F.struct("written_ms", F.xxhash64("embedding"))).alias("_later"))
        chunks = chunks.join(later, ["bucket", "id"], "left").withColumn("embedding", F.coalesce("embedding", "_later")).drop("_later")
    if user_id is not None:
        value = F.lit(user_id).cast(chunks.schema["user_id"].dataType)
        chunks = chunks.where(F.col("user_id") == value)
        if buckets is not None:
            chunks = chunks.where(F.col("bucket") == user_bucket(value, buckets))
    if document_ids is not None:
        chunks = chunks.where(F.col("document_id").isin(*document_ids))
    return chunks.drop("bucket")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PAGES).parquet(path)


def uploaded_files(spark: SparkSession, path: str, max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) files below a folder, listed without reading their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return checked_files(files.select("path", "length", "modificationTime"), max_bytes)


def checked_files(files: DataFrame, max_bytes: int = MAX_UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """Split a listing (path, length) into PDFs of acceptable size and the rest, with the reason."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "not a PDF").when(F.col("length") > max_bytes, "too large")
    rows = files.withColumn("reject_reason", reason)
    return rows.where(F.col("reject_reason").isNull()), rows.where(F.col("reject_reason").isNotNull())
