"""Running a stream over everything that is available, into a table of the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ROCKSDB_PROVIDER, fresh_path


def stream_of(spark: SparkSession, folder: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """File stream of Parquet rows."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def use_rocksdb(spark: SparkSession) -> None:
    """State beyond memory: keyed processors keep theirs in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


def appended(stream: DataFrame, label: str) -> DataFrame:
    """Drain an append stream into a file sink, which records each file once, and read it."""
    spark = stream.sparkSession
    path = fresh_path(spark, label)
    running = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", fresh_path(spark, label + "-state")).trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def by_batch(stream: DataFrame, label: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Drain a stream batch by batch. ``write`` must give the same result when a batch is replayed."""
    spark = stream.sparkSession
    running = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", fresh_path(spark, label + "-state")).trigger(availableNow=True).start()
    )
    running.awaitTermination()


def batch_folder(root: str, batch: int) -> str:
    """Folder of one batch; overwritten as a whole when the batch is replayed."""
    return f"{root}/batch={batch}"
