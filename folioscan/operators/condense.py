"""Texts put together for a model: transcripts, capped documents, batches, context blocks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .toplists import top_per

STUFF_BELOW = 200_000
BATCH_CHARS = 15_000


def joined_text(df: DataFrame, keys: list[str], part: Column, order: list[str], text: Column, sep: str) -> DataFrame:
    """One text per key, its pieces in order.

    Sorting and joining run per (key, part), where ``part`` is a coarse step of
    the order; the last aggregate only strings finished parts together.
    """
    parts = df.groupBy(*keys, part.alias("_part")).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_t")))), lambda s: s["_t"]), sep
        ).alias("_text"),
        F.count("*").alias("_n"),
    )
    return parts.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_part", "_text"))), lambda s: s["_text"]), sep)
        .alias("text"),
        F.sum("_n").alias("n_pieces"),
    )


def transcripts(messages: DataFrame, part: Column) -> DataFrame:
    """Whole conversation as ``User:``/``Assistant:`` lines."""
    label = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    line = F.concat(label, F.lit(": "), F.col("content"))
    return joined_text(messages, ["conversation_id", "user_id"], part, ["created_ms", "id"], line, "\n")


def assistant_text(messages: DataFrame, part: Column) -> DataFrame:
    only = messages.where(F.col("role") == "assistant")
    return joined_text(only, ["conversation_id", "user_id"], part, ["created_ms", "id"], F.col("content"), "\n\n")


def first_chunks(chunks: DataFrame, limit: int | None = None, text_order: bool = False) -> DataFrame:
    """Passages of each document with their place ``nth``; all of them, or the first ``limit``.

    By number; ``text_order`` sorts the index as text ("10" before "2"), as capped
    fetches through a text accessor do.
    """
    index = F.col("chunk_index").cast("string") if text_order else F.col("chunk_index")
    order = [index.asc_nulls_last(), F.col("id").asc()]
    if limit is None:
        return chunks.withColumn("nth", F.row_number().over(Window.partitionBy("document_id").orderBy(*order)).cast("long"))
    return top_per(chunks, ["document_id"], order, limit, "nth")


def document_text(chunks: DataFrame, limit: int | None = None, text_order: bool = False) -> DataFrame:
    """All passages of each document (or the first ``limit``) joined by a blank line, in parts of 1,024 passages."""
    placed = first_chunks(chunks, limit, text_order)
    whole = joined_text(placed, ["document_id"], F.floor(F.col("nth") / 1024), ["nth"], F.col("content"), "\n\n")
    chars = (F.length("text") - 2 * (F.col("n_pieces") - 1)).cast("long")
    return whole.select("document_id", "text", F.col("n_pieces").alias("n_chunks"), chars.alias("total_chars"))


def strategy(total_chars: Column, threshold: int = STUFF_BELOW) -> Column:
    return F.when(total_chars < threshold, "stuff").otherwise("map_reduce")


def next_batches(lengths: list[int], max_chars: int, batch: int = 0, size: int = 0) -> tuple[list[int], int, int]:
    """Batch number of each piece, packed in order, from an open (batch, size) on; a too long piece is a batch of its own."""
    out = []
    for length in lengths:
        if not batch or size and size + length > max_chars:
            batch, size = batch + 1, 0
        size += length
        out.append(batch)
    return out, batch, size


def greedy_batches(chunks: DataFrame, limit: int | None = None, max_chars: int = BATCH_CHARS) -> DataFrame:
    """(document_id, nth, id, content, batch) of all passages.

    The passages of a document stream through one task in order; only the open batch and its
    size are carried, so a document may have any number of them.
    """
    placed = first_chunks(chunks, limit).select("document_id", "nth", "id", "content").withColumn("_n", F.length("content"))

    def run(batches):
        document, batch, size = None, 0, 0
        for part in batches:
            owners, lengths = part.column(0).to_pylist(), [n or 0 for n in part.column(4).to_pylist()]
            numbers: list[int] = []
            at = 0
            while at < len(owners):
                stop = at
                while stop < len(owners) and owners[stop] == owners[at]:
                    stop += 1
                if owners[at] != document:
                    document, batch, size = owners[at], 0, 0
                made, batch, size = next_batches(lengths[at:stop], max_chars, batch, size)
                numbers += made
                at = stop
            yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(numbers, pa.int64())], names=[*part.schema.names[:4], "batch"])

    schema = T.StructType([*placed.schema.fields[:4], T.StructField("batch", T.LongType())])
    return placed.repartition("document_id").sortWithinPartitions("document_id", "nth").mapInArrow(run, schema)


def map_inputs(batched: DataFrame, documents: DataFrame) -> DataFrame:
    """One model input per batch: ``Excerpt i/n from file`` and the batch text."""
    body = batched.groupBy("document_id", "batch").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda s: s["content"]),
                     "\n\n").alias("body"),
        F.count("*").alias("n_chunks"),
    )
    of = F.max("batch").over(Window.partitionBy("document_id"))
    named = body.withColumn("n_batches", of).join(
        documents.select(F.col("id").alias("document_id"), "filename"), "document_id"
    )
    head = F.concat(F.lit("Excerpt "), F.col("batch"), F.lit("/"), F.col("n_batches"), F.lit(" from "),
                    F.col("filename"), F.lit(":\n\n"))
    return named.select("document_id", "batch", "n_batches", "n_chunks", F.concat(head, F.col("body")).alias("input"))


def reduce_input(partials: DataFrame) -> DataFrame:
    """``Part i:`` texts of the partial results, one row per document (bounded by the batch count)."""
    part = F.concat(F.lit("Part "), F.col("batch"), F.lit(": "), F.col("partial"))
    return partials.groupBy("document_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("batch", part.alias("t")))), lambda s: s["t"]), "\n\n"
        ).alias("input")
    )


def _chunk_lines(number: Column) -> Column:
    section = F.when(
        F.coalesce(F.col("heading"), F.lit("")) != "", F.concat(F.lit(" | Section: "), F.col("heading"))
    ).otherwise("")
    return F.concat(
        F.lit("[Chunk "), number, F.lit(" - Page "), F.coalesce(F.col("page_number").cast("string"), F.lit("?")),
        section, F.lit("]\n"), F.col("content"),
    )


def context_block(selected: DataFrame) -> DataFrame:
    """Selected passages of a question under one title per file, numbered through.

    Files come in the order in which they first appear. Lists are the picks of
    one question, at most a dozen rows.
    """
    per_question = Window.partitionBy("query_id")
    file = F.coalesce(F.col("filename"), F.lit("document"))
    rows = (
        selected.withColumn("_file", file)
        .withColumn("_first", F.min("pick").over(Window.partitionBy("query_id", "_file")))
        .withColumn("_no", F.row_number().over(per_question.orderBy("_first", "pick")))
    )
    title = F.when(
        F.col("pick") == F.col("_first"), F.concat(F.lit("=== Document: "), F.col("_file"), F.lit(" ===\n\n"))
    ).otherwise("")
    rows = rows.withColumn("_text", F.concat(title, _chunk_lines(F.col("_no"))))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_no", "_text"))), lambda s: s["_text"]), "\n\n")
        .alias("context"),
        F.count("*").alias("n_chunks"),
        F.count_distinct("_file").alias("n_files"),
    ).withColumn("multi_document", F.col("n_files") > 1)


def context_flat(selected: DataFrame) -> DataFrame:
    """The same passages in selection order, without titles."""
    rows = selected.withColumn("_text", _chunk_lines(F.col("pick")))
    return rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pick", "_text"))), lambda s: s["_text"]), "\n\n")
        .alias("context"),
        F.count("*").alias("n_chunks"),
    )
