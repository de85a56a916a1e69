"""Model inputs for summaries of documents and conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import condense
from ..operators.scope import ready_documents


def document_inputs(
    documents: DataFrame, chunks: DataFrame, threshold: int = condense.STUFF_BELOW,
    max_chars: int = condense.BATCH_CHARS,
) -> DataFrame:
    """One row per model call: the whole text of small documents, the batches of large ones.

    The batches are rows, so the calls of one document run side by side.
    """
    ready = ready_documents(documents)
    own = chunks.join(ready.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    batched = condense.greedy_batches(own, max_chars=max_chars)
    sizes = batched.groupBy("document_id").agg(F.sum(F.length("content")).alias("total_chars"))
    tagged = batched.join(sizes, "document_id").withColumn(
        "strategy", condense.strategy(F.col("total_chars"), threshold)
    )
    whole = tagged.where(F.col("strategy") == "stuff").withColumn("batch", F.lit(1).cast("long"))
    body = whole.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda s: s["content"]),
                     "\n\n").alias("body"),
        F.count("*").alias("n_chunks"),
    ).join(ready.select(F.col("id").alias("document_id"), "filename"), "document_id")
    one = body.select(
        "document_id", F.lit(1).cast("long").alias("batch"), F.lit(1).cast("long").alias("n_batches"), "n_chunks",
        F.concat(F.lit("Document: "), "filename", F.lit("\n\n"), "body").alias("input"),
        F.lit("stuff").alias("strategy"),
    )
    many = condense.map_inputs(tagged.where(F.col("strategy") == "map_reduce"), ready).withColumn(
        "strategy", F.lit("map_reduce")
    )
    return one.unionByName(many)


def conversation_inputs(messages: DataFrame, part: Column) -> DataFrame:
    return condense.transcripts(messages, part)


def combined_inputs(partials: DataFrame, documents: DataFrame) -> DataFrame:
    """Second-level inputs from the partial results of the batches."""
    joined = condense.reduce_input(partials).join(
        documents.select(F.col("id").alias("document_id"), "filename"), "document_id"
    )
    head = F.concat(F.lit("Document: "), F.col("filename"), F.lit("\n\nPartial summaries:\n\n"))
    return joined.select("document_id", F.concat(head, F.col("input")).alias("input"))


def model_outputs(inputs: DataFrame, answer, batch_rows: int = 32) -> DataFrame:
    """Run a user's callable (list of texts to list of texts) over the inputs, in Arrow batches.

    One row is one model call, so failures are retried by task and nothing passes through the driver.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inputs.schema.fields) + ", output string"

    def run(parts):
        for part in parts:
            texts = part["input"].tolist()
            done = []
            for at in range(0, len(texts), batch_rows):
                done += list(answer(texts[at:at + batch_rows]))
            yield part.assign(output=done)

    return inputs.mapInPandas(run, schema)
