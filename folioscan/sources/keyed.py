"""Tables with one row per key, changed by upserts and deletes that rewrite only the buckets they touch.

Rows lie in directories by bucket, a hash of the columns ``by``. A change reads the touched buckets and puts
what they hold afterwards in their place by a dynamic partition overwrite, which moves its files there once all are
written; other buckets are not read or written. New rows are shuffled once, to their bucket; stored rows lie in
theirs and meet only the keys of a change. The newest row of a key wins by ``order`` whatever order
batches arrive in, so a batch that is written again changes nothing. A rewritten bucket keeps
one row without content, so that a bucket whose last row goes is overwritten as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.toplists import best_row
from ..session import write_table
from ..sizing import fits, join_sized

BUCKETS = 16
PARTS = 8  # tasks and files of a bucket in one change
LIVE = "_live"


@dataclass(frozen=True)
class KeyedTable:
    """A stored table: ``keys`` name a row (NULL equals NULL), ``order`` tells the newer of two, ``by`` (default: keys) deals out buckets."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    buckets: int = BUCKETS

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(self.by or self.keys)), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).where(LIVE).drop("bucket", LIVE)

    def _put(self, rows: DataFrame, touched: list[int]) -> None:
        """``rows`` (with their bucket, and near others of it) become all that the touched buckets hold."""
        empty = self.spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1)
        held = rows.withColumn(LIVE, F.lit(True)).unionByName(empty.withColumn(LIVE, F.lit(False)), allowMissingColumns=True)
        held.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path)

    def _newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, dealt by bucket in ``PARTS`` parts; the aggregate needs no other shuffle."""
        order = F.struct(*self.order) if self.order else F.lit(0)
        dealt = rows.withColumn("bucket", self._bucket()).withColumn("_part", F.pmod(F.hash(*self.keys), F.lit(PARTS)))
        return best_row(dealt.repartition("bucket", "_part"), [*self.keys, "bucket", "_part"], order).drop("_part")

    def _without(self, rows: DataFrame, keys: DataFrame, newer: bool) -> DataFrame:
        """``rows`` but those whose key ``keys`` has with a later (``newer``) row, or with one as late."""
        there = keys.select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.struct(*self.order, F.lit(0)).alias("_order"))
        own = F.struct(*self.order, F.lit(0))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in self.keys]
        later = F.col("_order") > own if newer else F.col("_order") >= own
        return rows.join(F.broadcast(there) if fits(there) else there, [*same, later], "left_anti")

    def upsert(self, rows: DataFrame) -> None:
        """Insert rows, or replace those with the same key that are not newer. The touched buckets are never more than the table has."""
        stored = self._stored()
        if stored is None:
            self._put(self._newest(rows), list(range(self.buckets)))
            return
        batch = write_table(self._newest(rows), "upserted-rows")
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]
        if touched:
            held = stored.where(F.col("bucket").isin(touched) & F.col(LIVE)).drop(LIVE)
            kept = self._without(held, batch, False)  # of equally new rows the one that comes later
            self._put(kept.unionByName(self._without(batch, held, True)), touched)

    def delete(self, gone: DataFrame) -> None:
        """Delete the rows that agree with a row of ``gone`` in all of its columns."""
        stored = self._stored()
        if stored is None:
            return
        lost = write_table(gone.distinct(), "deleted-keys")
        touched = [r[0] for r in stored.where(LIVE).join(lost, lost.columns, "left_semi").select("bucket").distinct().collect()]
        if touched:
            held = stored.where(F.col("bucket").isin(touched) & F.col(LIVE)).drop(LIVE)
            self._put(join_sized(held, lost, lost.columns, "left_anti"), touched)


def delete_cascade(tables: dict[str, KeyedTable], gone: DataFrame) -> None:
    """Delete documents (id) and everything that hangs on them, children first, so that a broken run can be repeated.

    ``tables``: documents, chunks, conversations, conversation_documents, messages, summaries, flashcard_decks, flashcards.
    Conversations go with their legacy document; links, summaries and decks with either side; messages with the conversation; cards with their deck.
    """
    docs = write_table(gone.select(F.col("id").alias("document_id")).distinct(), "gone-documents")
    held = tables["conversations"].read()
    lost = write_table(held.join(docs, "document_id", "left_semi").select(F.col("id").alias("conversation_id")), "gone-conversations")
    decks = tables["flashcard_decks"].read()
    of_either = [decks.join(x, x.columns, "left_semi").select(F.col("id").alias("deck_id")) for x in (docs, lost)]
    tables["flashcards"].delete(of_either[0].unionByName(of_either[1]))
    for name in ("flashcard_decks", "summaries", "conversation_documents"):
        tables[name].delete(docs)
        tables[name].delete(lost)
    tables["messages"].delete(lost)
    tables["conversations"].delete(lost.withColumnRenamed("conversation_id", "id"))
    tables["chunks"].delete(docs)
    tables["documents"].delete(docs.withColumnRenamed("document_id", "id"))
