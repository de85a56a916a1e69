"""Stored postings: which passages hold a term, and how often.

The table has one row per (term, passage), in directories by term bucket and sorted by term, user
and document inside a file; beside it lie the figures of each (term, user): passages and the
largest count. A question is met through its rarest term: only that term's postings become
candidates, scope is checked there, and the other terms are looked up for the candidates
alone. Passages themselves are not read, and nothing is exploded but the questions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.stems import stem, stems
from ..functions.terms import terms
from ..session import write_table
from ..sizing import fits, join_sized

TERM_BUCKETS = 16
ROWS, FIGURES, KIND = "rows", "figures", "kind"


def term_bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class Postings:
    """A stored postings table; ``stemmed`` says which kind of term it holds."""

    rows: DataFrame
    figures: DataFrame
    buckets: int
    stemmed: bool


def stemmed_rows(rows: DataFrame) -> DataFrame:
    """Rows with a column ``term``, reduced to stems. Different terms are stemmed once each."""
    known = write_table(rows.select("term").distinct().withColumn("stem", stem(F.col("term"))), "term-stems")
    spread = F.xxhash64(*[c for c in rows.columns if c != "term"])
    return join_sized(rows, known, ["term"], spread=spread).withColumn("term", F.col("stem")).drop("stem")


def count_terms(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """(term, user_id, document_id, id, tf) of passages (id, document_id, user_id, content)."""
    found = chunks.select("user_id", "document_id", "id", F.explode(terms(F.col("content"))).alias("term"))
    keys = ["term", "user_id", "document_id", "id"]
    if stemmed:
        found = stemmed_rows(found)
    return found.groupBy(*keys).agg(F.count("*").alias("tf"))


def write_postings(chunks: DataFrame, path: str, stemmed: bool = True, buckets: int = TERM_BUCKETS) -> None:
    """Store the postings of passages. Files of a bucket have an even size; a frequent term spans several."""
    spark = chunks.sparkSession
    rows = count_terms(chunks, stemmed).withColumn("bucket", term_bucket(F.col("term"), buckets))
    even = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term", "user_id", "document_id")
    even.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{ROWS}")
    per_user = spark.read.parquet(f"{path}/{ROWS}").groupBy("bucket", "term", "user_id").agg(F.count("*").alias("passages"), F.max("tf").alias("most"))
    per_user.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{FIGURES}")
    kind = spark.createDataFrame([(buckets, stemmed)], "buckets int, stemmed boolean")
    kind.coalesce(1).write.mode("overwrite").parquet(f"{path}/{KIND}")


def read_postings(spark: SparkSession, path: str) -> Postings:
    try:
        kind = spark.read.parquet(f"{path}/{KIND}").first()
    except AnalysisException as missing:
        raise ValueError(f"no postings at {path}") from missing
    return Postings(spark.read.parquet(f"{path}/{ROWS}"), spark.read.parquet(f"{path}/{FIGURES}"), kind.buckets, kind.stemmed)


def wanted_terms(queries: DataFrame, store: Postings) -> DataFrame:
    """(query_id, user_id, doc_ids, n_terms, term, bucket): the different terms of each question, of the store's kind."""
    kind = store.rows.schema["document_id"].dataType.simpleString()
    scope = F.col("doc_ids") if "doc_ids" in queries.columns else F.lit(None)
    words = terms(F.col("query_text"))
    asked = queries.select("query_id", "user_id", scope.cast(f"array<{kind}>").alias("doc_ids"), F.array_distinct(stems(words) if store.stemmed else words).alias("terms"))
    each = asked.select("query_id", "user_id", "doc_ids", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    return each.withColumn("bucket", term_bucket(F.col("term"), store.buckets))


def matching(store: Postings, queries: DataFrame) -> DataFrame:
    """(query_id, id, document_id, score) of passages that hold every term of a question; score counts their occurrences.

    Questions without a term match nothing, and so do questions with a term that none of the user's passages has.
    """
    on, spread = ["bucket", "term", "user_id"], F.xxhash64("id")
    # bucket >= 0 holds for all; Spark prunes the store's directories by a side that has a condition
    wanted = wanted_terms(queries, store).where("bucket >= 0")
    known = join_sized(store.figures.select(*on, "passages"), wanted, on)
    own = Window.partitionBy("query_id")
    place = F.row_number().over(own.orderBy("passages", "term"))
    live = known.withColumn("known", F.count("*").over(own)).withColumn("first", place == 1).where("known = n_terms")
    live = write_table(live.drop("known"), "live-terms").where("bucket >= 0")
    small = fits(live)

    def joined(big: DataFrame, terms_: DataFrame, keys: list[str]) -> DataFrame:
        return big.join(F.broadcast(terms_), keys) if small else join_sized(big, terms_, keys, spread=spread)

    first = live.where("first").select("query_id", "user_id", "doc_ids", "term", "bucket", "n_terms")
    met = joined(store.rows, first, on)
    visible = F.col("doc_ids").isNull() | F.array_contains("doc_ids", F.col("document_id"))
    candidates = met.where(visible).select("query_id", "user_id", "id", "document_id", "tf", "n_terms")
    candidates = write_table(candidates, "posting-candidates")
    done = candidates.where("n_terms = 1").select("query_id", "id", "document_id", F.col("tf").alias("score"))
    rest = live.where("NOT first").select("query_id", "term", "bucket")
    pairs = joined(candidates.where("n_terms > 1").select("query_id", "user_id", "document_id", "id"), rest, ["query_id"])
    keys = ["bucket", "term", "user_id", "document_id", "id"]
    also = join_sized(store.rows.select(*keys, "tf"), pairs, keys, spread=spread)
    held = also.groupBy("query_id", "id").agg(F.count("*").alias("others"), F.sum("tf").alias("more"))
    whole = candidates.join(held, ["query_id", "id"]).where("others = n_terms - 1")
    return done.unionByName(whole.select("query_id", "id", "document_id", (F.col("tf") + F.col("more")).alias("score")))
