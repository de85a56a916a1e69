"""Reciprocal-rank fusion (Cormack, Clarke and Buettcher 2009) of two ranked lists."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from . import cells, keyword, knn, postings as stored_postings
from .toplists import top_per

DAMPING = 60


def fuse(vector_list: DataFrame, keyword_list: DataFrame, damping: int = DAMPING) -> DataFrame:
    """Score every row of either list by the sum of 1 / (damping + rank); a missing side adds 0."""
    v = vector_list.select("query_id", "id", F.col("document_id").alias("_vd"), F.col("rank").alias("v_rank"))
    w = keyword_list.select("query_id", "id", F.col("document_id").alias("_kd"), F.col("rank").alias("k_rank"))
    both = v.join(w, ["query_id", "id"], "full_outer")

    def share(rank: str):
        return F.coalesce(F.lit(1.0) / (F.lit(float(damping)) + F.col(rank)), F.lit(0.0))

    return both.select(
        "query_id", "id", F.coalesce("_vd", "_kd").alias("document_id"), "v_rank", "k_rank",
        (share("v_rank") + share("k_rank")).alias("rrf_score"),
    )


def best_fused(fused: DataFrame, match_count: int = 10) -> DataFrame:
    order = [F.col("rrf_score").desc_nulls_last(), F.col("id").asc()]
    return top_per(fused, ["query_id"], order, match_count, "position")


def hybrid_search(
    chunks: DataFrame,
    queries: DataFrame,
    match_count: int = 10,
    list_size: int = 20,
    damping: int = DAMPING,
    postings: keyword.Lexicon | stored_postings.Postings | None = None,
    index: cells.CellIndex | None = None,
    stem: bool = True,
) -> DataFrame:
    """Fused vector and keyword search of a question batch.

    ``queries``: query_id, user_id, query_text, query_embedding and optionally
    doc_ids; NULL doc_ids means all documents of the user, one id one document.
    ``postings``, the passages' words or stored postings, take the place of their text, a stored cell ``index`` that of the exact vector list.
    """
    asked = write_table(queries, "asked")
    near = partial(knn.nearest, chunks) if index is None else partial(cells.nearest_stored, index)
    named = partial(keyword.ranked, chunks if postings is None else postings)
    with ThreadPoolExecutor(2) as pool:  # the small jobs that plan either list run side by side
        lists = [pool.submit(inheritable_thread_target(asked.sparkSession)(f), asked, list_size, *more) for f, more in ((near, ()), (named, (stem,)))]
        vector_list, keyword_list = (x.result() for x in lists)
    return best_fused(fuse(vector_list, keyword_list, damping), match_count)


def top_scores(ranked: DataFrame, min_useful: float = 0.005, weak: float = 0.02) -> DataFrame:
    """Best score per question and the path it opens."""
    best = ranked.groupBy("query_id").agg(F.max("rrf_score").alias("top_score"))
    return best.withColumn(
        "route",
        F.when(F.col("top_score") < min_useful, "direct_fallback")
        .when(F.col("top_score") < weak, "second_pass")
        .otherwise("rag"),
    )


def better_run(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per question the rows of the second run if its best score is strictly higher, else the first."""
    a = first.groupBy("query_id").agg(F.max("rrf_score").alias("a"))
    b = second.groupBy("query_id").agg(F.max("rrf_score").alias("b"))
    take_second = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b") > F.col("a")))
    choice = a.join(b, "query_id", "full_outer").select("query_id", take_second.alias("_second"))
    tagged = first.withColumn("run", F.lit("direct")).unionByName(second.withColumn("run", F.lit("second")))
    return (
        tagged.join(choice, "query_id")
        .where((F.col("run") == "second") == F.col("_second"))
        .drop("_second")
    )
