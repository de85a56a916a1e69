"""Hybrid search in its three scopes, and the passages behind a ranked list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fusion import hybrid_search
from ..session import write_table
from ..sizing import join_sized


def search_user(chunks: DataFrame, queries: DataFrame, match_count: int = 10, **stores) -> DataFrame:
    """All documents of the asking user. ``stores``: postings and index, see :func:`hybrid_search`."""
    return hybrid_search(chunks, queries.drop("doc_ids"), match_count, **stores)


def search_document(chunks: DataFrame, queries: DataFrame, match_count: int = 10, **stores) -> DataFrame:
    """One document per question (column doc_id)."""
    return hybrid_search(chunks, queries.withColumn("doc_ids", F.array("doc_id")), match_count, **stores)


def search_set(chunks: DataFrame, queries: DataFrame, match_count: int = 10, **stores) -> DataFrame:
    """A document set per question (column doc_ids); a question without a set is asked over all documents of its user."""
    return hybrid_search(chunks, queries, match_count, **stores)


def with_passages(ranked: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Passage columns for the rows of a ranked list.

    The list (questions x match count) is the small side. It also carries the
    document, so stored passages that are clustered by document are read only
    where a ranked row points. The list is written first: it is read by the size
    check and by the join, and must not be searched for twice.
    """
    ranked = write_table(ranked, "ranked")
    body = chunks.select("document_id", "id", *columns)
    return join_sized(body, ranked, ["document_id", "id"], spread=F.xxhash64("id"))


def sources(selected: DataFrame) -> DataFrame:
    """Citation rows of selected passages."""
    return selected.select(
        "query_id", "pick", F.col("id").alias("chunk_id"), "document_id", "page_number", "filename",
        F.col("heading").alias("section"), F.col("content").alias("snippet"),
    )
