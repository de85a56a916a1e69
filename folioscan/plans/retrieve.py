"""From questions to the passages an answer is written from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routing
from ..operators import fusion, lookup, mmr
from ..session import write_table
from .search import sources, with_passages


LOOKUP_PICKS = 5  # a page or section lookup gives as many over any number of documents


@dataclass(frozen=True)
class Retrieval:
    labelled: DataFrame
    selected: DataFrame
    sources: DataFrame


def labelled_questions(queries: DataFrame) -> DataFrame:
    """Questions with their class and, if any, the page or section they ask for."""
    text = F.col("query_text")
    return queries.withColumns({
        "class": routing.question_class(text),
        "reply_key": routing.small_talk_key(text),
        "asked_page": routing.lookup_page(text),
        "asked_section": routing.lookup_section(text),
        "k": F.when(
            routing.lookup_page(text).isNotNull() | routing.lookup_section(text).isNotNull(), F.lit(LOOKUP_PICKS).cast("long")
        ).otherwise(mmr.picks_for(F.col("n_docs"))),
    })


def retrieve(
    chunks: DataFrame, queries: DataFrame, second_pass: DataFrame | None = None,
    match_count: int = 20, min_useful: float = 0.005, weak: float = 0.02, **stores,
) -> Retrieval:
    """Route, search or look up, and diversify a batch of questions.

    ``queries``: query_id, user_id, query_text, query_embedding, doc_ids, doc_id,
    n_docs. ``second_pass`` (query_id, query_embedding) holds the vectors of
    hypothetical answers (Gao et al. 2022); it is tried for questions over at
    most one document whose best score is weak, and kept where it scores higher.
    ``stores``: postings and index, see :func:`hybrid_search`.
    """
    asked = write_table(labelled_questions(queries), "questions")
    real = asked.where(F.col("class") != "conversational")
    by_lookup = real.where(F.col("asked_page").isNotNull() | F.col("asked_section").isNotNull())
    by_search = real.where(F.col("asked_page").isNull() & F.col("asked_section").isNull()).withColumn(
        "doc_ids", F.coalesce("doc_ids", F.when(F.col("doc_id").isNotNull(), F.array("doc_id")))
    )
    columns = ["query_id", "id", "document_id", "rrf_score", "position"]
    found = lookup.by_page(chunks, by_lookup).unionByName(lookup.by_section(chunks, by_lookup)).select(*columns)
    first = write_table(fusion.hybrid_search(chunks, by_search, match_count, **stores).select(*columns), "first-pass")
    routes = fusion.top_scores(first, min_useful, weak)
    kept = first.join(routes.where(F.col("route") != "direct_fallback"), "query_id", "left_semi")
    if second_pass is not None:
        again = by_search.where(F.col("n_docs") <= 1).join(
            routes.where(F.col("route") == "second_pass"), "query_id", "left_semi"
        ).drop("query_embedding").join(second_pass.select("query_id", "query_embedding"), "query_id")
        second = write_table(fusion.hybrid_search(chunks, again, match_count, **stores).select(*columns), "second-pass")
        kept = fusion.better_run(kept, second).drop("run")
    with_vectors = with_passages(found.unionByName(kept), chunks, ["embedding", "content", "page_number", "filename", "heading"])
    body = write_table(with_vectors, "candidate-passages")
    picked = mmr.rerank(body, asked)
    selected = body.drop("embedding").join(picked, ["query_id", "id"])
    return Retrieval(asked, selected, sources(selected))


def outcomes(run: Retrieval, documents: DataFrame) -> DataFrame:
    """How each question ends: one row per row of ``run.labelled``, whatever was found.

    ``path`` is conversational (with its ``reply_key``), no_documents (the user has none that is ready),
    lookup, not_found (a page or section that no passage has), search, or direct (answered without passages).
    ``documents``: user_id, status.
    """
    picks = run.selected.groupBy("query_id").agg(F.count("*").alias("n_picks"))
    ready = documents.where(F.col("status") == "ready").select("user_id").distinct().withColumn("_ready", F.lit(True))
    asked = run.labelled.select("query_id", "user_id", "class", "reply_key", "asked_page", "asked_section")
    met = asked.join(picks, "query_id", "left").join(ready, "user_id", "left")
    found = F.coalesce("n_picks", F.lit(0))
    by_lookup = F.col("asked_page").isNotNull() | F.col("asked_section").isNotNull()
    path = (
        F.when(F.col("class") == "conversational", "conversational")
        .when(F.col("_ready").isNull(), "no_documents")
        .when(by_lookup, F.when(found > 0, "lookup").otherwise("not_found"))
        .otherwise(F.when(found > 0, "search").otherwise("direct"))
    )
    return met.select("query_id", path.alias("path"), "reply_key")
