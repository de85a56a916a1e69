"""Maximal marginal relevance (Carbonell and Goldstein 1998) over each question's candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAMBDA = 0.7


def picks_for(n_docs: Column, base: int = 5) -> Column:
    """How many passages an answer gets: 5 for one document, 4 per document up to 12."""
    return F.when(n_docs <= 1, F.lit(base)).otherwise(F.least(4 * n_docs, F.lit(12))).cast("long")


def _dots(vectors: np.ndarray, one: np.ndarray) -> np.ndarray:
    # Row by row, so that equal vectors get equal values; a matrix product may round them apart.
    return (vectors * one).sum(axis=1)


def greedy_order(query: np.ndarray, vectors: np.ndarray, k: int, lam: float) -> list[int]:
    """Row numbers in selection order; the earlier candidate wins ties."""
    relevance = lam * _dots(vectors, query)
    closest = np.full(len(vectors), -np.inf)
    taken: list[int] = []
    for _ in range(min(k, len(vectors))):
        penalty = (1 - lam) * closest if taken else 0.0
        score = relevance - penalty
        score[taken] = -np.inf
        best = int(np.argmax(score))
        taken.append(best)
        closest = np.maximum(closest, _dots(vectors, vectors[best]))
    return taken


def _usable(vector, size: int) -> np.ndarray:
    # A vector of another length has no similarity to the question: all its products are 0.
    out = np.asarray(vector, dtype=np.float64)
    return out if len(out) == size else np.zeros(size)


def _rerank(lam: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            ids_out, pick_out, query_out = [], [], []
            for row in part.itertuples(index=False):
                ids, vectors, k = list(row.ids), list(row.vectors), int(row.k)
                usable = [i for i, v in enumerate(vectors) if v is not None and len(v)]
                query = row.query_embedding
                if len(ids) <= k or query is None or not len(query) or not usable:
                    chosen = list(range(min(k, len(ids)))) if len(ids) > k else list(range(len(ids)))
                else:
                    query = np.asarray(query, dtype=np.float64)
                    matrix = np.stack([_usable(vectors[i], len(query)) for i in usable])
                    chosen = [usable[i] for i in greedy_order(query, matrix, k, lam)]
                ids_out += [ids[i] for i in chosen]
                pick_out += range(1, len(chosen) + 1)
                query_out += [row.query_id] * len(chosen)
            yield pd.DataFrame({"query_id": query_out, "id": ids_out, "pick": np.array(pick_out, dtype=np.int64)})

    return run


def rerank(candidates: DataFrame, queries: DataFrame, lam: float = LAMBDA) -> DataFrame:
    """Selected passages (query_id, id, pick) in selection order.

    ``candidates``: query_id, id, position, embedding; a bounded list per question
    (the match count of the search). ``queries``: query_id, query_embedding, k.
    Up to ``k`` candidates pass unchanged. Candidates without a vector are passed
    over, unless none has one: then the first ``k`` by position are kept.
    """
    lists = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "id", "embedding"))).alias("c")
    )
    rows = lists.join(queries.select("query_id", "query_embedding", "k"), "query_id").select(
        "query_id", "query_embedding", "k", F.col("c.id").alias("ids"), F.col("c.embedding").alias("vectors")
    )
    kinds = [df.schema[name].dataType.simpleString() for df, name in ((queries, "query_id"), (candidates, "id"))]
    return rows.mapInPandas(_rerank(lam), f"query_id {kinds[0]}, id {kinds[1]}, pick long")
