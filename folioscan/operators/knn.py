"""Nearest passages of a batch of question vectors.

Passages are scanned once, however many questions there are, and their rows are never shuffled. Each
Arrow batch is packed into tiles of one tenant (or one document, for questions over some
documents), the questions are packed into tiles of the same tenant or document, and tiles meet
in a join whose small side is measured: broadcast, or shuffled as whole tiles beyond the bound. A pair
of tiles is one matrix product of a fixed size; only the best ``k`` rows per question leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_batches, write_table
from ..sizing import BROADCAST_BYTES, join_sized
from .toplists import top_of_lists

QUESTION_TILE = 512
PASSAGE_TILE = 4096


def _ordered_sum(products: np.ndarray) -> np.ndarray:
    # Left-to-right accumulation gives equal vectors equal distances wherever they sit in a batch.
    return np.add.accumulate(products, axis=1)[:, -1]


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    scale = np.sqrt(_ordered_sum(rows * rows)) * np.sqrt(_ordered_sum((query * query)[None, :]))[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1.0 - _ordered_sum(rows * query[None, :]) / scale


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def out_schema(chunks: DataFrame, queries: DataFrame) -> str:
    return f"query_id {kind_of(queries, 'query_id')}, id {kind_of(chunks, 'id')}, document_id {kind_of(chunks, 'document_id')}, distance double"


def _as_bytes(column: pa.Array) -> tuple[np.ndarray, int]:
    """Rows of equally long vectors (floats, or codes of one length) as a matrix of bytes per row."""
    rows = len(column)
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        return values.reshape(rows, -1).view(np.uint8), values.itemsize
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1), 1


def packed(passages: DataFrame, keys: list[str], payload: str = "embedding", size: int = PASSAGE_TILE) -> DataFrame:
    """Tiles (key, ids, docs, data) of passages with equal keys in one Arrow batch; a row goes to a tile for each of its ``keys`` that is not null.

    ``data`` holds the payloads (vectors as floats, or codes) one after the other; rows with equal keys have payloads of one length.
    """
    small_batches(passages.sparkSession)
    schema = f"key string, ids array<{kind_of(passages, 'id')}>, docs array<{kind_of(passages, 'document_id')}>, data binary"
    columns = [*keys, "id", "document_id", payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in keys:
                part = batch.filter(batch.column(name).is_valid())
                if not part.num_rows:
                    continue
                coded = part.column(name).dictionary_encode()
                codes = coded.indices.to_numpy()
                order = np.argsort(codes, kind="stable")
                part, codes = part.take(pa.array(order)), codes[order]
                edges = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
                tiles = [(a, min(a + size, stop)) for start, stop in zip(edges, edges[1:]) for a in range(start, stop, size)]
                names = coded.dictionary.to_pylist()
                data = []
                for a, b in tiles:
                    data.append(_as_bytes(part.column(payload).slice(a, b - a))[0].tobytes())
                offsets = pa.array([0, *(b for _, b in tiles)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([names[codes[a]] for a, _ in tiles], pa.string()),
                        pa.ListArray.from_arrays(offsets, part.column("id")),
                        pa.ListArray.from_arrays(offsets, part.column("document_id")),
                        pa.array(data, pa.binary()),
                    ],
                    names=["key", "ids", "docs", "data"],
                )

    return passages.select(*columns).mapInArrow(run, schema)


def question_tiles(questions: DataFrame, size: int = QUESTION_TILE) -> DataFrame:
    """Tiles (key, part, questions) of questions (key, query_id, query_embedding, doc_ids) with equal keys."""
    many = questions.groupBy("key").agg(F.ceil(F.count("*") / size).alias("parts"))
    part = F.pmod(F.xxhash64("query_id"), F.col("parts"))
    row = F.struct("query_id", F.col("query_embedding").cast("array<float>").alias("vector"), "doc_ids")
    return questions.join(many, "key").withColumn("part", part).groupBy("key", "part").agg(F.collect_list(row).alias("questions"))


def _best_of(score: np.ndarray, k: int, margin: float) -> list[np.ndarray]:
    """Per question the passages that may be among its ``k`` best; scores are single precision."""
    if score.shape[1] <= k:
        return [np.arange(score.shape[1])] * len(score)
    floor = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    return [np.flatnonzero(row >= f - margin) for row, f in zip(score, floor)]


Decode = Callable[[str, bytes, int], np.ndarray]


def floats(key: str, data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(rows, -1)


def met(
    tiles: DataFrame, questions: DataFrame, schema: str, k: int, decode: Decode = floats, max_bytes: int = BROADCAST_BYTES,
    mark: Callable[[str], int] | None = None,
) -> DataFrame:
    """(query_id, id, document_id, distance): the best ``k`` of every pair of tiles, with the number that ``mark`` gives for its key as a last column of ``schema``."""
    pairs = join_sized(tiles, questions, ["key"], spread=F.xxhash64("ids"), max_bytes=max_bytes).select("key", "ids", "docs", "data", "questions")

    def one(key: str, ids: pa.Array, docs: pa.Array, data: bytes, asked: pa.Array):
        rows = decode(key, data, len(ids)).astype(np.float64)
        norms = np.linalg.norm(rows, axis=1)
        live = np.flatnonzero(norms > 0)
        if not len(live):
            return None
        rows, ids, docs = rows[live], ids.take(pa.array(live)), docs.take(pa.array(live))
        unit = (rows / norms[live, None]).astype(np.float32)
        order_by = np.empty(len(ids), np.int64)  # ids rank like the column, numbers or text
        order_by[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
        vectors = asked.field("vector").flatten().to_numpy(zero_copy_only=False).reshape(len(asked), -1).astype(np.float64)
        lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
        lengths[lengths == 0] = 1.0
        score = (vectors / lengths).astype(np.float32) @ unit.T
        scopes = asked.field("doc_ids")
        if scopes.null_count < len(scopes):
            for i, scope in enumerate(scopes):
                if scope.is_valid:
                    score[i, ~pc.is_in(docs, value_set=scope.values.cast(docs.type)).to_numpy(zero_copy_only=False)] = -np.inf
        # single precision finds the candidates; the margin covers its rounding, double precision decides
        margin = 4.0e-7 * (rows.shape[1] + 8)
        which, picks, dists = [], [], []
        for i, at in enumerate(_best_of(score, k, margin)):
            at = at[score[i, at] > -np.inf]
            dist = _distances(rows[at], vectors[i])
            keep = np.lexsort((order_by[at], dist))[:k]
            which.append(np.full(len(keep), i))
            picks.append(at[keep])
            dists.append(dist[keep])
        which, picks = np.concatenate(which), pa.array(np.concatenate(picks))
        return [asked.field("query_id").take(pa.array(which)), ids.take(picks), docs.take(picks), pa.array(np.concatenate(dists))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, ids, docs, data, asked = batch.columns
            for i in range(batch.num_rows):
                made = one(key[i].as_py(), ids[i].values, docs[i].values, data[i].as_py(), asked[i].values)
                if made and mark:
                    made.append(pa.array(np.full(len(made[0]), mark(key[i].as_py()), np.int64)))
                if made:
                    yield pa.RecordBatch.from_arrays(made, names=names)

    names = [part.split()[0] for part in schema.split(", ")]
    small_batches(tiles.sparkSession)
    return pairs.mapInArrow(run, schema)


def key_of(*parts) -> Column:
    return F.to_json(F.struct(*parts))


def asked_scopes(queries: DataFrame, document_kind: str) -> tuple[DataFrame, int, int]:
    """Questions with a vector, their ``doc_ids`` and the ``size`` of the vector, which is the same in all; how many have no documents, and how many do."""
    if "doc_ids" not in queries.columns:
        queries = queries.withColumn("doc_ids", F.lit(None))
    asked = queries.where(F.col("query_embedding").isNotNull())
    asked = asked.select("query_id", "user_id", "query_embedding", F.col("doc_ids").cast(f"array<{document_kind}>").alias("doc_ids"), F.size("query_embedding").alias("size"))
    asked = write_table(asked, "asked-vectors")  # read several times: sizes, scopes, tiles
    few = asked.agg(F.min("size").alias("least"), F.max("size").alias("most"), F.count("*").alias("all"), F.count("doc_ids").alias("scoped")).first()
    if few.least != few.most:
        raise ValueError(f"questions have vectors of different lengths: {[few.least, few.most]}")
    return asked, few["all"] - few.scoped, few.scoped


def nearest(chunks: DataFrame, queries: DataFrame, k: int = 20, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The ``k`` nearest passages of every question: (query_id, id, document_id, distance, rank).

    ``chunks``: id, document_id, user_id, embedding. ``queries``: query_id, user_id, query_embedding, doc_ids (NULL: all
    documents of the user). Ids may be numbers or text. Passages without a vector, or with one of another length
    than the questions', are left out.
    """
    asked, n_open, n_scoped = asked_scopes(queries, kind_of(chunks, "document_id"))
    stored = chunks.select("id", "document_id", "user_id", "embedding", F.size("embedding").alias("size")).where(F.col("embedding").isNotNull())
    spread, keys, parts = F.xxhash64("id"), [], []
    none = F.lit(None).cast(asked.schema["doc_ids"].dataType).alias("doc_ids")
    for name, many, on in (("open", n_open, ["user_id", "size"]), ("limited", n_scoped, ["user_id", "size", "document_id"])):
        if not many and (n_open or n_scoped or name == "limited"):
            continue
        some = asked.where("doc_ids IS NULL")
        if name == "limited":
            some = asked.where("doc_ids IS NOT NULL").withColumn("document_id", F.explode(F.array_distinct("doc_ids")))
        some = some.withColumn("key", key_of(*on))
        parts.append(some.select("key", "query_id", "query_embedding", none))
        how = "left" if n_open and n_scoped else "inner"
        stored = join_sized(stored, some.select(*on, F.col("key").alias(name)).distinct(), on, how, spread=spread, max_bytes=max_bytes)
        keys.append(name)
    tiles = question_tiles(reduce(DataFrame.unionByName, parts))
    live = reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in keys])
    found = met(packed(stored.where(live), keys), tiles, out_schema(chunks, queries), k, max_bytes=max_bytes)
    return top_of_lists(found, ["query_id"], [F.col("distance").asc_nulls_last(), F.col("id").asc()], k)
