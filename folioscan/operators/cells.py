"""Approximate nearest passages from a stored cell index (inverted file, Jegou et al. 2011).

The index is a table in directories by cell. A row has the passage's ids, its vector, and a code:
the difference from the cell's centre in one byte per dimension, after its scale as a float. A question is sent to the cells
with the closest centres; the join prunes the directories to these, codes give an approximate list
several times as long as asked for, and only the rows of that list are read with their vectors
and ranked exactly. Cells that grow beyond a bound are split, all of them in one pass; cell numbers are never used
again, so an old directory that the list of centres no longer names is simply not read.

Centres are fitted on a bounded sample (``SAMPLE_ROWS`` passages; ``SPLIT_ROWS`` of a cell that is split):
it shapes the cells, every passage with a vector is indexed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from ..session import write_table
from ..sizing import join_sized
from .knn import asked_scopes, key_of, kind_of, met, out_schema, packed, question_tiles
from .toplists import top_of_lists, top_per

SAMPLE_ROWS = 100_000
SPLIT_ROWS = 4096
PART_ROWS = 256  # of such a sample: a part with fewer is split by a sample of its own, in the next pass
CELL_ROWS = 100_000
PROBE_SHARE = 11 / 16  # of the cells, for vectors without structure
CENTRE_BYTES = 64 << 20  # of all centres; they go to every task
ROWS, CENTRES = "rows", "centres"


@dataclass(frozen=True)
class CellIndex:
    """A stored index: ``rows`` (cell, id, document_id, user_id, code, embedding) and the centres of its live cells."""

    path: str
    rows: DataFrame
    numbers: np.ndarray
    centres: np.ndarray


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _some(vectors: DataFrame, rows: int, sample_rows: int, seed: int = 7) -> DataFrame:
    """About ``sample_rows`` of the ``rows`` passages, written once where they are not all: fitting reads them several times."""
    if rows <= sample_rows:
        return vectors
    return write_table(vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rows)) < sample_rows), "cell-sample")


def fit_centres(some: DataFrame, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of ``cells`` cells of the vectors."""
    if cells < 2:
        return np.zeros((1, some.select(F.size("embedding")).first()[0]))
    features = some.select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine").fit(features)
    return _unit(np.array([[float(x) for x in c] for c in model.clusterCenters()]))


def _halves(vectors: np.ndarray, seed: int = 7) -> np.ndarray | None:
    """Two centres of a cell's vectors by two-means; none if all point the same way."""
    unit = _unit(vectors.astype(np.float64))
    first = unit[np.random.default_rng(seed).integers(len(unit))]
    pair = np.stack([unit[np.argmin(unit @ first)], unit[np.argmin(unit @ unit[np.argmin(unit @ first)])]])
    for _ in range(20):
        near = np.argmax(unit @ pair.T, axis=1)
        if near.min() == near.max():
            return None
        pair = _unit(np.stack([unit[near == i].mean(axis=0) for i in (0, 1)]))
    return pair


def _parts(vectors: np.ndarray, rows: int, cell_rows: int) -> list[np.ndarray]:
    """Centres of the parts of a cell with ``rows`` rows, from a sample of them: halves, and halves of those that still stand for too many rows. None if all point the same way."""
    pair = _halves(vectors)
    if pair is None:
        return []
    near, out = np.argmax(_unit(vectors.astype(np.float64)) @ pair.T, axis=1), []
    for i in (0, 1):
        part = vectors[near == i]
        many = rows * len(part) / len(vectors)
        out += (_parts(part, many, cell_rows) if many > cell_rows and len(part) >= PART_ROWS else []) or [pair[i]]
    return out


def _checked(centres: np.ndarray) -> np.ndarray:
    if centres.nbytes > CENTRE_BYTES:
        raise ValueError(f"{len(centres)} centres take more than {CENTRE_BYTES} bytes; use fewer cells")
    return centres


def _assigned(vectors: DataFrame, numbers: np.ndarray, centres: np.ndarray, within: np.ndarray | None = None) -> DataFrame:
    """Passages (id, document_id, user_id, embedding) with their cell and code. With ``within``, the cell that each centre is
    a part of, passages of a ``cell`` go to its parts."""
    unit = _checked(centres).astype(np.float32)
    kept = ["id", "document_id", "user_id", "embedding"]
    schema = ", ".join(f"{c} {kind_of(vectors, c)}" for c in kept) + ", cell long, code binary"

    def nearest_centre(rows: np.ndarray, cells: np.ndarray | None) -> np.ndarray:
        if cells is None:
            return np.argmax(rows @ unit.T, axis=1)
        own = np.empty(len(rows), np.int64)
        for cell in np.unique(cells):
            mine, parts = cells == cell, np.flatnonzero(within == cell)
            own[mine] = parts[np.argmax(rows[mine] @ unit[parts].T, axis=1)]
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(batch.num_rows, -1)
            rows = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            own = nearest_centre(rows, None if within is None else batch.column(4).to_numpy())
            rest = rows - unit[own]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12).astype("<f4")[:, None]
            code = np.hstack([scale.view(np.uint8), np.rint(rest / scale * 127).astype(np.int8).view(np.uint8)])
            ends = pa.py_buffer(np.arange(len(code) + 1, dtype=np.int32) * code.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(numbers[own]), pa.Array.from_buffers(pa.binary(), len(code), [None, ends, pa.py_buffer(code)])],
                names=[*kept, "cell", "code"],
            )

    return vectors.select(*kept, *([] if within is None else ["cell"])).mapInArrow(run, schema)


def _write_rows(rows: DataFrame, path: str) -> None:
    even = rows.hint("rebalance", F.col("cell")).sortWithinPartitions("cell", "user_id", "document_id")
    even.write.mode("append").partitionBy("cell").parquet(f"{path}/{ROWS}")


def _write_centres(spark: SparkSession, path: str, numbers: np.ndarray, centres: np.ndarray, version: int) -> None:
    rows = [(int(n), [float(x) for x in c]) for n, c in zip(numbers, centres)]
    spark.createDataFrame(rows, "cell long, centre array<double>").coalesce(1).write.parquet(f"{path}/{CENTRES}/version={version}")


def read_index(spark: SparkSession, path: str) -> CellIndex:
    listed = spark.read.parquet(f"{path}/{CENTRES}")
    last = listed.agg(F.max("version")).first()[0]
    held = listed.where(F.col("version") == last).orderBy("cell").collect()  # bounded by CENTRE_BYTES
    return CellIndex(path, spark.read.parquet(f"{path}/{ROWS}"), np.array([r.cell for r in held]), np.array([r.centre for r in held]))


def _parts_of(vectors: DataFrame, rows: dict[int, int], cell_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(cells, centres) of the parts of cells with more than ``cell_rows`` of their ``rows``; cells that cannot be split have none."""
    few = vectors.where(F.col("cell").isin(list(rows))).select("cell", "embedding", F.xxhash64("id").alias("h"))
    sample = top_per(few, ["cell"], [F.col("h")], SPLIT_ROWS).select("cell", "embedding")

    def run(key: tuple, held: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        data = held.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(held.num_rows, -1)
        made = [c.tolist() for c in _parts(data, rows[cell], cell_rows)]
        return pa.table({"cell": pa.array([cell] * len(made), pa.int64()), "part": pa.array(range(len(made)), pa.int64()), "centre": pa.array(made, pa.list_(pa.float64()))})

    made = sorted(sample.groupBy("cell").applyInArrow(run, "cell long, part long, centre array<double>").collect())  # bounded like the centres
    return np.array([r.cell for r in made], np.int64), np.array([r.centre for r in made])


def _with_parts(numbers: np.ndarray, centres: np.ndarray, within: np.ndarray, new: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keep = ~np.isin(numbers, within)
    return np.concatenate([numbers[keep], new]), _checked(np.concatenate([centres[keep], parts]))


def _finer(some: DataFrame, centres: np.ndarray, rows: int, cell_rows: int) -> np.ndarray:
    """Centres, and those of the parts of cells that would hold more than ``cell_rows`` of all ``rows`` as it looks from the sample, so that few rows are written twice."""
    numbers = np.arange(len(centres))
    held = write_table(_assigned(some, numbers, centres).select("id", "cell", "embedding"), "sample-cells")
    counts = {r.cell: r["count"] for r in held.groupBy("cell").count().collect()}
    full = {cell: many for cell, n in counts.items() if (many := rows * n // sum(counts.values())) > cell_rows}
    if not full:
        return centres
    within, parts = _parts_of(held, full, cell_rows)
    return _with_parts(numbers, centres, within, len(centres) + np.arange(len(within)), parts)[1] if len(within) else centres


def _split(spark: SparkSession, path: str, cell_rows: int) -> CellIndex:
    """Split cells with more than ``cell_rows`` rows, again and again; a pass splits all of them, and only their rows are written anew."""
    stuck: set[int] = set()
    before: dict[int, int] = {}  # rows of the cell that a part comes from
    while True:
        index = read_index(spark, path)
        live = index.rows.where(F.col("cell").isin([int(n) for n in index.numbers]))
        full = {r.cell: r["count"] for r in live.groupBy("cell").count().where(F.col("count") > cell_rows).collect()}
        stuck |= {cell for cell, rows in full.items() if before.get(cell) == rows}
        full = {cell: rows for cell, rows in full.items() if cell not in stuck}
        if not full:
            return index
        number = int(spark.read.parquet(f"{path}/{CENTRES}").agg(F.max("cell")).first()[0])
        version = int(spark.read.parquet(f"{path}/{CENTRES}").agg(F.max("version")).first()[0])
        within, parts = _parts_of(live, full, cell_rows)
        stuck |= set(full) - set(within.tolist())
        if not len(within):
            return index
        new = number + 1 + np.arange(len(within))
        before |= {int(n): full[cell] for n, cell in zip(new, within.tolist())}
        numbers, centres = _with_parts(index.numbers, index.centres, within, new, parts)
        _write_rows(_assigned(live.where(F.col("cell").isin(np.unique(within).tolist())), new, parts, within), path)
        _write_centres(spark, path, numbers, centres, version + 1)


def _indexable(chunks: DataFrame, size: int | None = None) -> DataFrame:
    rows = chunks.select("id", "document_id", "user_id", F.col("embedding").cast("array<float>").alias("embedding")).where(F.col("embedding").isNotNull())
    return rows if size is None else rows.where(F.size("embedding") == size)


def write_index(chunks: DataFrame, path: str, cells: int, cell_rows: int = CELL_ROWS, sample_rows: int = SAMPLE_ROWS) -> CellIndex:
    """Index all passages with a vector in an empty folder; vectors have one length."""
    spark, rows = chunks.sparkSession, _indexable(chunks)
    many = rows.count()
    some = _some(rows, many, sample_rows)
    centres = _finer(some, fit_centres(some, cells), many, cell_rows)
    numbers = np.arange(len(centres))
    _write_rows(_assigned(rows, numbers, centres), path)
    _write_centres(spark, path, numbers, centres, 0)
    return _split(spark, path, cell_rows)


def append_index(chunks: DataFrame, path: str, cell_rows: int = CELL_ROWS) -> CellIndex:
    """Add passages to the cells of a stored index and split what has grown too large."""
    spark = chunks.sparkSession
    index = read_index(spark, path)
    _write_rows(_assigned(_indexable(chunks, index.centres.shape[1]), index.numbers, index.centres), path)
    return _split(spark, path, cell_rows)


def probes_for(index: CellIndex, share: float = PROBE_SHARE) -> int:
    """How many cells are ``share`` of the live ones: splits make more of them, and each question needs as many more."""
    return max(1, math.ceil(share * len(index.numbers)))


def probed(index: CellIndex, asked: DataFrame, probes: int) -> DataFrame:
    """Questions with each of the ``probes`` cells whose centres are closest."""
    unit, numbers = _checked(index.centres), index.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = np.array(batch.column(1).to_pylist(), np.float64)
                order = np.argsort(-(vectors @ unit.T), axis=1, kind="stable")[:, :probes]
                found = pa.array(numbers[order].tolist(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["query_id", "cells"])

    cells = asked.select("query_id", "query_embedding").mapInArrow(run, f"query_id {kind_of(asked, 'query_id')}, cells array<long>")
    return asked.join(cells.dropDuplicates(["query_id"]), "query_id").select("*", F.explode("cells").alias("cell")).drop("cells").withColumn("cell", F.col("cell").cast(kind_of(index.rows, "cell")))


def nearest_stored(index: CellIndex, queries: DataFrame, k: int = 20, probes: int = 8, refine: int = 4) -> DataFrame:
    """Like exact search, over the ``probes`` closest cells of each question: (query_id, id, document_id, distance, rank).

    ``refine`` times ``k`` rows of the approximate list are ranked by their vectors.
    """
    asked = write_table(probed(index, asked_scopes(queries, kind_of(index.rows, "document_id"))[0], probes), "probed-cells")
    asked = asked.where(F.col("cell") >= 0)  # holds for all; Spark prunes directories by a side that has a condition
    key = key_of("cell", "user_id")
    tiles = question_tiles(asked.select(key.alias("key"), "query_id", "query_embedding", "doc_ids"))
    wanted = asked.select("cell", "user_id", key.alias("key")).distinct()
    spread = F.xxhash64("id")
    coded = join_sized(index.rows.select("cell", "user_id", "document_id", "id", "code"), wanted, ["cell", "user_id"], spread=spread)
    place = {int(n): i for i, n in enumerate(index.numbers)}
    unit = index.centres.astype(np.float32)

    def decode(name: str, data: bytes, many: int) -> np.ndarray:
        held = np.frombuffer(data, np.uint8).reshape(many, -1)
        scale, code = (np.ascontiguousarray(x) for x in (held[:, :4], held[:, 4:]))
        return unit[place[json.loads(name)["cell"]]] + code.view(np.int8).astype(np.float32) * (scale.view("<f4") / 127)

    schema = out_schema(index.rows, queries) + ", cell long"
    near = met(packed(coded, ["key"], "code"), tiles, schema, refine * k, decode, mark=lambda name: json.loads(name)["cell"])
    few = top_of_lists(near, ["query_id"], [F.col("distance").asc(), F.col("id").asc()], refine * k, "approximate")
    few = write_table(few.select("query_id", "id", F.col("cell").cast(kind_of(index.rows, "cell")).alias("cell")), "approximate-list")
    cells = asked.select("query_id", "user_id", "cell", "query_embedding")
    listed = few.join(cells, ["query_id", "cell"]).select("cell", "user_id", "id", "query_id", "query_embedding")
    exact = join_sized(index.rows.select("cell", "user_id", "id", "document_id", "embedding"), listed, ["cell", "user_id", "id"], spread=spread)
    ranked = exact.select("query_id", "id", "document_id", cosine_distance(F.col("embedding"), F.col("query_embedding")).alias("distance"))
    return top_per(ranked.where("distance IS NOT NULL"), ["query_id"], [F.col("distance").asc(), F.col("id").asc()], k)
