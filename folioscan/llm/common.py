"""Helpers shared by the operators: reading tables, adding results to rows, slicing batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SLICE_BYTES = 1 << 20
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores in front until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = "_" + base
    return base


def column(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


def slices(sizes: Iterable[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a row range so that each piece holds about ``limit`` bytes; one row is never cut."""
    start, held, i = 0, 0, -1
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += size
    if i >= start:
        yield start, i + 1


def lengths(data: pa.Array) -> list[int]:
    """Bytes of each value, 0 for null."""
    return pc.fill_null(pc.binary_length(data), 0).to_pylist()


def small_batches(df: DataFrame) -> None:
    """Let Arrow batches hold ``BATCH_BYTES`` where the session kept Spark's larger default."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) in ("67108864b", "64MB", "67108864"):
        conf.set(key, f"{BATCH_BYTES}b")


def attach(
    df: DataFrame, make: Callable[[], Callable[[list], list]], fields: str, name: str, text: str = "text",
) -> DataFrame:
    """``df`` with one more struct column ``name``: what ``make()`` makes of the whole texts.

    ``make`` runs once in each task and gives a function from a list of texts (UTF-8 bytes or
    None) to a list of tuples in the order of ``fields``. All columns of ``df`` pass through.
    """
    small_batches(df)
    struct = T._parse_datatype_string(f"struct<{fields}>")
    arrow = to_arrow_type(struct)
    where = df.columns.index(text)
    names = struct.fieldNames()

    def run(batches):
        work = make()
        for batch in batches:
            data = batch.column(where).cast(pa.binary())
            for a, b in slices(lengths(data)):
                rows = work(data.slice(a, b - a).to_pylist())
                part = batch.slice(a, b - a)
                made = pa.array([dict(zip(names, row)) for row in rows], type=arrow)
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, struct)])
    return df.mapInArrow(run, schema)


def blocks(rows: DataFrame, key: str, member: str, many: Column) -> DataFrame:
    """Deal each group of ``key`` into ``many`` blocks by ``member``; any two blocks meet in a cell of their own.

    A row gets one copy per block of its group, with the number of the ``cell``, the row's ``own``
    block and whether the cell holds two different blocks (``cross``). A group of one block is one cell.
    """
    last = F.greatest(many.cast("long"), F.lit(1).cast("long")) - 1
    dealt = rows.withColumn("own", F.pmod(F.xxhash64(member), last + 1)).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    cell = F.xxhash64(key, F.least("own", "met"), F.greatest("own", "met"))
    return dealt.withColumn("cell", cell).withColumn("cross", F.col("own") != F.col("met")).drop("met")


def whole_cells(batches: Iterator[pa.RecordBatch], take: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``take`` of runs of whole cells, from a stream that is sorted by its first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column(0).to_numpy()
        cut = int(np.searchsorted(cells, cells[-1], "left"))
        if cut or (held and held[-1].column(0)[-1].as_py() != cells[0]):
            done = pa.Table.from_batches([*held, batch.slice(0, cut)]) if cut else pa.Table.from_batches(held)
            yield take(done)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield take(pa.Table.from_batches(held))


def bounds(cells: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
