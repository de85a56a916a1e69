"""Ordered scans over long sequences, split into blocks.

A running count, a forward fill or a look at the previous row needs the rows of
a sequence in order. Partitioning a window by the sequence alone would put the
largest document or user on one task. Here every sequence is cut into blocks of
its order column, the window runs per (sequence, block), and what one block owes
the next is passed on through one summary row per block.

Sequence keys and order columns are never NULL in the stored tables. The input is
read twice, for the blocks and for the rows, so callers pass a stored table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _before(keys: list[str], block: str):
    return Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)


def _inside(keys: list[str], block: str, order: list[str]):
    return Window.partitionBy(*keys, block).orderBy(*order)


def with_block_totals(df: DataFrame, keys: list[str], block: str, totals: dict[str, Column]) -> DataFrame:
    """Add, per name, the sum of that value over all earlier blocks of the sequence."""
    sums = df.groupBy(*keys, block).agg(*[F.sum(v).alias(n) for n, v in totals.items()])
    for name in totals:
        sums = sums.withColumn(name, F.coalesce(F.sum(name).over(_before(keys, block)), F.lit(0)))
    return df.join(sums, keys + [block])


def numbered(df: DataFrame, keys: list[str], block: str, order: list[str], name: str) -> DataFrame:
    """0-based position of each row in its sequence."""
    out = with_block_totals(df, keys, block, {"_base": F.lit(1)})
    local = F.row_number().over(_inside(keys, block, order)) - 1
    return out.withColumn(name, (F.col("_base") + local).cast("long")).drop("_base")


def running_before(df: DataFrame, keys: list[str], block: str, order: list[str], value: Column, name: str) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the sequence."""
    rows = df.withColumn("_value", value)
    out = with_block_totals(rows, keys, block, {"_base": F.col("_value")})
    local = F.sum("_value").over(_inside(keys, block, order).rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn(name, F.col("_base") + F.coalesce(local, F.lit(0))).drop("_base", "_value")


def filled(
    df: DataFrame, keys: list[str], block: str, order: list[str], value: str, name: str, inclusive: bool = True
) -> DataFrame:
    """Nearest non-null ``value`` at or before each row (or strictly before it)."""
    marker = F.when(F.col(value).isNotNull(), F.struct(*[F.col(c) for c in order]))
    tail = (
        df.groupBy(*keys, block)
        .agg(F.max_by(F.col(value), marker).alias("_tail"))
        .withColumn("_tail", F.last("_tail", ignorenulls=True).over(_before(keys, block)))
    )
    upto = 0 if inclusive else -1
    local = F.last(value, ignorenulls=True).over(
        _inside(keys, block, order).rowsBetween(Window.unboundedPreceding, upto)
    )
    return (
        df.join(tail, keys + [block])
        .withColumn(name, F.coalesce(local, F.col("_tail")))
        .drop("_tail")
    )


def previous(df: DataFrame, keys: list[str], block: str, order: list[str], values: dict[str, Column]) -> DataFrame:
    """Values of the row just before each row, NULL for the first of a sequence."""
    packed = F.struct(*[v.alias(n) for n, v in values.items()])
    marker = F.struct(*[F.col(c) for c in order])
    rows = df.withColumn("_self", packed)
    tail = (
        rows.groupBy(*keys, block)
        .agg(F.max_by("_self", marker).alias("_tail"))
        .withColumn("_tail", F.last("_tail").over(_before(keys, block)))
    )
    out = rows.join(tail, keys + [block]).withColumn(
        "_prev", F.coalesce(F.lag("_self").over(_inside(keys, block, order)), F.col("_tail"))
    )
    for name in values:
        out = out.withColumn(name, F.col("_prev")[name])
    return out.drop("_self", "_tail", "_prev")


def handed_on(
    df: DataFrame, keys: list[str], block: str, order: list[str], fresh: str, text: str, name: str
) -> DataFrame:
    """Adds the text each row is handed by the rows before it.

    A ``fresh`` row hands on its own ``text``; any other row hands on what it was
    handed with its own text appended. The first row of a sequence must be fresh.
    """
    inside = _inside(keys, block, order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_run", F.sum(F.col(fresh).cast("int")).over(upto))
    run = Window.partitionBy(*keys, block, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_said", F.array_join(F.collect_list(text).over(run), " "))
    blocks = rows.groupBy(*keys, block).agg(
        F.max(F.col(fresh).cast("int")).alias("_any"),
        F.max_by("_said", F.struct(*[F.col(c) for c in order])).alias("_end"),
    )
    by_block = Window.partitionBy(*keys).orderBy(block)
    blocks = blocks.withColumn("_chain", F.sum("_any").over(by_block))
    chain = Window.partitionBy(*keys, "_chain").orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    blocks = blocks.withColumn("_left", F.array_join(F.collect_list("_end").over(chain), " "))
    blocks = blocks.select(*keys, block, F.lag("_left").over(by_block).alias("_enter"))
    out = rows.join(blocks, keys + [block])
    whole = F.when(F.col("_run") == 0, F.concat_ws(" ", "_enter", "_said")).otherwise(F.col("_said"))
    out = out.withColumn("_whole", whole)
    handed = F.when(F.row_number().over(inside) == 1, F.col("_enter")).otherwise(F.lag("_whole").over(inside))
    return out.withColumn(name, handed).drop("_run", "_said", "_enter", "_whole")
