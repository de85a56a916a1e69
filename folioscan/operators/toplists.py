"""Best rows per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every key with their 1-based rank.

    Spark cuts each map task to ``k`` rows per key before the shuffle
    (WindowGroupLimit), so a hot key does not reach one task whole.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position.cast("long")).where(F.col(rank) <= k)


def top_of_lists(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Like :func:`top_per` for lists that were already cut per task.

    With many thousand tasks their lists add up to a large group per key; a
    first round per (key, part) shrinks it before the last one.
    """
    parts = df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(64)))
    few = top_per(parts, keys + ["_part"], order, k, "_first").drop("_first", "_part")
    return top_per(few, keys, order, k, rank)


def best_row(df: DataFrame, keys: list[str], order: Column, newest: bool = True) -> DataFrame:
    """One row per key: the one with the greatest (or least) ``order``.

    A plain aggregate, combined before the shuffle: a key that holds a third of
    the rows sends one row per map task. NULL keys count as equal.
    """
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    out = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return out.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
