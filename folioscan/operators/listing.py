"""Lists as a user sees them: newest conversations and documents first, messages oldest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import carry


def listed(df: DataFrame, keys: list[str], ms: str, newest_first: bool = True, step_ms: int = 3_600_000) -> DataFrame:
    """Adds ``place``, the 1-based place of a row in the list of its key.

    Places are counted per block of time and continued from block to block, so
    the longest list is numbered by many tasks. Ties go by id in the same direction.
    """
    sign = -1 if newest_first else 1
    rows = df.withColumn("_at", F.col(ms) * sign).withColumn("_id", F.col("id") * sign)
    rows = rows.withColumn("_block", F.floor(F.col("_at") / step_ms))
    rows = carry.numbered(rows, keys, "_block", ["_at", "_id"], "place")
    return rows.withColumn("place", F.col("place") + 1).drop("_at", "_id", "_block")
