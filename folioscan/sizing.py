"""Size checks that decide between broadcast and shuffle joins.

A side is broadcast only after its rows and bytes were counted. Beyond the
bound the same join runs as a salted shuffle join, so the result never depends
on which way was taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
BROADCAST_ROWS = 1_000_000
SALTS = 32

_FIXED = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
    T.LongType: 8, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}


def _value_bytes(value: Column, dtype: T.DataType) -> Column:
    for kind, width in _FIXED.items():
        if isinstance(dtype, kind):
            return F.lit(width).cast("long")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)).cast("long")
    if isinstance(dtype, T.ArrayType):
        for kind, width in _FIXED.items():
            if isinstance(dtype.elementType, kind):
                return F.coalesce(F.size(value) * width, F.lit(0)).cast("long")
    return F.coalesce(F.octet_length(F.to_json(F.struct(value.alias("v")))), F.lit(0)).cast("long")


def row_bytes(df: DataFrame) -> Column:
    """Approximate width of one row."""
    total = F.lit(16).cast("long")
    for field in df.schema.fields:
        total = total + _value_bytes(F.col(f"`{field.name}`"), field.dataType)
    return total


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of ``df``: one aggregate job, no rows reach the driver."""
    row = df.select(row_bytes(df).alias("w")).agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES, max_rows: int = BROADCAST_ROWS) -> bool:
    rows, size = measure(df)
    return rows <= max_rows and size <= max_bytes


def join_sized(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    spread: Column | None = None,
    max_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join that broadcasts ``small`` when its measured size allows it.

    Otherwise both sides are shuffled on ``on`` plus a salt: ``spread`` (a hash
    of some unique column of ``big``) deals the rows of a hot key over ``SALTS``
    tasks and ``small`` is repeated once per salt. ``how`` may be inner, left,
    left_semi or left_anti; in all of them each row of ``big`` meets every
    matching row of ``small`` exactly once.
    """
    if fits(small, max_bytes):
        return big.join(F.broadcast(small), on, how)
    if spread is None:
        return big.join(small, on, how)
    salted = big.withColumn("_salt", F.pmod(spread, F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, on + ["_salt"], how).drop("_salt")
