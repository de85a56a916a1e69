"""Small tables with the awkward rows that every operator must take."""

import random

SF = "/root/testdata/sf0.001"
ALPHA = "abcdefghijklmnopqrstuvwxyz"


def words(rng, n):
    return " ".join("".join(rng.choice(ALPHA) for _ in range(rng.randint(2, 7))) for _ in range(n))


def documents(spark, extra=True):
    """Null ids and texts, empty, blank, one-word, repeated, near-equal and very long texts, clashing column names."""
    rng = random.Random(5)
    long_ = words(rng, 12_000)
    base = words(rng, 120)
    rows = [
        (1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (None, "no id here"), (None, None),
        (8, long_), (9, base), (9, base), (10, "Straße É日本 \U0001f600 " * 30), (11, words(rng, 300)), (12, "a" * 40_000),
    ]
    if not extra:
        return spark.createDataFrame(rows, "doc_id long, text string")
    full = [(i, t, "x", 1, "result", 2.0, "k") for i, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, kept string, fp int, _result string, score double, row string")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
