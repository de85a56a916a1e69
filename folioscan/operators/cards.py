"""Card decks from stored model responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.outputs import parse_cards, valid_cards


def read_responses(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(responses with their valid cards, responses that cannot be read or hold no valid card)."""
    parsed = responses.withColumn("cards", valid_cards(parse_cards(F.col("response"))))
    good = F.coalesce(F.size("cards"), F.lit(0)) > 0
    reason = F.when(F.col("cards").isNull(), "no JSON array found").otherwise("no valid cards")
    return parsed.where(good), parsed.where(~good).withColumn("error", reason).drop("cards")


def deck_rows(read: DataFrame) -> DataFrame:
    """Deck headers; the id is derived from the source, so a replay makes the same deck."""
    source = F.concat_ws("|", "user_id", "source_type", "source_id")
    return read.select(
        F.sha2(source, 256).alias("id"), "user_id", "source_type", "source_id",
        F.lit("Flashcard Deck").alias("title"), F.size("cards").cast("long").alias("n_cards"),
    )


def card_rows(read: DataFrame) -> DataFrame:
    source = F.concat_ws("|", "user_id", "source_type", "source_id")
    return read.select(F.sha2(source, 256).alias("deck_id"), F.posexplode("cards").alias("card_no", "_c")).select(
        "deck_id", F.col("card_no").cast("long"), F.col("_c.question").alias("question"), F.col("_c.answer").alias("answer")
    )
