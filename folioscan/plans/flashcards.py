"""Source texts for card decks, and decks from the responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import cards, condense
from ..operators.scope import ready_documents


def source_texts(documents: DataFrame, chunks: DataFrame, messages: DataFrame, part: Column) -> DataFrame:
    """One text per source: the assistant's side of a conversation, or a whole ready document."""
    ready = ready_documents(documents).select(F.col("id").alias("document_id"), "user_id")
    docs = condense.document_text(chunks).join(ready, "document_id").select(
        "user_id", F.lit("document").alias("source_type"), F.col("document_id").alias("source_id"), "text"
    )
    talks = condense.assistant_text(messages, part).select(
        "user_id", F.lit("conversation").alias("source_type"), F.col("conversation_id").alias("source_id"), "text"
    )
    return docs.unionByName(talks).where(F.col("text") != "")


def decks_from(responses: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(decks, cards, responses that gave none)."""
    good, bad = cards.read_responses(responses)
    return cards.deck_rows(good), cards.card_rows(good), bad
