"""Conversations, messages, decks, ownership and deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import audio_key
from ..functions.text import normalise
from ..session import write_table
from ..sizing import join_sized
from .toplists import best_row, top_per

HISTORY_MESSAGES = 6


def with_documents(conversations: DataFrame, links: DataFrame) -> DataFrame:
    """Conversations with the ids of their documents; none gives an empty array."""
    lists = links.groupBy(F.col("conversation_id").alias("id")).agg(
        F.sort_array(F.collect_set("document_id")).alias("document_ids")
    )
    return conversations.join(lists, "id", "left").withColumn(
        "document_ids", F.coalesce("document_ids", F.array().cast("array<long>"))
    )


def decks_with_cards(decks: DataFrame, cards: DataFrame) -> DataFrame:
    """Decks with their cards in order of creation; a deck holds the cards of one model response."""
    lists = cards.groupBy(F.col("deck_id").alias("id")).agg(
        F.array_sort(F.collect_list(F.struct("created_ms", F.col("id").alias("card_id"), "question", "answer")))
        .alias("cards")
    )
    none = F.array().cast("array<struct<created_ms:bigint,card_id:bigint,question:string,answer:string>>")
    return decks.join(lists, "id", "left").withColumn("cards", F.coalesce("cards", none))


def owned(requests: DataFrame, resources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests whose resource belongs to the user, the others)."""
    held = resources.select(F.col("id").alias("resource_id"), "user_id")
    on = ["resource_id", "user_id"]
    return requests.join(held, on, "left_semi"), requests.join(held, on, "left_anti")


def visible_children(children: DataFrame, parents: DataFrame, parent_key: str, user_id) -> DataFrame:
    """Rows whose parent belongs to the user."""
    mine = parents.where(F.col("user_id") == user_id).select(F.col("id").alias(parent_key))
    return children.join(mine, parent_key, "left_semi")


def visible_pairs(children: DataFrame, parents: DataFrame, parent_key: str) -> DataFrame:
    """Batch form for all users at once: each child with the user who may see it."""
    return children.join(parents.select(F.col("id").alias(parent_key), "user_id"), parent_key)


def fetch(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Passages of an id batch; ids that are gone are ignored."""
    return join_sized(chunks, wanted.select("id").distinct(), ["id"], "left_semi", spread=F.xxhash64("id"))


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """What is left of every table when the documents ``gone`` (id) are deleted.

    Conversations go with their legacy document; links go with either side;
    messages and conversation summaries go with the conversation; decks with
    their document or conversation; cards with their deck.
    """
    docs = gone.select(F.col("id").alias("document_id")).distinct()
    left: dict[str, DataFrame] = {}
    left["documents"] = join_sized(tables["documents"], docs.withColumnRenamed("document_id", "id"), ["id"], "left_anti")
    left["chunks"] = join_sized(tables["chunks"], docs, ["document_id"], "left_anti", F.xxhash64("id"))
    lost = (
        tables["conversations"].join(docs, "document_id", "left_semi").select(F.col("id").alias("conversation_id"))
    )
    docs, lost = write_table(docs, "gone-documents"), write_table(lost, "gone-conversations")
    left["conversations"] = join_sized(
        tables["conversations"], lost.withColumnRenamed("conversation_id", "id"), ["id"], "left_anti", F.xxhash64("id")
    )

    def without(name: str) -> DataFrame:
        kept = join_sized(tables[name], docs, ["document_id"], "left_anti", F.xxhash64(*tables[name].columns))
        return join_sized(kept, lost, ["conversation_id"], "left_anti", F.xxhash64(*kept.columns))

    left["conversation_documents"] = without("conversation_documents")
    left["messages"] = join_sized(tables["messages"], lost, ["conversation_id"], "left_anti", F.xxhash64("id"))
    left["summaries"] = without("summaries")
    left["flashcard_decks"] = without("flashcard_decks")
    lost_decks = write_table(
        tables["flashcard_decks"].join(left["flashcard_decks"], "id", "left_anti").select(F.col("id").alias("deck_id")),
        "gone-decks",
    )
    left["flashcards"] = join_sized(tables["flashcards"], lost_decks, ["deck_id"], "left_anti", F.xxhash64("id"))
    return left


def cited_evidence(sources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every cited source with its evidence row, where the message kept one."""
    return sources.join(evidence, ["message_id", "chunk_id"], "left")


def marked_lines(cited: DataFrame, pages: DataFrame, min_chars: int = 4) -> DataFrame:
    """Lines of the cited page that occur in the cited passage, after normalising both.

    Each citation meets one page row; its lines are tried in place.
    """
    text = cited.withColumn("_passage", normalise(F.col("content")))
    met = text.join(pages.select("document_id", "page_number", F.col("text").alias("_page")),
                    ["document_id", "page_number"])
    lines = met.select(
        *[c for c in cited.columns], "_passage", F.posexplode(F.split("_page", "\n")).alias("line_no", "line")
    ).withColumn("_line", normalise(F.col("line")))
    hit = (F.length("_line") >= min_chars) & F.contains(F.col("_passage"), F.col("_line"))
    return lines.where(hit).drop("_passage", "_line")


def recent_messages(messages: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """The last ``n`` messages of each conversation, numbered oldest first."""
    few = top_per(messages, ["conversation_id"], [F.col("created_ms").desc(), F.col("id").desc()], n, "_back")
    return top_per(few.drop("_back"), ["conversation_id"], [F.col("created_ms").asc(), F.col("id").asc()], n, "nth")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return best_row(df, keys, F.struct(*[F.col(c) for c in order]))


def evidence_of(retrieved: Column) -> Column:
    """Audit fields of retrieved passages; the vector is left behind."""
    return F.transform(
        retrieved,
        lambda c: F.struct(
            c["id"].alias("id"), c["document_id"].alias("document_id"), c["content"].alias("content"),
            c["page_number"].alias("page_number"), c["filename"].alias("filename"),
            c["heading"].alias("section"), c["rrf_score"].alias("rrf_score"),
        ),
    )


def sources_of(evidence: Column) -> Column:
    """Citation rows of stored evidence."""
    return F.transform(
        evidence,
        lambda c: F.struct(
            c["id"].alias("chunk_id"), c["document_id"].alias("document_id"), c["page_number"].alias("page_number"),
            F.coalesce(c["filename"], F.lit("")).alias("filename"), c["section"].alias("section"),
            F.coalesce(c["content"], F.lit("")).alias("snippet"),
        ),
    )


def with_sources(messages: DataFrame) -> DataFrame:
    """Assistant messages without sources take them from their evidence."""
    lacking = (F.col("role") == "assistant") & (F.coalesce(F.size("sources"), F.lit(0)) <= 0)
    some = F.coalesce(F.size("retrieved_chunks"), F.lit(0)) > 0
    return messages.withColumn(
        "sources", F.when(lacking & some, sources_of(F.col("retrieved_chunks"))).otherwise(F.col("sources"))
    )


def voice_urls(single: Column, many: Column) -> Column:
    """All voice URLs of a message, each once."""
    none = F.array().cast("array<string>")
    one = F.when(single.isNotNull(), F.array(single)).otherwise(none)
    return F.array_union(one, F.coalesce(many, none))


def voice_keys(messages: DataFrame) -> DataFrame:
    """Distinct audio object keys of each conversation."""
    urls = messages.select("conversation_id", F.explode(voice_urls(F.col("voice_url"), F.col("voice_urls"))).alias("u"))
    return (
        urls.select("conversation_id", audio_key(F.col("u")).alias("object_key"))
        .where(F.col("object_key").isNotNull())
        .distinct()
    )


def document_ordinal(document_id: Column, all_ids: Column, colours: int = 5) -> Column:
    """Stable place of a document in its set, cycling; unknown ids take place 0."""
    at = F.coalesce(F.array_position(all_ids, document_id), F.lit(0))
    return F.pmod(F.greatest(at - 1, F.lit(0)), F.lit(colours)).cast("long")


def touched(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Conversations with ``updated_ms`` moved to their newest message."""
    newest = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.max("created_ms").alias("_newest"))
    return (
        conversations.join(newest, "id", "left")
        .withColumn("updated_ms", F.greatest(F.col("updated_ms"), F.coalesce("_newest", F.col("updated_ms"))))
        .drop("_newest")
    )
