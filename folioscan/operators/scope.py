"""Who may see what: tenant, document scope, ready documents, request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..sizing import join_sized

STYLES = ("concise", "explanatory", "conversational")
ROLES = ("user", "assistant")
READY = "ready"


def of_tenant(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") == user_id)


def in_scope(document_id: Column, doc_ids: Column, doc_id: Column) -> Column:
    """Id list before single id before no restriction."""
    return (
        F.when(doc_ids.isNotNull(), F.array_contains(doc_ids, document_id))
        .when(doc_id.isNotNull(), document_id == doc_id)
        .otherwise(F.lit(True))
    )


def asked_documents(queries: DataFrame, document_kind: str) -> tuple[DataFrame, DataFrame]:
    """(questions over some documents, one row per question and ``document_id``; questions over all documents of their user).

    An id list counts before a single id, an empty list asks about nothing. Joins on (user, document) meet the documents asked about and no others.
    """
    for name, kind in (("doc_ids", f"array<{document_kind}>"), ("doc_id", document_kind)):
        column = F.col(name) if name in queries.columns else F.lit(None)
        queries = queries.withColumn(name, column.cast(kind))
    one = F.when(F.col("doc_id").isNotNull(), F.array("doc_id"))
    held = queries.withColumn("_docs", F.coalesce(F.array_distinct("doc_ids"), one)).drop("doc_ids", "doc_id")
    limited = held.where("_docs IS NOT NULL").withColumn("document_id", F.explode("_docs")).where("document_id IS NOT NULL")
    return limited.drop("_docs"), held.where("_docs IS NULL").drop("_docs")


def on_page(pages: Column, page_number: Column, wanted: Column) -> Column:
    """The passage touches the page: listed, or the only page when there is no list."""
    return F.coalesce(F.array_contains(pages, wanted), F.lit(False)) | (
        pages.isNull() & (page_number == wanted)
    )


def heading_like(heading: Column, pattern: Column) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the pattern stay wildcards."""
    return heading.ilike(F.concat(F.lit("%"), pattern, F.lit("%"))) if isinstance(pattern, str) else F.call_function(
        "ilike", heading, F.concat(F.lit("%"), pattern, F.lit("%"))
    )


def ready_documents(documents: DataFrame) -> DataFrame:
    return documents.where(F.col("status") == READY)


def users_with_ready_documents(users: DataFrame, documents: DataFrame) -> DataFrame:
    """Users that own at least one ready document. The owners are made distinct first,
    so a user with very many documents sends one row per task."""
    owners = ready_documents(documents).select("user_id").distinct()
    return users.join(owners, "user_id", "left_semi")


def checked_requests(requests: DataFrame, max_chars: int = 2000) -> DataFrame:
    """Adds ``reject_reason`` (NULL when accepted) and the effective style."""
    question = strip(F.coalesce(F.col("question"), F.lit("")))
    reason = (
        F.when(question == "", "question is empty")
        .when(F.col("conversation_id").isNull(), "conversation is missing")
        .when(F.length(question) > max_chars, "question is too long")
        .when(~F.lower(F.coalesce(F.col("filename"), F.lit("x.pdf"))).endswith(".pdf"), "file is not a PDF")
    )
    style = F.when(F.col("response_style").isin(*STYLES), F.col("response_style")).otherwise("explanatory")
    return requests.withColumn("reject_reason", reason).withColumn("response_style", style)


def role_violations(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a known role, rows with any other role)."""
    known = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    return messages.where(known), messages.where(~known)


def resolved_scope(requests: DataFrame, conversations: DataFrame, links: DataFrame) -> DataFrame:
    """Effective documents of each request.

    Ids sent along win; otherwise the documents linked to the conversation, but
    only if the asking user owns it; otherwise its single legacy document. Only
    the conversations of the batch are looked at.
    """
    asked = requests.select("conversation_id").distinct()
    owned = join_sized(
        conversations.select(F.col("id").alias("conversation_id"), "user_id", F.col("document_id").alias("_legacy")),
        asked, ["conversation_id"], "left_semi",
    )
    linked = join_sized(links, asked, ["conversation_id"], "left_semi", F.xxhash64("document_id")).groupBy(
        "conversation_id"
    ).agg(F.sort_array(F.collect_set("document_id")).alias("_linked"))
    known = owned.join(linked, "conversation_id", "left")
    out = requests.join(known, ["conversation_id", "user_id"], "left")
    some = F.when(F.size("request_ids") > 0, F.col("request_ids"))
    out = out.withColumn("doc_ids", F.coalesce(some, F.when(F.size("_linked") > 0, F.col("_linked"))))
    n_docs = F.when(F.col("doc_ids").isNotNull(), F.size("doc_ids")).otherwise(
        F.when(F.col("_legacy").isNotNull(), 1).otherwise(0)
    )
    return (
        out.withColumn("n_docs", n_docs.cast("long"))
        .withColumn("doc_id", F.col("_legacy"))
        .drop("_linked", "_legacy")
    )


def is_named(text: Column) -> Column:
    return ~is_blank(text)
