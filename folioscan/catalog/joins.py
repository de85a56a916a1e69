"""Joins between conversations, documents, decks and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conversations as C
from ..operators import scope
from . import query


@query("join_conversation_docs", """SELECT c.id, c.user_id, coalesce(string_agg(d.document_id::VARCHAR, ',' ORDER BY d.document_id), '') AS document_ids
 FROM fx_conversations c LEFT JOIN fx_conversation_documents d ON d.conversation_id = c.id GROUP BY 1, 2""")
def _(t):
    out = C.with_documents(t.conversations, t.conversation_documents)
    return out.select("id", "user_id", F.array_join(F.col("document_ids").cast("array<string>"), ",").alias("document_ids"))


@query("join_scope_resolve", """SELECT question_id, coalesce(array_to_string(ids, ','), '') AS doc_ids, doc_id,
 CASE WHEN len(ids) > 0 THEN len(ids) WHEN doc_id IS NOT NULL THEN 1 ELSE 0 END AS n_docs
 FROM (SELECT q.question_id, CASE WHEN q.turn % 6 = 2 THEN [q.turn, q.question_id] ELSE s.ids END AS ids, v.document_id AS doc_id
 FROM (SELECT *, CASE WHEN question_id % 10 = 4 THEN user_id + 1 ELSE user_id END AS asker FROM fx_questions) q
 LEFT JOIN fx_conversations v ON v.id = q.conversation_id AND v.user_id = q.asker
 LEFT JOIN (SELECT conversation_id, list(document_id ORDER BY document_id) AS ids FROM fx_conversation_documents GROUP BY 1) s
 ON s.conversation_id = v.id)""")
def _(t):
    sent = F.when(F.col("turn") % 6 == 2, F.array("turn", "question_id")).otherwise(F.array().cast("array<long>"))
    asker = F.when(F.col("question_id") % 10 == 4, F.col("user_id") + 1).otherwise(F.col("user_id"))
    asked = t.questions.withColumn("request_ids", sent).withColumn("user_id", asker)
    out = scope.resolved_scope(asked, t.conversations, t.conversation_documents)
    ids = F.coalesce(F.array_join(F.col("doc_ids").cast("array<string>"), ","), F.lit(""))
    return out.select("question_id", ids.alias("doc_ids"), "doc_id", "n_docs")


@query("join_deck_cards", """SELECT d.id, d.user_id, count(c.id) AS n_cards,
 coalesce(string_agg(c.id || ':' || c.question, '|' ORDER BY c.created_ms, c.id), '') AS cards
 FROM fx_decks d LEFT JOIN fx_cards c ON c.deck_id = d.id GROUP BY 1, 2""")
def _(t):
    out = C.decks_with_cards(t.decks, t.cards)
    shown = F.transform("cards", lambda c: F.concat(c["card_id"].cast("string"), F.lit(":"), c["question"]))
    return out.select("id", "user_id", F.size("cards").cast("long").alias("n_cards"), F.array_join(shown, "|").alias("cards"))


@query("join_owned", """SELECT q.question_id, v.id IS NOT NULL AS is_owned FROM fx_questions q LEFT JOIN fx_conversations v
 ON v.id = q.conversation_id AND v.user_id = CASE WHEN q.turn % 4 = 2 THEN q.user_id + 1 ELSE q.user_id END""")
def _(t):
    asker = F.when(F.col("turn") % 4 == 2, F.col("user_id") + 1).otherwise(F.col("user_id"))
    asked = t.questions.select("question_id", asker.alias("user_id"), F.col("conversation_id").alias("resource_id"))
    good, bad = C.owned(asked, t.conversations)
    out = good.withColumn("is_owned", F.lit(True)).unionByName(bad.withColumn("is_owned", F.lit(False)))
    return out.select("question_id", "is_owned")


@query("join_rls_subquery", """SELECT id, deck_id, question FROM fx_cards
 WHERE deck_id IN (SELECT id FROM fx_decks WHERE user_id = (SELECT min(user_id) FROM fx_decks))""")
def _(t):
    user = t.decks.agg(F.min("user_id")).first()[0]
    return C.visible_children(t.cards, t.decks, "deck_id", user).select("id", "deck_id", "question")


@query("join_fetch_ids", """SELECT id, content FROM fx_chunks WHERE id IN (SELECT document_id * 100000 + position * 2 FROM fx_evidence)""")
def _(t):
    wanted = t.evidence.select((F.col("document_id") * 100000 + F.col("position") * 2).alias("id"))
    return C.fetch(t.chunks, wanted).select("id", "content")


GONE = {"fx_gone": "SELECT id AS document_id FROM fx_documents WHERE status = 'partial'",
        "fx_lost": "SELECT id AS conversation_id FROM fx_conversations WHERE document_id IN (SELECT document_id FROM fx_gone)"}


CASCADE = """SELECT 'documents' AS name, count(*) AS n, sum(id)::BIGINT AS ids FROM fx_documents WHERE id NOT IN (SELECT document_id FROM fx_gone)
 UNION ALL SELECT 'chunks', count(*), sum(id)::BIGINT FROM fx_chunks WHERE document_id NOT IN (SELECT document_id FROM fx_gone)
 UNION ALL SELECT 'conversations', count(*), sum(id)::BIGINT FROM fx_conversations WHERE id NOT IN (SELECT conversation_id FROM fx_lost)
 UNION ALL SELECT 'conversation_documents', count(*), sum(conversation_id * 100000 + document_id)::BIGINT FROM fx_conversation_documents
 WHERE document_id NOT IN (SELECT document_id FROM fx_gone) AND conversation_id NOT IN (SELECT conversation_id FROM fx_lost)
 UNION ALL SELECT 'messages', count(*), sum(id)::BIGINT FROM fx_messages WHERE conversation_id NOT IN (SELECT conversation_id FROM fx_lost)
 UNION ALL SELECT 'summaries', count(*), sum(id)::BIGINT FROM fx_summary_log WHERE (document_id IS NULL OR document_id NOT IN
 (SELECT document_id FROM fx_gone)) AND (conversation_id IS NULL OR conversation_id NOT IN (SELECT conversation_id FROM fx_lost))
 UNION ALL SELECT 'flashcard_decks', count(*), sum(id)::BIGINT FROM fx_decks WHERE document_id NOT IN (SELECT document_id FROM fx_gone)
 UNION ALL SELECT 'flashcards', count(*), sum(id)::BIGINT FROM fx_cards WHERE deck_id NOT IN (SELECT document_id FROM fx_gone)"""


def cascade_tables(t) -> dict:
    return {"documents": t.documents, "chunks": t.bare_chunks, "conversations": t.conversations,
            "conversation_documents": t.conversation_documents, "messages": t.messages, "summaries": t.summary_log,
            "flashcard_decks": t.decks, "flashcards": t.cards}


def cascade_counts(left: dict):
    """Rows and the sum of their ids, per table."""
    out = None
    for name, df in left.items():
        key = F.col("id") if "id" in df.columns else F.col("conversation_id") * 100000 + F.col("document_id")
        row = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(key).alias("ids"))
        out = row if out is None else out.unionByName(row)
    return out


@query("join_cascade_delete", CASCADE, views=GONE)
def _(t):
    return cascade_counts(C.delete_documents(cascade_tables(t), t.documents.where(F.col("status") == "partial")))


@query("join_citation_evidence", """SELECT s.message_id, s.chunk_id, e.chunk_id IS NOT NULL AS has_evidence, e.content
 FROM (SELECT message_id, chunk_id + CASE WHEN position = 1 THEN 50000 ELSE 0 END AS chunk_id FROM fx_evidence) s
 LEFT JOIN fx_evidence e USING (message_id, chunk_id)""")
def _(t):
    moved = F.col("chunk_id") + F.when(F.col("position") == 1, 50000).otherwise(0)
    cited = t.evidence.select("message_id", moved.alias("chunk_id"))
    out = C.cited_evidence(cited, t.evidence.select("message_id", "chunk_id", "content"))
    return out.select("message_id", "chunk_id", F.col("content").isNotNull().alias("has_evidence"), "content")


NORM = r"""trim(regexp_replace(regexp_replace(replace(replace(lower({x}), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s]', '', 'g'))"""


@query("join_span_match", f"""SELECT DISTINCT chunk_id, document_id, page_number, line_no, line FROM (
 SELECT chunk_id, document_id, page_number, pos - 1 AS line_no, line, {NORM.format(x='content')} AS c, {NORM.format(x='line')} AS l
 FROM (SELECT e.chunk_id, e.document_id, e.page_number, e.content, unnest(string_split(p.text, chr(10))) AS line,
 generate_subscripts(string_split(p.text, chr(10)), 1) AS pos FROM (SELECT DISTINCT chunk_id, document_id, page_number, content FROM fx_evidence) e
 JOIN fx_pages p USING (document_id, page_number))) WHERE length(l) >= 4 AND contains(c, l)""")
def _(t):
    cited = t.evidence.select("chunk_id", "document_id", "page_number", "content").distinct()
    out = C.marked_lines(cited, t.pages)
    return out.select("chunk_id", "document_id", "page_number", F.col("line_no").cast("long"), "line")


@query("win_recent_messages", """SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_ms, id) AS nth
 FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_ms DESC, id DESC) AS back FROM fx_messages) WHERE back <= 6""")
def _(t):
    return C.recent_messages(t.messages).select("conversation_id", "id", "nth")


@query("win_latest_per_key", """SELECT job_id, user_id, written_ms, status FROM fx_result_log QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY written_ms DESC, seq DESC) = 1""")
def _(t):
    return C.latest(t.result_log, ["job_id"], ["written_ms", "seq"]).select("job_id", "user_id", "written_ms", "status")


@query("win_doc_ordinal", """SELECT q.query_id, e.document_id, greatest(coalesce(list_position(q.doc_ids, e.document_id), 0) - 1, 0) % 5 AS colour
 FROM fx_scoped_queries q JOIN (SELECT DISTINCT v.id AS conversation_id, v.document_id FROM fx_conversations v WHERE document_id IS NOT NULL
 UNION SELECT * FROM fx_conversation_documents) e USING (conversation_id) WHERE q.doc_ids IS NOT NULL""")
def _(t):
    legacy = t.conversations.where(F.col("document_id").isNotNull()).select(F.col("id").alias("conversation_id"), "document_id")
    shown = legacy.unionByName(t.conversation_documents).distinct()
    rows = t.scoped_queries.where(F.col("doc_ids").isNotNull()).join(shown, "conversation_id")
    return rows.select("query_id", "document_id", C.document_ordinal(F.col("document_id"), F.col("doc_ids")).alias("colour"))


@query("set_voice_union", """SELECT id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN voice_url IS NULL THEN [] ELSE [voice_url] END,
 coalesce(voice_urls, [])))), ' ') AS urls FROM fx_messages""")
def _(t):
    urls = F.array_sort(C.voice_urls(F.col("voice_url"), F.col("voice_urls")))
    return t.messages.select("id", F.array_join(urls, " ").alias("urls"))


@query("agg_voice_files", """SELECT DISTINCT conversation_id, object_key FROM (SELECT conversation_id,
 regexp_extract(u, '^https://[^/]+/([^?]*)', 1) AS object_key FROM (SELECT conversation_id, unnest(list_concat([voice_url], coalesce(voice_urls, []))) AS u
 FROM fx_messages) WHERE u IS NOT NULL) WHERE object_key LIKE 'audio/%'""")
def _(t):
    return C.voice_keys(t.messages)
