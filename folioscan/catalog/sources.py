"""Sources and sinks over messages and rows made from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import cards, conversations
from ..session import fresh_path
from ..sources import sinks
from ..sources import tables as src
from ..sources.keyed import KeyedTable, delete_cascade
from . import query
from .joins import CASCADE, GONE, cascade_counts, cascade_tables


def upload_bodies(t):
    """Notifications for every document; every third one is wrapped in an outer message.

    Every fourth one holds a second record, of another file of the document.
    """
    d = F.col("id").cast("string")
    key = F.concat(F.lit("uploads/u"), F.col("user_id").cast("string"), F.lit("/"), d, F.lit("/my+file%20"), d, F.lit(".pdf"))

    def record(key):
        return F.struct(F.struct(F.struct(F.lit("box").alias("name")).alias("bucket"), F.struct(key.alias("key")).alias("object")).alias("s3"))

    two = F.array(record(key), record(F.regexp_replace(key, "my\\+file", "more")))
    inner = F.to_json(F.struct(F.when(F.col("id") % 4 == 1, two).otherwise(F.array(record(key))).alias("Records")))
    body = F.when(F.col("id") % 3 == 0, F.to_json(F.struct(inner.alias("Message")))).otherwise(inner)
    return t.documents.select("id", body.alias("body"))


@query("src_upload_events", """SELECT id, 'box' AS bucket, 'uploads/u' || user_id || '/' || id || '/my file ' || id || '.pdf' AS object_key,
 'u' || user_id AS user_id, id::VARCHAR AS document_id, 'my file ' || id || '.pdf' AS filename FROM fx_documents
 UNION ALL SELECT id, 'box', 'uploads/u' || user_id || '/' || id || '/more ' || id || '.pdf', 'u' || user_id, id::VARCHAR, 'more ' || id || '.pdf'
 FROM fx_documents WHERE id % 4 = 1""")
def _(t):
    return src.decoded_uploads(upload_bodies(t)).select("id", "bucket", "object_key", "user_id", "document_id", "filename")


@query("src_pages", "SELECT document_id, user_id, filename, page_number, text, has_images FROM fx_pages")
def _(t):
    path = fresh_path(t.spark, "pages")
    t.pages.write.parquet(path)
    return src.read_pages(t.spark, path)


@query("src_chunks", """SELECT id, document_id, content FROM fx_chunks WHERE user_id = (SELECT max(user_id) FROM fx_documents)""")
def _(t):
    path = fresh_path(t.spark, "chunks")
    sinks.append_chunks(t.chunks.drop("embedding"), path)
    user = t.documents.agg(F.max("user_id")).first()[0]
    return src.read_chunks(t.spark, path, user).select("id", "document_id", "content")


@query("src_embed_jobs", """SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'finalize' ELSE 'embed' END AS message_type,
 user_id::VARCHAR AS document_id, CASE WHEN event_id % 5 = 2 THEN 0 ELSE 2 END AS n_ids, CASE WHEN event_id % 5 = 3 THEN event_id ELSE 0 END AS batch_num FROM events""")
def _(t):
    e = F.col("event_id")
    body = F.to_json(F.struct(
        F.when(e % 5 == 2, "finalize").when(e % 5 == 3, "embed").alias("message_type"), F.col("user_id").cast("string").alias("document_id"),
        F.when(e % 5 != 2, F.array(e.cast("string"), F.lit("x"))).alias("chunk_ids"), F.when(e % 5 == 3, e).alias("batch_num"),
    ))
    jobs = src.decoded_embed_jobs(t.raw("events").select("event_id", body.alias("body")))
    embed, final = src.split_by_type(jobs)
    return embed.unionByName(final).select(
        "event_id", "message_type", "document_id", F.size("chunk_ids").cast("int").alias("n_ids"), "batch_num"
    )


@query("src_query_jobs", """SELECT question_id, 'j' || question_id AS job_id, question AS query, question_id % 4 = 2 AS voice_mode,
 CASE WHEN question_id % 3 = 0 THEN 'concise' ELSE 'explanatory' END AS response_style, CASE WHEN question_id % 7 = 0 THEN 1 ELSE 0 END AS n_ids FROM fx_questions""")
def _(t):
    q = F.col("question_id")
    body = F.to_json(F.struct(
        F.concat(F.lit("j"), q.cast("string")).alias("job_id"), F.col("question").alias("query"), F.col("user_id").cast("string").alias("user_id"),
        F.when(q % 4 == 2, True).alias("voice_mode"), F.when(q % 3 == 0, "concise").alias("response_style"),
        F.when(q % 7 == 0, F.array(q.cast("string"))).alias("document_ids"),
    ))
    jobs = src.decoded_query_jobs(t.questions.select("question_id", body.alias("body")))
    return jobs.select("question_id", "job_id", "query", "voice_mode", "response_style", F.size("document_ids").cast("int").alias("n_ids"))


@query("sink_chunks", "SELECT id, document_id, user_id, content, true AS no_vector, len(list_distinct(regexp_extract_all(content, 'a'))) AS has_a FROM fx_chunks")
def _(t):
    path = fresh_path(t.spark, "chunks")
    rows = t.chunks.drop("embedding")
    cut = F.col("document_id") % 2 == 0
    sinks.append_chunks(rows.where(cut), path)
    sinks.append_chunks(rows.where(~cut), path)
    stored = t.spark.read.parquet(path)
    return stored.select(
        "id", "document_id", "user_id", "content", F.col("embedding").isNull().alias("no_vector"),
        F.size(F.array_distinct(F.regexp_extract_all("content", F.lit("(a)"), 1))).cast("int").alias("has_a"),
    )


@query("sink_embedding_backfill", """SELECT c.id, CASE WHEN c.embedding IS NOT NULL THEN 'kept' WHEN n.vec_id IS NOT NULL THEN 'filled' ELSE 'missing' END AS state,
 round(coalesce(c.embedding, n.embedding)[1]::DOUBLE, 6) AS first FROM fx_chunks c LEFT JOIN embeddings n ON c.embedding IS NULL AND n.vec_id = c.id % 1000""")
def _(t):
    path = fresh_path(t.spark, "backfilled")
    sinks.append_chunks(t.chunks.select("id", "user_id", "document_id", "embedding", F.col("embedding").isNotNull().alias("had")), path)
    lacking = src.read_chunks(t.spark, path).where(F.col("embedding").isNull()).select("id", "user_id", (F.col("id") % 1000).alias("vec_id"))
    sinks.append_vectors(lacking.join(t.raw("embeddings").select("vec_id", "embedding"), "vec_id"), path)
    out = src.read_chunks(t.spark, path)
    state = F.when(F.col("had"), "kept").when(F.col("embedding").isNotNull(), "filled").otherwise("missing")
    return out.select("id", state.alias("state"), F.round(F.get("embedding", 0).cast("double"), 6).alias("first"))


def _twice(table, rows, first):
    """A keyed table after its later rows were written, then its first, then the later ones once more."""
    for some in (~first, first, ~first):
        table.upsert(rows.where(some))
    return table.read()


STATUS = "CASE event_id % 3 WHEN 0 THEN 'processing' WHEN 1 THEN 'indexing' ELSE 'ready' END"


@query("sink_doc_status", f"""SELECT user_id AS document_id, {STATUS} AS status, ms AS written_ms FROM fx_events
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ms DESC, event_id DESC) = 1""")
def _(t):
    e = F.col("event_id")
    status = F.when(e % 3 == 0, "processing").when(e % 3 == 1, "indexing").otherwise("ready")
    log = t.events.select(F.col("user_id").alias("document_id"), status.alias("status"), F.col("ms").alias("written_ms"), e.alias("seq"))
    held = sinks.status_table(t.spark, fresh_path(t.spark, "status"))
    return _twice(held, log, e % 2 == 0).select("document_id", "status", "written_ms")


@query("sink_messages", """SELECT conversation_id, role, content, created_ms, n_evidence FROM (
 SELECT conversation_id, 'user' AS role, 'q ' || id AS content, created_ms, NULL::BIGINT AS n_evidence FROM fx_messages WHERE id IN (SELECT message_id FROM fx_evidence)
 UNION ALL SELECT m.conversation_id, 'assistant', m.content, m.created_ms + 1, n FROM fx_messages m
 JOIN (SELECT message_id, count(*) AS n FROM fx_evidence GROUP BY 1) e ON e.message_id = m.id)""")
def _(t):
    said = t.messages.select("id", "conversation_id", "user_id", "content", "created_ms")
    exchanges = t.with_evidence(said.join(t.asked.withColumnRenamed("message_id", "id"), "id")).select(
        "conversation_id", "user_id", F.concat(F.lit("q "), F.col("id").cast("string")).alias("question"),
        F.col("content").alias("answer"), F.col("evidence").alias("retrieved"), F.col("created_ms").alias("asked_ms"),
    )
    out = _twice(sinks.message_table(t.spark, fresh_path(t.spark, "messages")), sinks.message_rows(exchanges), F.col("role") == "user")
    n = F.when(F.col("retrieved_chunks").isNotNull(), F.size("retrieved_chunks").cast("long"))
    return out.select("conversation_id", "role", "content", "created_ms", n.alias("n_evidence"))


@query("sink_conversation", r"""SELECT v.id, v.user_id, CASE WHEN length(q) > 40 THEN regexp_replace(substring(q, 1, 40), '\s+$', '') || '…' WHEN q = '' THEN 'New Conversation' ELSE q END AS title,
 f.first AS document_id, d.document_id AS linked, greatest(v.updated_ms, coalesce(m.newest, 0)) AS updated_ms
 FROM (SELECT *, regexp_replace(regexp_replace(coalesce(question, ''), '^\s+', ''), '\s+$', '') AS q FROM fx_conversations) v
 LEFT JOIN (SELECT conversation_id, min(document_id) AS first FROM fx_conversation_documents GROUP BY 1) f ON f.conversation_id = v.id
 LEFT JOIN fx_conversation_documents d ON d.conversation_id = v.id
 LEFT JOIN (SELECT conversation_id, max(created_ms) AS newest FROM fx_messages GROUP BY 1) m ON m.conversation_id = v.id""")
def _(t):
    asked = conversations.with_documents(t.conversations.drop("document_id"), t.conversation_documents).withColumnRenamed("id", "conversation_id")
    made, links = sinks.conversation_rows(asked, text.conversation_title(F.coalesce("question", F.lit(""))))
    made = conversations.touched(made, t.messages)
    kept, kept_links = sinks.conversation_tables(t.spark, fresh_path(t.spark, "conversations"))
    made = _twice(kept, made, F.col("id") % 3 == 0)
    links = _twice(kept_links, links, F.col("position") == 0)
    linked = links.select(F.col("conversation_id").alias("id"), F.col("document_id").alias("linked"))
    return made.join(linked, "id", "left").select("id", "user_id", "title", "document_id", "linked", "updated_ms")


@query("sink_upsert_summary", """SELECT user_id, source_type, conversation_id, document_id, id, content FROM fx_summary_log
 QUALIFY row_number() OVER (PARTITION BY user_id, source_type, conversation_id, document_id ORDER BY created_ms DESC, id DESC) = 1""")
def _(t):
    held = sinks.summary_table(t.spark, fresh_path(t.spark, "summaries"))
    return _twice(held, t.summary_log, F.col("id") % 2 == 0).select("user_id", "source_type", "conversation_id", "document_id", "id", "content")


@query("sink_deck", r"""WITH fx_w AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '["\\\[\]\x00-\x1f]', '', 'g')) AS w FROM documents),
 fx_c AS (SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS card_no, count(*) OVER (PARTITION BY doc_id) AS n_cards FROM
 (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM fx_w WHERE doc_id % 4 <> 3) WHERE (doc_id + i) % 4 <> 1)
 SELECT sha256((doc_id % 5) || '|document|' || doc_id) AS deck_id, doc_id % 5 AS user_id, 'document' AS source_type, doc_id AS source_id, 'Flashcard Deck' AS title,
 n_cards, card_no, regexp_replace('Q ' || w, '\s+$', '') AS question, regexp_replace('A ' || w, '\s+$', '') AS answer FROM fx_c""")
def _(t):
    """Deck and card rows written, read back and joined."""
    good, _bad = cards.read_responses(t.card_responses)
    decks, rows = fresh_path(t.spark, "decks"), fresh_path(t.spark, "cards")
    cards.deck_rows(good).write.parquet(decks)
    cards.card_rows(good).write.parquet(rows)
    stored = t.spark.read.parquet(decks).withColumnRenamed("id", "deck_id")
    return stored.join(t.spark.read.parquet(rows), "deck_id")


@query("sink_job_result", """SELECT job_id, user_id, status, written_ms FROM (SELECT * FROM fx_result_log QUALIFY row_number() OVER
 (PARTITION BY job_id ORDER BY written_ms DESC, seq DESC) = 1) WHERE written_ms + 86400000 * 10 > (SELECT max(ms) FROM fx_events)""")
def _(t):
    from ..operators import usage

    now = t.events.agg(F.max("ms")).first()[0]
    stored = _twice(sinks.result_table(t.spark, fresh_path(t.spark, "results")), t.result_log, F.col("seq") == 0)
    held = usage.live(stored, F.lit(now), 86_400_000 * 10)
    return held.select("job_id", "user_id", "status", "written_ms")




@query("sink_cascade_delete", f"SELECT name, coalesce(n, 0) AS n, ids FROM ({CASCADE})", views=GONE)
def _(t):
    """All tables written by key, the documents deleted twice, and what is then read."""
    path, by_id = fresh_path(t.spark, "cascade"), ("id",)
    rows = cascade_tables(t)
    keys = {"conversation_documents": ("conversation_id", "document_id"), "summaries": ("id", "source_type")}
    near = {"chunks": ("document_id",), "messages": ("conversation_id",), "flashcards": ("deck_id",)}
    held = {n: KeyedTable(t.spark, f"{path}/{n}", keys.get(n, by_id), by=near.get(n, ())) for n in rows}
    for name, table in held.items():
        table.upsert(rows[name])
    for _ in range(2):
        delete_cascade(held, t.documents.where(F.col("status") == "partial"))
    return cascade_counts({n: table.read() for n, table in held.items()})
