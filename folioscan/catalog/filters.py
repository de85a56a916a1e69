"""Projections, filters and predicates; top lists and sorts of the stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import outputs, text
from ..operators import condense, conversations, reports, scope, structure, usage
from ..sources import tables as src
from . import query


@query("flt_tenant", "SELECT user_id, count(*) AS own_chunks, min(id) AS first_id FROM fx_chunks WHERE user_id = (SELECT max(user_id) FROM fx_documents) GROUP BY 1")
def _(t):
    user = t.documents.agg(F.max("user_id")).first()[0]
    return scope.of_tenant(t.chunks, user).groupBy("user_id").agg(F.count("*").alias("own_chunks"), F.min("id").alias("first_id"))


@query("flt_ready_docs", """SELECT q.query_id, EXISTS (SELECT 1 FROM fx_documents d WHERE d.user_id = q.asker AND status = 'ready') AS has_ready
 FROM (SELECT query_id, CASE WHEN query_id % 4 = 3 THEN query_id + 100000 ELSE user_id END AS asker FROM fx_queries) q""")
def _(t):
    asker = F.when(F.col("query_id") % 4 == 3, F.col("query_id") + 100000).otherwise(F.col("user_id"))
    asked = t.queries.select("query_id", asker.alias("user_id"))
    ready = scope.users_with_ready_documents(asked, t.documents).select("query_id", F.lit(True).alias("has_ready"))
    return asked.select("query_id").join(ready, "query_id", "left").withColumn("has_ready", F.coalesce("has_ready", F.lit(False)))


STRIP = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


@query("prj_classify_pages", f"""SELECT document_id, page_number, length(t) AS char_count, CASE WHEN length(t) < 50
 THEN CASE WHEN has_images THEN 'image_only' ELSE 'no_text_layer' END END AS skip_reason
 FROM (SELECT *, {STRIP.format(x='text')} AS t FROM fx_pages)""")
def _(t):
    return structure.classified_pages(t.pages).select("document_id", "page_number", "char_count", "skip_reason")


@query("prj_has_tables", f"""SELECT document_id, page_number, contains(t, chr(9)) OR contains(t, '    ') AS has_tables
 FROM (SELECT *, {STRIP.format(x='text')} AS t FROM fx_marked_pages)""")
def _(t):
    return structure.classified_pages(t.marked_pages).select("document_id", "page_number", "has_tables")


@query("prj_evidence", """SELECT m.id AS message_id, e.position, e.chunk_id, e.document_id, e.page_number, e.filename, e.section,
 e.content AS snippet FROM fx_messages m JOIN fx_evidence e ON e.message_id = m.id WHERE m.turn % 3 > 0 OR e.position = 0""")
def _(t):
    asked = t.messages.select("id", "role", "turn").join(t.asked.withColumnRenamed("message_id", "id"), "id")
    stored = t.with_evidence(asked).select("id", "role", "turn", conversations.evidence_of(F.col("evidence")).alias("retrieved_chunks"))
    held = conversations.sources_of(F.col("retrieved_chunks"))
    given = stored.withColumn("sources", F.when(F.col("turn") % 3 == 0, F.slice(held, 1, 1)))
    shown = conversations.with_sources(given)
    return shown.select(F.col("id").alias("message_id"), F.posexplode("sources").alias("position", "s")).select(
        "message_id", F.col("position").cast("long"), "s.*"
    )


@query("flt_request_valid", f"""SELECT question_id, CASE WHEN style IN ('concise', 'explanatory', 'conversational') THEN style ELSE 'explanatory' END AS response_style,
 CASE WHEN q = '' THEN 'question is empty' WHEN turn % 8 = 4 THEN 'conversation is missing' WHEN length(q) > 2000
 THEN 'question is too long' WHEN NOT lower(file) LIKE '%.pdf' THEN 'file is not a PDF' END AS reject_reason
 FROM (SELECT *, {STRIP.format(x='''repeat(question, CASE WHEN question_id % 5 = 0 THEN 300 ELSE 1 END)''')} AS q,
 CASE turn % 6 WHEN 0 THEN 'concise' WHEN 2 THEN 'loud' ELSE NULL END AS style,
 'f' || turn || CASE WHEN question_id % 7 = 1 THEN '.doc' ELSE '.PDF' END AS file FROM fx_questions)""")
def _(t):
    n, turn = F.col("question_id"), F.col("turn")
    asked = t.questions.select(
        "question_id", F.repeat("question", F.when(n % 5 == 0, 300).otherwise(1)).alias("question"),
        F.when(turn % 8 != 4, F.col("conversation_id")).alias("conversation_id"),
        F.when(turn % 6 == 0, "concise").when(turn % 6 == 2, "loud").alias("response_style"),
        F.concat(F.lit("f"), turn.cast("string"), F.when(n % 7 == 1, ".doc").otherwise(".PDF")).alias("filename"),
    )
    return scope.checked_requests(asked).select("question_id", "response_style", "reject_reason")


@query("flt_job_live", """SELECT e.event_id AS job_id, e.event_type = 'view' AS is_view, CASE WHEN r.written_ms <= e.ms + 1800000 * (e.event_id % 4) AND
 r.written_ms + 3600000 > e.ms + 1800000 * (e.event_id % 4) THEN r.status ELSE 'not_found' END AS status
 FROM fx_events e LEFT JOIN (SELECT job_id, arg_max(status, seq) AS status, max(written_ms) AS written_ms FROM fx_result_log GROUP BY 1) r
 ON r.job_id = e.event_id""")
def _(t):
    from ..sources.sinks import current_results

    asked_ms = F.col("ms") + 1800000 * (F.col("event_id") % 4)
    asked = t.events.select(F.col("event_id").alias("job_id"), (F.col("event_type") == "view").alias("is_view"), asked_ms.alias("asked_ms"))
    return usage.polled(asked, current_results(t.result_log)).select("job_id", "is_view", "status")


BARE = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


@query("flt_valid_cards", f"""SELECT id, {BARE.format(x='question')} AS question, {BARE.format(x='answer')} AS answer FROM fx_cards
 WHERE {BARE.format(x='question')} <> '' AND {BARE.format(x='answer')} <> ''""")
def _(t):
    one = t.cards.select("id", F.array(F.struct("question", "answer")).alias("c"))
    return one.select("id", F.inline(outputs.valid_cards(F.col("c"))))


@query("flt_role_check", """SELECT role IN ('user', 'assistant') AS accepted, role, count(*) AS n FROM conversations GROUP BY 1, 2""")
def _(t):
    good, bad = scope.role_violations(t.raw("conversations"))
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return both.groupBy("accepted", "role").agg(F.count("*").alias("n"))


@query("flt_summaries", """SELECT q.question_id, s.id, s.content FROM fx_questions q JOIN fx_summary_log s ON s.user_id = q.user_id
 AND CASE WHEN q.turn % 4 = 0 THEN s.conversation_id = q.conversation_id ELSE s.document_id = q.conversation_id END""")
def _(t):
    talk = F.col("turn") % 4 == 0
    asked = t.questions.select(
        "question_id", "user_id", F.when(talk, "conversation").otherwise("document").alias("source_type"),
        F.col("conversation_id").alias("source_id"),
    )
    stored = t.summary_log.withColumn("source_id", F.coalesce("conversation_id", "document_id"))
    return asked.join(stored, ["user_id", "source_type", "source_id"]).select("question_id", "id", "content")


@query("flt_upload_size", """SELECT path, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'not a PDF' WHEN size > 52428800 THEN 'too large' END AS reject_reason
 FROM (SELECT 'uploads/' || doc_id % 5 || '/' || doc_id || CASE WHEN doc_id % 11 = 3 THEN '.txt' ELSE '.Pdf' END AS path,
 n_chars * 5000 AS size FROM documents)""")
def _(t):
    d = F.col("doc_id")
    files = t.raw("documents").select(
        F.concat(F.lit("uploads/"), (d % 5).cast("string"), F.lit("/"), d.cast("string"),
                 F.when(d % 11 == 3, ".txt").otherwise(".Pdf")).alias("path"), (F.col("n_chars") * 5000).alias("length"),
    )
    good, bad = src.checked_files(files)
    return good.unionByName(bad).select("path", "reject_reason")


@query("prj_title", f"""SELECT id, CASE WHEN q = '' THEN 'New Conversation' WHEN length(q) > 40
 THEN regexp_replace(substring(q, 1, 40), '\\s+$', '') || '…' ELSE q END AS title
 FROM (SELECT id, {STRIP.format(x='''CASE WHEN id % 9 = 0 THEN '  ' WHEN id % 9 = 1 THEN substring(content, 1, 20) ELSE content END''')} AS q FROM fx_messages)""")
def _(t):
    n = F.col("id")
    q = F.when(n % 9 == 0, "  ").when(n % 9 == 1, F.substring("content", 1, 20)).otherwise(F.col("content"))
    return t.messages.select("id", text.conversation_title(q).alias("title"))


@query("prj_credit_balance", """SELECT u.user_id, u.high, coalesce(p.credits, 0) AS voice_credits
 FROM (SELECT DISTINCT user_id, value > 90 AS high FROM events) u
 LEFT JOIN (SELECT user_id, value > 90 AS high, count(*) AS credits FROM events WHERE event_type = 'signup' GROUP BY 1, 2) p USING (user_id, high)""")
def _(t):
    events = t.raw("events").withColumn("high", F.col("value") > 90)
    users = events.select(F.struct("user_id", "high").alias("user_id")).distinct()
    profiles = events.where(F.col("event_type") == "signup").groupBy(F.struct("user_id", "high").alias("user_id")).agg(F.count("*").alias("voice_credits"))
    return usage.credit_balance(users, profiles).select("user_id.user_id", "user_id.high", "voice_credits")


# Sorts and top lists

@query("sort_recent", """SELECT 'conversation' AS kind, user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY updated_ms DESC, id DESC) AS place FROM fx_conversations
 UNION ALL SELECT 'document', user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_ms DESC, id DESC) FROM fx_documents
 UNION ALL SELECT 'message', user_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_ms, id) FROM fx_messages""")
def _(t):
    from ..operators.listing import listed

    talks = listed(t.conversations, ["user_id"], "updated_ms")
    docs = listed(t.documents, ["user_id"], "created_ms")
    said = listed(t.messages, ["conversation_id"], "created_ms", newest_first=False)
    out = [d.select(F.lit(k).alias("kind"), "user_id", "id", "place") for k, d in
           (("conversation", talks), ("document", docs), ("message", said))]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("sort_lexicographic_index", """SELECT document_id, id, nth FROM (SELECT document_id, id,
 row_number() OVER (PARTITION BY document_id ORDER BY chunk_index::VARCHAR, id) AS nth FROM fx_chunks)""")
def _(t):
    return condense.first_chunks(t.chunks, text_order=True).select("document_id", "id", "nth")


@query("topk_slow_jobs", """SELECT * FROM (SELECT 'slow' AS kind, job_id, duration_ms FROM fx_job_log WHERE duration_ms > 10000
 ORDER BY duration_ms DESC, job_id LIMIT 20) UNION ALL SELECT * FROM (SELECT 'error', job_id, duration_ms FROM fx_job_log
 WHERE status = 'error' ORDER BY ts DESC, job_id DESC LIMIT 50)""")
def _(t):
    slow = reports.slow_jobs(t.job_log, 10_000).select(F.lit("slow").alias("kind"), "job_id", "duration_ms")
    return slow.unionByName(reports.newest_errors(t.job_log).select(F.lit("error").alias("kind"), "job_id", "duration_ms"))
