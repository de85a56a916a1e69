"""Aggregates: counts, summaries of a document's state, and texts put together for a model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cards, condense, reports, structure
from ..plans import flashcards, summarize
from . import query


def PART():
    """A coarse step of the order of a conversation's messages."""
    return F.floor(F.col("turn") / 200)


@query("agg_chunk_count", """SELECT d.id, count(c.id) AS chunk_count FROM fx_documents d LEFT JOIN fx_chunks c
 ON c.document_id = d.id GROUP BY 1""")
def _(t):
    return reports.chunk_counts(t.documents, t.chunks).select("id", "chunk_count")


@query("agg_embedding_coverage", """SELECT user_id, count(*) AS total, count(embedding) AS with_embedding,
 count(*) - count(embedding) AS missing_embedding FROM fx_chunks GROUP BY 1""")
def _(t):
    return reports.embedding_coverage(t.chunks, ["user_id"])


@query("agg_extraction_summary", r"""SELECT document_id, count(*) AS total_pages, count(*) FILTER (n >= 50) AS extracted_pages,
 count(*) FILTER (n < 50) AS skipped_count, coalesce(string_agg(page_number::VARCHAR, ',' ORDER BY page_number) FILTER (n < 50), '') AS skipped_pages,
 count(*) FILTER (n >= 50) = 0 AS failed FROM (SELECT *, length(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) AS n FROM fx_pages) GROUP BY 1""")
def _(t):
    out = structure.extraction_summary(structure.classified_pages(t.pages))
    return out.withColumn("skipped_pages", F.array_join(F.col("skipped_pages").cast("array<string>"), ","))


ATTEMPTS = {"fx_attempts": """SELECT document_id, (page_number - 1) // 4 AS window_no, count(*) AS n_chunks,
 (document_id + (page_number - 1) // 4) % 23 = 5 AS chunk_error, (document_id + (page_number - 1) // 4) % 29 = 7 AS store_error
 FROM fx_chunks GROUP BY 1, 2, 4, 5"""}
STATS = """SELECT *, CASE WHEN chunk_error THEN 'chunk_failed' WHEN n_chunks = 0 THEN 'skipped' WHEN store_error THEN 'failed' ELSE 'ok' END AS status FROM fx_attempts"""


@query("agg_window_stats", f"""SELECT s.document_id, s.window_no, s.status AS window_status, CASE WHEN s.status = 'ok' THEN n_chunks ELSE 0 END AS chunks,
 d.windows_total, d.failed_windows, d.chunk_count, CASE WHEN d.failed_windows = 0 THEN 'indexing' ELSE 'partial' END AS document_status
 FROM ({STATS}) s JOIN (SELECT document_id, count(*) AS windows_total, count(*) FILTER (status IN ('failed', 'chunk_failed')) AS failed_windows,
 sum(CASE WHEN status = 'ok' THEN n_chunks ELSE 0 END)::BIGINT AS chunk_count FROM ({STATS}) GROUP BY 1) d USING (document_id)""", views=ATTEMPTS)
def _(t):
    w = F.floor((F.col("page_number") - 1) / 4)
    made = t.chunks.groupBy("document_id", w.alias("window_no")).agg(
        F.count("*").alias("n_chunks")
    )
    tried = made.withColumn("chunk_error", (F.col("document_id") + F.col("window_no")) % 23 == 5).withColumn(
        "store_error", (F.col("document_id") + F.col("window_no")) % 29 == 7
    )
    stats = reports.window_stats(tried)
    docs = reports.document_progress(stats).withColumnRenamed("status", "document_status")
    return stats.select("document_id", "window_no", F.col("status").alias("window_status"), "chunks").join(docs, "document_id")


@query("agg_transcript", """SELECT conversation_id, user_id, count(*) AS n_pieces, string_agg(CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || content,
 chr(10) ORDER BY created_ms, id) AS text FROM fx_messages GROUP BY 1, 2""")
def _(t):
    return condense.transcripts(t.messages, PART())


@query("agg_assistant_text", """SELECT conversation_id, user_id, count(*) AS n_pieces, string_agg(content, chr(10) || chr(10) ORDER BY created_ms, id) AS text
 FROM fx_messages WHERE role = 'assistant' GROUP BY 1, 2""")
def _(t):
    return condense.assistant_text(t.messages, PART())


@query("agg_document_text", """SELECT document_id, count(*) AS n_chunks, sum(length(content))::BIGINT AS total_chars,
 string_agg(content, chr(10) || chr(10) ORDER BY chunk_index, id) AS text FROM (SELECT *, row_number() OVER
 (PARTITION BY document_id ORDER BY chunk_index, id) AS nth FROM fx_chunks) GROUP BY 1""")
def _(t):
    return condense.document_text(t.chunks)


@query("agg_strategy", """SELECT document_id, sum(length(content))::BIGINT AS total_chars,
 CASE WHEN sum(length(content)) < 4000 THEN 'stuff' ELSE 'map_reduce' END AS strategy FROM fx_chunks GROUP BY 1""")
def _(t):
    sizes = t.chunks.groupBy("document_id").agg(F.sum(F.length("content")).alias("total_chars"))
    return sizes.withColumn("strategy", condense.strategy(F.col("total_chars"), 4000))


BATCHES = {
    "fx_first": """SELECT document_id, id, content, length(content) AS n, nth FROM (SELECT *, row_number() OVER
 (PARTITION BY document_id ORDER BY chunk_index, id) AS nth FROM fx_chunks)""",
    "fx_fold": """SELECT document_id, nth, 1::BIGINT AS batch, n::BIGINT AS size FROM fx_first WHERE nth = 1 UNION ALL
 SELECT f.document_id, f.nth, CASE WHEN p.size + f.n > {max} THEN p.batch + 1 ELSE p.batch END,
 CASE WHEN p.size + f.n > {max} THEN f.n ELSE p.size + f.n END FROM fx_fold p JOIN fx_first f ON f.document_id = p.document_id AND f.nth = p.nth + 1""",
}


def _fold(limit: int) -> dict[str, str]:
    return {k: v.replace("{max}", str(limit)) for k, v in BATCHES.items()}


@query("agg_greedy_batches", "SELECT document_id, id, nth, batch FROM fx_fold JOIN fx_first USING (document_id, nth)", True, _fold(3000))
def _(t):
    return condense.greedy_batches(t.chunks, max_chars=3000).select("document_id", "id", "nth", "batch")


@query("agg_map_reduce_assemble", """SELECT document_id, string_agg('Part ' || batch || ': ' || 'Excerpt ' || batch || '/' || n_batches || ' from '
 || 'doc_' || document_id || '.pdf:' || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY batch) AS input
 FROM (SELECT document_id, batch, max(batch) OVER (PARTITION BY document_id) AS n_batches, body FROM (SELECT document_id, batch,
 string_agg(content, chr(10) || chr(10) ORDER BY nth) AS body FROM fx_fold JOIN fx_first USING (document_id, nth) GROUP BY 1, 2)) GROUP BY 1""", True, _fold(3000))
def _(t):
    inputs = condense.map_inputs(condense.greedy_batches(t.chunks, max_chars=3000), t.documents)
    return condense.reduce_input(inputs.withColumnRenamed("input", "partial"))


@query("agg_ready_count", "SELECT user_id, count(*) FILTER (status = 'ready') AS ready_documents FROM fx_documents GROUP BY 1")
def _(t):
    return reports.ready_counts(t.documents)


@query("agg_has_active", "SELECT user_id, bool_or(status IN ('processing', 'indexing')) AS has_active FROM fx_documents GROUP BY 1")
def _(t):
    return reports.has_active(t.documents)


@query("agg_job_outcomes", """SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000 AS bin_ms, count(*) AS jobs, count(*) FILTER (status = 'done') AS done,
 count(*) FILTER (status <> 'done') AS failed FROM fx_job_log GROUP BY 1""")
def _(t):
    out = reports.job_outcomes(t.job_log)
    return out.select(F.unix_millis("bin_start").alias("bin_ms"), "jobs", "done", "failed")


INPUTS = """SELECT document_id, 1::BIGINT AS batch, 1::BIGINT AS n_batches, 'stuff' AS strategy, 'Document: doc_' || document_id || '.pdf' || chr(10) || chr(10)
 || string_agg(content, chr(10) || chr(10) ORDER BY nth) AS input FROM fx_first WHERE document_id IN (SELECT document_id FROM fx_small) GROUP BY 1
 UNION ALL SELECT document_id, batch, max(batch) OVER (PARTITION BY document_id), 'map_reduce', 'Excerpt ' || batch || '/' ||
 max(batch) OVER (PARTITION BY document_id) || ' from doc_' || document_id || '.pdf:' || chr(10) || chr(10) || body
 FROM (SELECT document_id, batch, string_agg(content, chr(10) || chr(10) ORDER BY nth) AS body FROM fx_fold JOIN fx_first USING (document_id, nth)
 WHERE document_id NOT IN (SELECT document_id FROM fx_small) AND document_id IN (SELECT id FROM fx_documents WHERE status = 'ready') GROUP BY 1, 2)"""
SMALL = {"fx_small": """SELECT document_id FROM fx_first WHERE document_id IN (SELECT id FROM fx_documents WHERE status = 'ready')
 GROUP BY 1 HAVING sum(n) < 4000"""}


@query("pipe_summarize_inputs", INPUTS, True, {**_fold(3000), **SMALL})
def _(t):
    out = summarize.document_inputs(t.documents, t.chunks, 4000, 3000)
    return out.select("document_id", "batch", "n_batches", "strategy", "input")


FLASH = r"""WITH fx_w AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '["\\\[\]\x00-\x1f]', '', 'g')) AS w FROM documents),
 fx_made AS (SELECT doc_id, 'Flashcard Deck' AS title, count(*) AS stored_cards FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM fx_w WHERE doc_id % 4 <> 3)
 WHERE (doc_id + i) % 4 <> 1 GROUP BY 1), fx_opening AS (SELECT document_id, content FROM fx_chunks),
 fx_texts AS (SELECT d.user_id, 'document' AS source_type, d.id AS source_id, sum(length(c.content) + 2)::BIGINT - 2 AS source_chars FROM fx_documents d
 JOIN fx_opening c ON c.document_id = d.id WHERE d.status = 'ready' GROUP BY 1, 2, 3
 UNION ALL SELECT user_id, 'conversation', conversation_id, sum(length(content) + 2)::BIGINT - 2 FROM fx_messages WHERE role = 'assistant' GROUP BY 1, 2, 3)
 SELECT t.*, m.title, m.stored_cards FROM fx_texts t LEFT JOIN fx_made m ON t.source_type = 'document' AND m.doc_id = t.source_id WHERE source_chars > 0"""


@query("pipe_flashcards", FLASH)
def _(t):
    """Source texts of every document and conversation, next to the decks their responses gave."""
    texts = flashcards.source_texts(t.documents, t.chunks, t.messages, PART())
    decks, rows, _bad = flashcards.decks_from(t.card_responses)
    per_deck = rows.groupBy(F.col("deck_id").alias("id")).agg(F.count("*").alias("stored_cards"))
    made = decks.join(per_deck, "id").select("source_type", "source_id", "title", "stored_cards")
    return texts.select("user_id", "source_type", "source_id", F.length("text").cast("long").alias("source_chars")).join(
        made, ["source_type", "source_id"], "left"
    )


CARDS = r"""WITH fx_w AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '["\\\[\]\x00-\x1f]', '', 'g')) AS w FROM documents),
 fx_c AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS i FROM fx_w WHERE doc_id % 4 <> 3)
 SELECT doc_id AS source_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS card_no,
 regexp_replace('Q ' || w, '\s+$', '') AS question, regexp_replace('A ' || w, '\s+$', '') AS answer FROM fx_c WHERE (doc_id + i) % 4 <> 1"""


@query("out_json_cards", CARDS)
def _(t):
    good, _bad = cards.read_responses(t.card_responses)
    rows = good.select("source_id", F.posexplode("cards").alias("card_no", "c"))
    return rows.select("source_id", F.col("card_no").cast("long"), "c.question", "c.answer")
