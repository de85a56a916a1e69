"""The derived views as DuckDB SQL, and a helper that puts the needed ones before a query."""

from __future__ import annotations

import re

from ..views import PREFIXES

_PREFIX_LIST = "[" + ", ".join("'" + p + "'" for p in PREFIXES) + "]"
_MARK = """CASE {n} % 9 WHEN 0 THEN '# ' || {l} WHEN 1 THEN '    ' || {l} WHEN 2 THEN '-' || {l}
 WHEN 3 THEN '- ' || {l} WHEN 4 THEN '1. ' || {l} WHEN 5 THEN '```' WHEN 6 THEN 'a | ' || {l} || ' | b'
 WHEN 7 THEN {l} || chr(9) || chr(9) || {l} ELSE {l} END"""


def _paged(per_page: int, mark: bool) -> str:
    line = _MARK.format(n="(pos - 1)", l="line") if mark else "line"
    return f"""SELECT doc_id AS document_id, doc_id % 5 AS user_id, 'doc_' || doc_id || '.pdf' AS filename,
 ((pos - 1) // {per_page}) + 1 AS page_number, string_agg({line}, chr(10) ORDER BY pos) AS text,
 (doc_id + (pos - 1) // {per_page}) % 2 = 0 AS has_images
 FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
 GROUP BY doc_id, (pos - 1) // {per_page}"""


VIEWS = {
    "fx_lines": """SELECT doc_id, pos - 1 AS line_no, line FROM (SELECT doc_id,
 unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
 FROM documents) WHERE length(trim(line)) > 0""",
    "fx_marked_lines": "SELECT doc_id, line_no, " + _MARK.format(n="line_no", l="line") + " AS line FROM fx_lines",
    "fx_documents": """SELECT doc_id AS id, doc_id % 5 AS user_id, 'doc_' || doc_id || '.pdf' AS filename,
 CASE WHEN doc_id % 7 = 5 THEN 'partial' WHEN doc_id % 7 = 6 THEN 'processing' WHEN doc_id % 35 = 4 THEN 'indexing'
 ELSE 'ready' END AS status, doc_id * 1000 % 77777 AS created_ms FROM documents""",
    "fx_pages": _paged(3, False),
    "fx_marked_pages": _paged(12, True),
    "fx_chunks": """SELECT l.doc_id * 100000 + l.line_no AS id, l.doc_id AS document_id, l.doc_id % 5 AS user_id,
 'doc_' || l.doc_id || '.pdf' AS filename, l.line AS content, l.line_no // 3 + 1 AS page_number,
 'Section ' || (l.line_no // 5 + 1) AS heading, l.line_no AS chunk_index,
 CASE WHEN l.doc_id % 2 = 0 THEN [l.line_no // 3 + 1, l.line_no // 3 + 2] END AS pages, e.embedding
 FROM fx_lines l LEFT JOIN embeddings e
 ON e.vec_id = (l.doc_id * 7 + l.line_no) % (SELECT count(*) + count(*) // 5 FROM embeddings)""",
    "fx_conversations": """SELECT conv_id AS id, conv_id % 5 AS user_id, min(text) FILTER (turn = 0) AS question,
 CASE WHEN conv_id % 4 > 0 OR conv_id % 8 = 0
 THEN conv_id % 5 + 5 * ((conv_id * 13) % (SELECT count(*) // 5 FROM documents)) END AS document_id,
 conv_id * 60000 AS created_ms, conv_id * 60000 AS updated_ms FROM conversations GROUP BY conv_id""",
    "fx_conversation_documents": """SELECT conv_id AS conversation_id,
 conv_id % 5 + 5 * ((conv_id * 13 + i * 7) % (SELECT count(*) // 5 FROM documents)) AS document_id
 FROM (SELECT DISTINCT conv_id FROM conversations), range(0, 4) t(i) WHERE i < conv_id % 4""",
    "fx_messages": """SELECT conv_id * 1000 + turn AS id, conv_id AS conversation_id, conv_id % 5 AS user_id, role,
 text AS content, turn, conv_id * 60000 + turn * 1000 AS created_ms,
 CASE WHEN turn % 3 = 0 THEN url END AS voice_url,
 CASE WHEN turn % 5 = 0 THEN [url, 'https://media.example.com/audio/' || conv_id || '/x.wav'] END AS voice_urls
 FROM (SELECT *, 'https://media.example.com/' || CASE WHEN turn % 2 = 0 THEN 'audio/' ELSE 'img/' END || conv_id
 || '/' || (turn // 4) || '.wav?sig=a%2Fb' AS url FROM conversations) WHERE role IN ('user', 'assistant')""",
    "fx_evidence": """SELECT m.id AS message_id, c.id AS chunk_id, c.document_id, c.page_number, c.filename,
 c.heading AS section, c.content, c.chunk_index AS position, 1.0::DOUBLE / (61.0::DOUBLE + c.chunk_index) AS rrf_score
 FROM fx_messages m JOIN fx_conversations v ON v.id = m.conversation_id JOIN fx_chunks c ON c.document_id = v.document_id
 WHERE m.role = 'assistant'""",
    "fx_queries": r"""SELECT b.item_id AS query_id, b.item_id % 5 AS user_id, b.item_id AS conversation_id,
 b.text AS query_text, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(b.text), '[\p{L}\p{N}]{4,}')))[1:1 + b.item_id % 2], ' ') AS short_text,
 e.embedding AS query_embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id""",
    "fx_both_queries": """SELECT * FROM fx_queries UNION ALL
 SELECT * REPLACE (-1 - query_id AS query_id, short_text AS query_text) FROM fx_queries""",
    "fx_scoped_queries": """SELECT q.*, s.doc_ids,
 q.query_id % 5 + 5 * ((q.query_id * 3) % (SELECT count(*) // 5 FROM documents)) AS doc_id,
 coalesce(len(s.doc_ids), 0) AS n_docs FROM fx_queries q
 LEFT JOIN (SELECT conversation_id, list(document_id ORDER BY document_id) AS doc_ids
 FROM fx_conversation_documents GROUP BY 1) s USING (conversation_id)""",
    "fx_questions": f"""SELECT conv_id * 2000 + turn * 2 + whole AS question_id, conv_id % 5 AS user_id, conv_id AS conversation_id,
 trim(CASE WHEN conv_id % 3 = 1 THEN upper(p) ELSE p END || ' ' ||
 CASE WHEN whole = 1 THEN text ELSE '' END)
 || CASE WHEN turn % 4 = 2 THEN '?' ELSE '' END AS question, turn
 FROM (SELECT *, {_PREFIX_LIST}[(conv_id * 7 + turn) % {len(PREFIXES)} + 1] AS p, unnest([0, 1]) AS whole FROM conversations WHERE role = 'user')""",
    "fx_responses": """SELECT doc_id * 100000 + line_no AS response_id, doc_id % 5 AS user_id, CASE line_no % 7
 WHEN 0 THEN '<think>' || line || chr(10) || 'YES</think> ' || line WHEN 1 THEN '  <think>no? ' || line
 WHEN 2 THEN 'Yes, but ' || line || ' so NO.' WHEN 3 THEN 'the large one, not small: ' || line
 WHEN 4 THEN 'small or Large ' || line || '</think> yes' WHEN 5 THEN 'This was not found in your documents. ' || line
 ELSE CASE WHEN line_no % 2 = 0 THEN line END END AS response FROM fx_lines""",
    "fx_events": "SELECT * EXCLUDE (ts), ts, epoch_us(ts) // 1000 AS ms FROM events",
    "fx_token_log": """SELECT event_id, 'b' || (user_id % 3) AS bucket, ms // 1000 AS ms,
 CASE WHEN event_type = 'purchase' THEN 2 ELSE 1 END::BIGINT AS cost FROM fx_events""",
    "fx_credit_log": """SELECT event_id, user_id, ms, CASE WHEN event_type = 'purchase' THEN 'consume' ELSE 'refund' END AS op
 FROM fx_events WHERE event_type IN ('purchase', 'error')""",
    "fx_job_log": """SELECT event_id AS job_id, user_id, ts, ms, event_type, value * 100 AS duration_ms,
 CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status FROM fx_events""",
    "fx_reuse_log": """SELECT 'cache:' || (user_id % 20) || ':' || event_type AS cache_key, event_id, ms FROM fx_events""",
    "fx_result_log": """SELECT * EXCLUDE (open) FROM (
 SELECT event_id AS job_id, user_id, ms AS written_ms, 0::BIGINT AS seq, 'pending' AS status, false AS open FROM fx_events
 UNION ALL SELECT event_id, user_id, ms + 5000, 1, CASE WHEN event_type = 'error' THEN 'error' ELSE 'done' END, event_type = 'signup'
 FROM fx_events) WHERE NOT open""",
    "fx_summary_log": """SELECT doc_id * 100000 + line_no AS id, doc_id % 5 AS user_id, 'document' AS source_type,
 NULL::BIGINT AS conversation_id, doc_id AS document_id, line AS content, doc_id * 50 + line_no AS created_ms
 FROM fx_lines UNION ALL
 SELECT -1 - id, user_id, 'conversation', id, NULL, coalesce(question, ''), created_ms FROM fx_conversations""",
    "fx_decks": """SELECT id, user_id, 'document' AS source_type, NULL::BIGINT AS conversation_id, id AS document_id,
 'Flashcard Deck' AS title, created_ms FROM fx_documents WHERE status = 'ready'""",
    "fx_cards": """SELECT doc_id * 100000 + line_no AS id, doc_id AS deck_id, substring(line, 1, 40) AS question,
 substring(line, 41) AS answer, 100000 - line_no AS created_ms FROM fx_lines WHERE doc_id IN (SELECT id FROM fx_decks)""",
}


def with_views(body: str, recursive: bool = False, extra: dict[str, str] | None = None) -> str:
    """``body`` preceded by the views it mentions, each after the views it needs itself."""
    known = {**VIEWS, **(extra or {})}
    placed: list[str] = []

    def place(text: str) -> None:
        for name in known:
            if name not in placed and re.search(rf"\b{name}\b", text):
                place(known[name].replace(name, ""))
                if name not in placed:
                    placed.append(name)

    place(body)
    if not placed and not recursive:
        return body
    ctes = ", ".join(f"{name} AS ({known[name]})" for name in placed)
    rest = body.strip()
    if rest[:5].upper() == "WITH ":
        rest = rest[5:]
        if rest[:10].upper() == "RECURSIVE ":
            rest = rest[10:]
        head = "WITH RECURSIVE " if recursive else "WITH "
        return head + (ctes + ", " if ctes else "") + rest
    return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + " " + rest
