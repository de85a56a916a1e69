"""Page text to passages: sections, windows, headings, bridging, copies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as X
from ..functions.embedding import embedded, hashed_vectors
from ..operators import chunking, structure
from ..operators.keyword import lexicon
from ..plans import ingest
from ..plans.search import search_user
from ..session import fresh_path
from ..sources import sinks, tables
from . import query

STRIPPED = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"
HEADINGS = (L.NUMBERED_HEADING, L.LETTERED_HEADING, L.HASH_HEADING, L.CAPITALS_HEADING, L.NAMED_HEADING)


def kind_of(x: str) -> str:
    bare = STRIPPED.format(x=x)
    heading = " OR ".join(f"regexp_matches({bare}, '{h}')" for h in HEADINGS)

    def has(pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    return f"""CASE WHEN {bare} = '' THEN 'prose' WHEN length({bare}) < {L.HEADING_MAX} AND ({heading}) THEN 'heading'
 WHEN {has(L.PIPE_ROW)} OR {has(L.TAB_ROW)} THEN 'table' WHEN {has(L.INDENTED)} OR {has(L.CODE_WORD)} THEN 'code'
 WHEN {has(L.LIST_ITEM)} THEN 'list' ELSE 'prose' END"""


RTRIM = r"regexp_replace({x}, '\s+$', '')"


@query("txt_line_type", "SELECT doc_id, line_no, " + kind_of("l") + " AS kind FROM (SELECT doc_id, line_no, " + RTRIM.format(x="line") + " AS l FROM fx_marked_lines)")
def _(t):
    return t.marked_lines.select("doc_id", "line_no", L.line_type(X.rstrip(F.col("line"))).alias("kind"))


# Line by line over all pages at once: the state of a page after each of its lines.
RUNS = {
    "fx_page_lines": f"""SELECT document_id, page_number, pos, raw, starts_with(bare, '```') AS fence, bare = '' AS blank, {kind_of('bare')} AS kind,
 count(*) OVER (PARTITION BY document_id, page_number) AS n_lines
 FROM (SELECT *, {RTRIM.format(x='raw')} AS bare FROM (SELECT document_id, page_number, pos,
 line || CASE WHEN pos < n THEN chr(10) ELSE '' END AS raw FROM (SELECT document_id, page_number, unnest(string_split(text, chr(10))) AS line,
 generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n FROM fx_marked_pages)))""",
    "fx_state": """SELECT DISTINCT document_id, page_number, 0::BIGINT AS pos, 'prose' AS cur, false AS fenced, '' AS open, NULL::VARCHAR AS done_kind,
 NULL::VARCHAR AS done_text FROM fx_page_lines UNION ALL
 SELECT l.document_id, l.page_number, l.pos::BIGINT,
 CASE WHEN l.fence THEN CASE WHEN s.fenced THEN 'prose' ELSE 'code' END WHEN s.fenced OR l.kind = s.cur OR (l.blank AND s.open <> '') THEN s.cur ELSE l.kind END,
 CASE WHEN l.fence THEN NOT s.fenced ELSE s.fenced END,
 CASE WHEN l.fence THEN CASE WHEN trim(s.open, chr(10) || chr(9) || ' ') = '' THEN s.open ELSE '' END
 WHEN s.fenced OR l.kind = s.cur OR (l.blank AND s.open <> '') THEN s.open || l.raw
 ELSE CASE WHEN trim(s.open, chr(10) || chr(9) || ' ') = '' THEN s.open ELSE '' END || l.raw END,
 CASE WHEN l.fence AND s.fenced THEN 'code' ELSE s.cur END,
 CASE WHEN l.fence OR NOT (s.fenced OR l.kind = s.cur OR (l.blank AND s.open <> '')) THEN trim(s.open, chr(10) || chr(9) || ' ') END
 FROM fx_state s JOIN fx_page_lines l ON l.document_id = s.document_id AND l.page_number = s.page_number AND l.pos = s.pos + 1""",
    "fx_emitted": """SELECT document_id, page_number, pos, done_kind AS kind, done_text AS text FROM fx_state WHERE done_text <> ''
 UNION ALL SELECT s.document_id, s.page_number, s.pos + 1, s.cur, trim(s.open, chr(10) || chr(9) || ' ') FROM fx_state s
 JOIN (SELECT document_id, page_number, max(pos) AS pos FROM fx_page_lines GROUP BY 1, 2) USING (document_id, page_number, pos)
 WHERE trim(s.open, chr(10) || chr(9) || ' ') <> ''""",
    "fx_sections": """SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id, page_number ORDER BY pos) - 1 AS section_no,
 kind AS content_type, text FROM fx_emitted""",
}


def _sections(t):
    return structure.page_sections(t.marked_pages, ["document_id"])


@query("win_line_runs", "SELECT document_id, page_number, section_no, content_type, text FROM fx_sections", True, RUNS)
def _(t):
    return _sections(t).select("document_id", "page_number", "section_no", "content_type", "text")


@query("win_section_id", "SELECT document_id, 'p' || page_number || 's' || section_no AS section_id, content_type FROM fx_sections", True, RUNS)
def _(t):
    return _sections(t).select("document_id", "section_id", "content_type")


@query("win_heading_ffill", """SELECT document_id, page_number, section_no, content_type, heading FROM (SELECT *, last_value(CASE WHEN content_type = 'heading'
 THEN text END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY page_number, section_no) AS heading FROM fx_sections) WHERE content_type <> 'heading'""", True, RUNS)
def _(t):
    out = structure.with_headings(_sections(t), ["document_id"], 2)
    return out.select("document_id", "page_number", "section_no", "content_type", "heading")


WINDOWS = {"fx_placed": """SELECT document_id, page_number, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS o,
 count(*) OVER (PARTITION BY document_id) AS n FROM fx_pages"""}


@query("win_page_windows", """SELECT document_id, page_number, o AS ordinal, w AS window_no FROM fx_placed, range(0, 2000) r(w)
 WHERE o >= w * 3 AND o < w * 3 + 5 AND w <= CASE WHEN n <= 5 THEN 0 ELSE (n - 5 + 2) // 3 END""", views=WINDOWS)
def _(t):
    return structure.page_windows(t.pages.select("document_id", "page_number"), 5, 2).select(
        "document_id", "page_number", "ordinal", "window_no"
    )


def _passages(t):
    """Lines taken as one-piece prose sections, in document order."""
    return t.chunks.select(
        "document_id", "page_number", (F.col("chunk_index") % 3).alias("section_no"), F.lit(0).cast("long").alias("piece_no"),
        F.when(F.col("chunk_index") % 4 == 3, "list").otherwise("prose").alias("content_type"),
        F.when(F.col("chunk_index") % 2 == 1, F.lower("content")).otherwise(
            F.when(F.col("chunk_index") % 6 == 2, F.concat(F.lit("x "), F.regexp_replace("content", "[.!?]", "")))
            .otherwise(F.regexp_replace("content", "[.!?]+$", ""))
        ).alias("raw"), "heading", "chunk_index", F.floor(F.col("chunk_index") / 7).alias("block"),
    )


BRIDGE = {
    "fx_raw": """SELECT document_id, page_number, chunk_index % 3 AS section_no, chunk_index, heading, CASE WHEN chunk_index % 4 = 3 THEN 'list' ELSE 'prose' END AS content_type,
 CASE WHEN chunk_index % 2 = 1 THEN lower(content) WHEN chunk_index % 6 = 2 THEN 'x ' || regexp_replace(content, '[.!?]', '', 'g')
 ELSE regexp_replace(content, '[.!?]+$', '') END AS raw, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS rn FROM fx_chunks""",
    "fx_bridge": r"""SELECT document_id, chunk_index, rn, raw AS text, regexp_replace(raw, '(?s)^.*[.!?]\s+', '') AS last FROM fx_raw WHERE rn = 1 UNION ALL
 SELECT document_id, chunk_index, rn, text, regexp_replace(text, '(?s)^.*[.!?]\s+', '') FROM (SELECT r.document_id, r.chunk_index, r.rn,
 CASE WHEN r.content_type = 'prose' AND regexp_matches(r.raw, '^\p{Ll}') THEN b.last || ' ' || r.raw ELSE r.raw END AS text
 FROM fx_bridge b JOIN fx_raw r ON r.document_id = b.document_id AND r.rn = b.rn + 1)""",
}


@query("win_bridge", "SELECT document_id, chunk_index, text FROM fx_bridge", True, BRIDGE)
def _(t):
    out = chunking.bridged(_passages(t), ["document_id"], "block")
    return out.select("document_id", "chunk_index", F.col("raw").alias("text"))


@query("txt_chunk_content", """SELECT id, '[Page ' || page_number || ']' || CASE WHEN chunk_index % 4 > 0 THEN ' [Section: ' || heading || ']' ELSE '' END || chr(10) || content AS content,
 length('[Page ' || page_number || ']' || CASE WHEN chunk_index % 4 > 0 THEN ' [Section: ' || heading || ']' ELSE '' END || chr(10) || content) AS char_count FROM fx_chunks""")
def _(t):
    rows = t.chunks.select(
        "id", "page_number", F.when(F.col("chunk_index") % 4 > 0, F.col("heading")).alias("heading"), F.col("content").alias("raw")
    )
    return chunking.with_content(rows).select("id", "content", "char_count")


@query("win_dedup_md5", """SELECT source, content_md5, id FROM (SELECT source, md5(line) AS content_md5, doc_id * 100000 + line_no AS id, row_number() OVER
 (PARTITION BY source, md5(line) ORDER BY doc_id * 100000 + line_no) AS rn FROM fx_lines JOIN documents USING (doc_id)) WHERE rn = 1""")
def _(t):
    rows = t.lines.join(t.raw("documents").select("doc_id", "source"), "doc_id").select(
        "source", F.col("line").alias("content"), (F.col("doc_id") * 100000 + F.col("line_no")).alias("id")
    )
    return chunking.first_copies(rows, ["source"], ["id"]).select("source", "content_md5", "id")


@query("win_chunk_index", """SELECT document_id, page_number, section_no, row_number() OVER (PARTITION BY document_id ORDER BY page_number, section_no) - 1 + document_id % 10 AS chunk_index
 FROM fx_raw""", views=BRIDGE)
def _(t):
    rows = _passages(t).drop("chunk_index")
    out = chunking.indexed(rows, ["document_id"], "block", F.col("document_id") % 10)
    return out.select("document_id", "page_number", "section_no", "chunk_index")


@query("txt_last_sentence", r"""SELECT id, regexp_replace(trim(content, chr(10) || chr(9) || ' '), '(?s)^.*[.!?]\s+', '') AS last_sentence FROM fx_chunks""")
def _(t):
    return t.chunks.select("id", X.last_sentence(X.strip(F.col("content"))).alias("last_sentence"))


@query("txt_normalise", r"""SELECT id, trim(regexp_replace(regexp_replace(replace(replace(lower(content), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '\s+', ' ', 'g'), '[^A-Za-z0-9_\s]', '', 'g')) AS text FROM fx_chunks""")
def _(t):
    return t.chunks.select("id", X.normalise(F.col("content")).alias("text"))


# a fold over sentences: pieces that are done, and the open one
PACK = {
    "fx_clean": r"SELECT doc_id, trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g')) AS clean FROM documents",
    "fx_packed": r"""SELECT doc_id, list_reduce(list_prepend({'done': []::VARCHAR[], 'open': ''},
 list_transform(list_filter(list_transform(string_split(regexp_replace(clean, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)),
 lambda s: s <> ''), lambda s: {'done': []::VARCHAR[], 'open': s})),
 lambda a, x: CASE WHEN length(x.open) > 500 THEN {'done': list_concat(a.done, CASE WHEN a.open = '' THEN [] ELSE [a.open] END,
 list_transform(range(0, length(x.open), 500), lambda i: substring(x.open, i + 1, 500))), 'open': ''}
 WHEN a.open = '' THEN {'done': a.done, 'open': x.open}
 WHEN length(a.open) + 1 + length(x.open) <= 500 THEN {'done': a.done, 'open': a.open || ' ' || x.open}
 ELSE {'done': list_append(a.done, a.open), 'open': x.open} END) AS r FROM fx_clean WHERE length(clean) > 500""",
}


@query("txt_sentence_pack", """SELECT doc_id, no - 1 AS piece_no, p[no] AS piece FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS no FROM (
 SELECT doc_id, CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END AS p FROM fx_packed
 UNION ALL SELECT doc_id, [clean] FROM fx_clean WHERE clean <> '' AND length(clean) <= 500))""", views=PACK)
def _(t):
    return t.raw("documents").select("doc_id", F.posexplode(X.sentence_pack(F.col("text"), 500)).alias("piece_no", "piece")).withColumn(
        "piece_no", F.col("piece_no").cast("long")
    )


@query("txt_split")
def _(t):
    sections = t.spread("documents").select(
        F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 5 == 0, "code").otherwise("prose").alias("content_type"),
        X.strip(F.col("text")).alias("text"),
    )
    return chunking.cut_sections(sections)


@query("pipe_ingest")
def _(t):
    out = ingest.ingest(t.marked_pages)
    return out.select("id", "document_id", "chunk_index", "page_number", "section_id", "content_type", "heading", "content", "char_count")


@query("pipe_end_to_end")
def _(t):
    """Pages to passages to a store, its vectors written back, and the questions searched in what is read again."""
    embed = hashed_vectors(64)
    path = fresh_path(t.spark, "store")
    sinks.append_chunks(ingest.ingest(t.pages), path)
    sinks.embed_stored(t.spark, path, embed)
    asked = t.queries.select("query_id", "user_id", "query_text")
    as_texts = asked.select(F.col("query_id").alias("id"), F.col("user_id").alias("document_id"), F.col("query_text").alias("content"))
    vectors = embedded(as_texts, embed).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    stored = tables.read_chunks(t.spark, path)
    words = lexicon(tables.read_chunks(t.spark, path, vectors=False))
    found = search_user(stored, asked.join(vectors, "query_id"), postings=words)
    return found.select("query_id", "id", "document_id", "v_rank", "k_rank", "rrf_score", "position")
