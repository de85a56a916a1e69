"""Labels over questions, and cleaning of stored responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import outputs as O
from ..functions import routing as R
from ..operators import scope
from . import query

def Q():
    return F.col("question")

WS = r"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+$', '')"


def _has(parts) -> str:
    return "(" + " OR ".join("contains(q, '" + p.replace("'", "''") + "')" for p in parts) + ")"


OPENING = "regexp_matches(q, '(?i)^(" + "|".join(R.SMALL_TALK).replace("'", "''") + ")')"
WORDS = r"list_filter(string_split_regex(q, '\s+'), lambda w: w <> '')"
STARTERS = "[" + ", ".join(f"'{w}'" for w in R.QUESTION_WORDS) + "]"
SHORT = f"(len({WORDS}) <= 2 AND NOT contains(q, '?') AND NOT coalesce(list_contains({STARTERS}, {WORDS}[1]), false))"
REPLY = "CASE " + " ".join(f"WHEN {_has(parts)} THEN '{key}'" for key, parts in R.REPLY_PARTS) + " ELSE 'greeting' END"
LOWER = "(SELECT *, " + WS.format(x="lower(question)") + " AS q FROM fx_questions)"
CLASS = f"CASE WHEN {_has(R.DOCUMENT_SIGNS)} THEN 'document' WHEN {_has(R.GENERAL_SIGNS)} THEN 'general' ELSE 'document' END"


@query("rt_conversational", f"SELECT question_id, {OPENING} OR {SHORT} AS small_talk FROM {LOWER}")
def _(t):
    return t.questions.select("question_id", R.is_small_talk(Q()).alias("small_talk"))


@query("rt_response_key", f"SELECT question_id, CASE WHEN {OPENING} THEN {REPLY} WHEN {SHORT} THEN 'default' END AS reply_key FROM {LOWER}")
def _(t):
    return t.questions.select("question_id", R.small_talk_key(Q()).alias("reply_key"))


@query("rt_doc_or_general", f"SELECT question_id, CASE WHEN {OPENING} OR {SHORT} THEN 'conversational' ELSE {CLASS} END AS class FROM {LOWER}")
def _(t):
    return t.questions.select("question_id", R.question_class(Q()).alias("class"))


PAGE = r"TRY_CAST(regexp_extract(question, '(?i)\b(?:page|pg)\.?\s*(?:number\s*|#\s*)?(\d+)\b', 1) AS BIGINT)"
QUOTE = "[\"'']"  # one of the two quote marks, the single one doubled for SQL
SECTION = (
    rf"regexp_replace(regexp_replace(trim(regexp_extract(question, '(?i)\b(?:section|chapter|part|unit|module|topic)\s+"
    rf"({QUOTE}?[\p{{L}}\p{{N}}_\s\-\.]{{2,60}}{QUOTE}?)', 1)), '^{QUOTE}+', ''), '{QUOTE}+$', '')"
)


@query("rt_structured", f"""SELECT question_id, page, CASE WHEN page IS NULL AND s <> '' THEN s END AS section,
 CASE WHEN page IS NOT NULL THEN 'page' WHEN s <> '' THEN 'section' END AS kind
 FROM (SELECT question_id, {PAGE} AS page, {SECTION} AS s FROM fx_questions)""")
def _(t):
    return t.questions.select(
        "question_id", R.lookup_page(Q()).alias("page"), R.lookup_section(Q()).alias("section"), R.lookup_kind(Q()).alias("kind")
    )


def _sql_words(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ALL_WORDS = r"regexp_extract_all(lower(question), '[\p{L}\p{N}_]+')"


@query("set_word_overlap", f"""SELECT question_id, list_has_any({ALL_WORDS}, {_sql_words(R.PRONOUNS)}) AS pronoun,
 list_has_any({ALL_WORDS}, {_sql_words(R.VAGUE_WORDS)}) AS vague FROM fx_questions""")
def _(t):
    return t.questions.select("question_id", R.mentions_pronoun(Q()).alias("pronoun"), R.is_vague(Q()).alias("vague"))


@query("rt_rewrite_gate", f"""SELECT question_id, turn > 0 AND (len({WORDS}) <= 10 OR list_has_any({ALL_WORDS}, {_sql_words(R.PRONOUNS)})
 OR list_has_any({ALL_WORDS}, {_sql_words(R.VAGUE_WORDS)})) AS rewrite, CASE WHEN turn % 6 = 2 THEN question WHEN turn % 6 = 4
 AND length(question) * 10 > 200 THEN question ELSE repeat(question, CASE WHEN turn % 6 = 4 THEN 10 ELSE 1 END) END AS accepted FROM {LOWER}
 """.replace("FROM (SELECT", "FROM (SELECT"))
def _(t):
    turn = F.col("turn")
    said = F.when(turn % 6 == 2, F.lit("  ")).otherwise(F.repeat("question", F.when(turn % 6 == 4, 10).otherwise(1)))
    return t.questions.select(
        "question_id", R.needs_rewrite(Q(), turn).alias("rewrite"), R.accepted_rewrite(Q(), said).alias("accepted")
    )


@query("rt_model", """SELECT query_id, CASE WHEN n_docs <= 1 THEN 'small' WHEN query_id % 3 = 0 THEN 'large'
 WHEN query_id % 3 = 1 THEN 'small' ELSE 'large' END AS model FROM fx_scoped_queries""")
def _(t):
    verdict = F.when(F.col("query_id") % 3 == 1, "small").when(F.col("query_id") % 3 == 2, "large")
    return t.scoped_queries.select("query_id", R.model_choice(F.col("n_docs"), verdict).alias("model"))


@query("rt_path", """SELECT response_id, CASE WHEN response_id % 2 = 0 AND (starts_with(response, 'This was not found in your documents.')
 OR starts_with(response, 'This is not clearly covered in your document.')) THEN 'rag_fallback' WHEN response_id % 2 = 0 THEN 'rag' ELSE 'direct' END AS path
 FROM fx_responses""")
def _(t):
    path = F.when(F.col("response_id") % 2 == 0, "rag").otherwise("direct")
    return t.responses.select("response_id", R.final_path(path, F.col("response")).alias("path"))


def RESP():
    return F.col("response")



@query("out_strip_think", "SELECT response_id, " + WS.format(x="regexp_replace(coalesce(response, ''), '(?s)<think>.*?</think>', '', 'g')") + " AS answer FROM fx_responses")
def _(t):
    return t.responses.select("response_id", O.strip_think(RESP()).alias("answer"))


@query("out_last_verdict", r"""SELECT response_id, coalesce(regexp_extract_all(upper(response), '\b(?:YES|NO)\b')[-1] = 'YES', true) AS retrieve FROM fx_responses""")
def _(t):
    return t.responses.select("response_id", O.last_verdict(RESP()).alias("retrieve"))


@query("out_last_label", """SELECT response_id, CASE WHEN response IS NULL THEN 'none' WHEN greatest(a, b) = 0 THEN 'none' WHEN a > b THEN 'small' ELSE 'large' END AS label
 FROM (SELECT *, length(lower(response)) - coalesce(nullif(instr(reverse(lower(response)), 'llams'), 0), length(response)) AS a,
 length(lower(response)) - coalesce(nullif(instr(reverse(lower(response)), 'egral'), 0), length(response)) AS b FROM fx_responses)""")
def _(t):
    label = O.last_label(F.coalesce(RESP(), F.lit("")), ("small", "large"), F.lit("none"))
    return t.responses.select("response_id", label.alias("label"))


@query("out_cached_payload", """SELECT response_id, CASE WHEN response_id % 3 = 1 THEN coalesce(regexp_replace(response, '["\\\\\\x00-\\x1f]', ' ', 'g'), 'none')
 ELSE coalesce(response, '') END AS answer, CASE WHEN response_id % 3 = 1 THEN 1 ELSE 0 END AS n_sources FROM fx_responses""")
def _(t):
    clean = F.coalesce(F.regexp_replace("response", r'["\\\x00-\x1f]', " "), F.lit("none"))
    packed = F.concat(F.lit('{"answer": "'), clean, F.lit('", "sources": [{"chunk_id": "c1", "page_number": 2}]}'))
    value = F.when(F.col("response_id") % 3 == 1, packed).otherwise(F.coalesce(RESP(), F.lit("")))
    return t.responses.select(
        "response_id", O.cached_answer(value).alias("answer"), F.size(O.cached_sources(value)).cast("int").alias("n_sources")
    )


# Keys

SETKEY = "substring(sha256(array_to_string(list_sort(list_transform({x}, lambda d: d::VARCHAR)), '|')), 1, 12)"


@query("set_docset_key", f"SELECT query_id, {SETKEY.format(x='doc_ids')} AS docset FROM fx_scoped_queries WHERE doc_ids IS NOT NULL")
def _(t):
    some = t.scoped_queries.where(F.col("doc_ids").isNotNull())
    return some.select("query_id", K.docset_key(F.reverse("doc_ids")).alias("docset"))


@query("key_cache", f"""SELECT q.question_id, 'cache:' || q.user_id || ':' || CASE WHEN len(s.ids) > 0 THEN {SETKEY.format(x='s.ids')}
 ELSE coalesce(v.document_id::VARCHAR, 'none') END || ':' || CASE WHEN q.turn % 4 = 0 THEN 'concise' ELSE 'explanatory' END || ':' || sha256(trim(lower(q.question))) AS cache_key
 FROM fx_questions q LEFT JOIN fx_conversations v ON v.id = q.conversation_id
 LEFT JOIN (SELECT conversation_id, list(document_id) AS ids FROM fx_conversation_documents GROUP BY 1) s ON s.conversation_id = q.conversation_id""")
def _(t):
    asked = t.questions.withColumn("request_ids", F.array().cast("array<long>"))
    out = scope.resolved_scope(asked, t.conversations, t.conversation_documents)
    part = K.document_part(F.col("doc_ids"), F.col("doc_id"))
    style = F.when(F.col("turn") % 4 == 0, "concise").otherwise("explanatory")
    return out.select("question_id", K.cache_key(F.col("user_id"), part, style, Q()).alias("cache_key"))


@query("key_object", """SELECT id, 'uploads/' || user_id || '/' || id || '/' || filename AS object_key, user_id::VARCHAR AS user_part,
 id::VARCHAR AS document_part, filename FROM fx_documents""")
def _(t):
    out = t.documents.withColumn("object_key", K.object_key(F.col("user_id"), F.col("id"), F.col("filename")))
    parts = K.object_key_parts(F.col("object_key"))
    return out.select(
        "id", "object_key", parts["user_id"].alias("user_part"), parts["document_id"].alias("document_part"),
        parts["filename"].alias("filename"),
    )


@query("key_content_md5", "SELECT id, md5(content) AS content_md5 FROM fx_chunks")
def _(t):
    return t.chunks.select("id", K.content_hash(F.col("content")).alias("content_md5"))
