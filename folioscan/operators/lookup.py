"""Exact page and section lookups for a batch of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from ..sizing import join_sized
from .scope import asked_documents, heading_like
from .toplists import top_per

CONSTANT_SCORE = 0.5


def _asked(chunks: DataFrame, queries: DataFrame, value: str) -> tuple[DataFrame | None, DataFrame | None]:
    """Questions over some documents and over all, None where there are none."""
    columns = ["query_id", "user_id", value] + [c for c in ("doc_ids", "doc_id") if c in queries.columns]
    asked = write_table(queries.select(*columns).where(F.col(value).isNotNull()), "asked-lookups")
    limited, everywhere = asked_documents(asked, chunks.schema["document_id"].dataType.simpleString())
    named = [F.col(c).isNotNull() for c in columns[3:]]
    some, every = asked.agg(F.count_if(reduce(lambda a, b: a | b, named, F.lit(False))), F.count("*")).first()
    return limited if some else None, everywhere if every > some else None


def _first_by_index(hits: DataFrame, limit: int) -> DataFrame:
    order = [F.col("chunk_index").asc_nulls_last(), F.col("document_id").asc(), F.col("id").asc()]
    out = top_per(hits, ["query_id"], order, limit, "position")
    return out.withColumn("rrf_score", F.lit(CONSTANT_SCORE))


_CARRIED = ["query_id", "id", "document_id", "chunk_index"]


def by_page(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Passages on the asked page, in document order.

    A passage is spread over the pages it touches, so the join is a plain equi-join on (user, document, page), or
    (user, page) for questions over all documents; no passage meets a question about another page or document.
    """
    touched = F.when(F.col("pages").isNull(), F.array(F.col("page_number").cast("long"))).otherwise(
        F.array_distinct(F.col("pages").cast("array<long>"))
    )
    spread = chunks.select("id", "document_id", "user_id", "chunk_index", F.explode(touched).alias("asked_page"))
    limited, everywhere = _asked(chunks, queries, "asked_page")
    hits = []
    for asked, keys in ((limited, ["user_id", "document_id", "asked_page"]), (everywhere, ["user_id", "asked_page"])):
        if asked is not None:
            hits.append(join_sized(spread, asked, keys, spread=F.xxhash64("id")).select(*_CARRIED))
    return _first_by_index(_all_of(hits, chunks, queries), limit)


def _all_of(hits: list[DataFrame], chunks: DataFrame, queries: DataFrame) -> DataFrame:
    if hits:
        return reduce(DataFrame.unionByName, hits)
    return chunks.where(F.lit(False)).select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), *_CARRIED[1:])


def grams(text: Column) -> Column:
    """The different three-character pieces of a lower-case text."""
    return F.when(
        F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))
    ).otherwise(F.array().cast("array<string>"))


def pattern_grams(pattern: Column) -> Column:
    """Three-character pieces that every text must hold which the pattern matches: those of its parts between wildcards."""
    return F.array_distinct(F.flatten(F.transform(F.split(F.lower(pattern), r"[%_\\]"), grams)))


def matched_headings(headings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(user_id, heading, asked_section) of distinct headings (user_id, heading) that hold a pattern (user_id, asked_section) of their user.

    A pattern meets only headings that hold its rarest piece of three characters; a pattern that has a piece no heading holds
    meets none. Patterns without such a piece are tried on all headings of their user.
    """
    spread = F.xxhash64("heading")
    held = write_table(patterns.withColumn("grams", pattern_grams(F.col("asked_section"))), "heading-patterns")
    users = held.select("user_id").distinct()
    own = write_table(join_sized(headings, users, ["user_id"], "left_semi", spread=spread), "asked-headings")
    each = held.select("user_id", "asked_section", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    by_gram = own.select("user_id", "heading", F.explode(grams(F.lower("heading"))).alias("gram"))
    counts = join_sized(by_gram, each.select("user_id", "gram").distinct(), ["user_id", "gram"], "left_semi", spread=spread)
    counts = counts.groupBy("user_id", "gram").agg(F.count("*").alias("headings"))
    known = each.join(counts, ["user_id", "gram"]).groupBy("user_id", "asked_section").agg(
        F.min_by("gram", F.struct("headings", "gram")).alias("gram"), F.count("*").alias("known"), F.max("n").alias("n")
    )
    rarest = known.where("known = n").select("user_id", "asked_section", "gram")
    met = join_sized(by_gram, rarest, ["user_id", "gram"], spread=spread).select("user_id", "heading", "asked_section")
    short = held.where(F.size("grams") == 0).select("user_id", "asked_section")
    met = met.unionByName(join_sized(own, short, ["user_id"], spread=spread).select("user_id", "heading", "asked_section"))
    return met.where(heading_like(F.col("heading"), F.col("asked_section")))


def by_section(chunks: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Passages whose heading holds the asked section text, in document order.

    Questions over some documents are met by (user, document) first, and only these documents' headings are tried. For
    questions over all documents each different pattern meets the headings that hold its rarest piece.
    """
    limited, everywhere = _asked(chunks, queries, "asked_section")
    body = chunks.where(F.col("heading").isNotNull()).select("id", "document_id", "user_id", "chunk_index", "heading")
    like = heading_like(F.col("heading"), F.col("asked_section"))
    hits = []
    if limited is not None:
        hits.append(join_sized(body, limited, ["user_id", "document_id"], spread=F.xxhash64("id")).where(like).select(*_CARRIED))
    if everywhere is not None:
        patterns = everywhere.select("user_id", "asked_section").distinct()
        matched = write_table(matched_headings(body.select("user_id", "heading").distinct(), patterns), "matched-headings")
        found = join_sized(body, matched, ["user_id", "heading"], spread=F.xxhash64("id"))
        hits.append(join_sized(found, everywhere, ["user_id", "asked_section"], spread=F.xxhash64("id")).select(*_CARRIED))
    return _first_by_index(_all_of(hits, chunks, queries), limit)
