"""Pages, page windows, sections and headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import FENCE, line_type
from ..functions.text import is_blank, lines_keeping_ends, lstrip, rstrip, strip
from . import carry

MIN_PAGE_CHARS = 50
WINDOW_PAGES = 50
WINDOW_OVERLAP = 3
PAGES_PER_BLOCK = 64


def has_tables(text: Column) -> Column:
    return text.contains("\t") | text.contains("    ")


def classified_pages(pages: DataFrame, min_chars: int = MIN_PAGE_CHARS) -> DataFrame:
    """Strips page text and adds char_count, has_tables and skip_reason (NULL: the page is kept)."""
    text = strip(F.col("text"))
    images = F.coalesce(F.col("has_images"), F.lit(False)) if "has_images" in pages.columns else F.lit(False)
    return (
        pages.withColumn("text", text)
        .withColumn("char_count", F.length("text").cast("long"))
        .withColumn("has_tables", has_tables(F.col("text")))
        .withColumn(
            "skip_reason",
            F.when(F.col("char_count") < min_chars, F.when(images, "image_only").otherwise("no_text_layer")),
        )
    )


def extraction_summary(classified: DataFrame) -> DataFrame:
    """Per document: pages seen, kept and skipped; without a kept page it has failed."""
    skipped = F.when(F.col("skip_reason").isNotNull(), F.col("page_number"))
    return classified.groupBy("document_id").agg(
        F.count("*").alias("total_pages"),
        F.count_if(F.col("skip_reason").isNull()).alias("extracted_pages"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("skipped_count"),
        F.sort_array(F.collect_list(skipped)).alias("skipped_pages"),
    ).withColumn("failed", F.col("extracted_pages") == 0)


def page_ordinals(pages: DataFrame, block_pages: int = PAGES_PER_BLOCK) -> DataFrame:
    """Kept pages with their 0-based position among the kept pages of the document."""
    blocks = pages.withColumn("_block", F.floor(F.col("page_number") / block_pages))
    return carry.numbered(blocks, ["document_id"], "_block", ["page_number"], "ordinal").drop("_block")


def page_windows(
    pages: DataFrame, size: int = WINDOW_PAGES, overlap: int = WINDOW_OVERLAP
) -> DataFrame:
    """Each kept page once per window that holds it.

    Window w starts at ordinal ``w * (size - overlap)``; the last window is the
    first one that reaches the last page.
    """
    step = size - overlap
    placed = page_ordinals(pages)
    counts = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    last = F.when(F.col("n_pages") <= size, F.lit(0)).otherwise(
        F.ceil((F.col("n_pages") - size) / F.lit(float(step)))
    ).cast("int")
    low = F.greatest(F.lit(0), F.ceil((F.col("ordinal") - size + 1) / F.lit(float(step)))).cast("int")
    high = F.least(last, F.floor(F.col("ordinal") / F.lit(float(step))).cast("int"))
    return (
        placed.join(counts, "document_id")
        .withColumn("window_no", F.explode(F.sequence(F.least(low, high), high)))
        .withColumn("window_no", F.col("window_no").cast("long"))
        .drop("n_pages")
    )


def _sections_of(text: Column) -> Column:
    """Array of (type, text) sections of one page, headings included.

    A fold over the lines of the page that carries line numbers, not text.
    Consecutive lines of one type form a section. A fence line closes what is open and toggles code; a blank line
    joins whatever is open; a buffer of blanks alone is never emitted and stays
    at the head of the next section.
    """
    span = "struct<kind:string,first:int,last:int>"
    none, zero = F.array().cast(f"array<{span}>"), F.lit(0)

    def trimmed(raw: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("at"), rstrip(raw).alias("line"))

    def bared(x: Column) -> Column:
        return F.struct(x["at"].alias("at"), x["line"].alias("line"), lstrip(x["line"]).alias("bare"))

    def described(x: Column) -> Column:
        return F.struct(
            x["at"].alias("at"),
            x["line"].startswith(FENCE).alias("fence"),
            (x["bare"] == "").alias("blank"),
            line_type(x["line"], x["bare"]).alias("kind"),
        )

    # ``first`` is the first line with text in the open buffer (0: none yet), ``held`` whether it has any line.
    def state(kind, fenced, first, held, at, done):
        return F.struct(
            kind.alias("kind"), fenced.alias("fenced"), first.alias("first"), held.alias("held"), at.alias("at"),
            done.alias("done"),
        )

    start = state(F.lit("prose"), F.lit(False), zero, F.lit(False), zero, none)

    def closed(acc: Column, kind: Column) -> Column:
        piece = F.struct(kind.alias("kind"), acc["first"].alias("first"), acc["at"].alias("last")).cast(span)
        return F.when(acc["first"] == 0, acc["done"]).otherwise(F.concat(acc["done"], F.array(piece)))

    code, prose, yes, no = F.lit("code"), F.lit("prose"), F.lit(True), F.lit(False)

    def step(acc: Column, line: Column) -> Column:
        only_blanks = acc["held"] & (acc["first"] == 0)
        own = F.when(line["blank"], zero).otherwise(line["at"])
        return (
            F.when(
                line["fence"] & ~acc["fenced"],
                state(code, yes, zero, only_blanks, line["at"], closed(acc, acc["kind"])),
            )
            .when(line["fence"], state(prose, no, zero, only_blanks, line["at"], closed(acc, code)))
            .when(
                acc["fenced"] | (line["kind"] == acc["kind"]) | (line["blank"] & acc["held"]),
                state(
                    acc["kind"], acc["fenced"], F.when(acc["first"] > 0, acc["first"]).otherwise(own), yes,
                    line["at"], acc["done"],
                ),
            )
            .otherwise(state(line["kind"], acc["fenced"], own, yes, line["at"], closed(acc, acc["kind"])))
        )

    # One transform per step: inside a lambda nothing is computed once and shared.
    raw = lines_keeping_ends(text)
    described_lines = F.transform(F.transform(F.transform(raw, trimmed), bared), described)
    spans = F.aggregate(described_lines, start, step, lambda acc: closed(acc, acc["kind"]))
    # The lines ride along as an argument, so they are split once and not per section.
    packed = F.transform(F.array(F.struct(raw.alias("raw"), spans.alias("spans"))), lambda p: F.transform(
        p["spans"],
        lambda s: F.struct(
            s["kind"].alias("kind"),
            strip(F.array_join(F.slice(p["raw"], s["first"], s["last"] - s["first"] + 1), "")).alias("text"),
        ),
    ))
    return F.get(packed, 0)


def page_sections(pages: DataFrame, keep: list[str]) -> DataFrame:
    """One row per section of a page, headings included. No shuffle: a page is one row."""
    return (
        pages.select(*keep, "page_number", F.posexplode(_sections_of(F.col("text"))).alias("section_no", "_s"))
        .select(
            *keep, "page_number", F.col("section_no").cast("long"),
            F.concat(F.lit("p"), F.col("page_number"), F.lit("s"), F.col("section_no")).alias("section_id"),
            F.col("_s.kind").alias("content_type"), F.col("_s.text").alias("text"),
        )
    )


def with_headings(sections: DataFrame, keys: list[str], block_pages: int = PAGES_PER_BLOCK) -> DataFrame:
    """Body sections with the nearest heading before them, across pages."""
    marked = sections.withColumn(
        "_own", F.when(F.col("content_type") == "heading", F.col("text"))
    ).withColumn("_block", F.floor(F.col("page_number") / block_pages))
    out = carry.filled(marked, keys, "_block", ["page_number", "section_no"], "_own", "heading")
    return out.where(F.col("content_type") != "heading").drop("_own", "_block")
