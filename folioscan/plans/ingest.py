"""Page texts to indexed passages.

The work on text is done page by page inside one row: lines to sections,
sections to pieces, bridging, prefixing and dropping copies. What a page needs
from the pages before it is small: the running heading, the last sentence and
the number of passages so far. Only those summaries are sorted by document; the
text itself is shuffled once, to meet them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import chunk_key
from ..functions.terms import terms
from ..functions.text import last_sentence, sentence_count, strip
from ..operators import carry
from ..operators.chunking import CHUNK_OVERLAP, CHUNK_SIZE, passage_content, split_text
from ..operators.structure import _sections_of, classified_pages, page_windows
from ..session import small_batches, write_table

SUMMARY_BLOCK = 4096
PASSAGE = "struct<section_no:bigint,content_type:string,heading:string,piece_no:bigint,raw:string>"


def _cut_long(size: int, overlap: int):
    @F.pandas_udf("array<array<string>>")
    def cut(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        out = []
        for page_texts, page_kinds in zip(texts, kinds):
            if page_texts is None:
                out.append(None)
                continue
            out.append([
                None if t is None else split_text(t, k == "code", size, overlap)
                for t, k in zip(page_texts, page_kinds)
            ])
        return pd.Series(out, dtype=object)

    return cut


def _with_local_heading(sections: Column) -> Column:
    """(section_no, kind, heading, text) of the body sections, headings taken from the same page."""
    item = "struct<section_no:bigint,kind:string,heading:string,text:string,cut:array<string>>"
    start = F.struct(
        F.lit(None).cast("string").alias("heading"), F.lit(0).cast("bigint").alias("n"),
        F.array().cast(f"array<{item}>").alias("out"),
    )

    def step(acc: Column, s: Column) -> Column:
        body = F.struct(
            acc["n"].alias("section_no"), s["kind"].alias("kind"), acc["heading"].alias("heading"),
            s["text"].alias("text"), s["cut"].alias("cut"),
        ).cast(item)
        is_heading = s["kind"] == "heading"
        return F.struct(
            F.when(is_heading, s["text"]).otherwise(acc["heading"]).alias("heading"),
            (acc["n"] + 1).cast("bigint").alias("n"),
            F.when(is_heading, acc["out"]).otherwise(F.concat(acc["out"], F.array(body))).alias("out"),
        )

    return F.aggregate(sections, start, step, lambda acc: F.struct(acc["heading"].alias("last"), acc["out"].alias("body")))


def page_passages(
    pages: DataFrame, keep: list[str], size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per page: its passages in order, and what later pages need to know."""
    small_batches(pages.sparkSession)
    found = pages.select(*keep, "page_number", _sections_of(F.col("text")).alias("_s"))
    too_long = F.transform(
        "_s", lambda s: F.when((s["kind"] != "heading") & (F.length(s["text"]) > size), s["text"])
    )
    any_long = F.exists("_s", lambda s: (s["kind"] != "heading") & (F.length(s["text"]) > size))
    cut = _cut_long(size, overlap)(
        F.when(any_long, too_long), F.when(any_long, F.col("_s.kind"))
    )
    found = found.withColumn("_cut", cut)
    joined = F.transform(
        "_s",
        lambda s, i: F.struct(s["kind"].alias("kind"), s["text"].alias("text"), F.get("_cut", i).alias("cut")),
    )
    found = found.withColumn("_h", _with_local_heading(joined))

    def pieces(s: Column) -> Column:
        texts = F.coalesce(s["cut"], F.array(strip(s["text"])))
        return F.transform(
            texts,
            lambda t, j: F.struct(
                s["section_no"].alias("section_no"), s["kind"].alias("content_type"), s["heading"].alias("heading"),
                j.cast("bigint").alias("piece_no"), t.alias("raw"),
            ).cast(PASSAGE),
        )

    passages = F.filter(F.flatten(F.transform("_h.body", pieces)), lambda p: p["raw"] != "")
    out = found.withColumn("passages", passages).withColumn("last_heading", F.col("_h.last"))
    tail = F.aggregate(
        "passages",
        F.struct(F.lit(True).alias("through"), F.lit(None).cast("string").alias("tail")),
        _tail_step,
    )
    return (
        out.withColumn("_t", tail)
        .withColumn("n_passages", F.size("passages").cast("long"))
        .withColumn("through", F.col("_t.through"))
        .withColumn("tail", F.col("_t.tail"))
        .select(*keep, "page_number", "passages", "last_heading", "n_passages", "through", "tail")
    )


def _opens(p: Column) -> Column:
    return (
        (p["piece_no"] == 0) & (p["content_type"] == "prose") & p["raw"].rlike(r"^\p{IsLowercase}")
    )


def _tail_step(acc: Column, p: Column) -> Column:
    """Last sentence a page hands on. ``through``: it continues the sentence it was handed."""
    one = sentence_count(p["raw"]) == 1
    goes_on = _opens(p) & one & (acc["tail"].isNull() | ~acc["tail"].rlike(r"[.!?]$"))
    return F.struct(
        (acc["through"] & goes_on).alias("through"),
        F.when(goes_on, F.concat_ws(" ", acc["tail"], p["raw"])).otherwise(last_sentence(p["raw"])).alias("tail"),
    )


def page_carry(staged: DataFrame, keys: list[str]) -> DataFrame:
    """Per page: heading_in, sentence_in and base, the number of passages before it.

    Two rounds over narrow page rows, each with one summary row per block of
    pages; the rows between the rounds are written, so neither is run twice.
    """
    rows = staged.select(*keys, "page_number", "last_heading", "n_passages", "through", "tail").withColumn(
        "_block", F.floor(F.col("page_number") / SUMMARY_BLOCK)
    )
    page = F.col("page_number")
    blocks = rows.groupBy(*keys, "_block").agg(
        F.max_by("last_heading", F.when(F.col("last_heading").isNotNull(), page)).alias("_heading"),
        F.max_by("tail", F.when(F.col("tail").isNotNull(), page)).alias("_tail"),
        F.sum("n_passages").alias("_count"),
    )
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        *keys, "_block", F.last("_heading", True).over(earlier).alias("_heading"),
        F.last("_tail", True).over(earlier).alias("_tail"),
        F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_count"),
    )
    before = Window.partitionBy(*keys, "_block").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    first = rows.join(blocks, keys + ["_block"]).select(
        *keys, "_block", "page_number", "through", "tail",
        F.coalesce(F.last("last_heading", True).over(before), F.col("_heading")).alias("heading_in"),
        F.coalesce(F.last("tail", True).over(before), F.col("_tail")).alias("_before"),
        (F.col("_count") + F.coalesce(F.sum("n_passages").over(before), F.lit(0))).alias("base"),
    )
    first = write_table(first, "page-heads")
    goes_on = F.col("through") & F.col("_before").isNotNull() & ~F.col("_before").rlike(r"[.!?]$")
    spoken = first.where(F.col("tail").isNotNull()).withColumn("_fresh", ~F.coalesce(goes_on, F.lit(False)))
    spoken = carry.handed_on(spoken, keys, "_block", ["page_number"], "_fresh", "tail", "sentence_in")
    return first.select(*keys, "page_number", "heading_in", "base").join(
        spoken.select(*keys, "page_number", "sentence_in"), keys + ["page_number"], "left"
    )


def _bridge(passages: Column, sentence_in: Column) -> Column:
    """Texts of the passages after bridging, from the sentence handed in."""
    start = F.struct(sentence_in.alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        text = F.when(_opens(p) & acc["last"].isNotNull(), F.concat_ws(" ", acc["last"], p["raw"])).otherwise(p["raw"])
        return F.struct(last_sentence(text).alias("last"), F.concat(acc["out"], F.array(text)).alias("out"))

    return F.aggregate(passages, start, step, lambda acc: acc["out"])


def finished(staged: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Passage rows. Copies share a page, because the page number is part of the text."""
    rows = staged.join(carried, keys + ["page_number"])
    placed = F.transform("passages", lambda p, i: F.struct(p.alias("p"), i.cast("bigint").alias("i")))
    whole = F.zip_with(
        placed, _bridge(F.col("passages"), F.col("sentence_in")),
        lambda q, text: F.struct(
            (F.col("base") + q["i"]).alias("chunk_index"), q["p"]["section_no"].alias("section_no"),
            q["p"]["content_type"].alias("content_type"),
            F.coalesce(q["p"]["heading"], F.col("heading_in")).alias("heading"),
            passage_content(
                F.col("page_number"), F.coalesce(q["p"]["heading"], F.col("heading_in")), text
            ).alias("content"),
        ),
    )
    rows = rows.withColumn("_p", whole)
    once = F.filter("_p", lambda p, i: F.array_position(F.col("_p.content"), p["content"]) == i + 1)
    return rows.withColumn("_p", F.explode(once))


def _final_columns(rows: DataFrame, extra: list[str]) -> DataFrame:
    p = F.col("_p")
    return rows.select(
        chunk_key(F.col("document_id"), p["chunk_index"], p["content"]).alias("id"),
        *extra, p["content"].alias("content"),
        F.col("page_number"), F.col("page_number").alias("page_number_end"),
        F.array("page_number").alias("pages"), p["heading"].alias("heading"),
        F.concat(F.lit("p"), F.col("page_number"), F.lit("s"), p["section_no"]).alias("section_id"),
        p["content_type"].alias("content_type"), p["chunk_index"].alias("chunk_index"),
        F.length(p["content"]).cast("long").alias("char_count"), terms(p["content"]).alias("terms"),
    )


def ingest(pages: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Passages of whole documents.

    ``pages``: document_id, user_id, filename, page_number, text. Passages are
    numbered over the document before copies are dropped, so a number never
    changes its passage. The staged pages are written once and read twice, the
    second time for three narrow columns only.
    """
    kept = classified_pages(pages).where(F.col("skip_reason").isNull())
    keep = ["document_id", "user_id", "filename"]
    staged = write_table(page_passages(kept, keep, size, overlap), "staged-pages")
    carried = write_table(page_carry(staged, ["document_id"]), "page-carry")
    return _final_columns(finished(staged, carried, ["document_id"]), keep)


def ingest_by_window(
    pages: DataFrame, window_pages: int = 50, window_overlap: int = 3,
    size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """Passages per page window, each window read on its own.

    Heading, bridge and copies start anew in every window, so the overlap pages
    yield their passages twice; numbers continue after the passages kept by the
    windows before.
    """
    kept = classified_pages(pages).where(F.col("skip_reason").isNull())
    keep = ["document_id", "user_id", "filename", "window_no"]
    spots = page_windows(kept.select("document_id", "page_number"), window_pages, window_overlap)
    placed = kept.join(spots, ["document_id", "page_number"])
    staged = write_table(page_passages(placed, keep, size, overlap), "staged-pages")
    keys = ["document_id", "window_no"]
    carried = write_table(page_carry(staged, keys), "page-carry")
    rows = write_table(_final_columns(finished(staged, carried, keys), keep), "window-passages")
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("document_id").orderBy("window_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    out = rows.join(offsets, keys).withColumn("chunk_index", F.col("chunk_index") + F.col("_offset"))
    identity = F.concat_ws("|", "window_no", "chunk_index")
    return out.withColumn("id", chunk_key(F.col("document_id"), identity, F.col("content"))).drop("_offset")
