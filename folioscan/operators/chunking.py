"""Sections to overlapping, prefixed, deduplicated passages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import last_sentence, sentence_count, strip
from ..session import small_batches
from . import carry
from .toplists import best_row

CHUNK_SIZE = 600
CHUNK_OVERLAP = 150
# Where text may be cut, coarsest first. The empty text cuts anywhere.
PROSE_CUTS = ("\n\n", "\n", ". ", " ", "")
CODE_CUTS = ("\nclass ", "\ndef ", "\n\n", "\n", " ", "")


def _pieces(text: str, cuts: tuple[str, ...], size: int, overlap: int) -> Iterator[str]:
    """Passages of at most ``size`` characters, cut at the coarsest mark that occurs.

    The mark stays at the head of the part it opens. A part that is still too
    long is cut again by the finer marks.
    """
    level = next(i for i, mark in enumerate(cuts) if not mark or mark in text)
    mark, finer = cuts[level], cuts[level + 1:]
    if mark:
        head, *tail = text.split(mark)
        parts = [p for p in (head, *(mark + t for t in tail)) if p]
    else:
        parts = list(text)
    waiting: list[str] = []
    for part in parts:
        if len(part) < size:
            waiting.append(part)
            continue
        yield from _packed(waiting, size, overlap)
        waiting = []
        if finer:
            yield from _pieces(part, finer, size, overlap)
        else:
            yield part
    yield from _packed(waiting, size, overlap)


def _packed(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to ``size``; the next passage repeats the last ``overlap`` characters' worth of parts."""
    first, used = 0, 0
    for at, part in enumerate(parts):
        if used + len(part) > size and at > first:
            whole = "".join(parts[first:at]).strip()
            if whole:
                yield whole
            while used > overlap or (used and used + len(part) > size):
                used -= len(parts[first])
                first += 1
        used += len(part)
    whole = "".join(parts[first:]).strip()
    if whole:
        yield whole


def split_text(text: str, code: bool = False, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    found = _pieces(text, CODE_CUTS if code else PROSE_CUTS, size, 0 if code else overlap)
    return [p for p in (f.strip() for f in found) if p]


def split_sections(text: Column, content_type: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of passages of a section.

    Most sections fit into one passage and stay in the JVM; only longer ones are
    handed to Python, as Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series(
            [None if t is None else split_text(t, k == "code", size, overlap) for t, k in zip(texts, kinds)],
            dtype=object,
        )

    short = F.length(text) <= size
    return F.when(short, F.array(strip(text))).otherwise(cut(F.when(~short, text), content_type))


def cut_sections(sections: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """One row per passage with its number inside the section; no passage crosses a section."""
    small_batches(sections.sparkSession)
    pieces = split_sections(F.col("text"), F.col("content_type"), size, overlap)
    keep = [c for c in sections.columns if c != "text"]
    return (
        sections.withColumn("_pieces", pieces)
        .select(*keep, F.posexplode("_pieces").alias("piece_no", "raw"))
        .withColumn("piece_no", F.col("piece_no").cast("long"))
        .where(F.col("raw") != "")
    )


ORDER = ["page_number", "section_no", "piece_no"]


def bridged(passages: DataFrame, keys: list[str], block: str) -> DataFrame:
    """Prepend the last sentence before a prose section that starts in lower case.

    The carried sentence is the last sentence of the previous passage *after* its
    own bridging. That differs from its own last sentence only if the passage is
    one sentence and the text before it did not end a sentence; then the two run
    on as one. Such runs are numbered and joined, which needs no loop.
    """
    out = carry.previous(passages, keys, block, ORDER, {"_before": F.col("raw")})
    opens = (
        (F.col("piece_no") == 0) & (F.col("content_type") == "prose") & F.col("_before").isNotNull()
        & F.col("raw").rlike(r"^\p{IsLowercase}")
    )
    runs_on = opens & (sentence_count(F.col("raw")) == 1) & ~F.col("_before").rlike(r"[.!?]$")
    out = out.withColumn("_opens", opens).withColumn("_fresh", ~runs_on)
    own = F.when(F.col("_fresh"), last_sentence(F.col("raw"))).otherwise(F.col("raw"))
    out = carry.handed_on(out.withColumn("_own", own), keys, block, ORDER, "_fresh", "_own", "_carried")
    text = F.when(F.col("_opens"), F.concat_ws(" ", "_carried", "raw")).otherwise(F.col("raw"))
    return out.withColumn("raw", text).drop("_before", "_opens", "_fresh", "_own", "_carried")


def passage_content(page_number: Column, heading: Column, raw: Column) -> Column:
    """Passage text with its page and section prefix."""
    section = F.when(
        heading.isNotNull() & (heading != ""), F.concat(F.lit(" [Section: "), heading, F.lit("]"))
    ).otherwise("")
    return F.concat(F.lit("[Page "), page_number.cast("string"), F.lit("]"), section, F.lit("\n"), raw)


def with_content(passages: DataFrame) -> DataFrame:
    return passages.withColumn(
        "content", passage_content(F.col("page_number"), F.col("heading"), F.col("raw"))
    ).withColumn("char_count", F.length("content").cast("long"))


def first_copies(passages: DataFrame, keys: list[str], order: list[str] = ORDER) -> DataFrame:
    """The first passage of every content within ``keys`` (a document, or a page window)."""
    hashed = passages.withColumn("content_md5", F.md5("content"))
    return best_row(hashed, keys + ["content_md5"], F.struct(*order), newest=False)


def indexed(passages: DataFrame, keys: list[str], block: str, offset: Column | None = None) -> DataFrame:
    """Document-wide 0-based passage number."""
    out = carry.numbered(passages, keys, block, ORDER, "chunk_index")
    return out if offset is None else out.withColumn("chunk_index", F.col("chunk_index") + offset)
