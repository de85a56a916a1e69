"""Structural type of one page line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# What counts as a heading, table row, code line and list item.
# A heading is matched on the stripped line and only below 120 characters.
HEADING_MAX = 120
NUMBERED_HEADING = r"^(\d+\.)+\d*\s+\S"
LETTERED_HEADING = r"^[A-Z]{1,5}\.\s+\S"
HASH_HEADING = r"^#{1,4}\s+\S"
CAPITALS_HEADING = r"^[A-Z][A-Z\s\-]{3,60}$"
NAMED_HEADING = r"(?i)^(chapter|section|part|unit|module|lecture)\s+[\da-z]"
PIPE_ROW = r"\|.*\|"
TAB_ROW = r"\t.*\t"
INDENTED = r"^( {4}|\t)"
CODE_WORD = (
    r"^\s*(def |class |function |public |private |void |int |float |bool |return |import |from "
    r"|#include |SELECT |INSERT |UPDATE |DELETE |if\s*\(|for\s*\(|while\s*\(|switch\s*\()"
)
LIST_ITEM = r"^\s*([-*•]|\d+[.)]\s|[a-zA-Z][.)]\s)\S"
FENCE = "```"


def _matches(value: Column, pattern: str) -> Column:
    return value.rlike("(?U)" + pattern)


def is_heading(bare: Column) -> Column:
    """Whether a stripped line has one of the heading forms."""
    named = "(?i:" + NAMED_HEADING.removeprefix("(?i)^") + ")"
    forms = [p.removeprefix("^") for p in (NUMBERED_HEADING, LETTERED_HEADING, HASH_HEADING, CAPITALS_HEADING)]
    return (F.length(bare) < HEADING_MAX) & _matches(bare, "^(?:" + "|".join([*forms, named]) + ")")


def line_type(line: Column, bare: Column | None = None) -> Column:
    """heading, table, code, list or prose; tested in that order, blank lines are prose.

    ``line`` has no trailing whitespace; ``bare`` is the same line without
    leading whitespace, if the caller has it at hand.
    """
    bare = strip(line) if bare is None else bare
    return (
        F.when(bare == "", "prose")
        .when(is_heading(bare), "heading")
        .when(_matches(line, PIPE_ROW) | _matches(line, TAB_ROW), "table")
        .when(_matches(line, INDENTED) | _matches(line, CODE_WORD), "code")
        .when(_matches(line, LIST_ITEM), "list")
        .otherwise("prose")
    )
