"""Text expressions on columns. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace and line ends as the page text defines them.
SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"(?<=[\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029])|(?<=\r)(?!\n)"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+"


def strip(value: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (``trim`` only knows blanks)."""
    return F.btrim(value, F.lit(SPACES))


def rstrip(value: Column) -> Column:
    return F.rtrim(value, F.lit(SPACES))


def lstrip(value: Column) -> Column:
    return F.ltrim(value, F.lit(SPACES))


def squeeze(value: Column) -> Column:
    """Collapse whitespace runs to one blank and strip the ends."""
    return F.trim(F.regexp_replace(value, rf"(?U){SPACE}+", " "))


def is_blank(value: Column) -> Column:
    return ~value.rlike(rf"(?U)[^\s\x1c-\x1f]")


def lines_keeping_ends(text: Column) -> Column:
    """Array of lines, each with its own line end."""
    return F.filter(F.split(text, LINE_END), lambda x: F.length(x) > 0)


def words(text: Column) -> Column:
    """Whitespace separated words; an empty array for blank text."""
    return F.filter(F.split(squeeze(text), " "), lambda x: x != "")


def last_sentence(text: Column) -> Column:
    return strip(F.element_at(F.split(text, SENTENCE_GAP), -1))


def sentence_count(text: Column) -> Column:
    return F.size(F.split(text, SENTENCE_GAP))


def normalise(text: Column) -> Column:
    """Matching form of page text: lower case, ligatures opened, punctuation dropped."""
    out = F.lower(text)
    out = F.replace(F.replace(out, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl"))
    out = F.regexp_replace(out, rf"(?U){SPACE}+", " ")
    out = F.regexp_replace(out, r"[^A-Za-z0-9_\s]", "")
    return F.trim(out)


def conversation_title(question: Column) -> Column:
    """First 40 characters, with an ellipsis when cut."""
    raw = strip(question)
    cut = F.concat(rstrip(F.substring(raw, 1, 40)), F.lit("…"))
    return (
        F.when(F.length(raw) > 40, cut)
        .when(F.length(raw) == 0, F.lit("New Conversation"))
        .otherwise(raw)
    )


def sentence_pack(text: Column, limit: int = 500) -> Column:
    """Pack sentences into pieces of at most ``limit`` characters.

    A sentence that is longer by itself first closes the pending piece and is
    then cut hard, so nothing is lost.
    """
    clean = squeeze(text)
    sentences = F.filter(
        F.transform(F.split(clean, r"(?<=[.!?]) "), lambda s: F.trim(s)), lambda s: s != ""
    )

    def hard_cut(s: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), (F.length(s) - 1).cast("int"), F.lit(limit)),
            lambda i: F.substring(s, i + 1, F.lit(limit)),
        )

    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), F.lit("").alias("open"))

    def step(acc: Column, s: Column) -> Column:
        pending = F.when(acc["open"] == "", empty).otherwise(F.array(acc["open"]))
        joined = F.concat(acc["open"], F.lit(" "), s)
        return (
            F.when(
                F.length(s) > limit,
                F.struct(F.concat(acc["done"], pending, hard_cut(s)).alias("done"), F.lit("").alias("open")),
            )
            .when(acc["open"] == "", F.struct(acc["done"].alias("done"), s.alias("open")))
            .when(F.length(joined) <= limit, F.struct(acc["done"].alias("done"), joined.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], pending).alias("done"), s.alias("open")))
        )

    packed = F.aggregate(
        sentences,
        start,
        step,
        lambda acc: F.concat(acc["done"], F.when(acc["open"] == "", empty).otherwise(F.array(acc["open"]))),
    )
    return F.when(clean == "", empty).when(F.length(clean) <= limit, F.array(clean)).otherwise(packed)
