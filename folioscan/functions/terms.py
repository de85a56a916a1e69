"""Search terms of a text, and how often query terms occur in it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual English stop words of full-text search.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can did do does doing don down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own s same she "
    "should so some such t than that the their theirs them themselves then there these they this those "
    "through to too under until up very was we were what when where which while who whom why will with "
    "you your yours yourself yourselves"
).split()


def raw_terms(text: Column) -> Column:
    """Lower-case words and numbers in reading order, stop words included."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def terms(text: Column) -> Column:
    """Search terms in reading order, repeats kept."""
    return F.filter(raw_terms(text), lambda t: ~t.isin(*STOP_WORDS))


def query_terms(text: Column) -> Column:
    return F.array_sort(F.array_distinct(terms(text)))


def anchor_term(distinct_terms: Column) -> Column:
    """The term a matching passage is looked up by: the longest, first in order on ties.

    Long words tend to be rare, so few passages meet each query. NULL for a
    query without terms, which therefore matches nothing.
    """
    best = F.aggregate(
        distinct_terms,
        F.lit("").cast("string"),
        lambda acc, t: F.when(F.length(t) > F.length(acc), t).otherwise(acc),
    )
    return F.when(F.size(distinct_terms) > 0, best)


def matches_all(passage_terms: Column, wanted: Column) -> Column:
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, passage_terms)) == 0)


def term_frequency(passage_terms: Column, wanted: Column) -> Column:
    """How many of the passage terms are query terms, repeats counted."""
    return F.size(F.filter(passage_terms, lambda t: F.array_contains(wanted, t)))
