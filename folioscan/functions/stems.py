"""Stems of search terms (Porter 1980) as column expressions.

A word is [C](VC)^m[V] in runs of consonants and vowels; y is a vowel after a consonant. Each
step is one pass over an array of terms whose element is bound once, so the plan grows with the number
of steps, not with their nesting. Terms that are not three or more letters a-z carry a mark at their
end while the steps run, which no suffix rule matches, and come out unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix tables of the published algorithm; the longest suffix of a word decides.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent",
    "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful",
    "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# Patterns over a stem, the same in every engine.
HEAD = "^(?:[^aeiou][^aeiouy]*[aeiouy]|[aeiou])[aeiou]*"  # [C]V
MEASURE_1 = HEAD + "[^aeiou]"  # m > 0
MEASURE_2 = HEAD + "[^aeiou][^aeiouy]*[aeiouy][aeiou]*[^aeiou]"  # m > 1
MEASURE_ONE = HEAD + "[^aeiou][^aeiouy]*(?:[aeiouy][aeiou]*)?$"  # m = 1
VOWEL = "[aeiou]|.y"
SHORT = "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"  # m = 1 and ends consonant, vowel, consonant other than w, x, y
DOUBLE = "(?:bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|[^aeiouy]yy)$"  # a double consonant that is cut; l, s and z stay
STEMMABLE = "^[a-z]{3,}$"
KEPT, OPENED = "\x02", "\x01"  # marks: left alone; ed or ing was cut


def ending(suffixes) -> str:
    """A word's rest and its longest suffix of a list."""
    return "^(.*?)(" + "|".join(suffixes) + ")$"


def _cut(w: Column, n: int) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _plural(w: Column) -> Column:
    return F.when(w.rlike("(?:ss|i)es$"), _cut(w, 2)).when(w.rlike("(?:^|[^s])s$"), _cut(w, 1)).otherwise(w)


def _past(w: Column) -> Column:
    stem = F.regexp_extract(w, "^(.*?)(?:ed|ing)$", 1)
    return (
        F.when(w.endswith("eed"), F.when(_cut(w, 3).rlike(MEASURE_1), _cut(w, 1)).otherwise(w))
        .when(stem.rlike(VOWEL), F.concat(stem, F.lit(OPENED)))
        .otherwise(w)
    )


def _closed(w: Column) -> Column:
    stem = _cut(w, 1)
    fixed = (
        F.when(stem.rlike("(?:at|bl|iz)$"), F.concat(stem, F.lit("e")))
        .when(stem.rlike(DOUBLE), _cut(stem, 1))
        .when(stem.rlike(SHORT), F.concat(stem, F.lit("e")))
        .otherwise(stem)
    )
    return F.when(w.endswith(OPENED), fixed).otherwise(w)


def _final_y(w: Column) -> Column:
    return F.when(w.endswith("y") & _cut(w, 1).rlike(VOWEL), F.concat(_cut(w, 1), F.lit("i"))).otherwise(w)


def _replaced(table: dict[str, str]):
    pattern = ending(table)
    values = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    def step(w: Column) -> Column:
        stem = F.regexp_extract(w, pattern, 1)
        return F.when(stem.rlike(MEASURE_1), F.concat(stem, values[F.regexp_extract(w, pattern, 2)])).otherwise(w)

    return step


def _dropped(w: Column) -> Column:
    pattern = ending(STEP_4)
    stem = F.regexp_extract(w, pattern, 1)
    allowed = (F.regexp_extract(w, pattern, 2) != "ion") | stem.rlike("[st]$")
    return F.when(stem.rlike(MEASURE_2) & allowed, stem).otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _cut(w, 1)
    gone = w.endswith("e") & (stem.rlike(MEASURE_2) | (stem.rlike(MEASURE_ONE) & ~stem.rlike(SHORT)))
    return F.when(gone, stem).otherwise(w)


def _final_l(w: Column) -> Column:
    return F.when(w.endswith("ll") & w.rlike(MEASURE_2), _cut(w, 1)).otherwise(w)


def _marked(w: Column) -> Column:
    return F.when(w.rlike(STEMMABLE), w).otherwise(F.concat(w, F.lit(KEPT)))


def _unmarked(w: Column) -> Column:
    return F.when(w.endswith(KEPT), _cut(w, 1)).otherwise(w)



def stems(terms: Column) -> Column:
    """The stems of an array of lower-case terms, in the same order, repeats kept."""
    steps = [_marked, _plural, _past, _closed, _final_y, _replaced(STEP_2), _replaced(STEP_3), _dropped, _final_e, _final_l, _unmarked]
    return reduce(lambda words, step: F.transform(words, step), steps, terms)


def stem(term: Column) -> Column:
    return F.get(stems(F.array(term)), 0)
