"""Quality rules with suffix-array repetition.

The words of many documents are numbered together and sorted once: prefix doubling ranks
the suffixes of all documents of a slice at the same time, with the document as first key, so
suffixes of different documents never compare equal. Only suffixes that still share their
rank are sorted again. The longest common prefixes of neighbours come from one more pass over
the finished array, so memory is linear in the words. The longest repeat that starts at a word is the larger of its
two neighbour prefixes; the union of these spans is what the maximal repeated substrings
(the right ends of the prefix intervals) cover.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach

BASE_WORDS = 5
MIN_WORDS = 10  # a maximal repeat counts from this length on
MAX_COVERED = 0.1  # of the words, by maximal repeats; half of what the base rule allows for short ones
MAX_LONGEST = 100  # words of the longest repeat
STEPS = 64  # words that neighbours are compared by one at a time
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long,"
    " longest_repeat long, n_maximal long, base_failed boolean, kept boolean"
)


def numbered(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all lists one after the other, and the bounds of the lists."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    ids = np.empty(bounds[-1], np.int64)
    for x, at in zip(lists, bounds):
        ids[at : at + len(x)] = np.fromiter(map(number.__getitem__, x), np.int64, len(x))
    return ids, bounds


def suffix_order(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of each suffix) of all lists, by prefix doubling."""
    n = len(ids)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][owner]
    key = owner * (ids.max() + 1) + ids
    order = np.argsort(key, kind="stable")
    fresh = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    step = 1
    size = np.bincount(head, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    while len(open_):
        ahead = open_ + step
        second = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[open_]
        by = np.lexsort((second, first))
        open_, first, second = open_[by], first[by], second[by]
        group = np.concatenate([[True], first[1:] != first[:-1]])
        split = group | np.concatenate([[True], second[1:] != second[:-1]])
        at = np.arange(len(open_))
        offset = np.maximum.accumulate(np.where(split, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        rank[open_] = first + offset
        step *= 2
        count = np.diff(np.append(np.flatnonzero(split), len(open_)))
        open_ = open_[np.repeat(count > 1, count)]
    order[rank] = np.arange(n)
    return order, rank


def shared_prefixes(ids: np.ndarray, bounds: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the suffix before it in order, by place in the text.

    Where the words before both are equal too, it is one less than at the place before. Only
    the others are compared, word by word in step and the few long ones in blocks: they add
    up to at most n log n words.
    """
    n = len(ids)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    end = bounds[1:][owner]
    before = np.where(rank > 0, order[rank - 1], 0)
    met = (rank > 0) & (owner[before] == owner)
    place = np.arange(n)
    first = bounds[:-1][owner]
    follows = met & (place > first) & (before > first)
    follows &= ids[place - 1] == ids[before - 1]
    shared = np.zeros(n, np.int64)
    live = np.flatnonzero(met & ~follows)
    for k in range(STEPS):
        a, b = live + k, before[live] + k
        live = live[(a < end[live]) & (b < end[live]) & (ids[np.minimum(a, n - 1)] == ids[np.minimum(b, n - 1)])]
        shared[live] = k + 1
        if not len(live):
            break
    for i in live.tolist():
        a, b, size = i + STEPS, int(before[i]) + STEPS, STEPS
        stop = int(end[i])
        while True:
            m = min(size, stop - a, stop - b)
            differ = ids[a : a + m] != ids[b : b + m]
            if m < size or differ.any():
                shared[i] = a - i + (int(differ.argmax()) if differ.any() else m)
                break
            a, b, size = a + m, b + m, size * 2
    source = np.maximum.accumulate(np.where(follows, 0, place))
    return shared[source] - (place - source)


def longest_repeats(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, prefix shared with the suffix before, longest repeat starting at each word)."""
    if not len(ids):
        return (np.zeros(0, np.int64),) * 3
    order, rank = suffix_order(ids, bounds)
    shared = shared_prefixes(ids, bounds, order, rank)[order]
    longest = np.empty(len(ids), np.int64)
    longest[order] = np.maximum(shared, np.append(shared[1:], 0))
    return order, shared, longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """True for words inside a repeat of at least ``least`` words."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + longest[at], -1)
    return np.cumsum(edge[:-1]) > 0


def rules(min_words: int = MIN_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST):
    """Function from texts to rows of ``FIELDS``."""

    def work(data):
        lists = [d.split() if d else [] for d in data]
        ids, bounds = numbered(lists)
        longest = longest_repeats(ids, bounds)[2]
        base, strict = covered(longest, BASE_WORDS), covered(longest, min_words)
        starts = longest >= min_words
        inner = np.concatenate([[False], longest[:-1] == longest[1:] + 1]) if len(longest) else starts
        inner[bounds[:-1][bounds[:-1] < len(longest)]] = False
        maximal = starts & ~inner
        total = lambda x: np.concatenate([[0], np.cumsum(x)])[bounds]
        n_base, n_strict, n_maximal = np.diff(total(base)), np.diff(total(strict)), np.diff(total(maximal))
        out = []
        for i, d in enumerate(data):
            d = d or b""
            n = len(lists[i])
            top = int(longest[bounds[i] : bounds[i + 1]].max()) if n else 0
            points = len(d) - sum(map(d.count, (bytes([c]) for c in SPACES))) if d.isascii() else len(d.decode()) - sum(map(d.count, (bytes([c]) for c in SPACES)))
            lines = [x for x in d.split(b"\n") if x.strip()]
            failed = n < 10 or 100 * int(n_base[i]) > 20 * n
            fine = int(n_strict[i]) <= max_covered * n and top <= max_longest
            out.append((
                n, points, sum(map(d.count, (bytes([c]) for c in SYMBOLS))), len(lines) - len(set(lines)), int(n_base[i]),
                int(n_strict[i]), top, int(n_maximal[i]), failed, not failed and fine,
            ))
        return out

    return work


def judged(
    docs: DataFrame, name: str = "quality", text: str = "text", min_words: int = MIN_WORDS,
    max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST,
) -> DataFrame:
    """``docs`` with a struct ``name`` of counts and the verdict ``kept``.

    A null or wordless text has zeros and fails the base rule (under ten words). Rows are
    judged one by one, so repeated rows get the same verdict. Very long texts are sorted whole.
    """
    return attach(docs, lambda: rules(min_words, max_covered, max_longest), FIELDS, name, text)


def digest(docs: DataFrame) -> DataFrame:
    return judged(docs.select("doc_id", "text")).select("doc_id", F.col("quality.*"))
