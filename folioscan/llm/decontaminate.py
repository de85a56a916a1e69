"""Benchmark decontamination by a prefix-filtered set join.

Every window of an item (``width`` consecutive words; a shorter item is one window) is the
set of its ``SHINGLE``-word shingles. A document holds the window only if it holds all of
them, so the rarest one is a sufficient prefix: the shingles of all windows are counted over
all documents, each window is joined by its rarest one, windows with a shingle that no
document has fall out, and what joins is cut by the position bounds (the window must fit
between the document's ends) and compared word by word.

Documents are never shuffled: item blocks of at most ``BLOCK_BYTES`` go to the tasks one
after the other and each adds its hits to the rows that pass through.
"""

from __future__ import annotations

import hashlib
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attach, column, free_name, lengths, slices

WIDTH = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20

#: A-Z to a-z, digits, a-z and all bytes of other characters kept, the rest to a space
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(FOLD).split() if data else []


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for the words of a shingle; equal keys of other words are sorted out by the comparison."""
    key = np.full(len(columns[0]), len(columns), np.uint64)
    for c in columns:
        key = (key ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


class Windows:
    """The windows of a block of items, as word numbers (0 is any other word)."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        vocabulary: dict[bytes, int] = {}
        rows, owners = [], []
        for owner, data in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(data)]
            for i in range(max(0, len(ids) - width) + 1 if ids else 0):
                rows.append(ids[i : i + width])
                owners.append(owner)
        self.vocabulary, self.width, self.owners = vocabulary, width, owners
        self.length = np.array([len(r) for r in rows], np.int64)
        self.words = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            self.words[i, : len(r)] = r
        self.span = np.minimum(self.length, SHINGLE)
        # shingles of all windows: key, window, offset
        keys, window, offset = [], [], []
        for at in range(width):
            for n in range(1, SHINGLE + 1):
                some = np.flatnonzero((self.span == n) & (at + n <= self.length))
                if len(some):
                    keys.append(_mixed([self.words[some, at + j] for j in range(n)]))
                    window.append(some)
                    offset.append(np.full(len(some), at))
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        self.key, self.window, self.offset = cat(keys, np.uint64), cat(window, np.int64), cat(offset, np.int64)
        self.known = np.unique(self.key)
        self.sizes = [n for n in range(1, SHINGLE + 1) if (self.span == n).any()]

    def numbers(self, documents: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of the documents with a 0 after each, and where each starts."""
        lists = [words_of(d) for d in documents]
        starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lists])]).astype(np.int64)
        ids = np.zeros(starts[-1], np.int64)
        get = self.vocabulary.get
        for x, at in zip(lists, starts):
            if x:
                ids[at : at + len(x)] = np.fromiter(map(get, x, repeat(0)), np.int64, len(x))
        return ids, starts

    def shingles(self, ids: np.ndarray):
        """(positions, keys) of all shingles made of item words."""
        for n in self.sizes:
            if len(ids) < n:
                continue
            whole = ids[: len(ids) - n + 1] > 0
            for j in range(1, n):
                whole &= ids[j : len(ids) - n + 1 + j] > 0
            at = np.flatnonzero(whole)
            yield at, _mixed([ids[at + j] for j in range(n)])

    def count(self, ids: np.ndarray, into: np.ndarray) -> None:
        for _, keys in self.shingles(ids):
            i = np.searchsorted(self.known, keys)
            i[i == len(self.known)] = 0
            into += np.bincount(i[self.known[i] == keys], minlength=len(into)) if len(self.known) else 0

    def set_prefix(self, counts: np.ndarray) -> None:
        """Order each window's shingles by rarity; keep the first, and only windows that may occur."""
        seen = counts[np.searchsorted(self.known, self.key)]
        order = np.lexsort((self.offset, seen, self.window))
        first = order[np.unique(self.window[order], return_index=True)[1]]
        first = first[seen[first] > 0]
        first = first[np.argsort(self.key[first], kind="stable")]
        self.join_keys, begin, many = np.unique(self.key[first], return_index=True, return_counts=True)
        self.join_begin, self.join_many = begin, many
        self.join_window, self.join_offset = self.window[first], self.offset[first]
        self.key = self.window = self.offset = self.known = np.zeros(0)  # not needed in the tasks

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence of a window."""
        starts, windows = [], []
        for at, keys in self.shingles(ids) if len(self.join_keys) else ():
            i = np.searchsorted(self.join_keys, keys)
            i[i == len(self.join_keys)] = 0
            hit = np.flatnonzero(self.join_keys[i] == keys)
            many = self.join_many[i[hit]]
            slot = np.repeat(self.join_begin[i[hit]] - np.cumsum(many) + many, many) + np.arange(many.sum())
            window = self.join_window[slot]
            start = np.repeat(at[hit], many) - self.join_offset[slot]
            fits = (start >= 0) & (start + self.length[window] <= len(ids))
            start, window = start[fits], window[fits]
            same = np.ones(len(start), bool)
            for j in range(self.width):
                need = self.words[window, j]
                same &= (need == 0) | (ids[np.minimum(start + j, len(ids) - 1)] == need)
            starts.append(start[same])
            windows.append(window[same])
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def _blocks(items: DataFrame, item_id: str, text: str, limit: int):
    """The items in blocks of about ``limit`` bytes, read one after the other."""
    rows = items.select(column(item_id).cast("string").alias("i"), column(text).alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.octet_length("t") + 64)).first()[0] or 0
    many = max(1, -(-int(total) // limit))
    for b in range(many):
        mine = rows if many == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(many)) == b)
        yield sorted((r.i, r.t.encode()) for r in mine.collect())


def hits(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, name: str = "contamination", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``name``: n_words, spans (merged hit word ranges, end exclusive), items.

    Null or wordless texts have no words and no hits. Items without an id or a word are
    skipped; items that share an id count once. Repeated documents are judged row by row.
    """
    spark = docs.sparkSession
    fields = "n_words long, spans array<struct<a: long, b: long>>, items array<string>"
    out, held = docs, None
    for block in _blocks(items, item_id, item_text, block_bytes):
        windows = Windows(block, width)
        if not len(windows.length):
            continue
        windows.set_prefix(_counts(docs, text, windows))
        shared = spark.sparkContext.broadcast(windows)
        fresh = free_name(out, name)
        out = attach(out, lambda shared=shared: _finder(shared.value), fields, fresh, text)
        if held is not None:
            a, b = column(held), column(fresh)
            out = out.withColumn(fresh, F.struct(
                a["n_words"].alias("n_words"), F.concat(a["spans"], b["spans"]).alias("spans"),
                F.array_distinct(F.concat(a["items"], b["items"])).alias("items"),
            )).drop(held)
        held = fresh
    if held is None:
        fresh = free_name(out, name)
        return attach(out, lambda: lambda data: [(len(words_of(d)), [], []) for d in data], fields, fresh, text).withColumnRenamed(fresh, name)
    return out.withColumnRenamed(held, name)


def _counts(docs: DataFrame, text: str, windows: Windows) -> np.ndarray:
    """How often each shingle of the windows occurs in all documents; summed in the tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def run(batches):
        w = shared.value
        total = np.zeros(len(w.known), np.int64)
        for batch in batches:
            data = batch.column(0).cast(pa.binary())
            for a, b in slices(lengths(data)):
                w.count(w.numbers(data.slice(a, b - a).to_pylist())[0], total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.LongType())])
    counts = np.zeros(len(windows.known), np.int64)
    for k, n in docs.select(column(text).alias("t")).mapInArrow(run, schema).groupBy("k").agg(F.sum("n")).collect():
        counts[k] = n
    return counts


def _finder(windows: Windows):
    def work(data):
        ids, starts = windows.numbers(data)
        at, window = windows.occurrences(ids)
        owner = np.searchsorted(starts, at, side="right") - 1
        order = np.argsort(at, kind="stable")
        at, window, owner = at[order], window[order], owner[order]
        cut = np.searchsorted(owner, np.arange(len(data) + 1))
        out = []
        for i in range(len(data)):
            mine = slice(cut[i], cut[i + 1])
            spans: list[list[int]] = []
            for a, b in zip((at[mine] - starts[i]).tolist(), (at[mine] - starts[i] + windows.length[window[mine]]).tolist()):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            names = sorted({windows.owners[w] for w in window[mine]})
            out.append((int(starts[i + 1] - starts[i] - 1), [{"a": a, "b": b} for a, b in spans], names))
        return out

    return work


def n_hit(spans):
    """Words inside any span; spans of several blocks may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        ordered, start,
        lambda acc, s: F.struct(
            F.greatest(acc["end"], s["b"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0).cast("long"), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Contract columns of the query: hit words and items of every document."""
    c = F.col("contamination")
    return hits(docs.select("doc_id", "text"), items).select(
        "doc_id",
        c["n_words"].alias("n_words"),
        n_hit(c["spans"]).alias("n_hit"),
        F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["items"]), ","), 256).alias("items_sha256"),
        (F.size(c["spans"]) > 0).alias("contaminated"),
    )


def sha_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
