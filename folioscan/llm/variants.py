"""Spelling variants: words that one edit turns into each other, found by dense tiles.

Two words of which the longer has M code points are one edit apart if and only if they differ and
their common prefix and common suffix together reach M - 1. So one of both is at least M // 2 long,
and near words agree in their first or last M // 2 code points: each word goes to the groups
of M = its length and M = its length + 1, by prefix and by suffix. A group is a matrix of padded code
points, once from the left and once from the right; tiles of it are compared with tiles, and the
first difference from either side gives prefix and suffix. A pair counts in its prefix group, or,
if it shares too short a prefix, in its suffix group: once in all. No pair leaves its tile: each word
takes along how many near words it has and the best of them. Groups beyond ``BLOCK`` words are
dealt into blocks, and each pair of blocks is a cell of its own.

Words are runs of Latin letters, lower-cased from A to Z only, after the deletions that ``occurrences``
makes; null and empty texts have none, a null id is drawn as an empty id. Repeated rows count
again, ties go to the smaller word, an empty table gives no words. Only a word's count and length
decide whether it is listed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from ..sizing import join_sized
from .common import blocks, column, lengths, slices, small_batches, whole_cells

LEAST_POINTS = 6
LEAST_COUNT = 5
TIMES = 5  # a form is so many times as frequent
DELETE_ONE_IN = 199
BLOCK = 1024  # words in a block of a group
HELD_WORDS = 100_000  # different words that a task counts before it sends them on
TILE_ROWS, TILE_BYTES = 256, 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = "[A-Za-zÀ-ÿ]"


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_POINTS, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word, n): words of at least ``least`` code points and how often they occur.

    With h the crc32 of ``<id>:<word>``, a word whose h is divisible by ``one_in`` first loses its code point h % length.
    """
    small_batches(docs)
    run = re.compile(_LETTERS + "{%d,}" % max(1, least))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return made

        for batch in batches:
            data = batch.column(1).cast(pa.binary())
            for a, b in slices(lengths(data)):
                for key, t in zip(batch.column(0).slice(a, b - a).to_pylist(), data.slice(a, b - a).to_pylist()):
                    if not t:
                        continue
                    start = zlib.crc32(b"%s:" % (key or "").encode())
                    for word, n in Counter(run.findall(t.translate(_LOWER).decode())).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % one_in == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                        held[word] += n
                    if len(held) >= HELD_WORDS:
                        yield sent()
        if held:
            yield sent()

    parts = docs.select(column(doc_id).cast("string").alias("id"), column(text).alias("text")).mapInArrow(counted, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def tile_links(words: list[bytes], longer: int, by_prefix: bool, cells: np.ndarray, own: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that are one edit apart and whose longer word has ``longer`` code points; rows are sorted by cell."""
    n = len(words)
    sizes = np.array([len(w) for w in words])
    head = np.frombuffer(b"".join(w.ljust(longer, b"\0") for w in words), np.uint8).reshape(n, longer)
    tail = np.frombuffer(b"".join(w[::-1].ljust(longer, b"\0") for w in words), np.uint8).reshape(n, longer)
    ends = np.searchsorted(cells, cells, "right")
    rows = max(1, min(TILE_ROWS, int((TILE_BYTES // longer) ** 0.5)))
    for i in range(0, n, rows):
        a = slice(i, min(n, i + rows))
        for j in range(i, int(ends[a.stop - 1]), rows):
            b = slice(j, min(n, j + rows))
            meet = cells[a, None] == cells[None, b]
            meet &= (sizes[a, None] == longer) | (sizes[None, b] == longer)
            meet &= ~cross[a, None] | (own[a, None] != own[None, b])
            if i == j:
                meet &= np.triu(np.ones(meet.shape, bool), 1)
            x, y = np.nonzero(meet)
            if len(x) * 4 < meet.size:  # few of the tile's pairs share a cell: compare these alone
                for at in range(0, len(x), rows * rows):
                    u, v = x[at : at + rows * rows] + i, y[at : at + rows * rows] + j
                    prefix, suffix = (head[u] != head[v]).argmax(axis=1), (tail[u] != tail[v]).argmax(axis=1)
                    good = (prefix + suffix >= longer - 1) & ((prefix >= longer // 2) == by_prefix)
                    yield u[good], v[good]
                continue
            prefix = (head[a, None, :] != head[None, b, :]).argmax(axis=2)
            suffix = (tail[a, None, :] != tail[None, b, :]).argmax(axis=2)
            u, v = np.nonzero(meet & (prefix + suffix >= longer - 1) & ((prefix >= longer // 2) == by_prefix))
            yield u + i, v + j


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best): of ``words`` (word, n; distinct) those with near words, how many, and (n, word) of the most frequent."""
    small_batches(words)
    size, kinds = F.length("word"), []
    for more in (0, 1):
        longer = size + more
        half = (longer / 2).cast("int")
        for side, part in ((0, F.substring(F.col("word"), F.lit(1), half)), (1, F.substring(F.col("word"), size - half + 1, half))):
            kinds.append(F.struct((longer * 2 + side).alias("code"), F.xxhash64(longer, F.lit(side), part).alias("key")))
    keyed = words.select("word", "n", F.explode(F.array(*kinds)).alias("k")).select("word", "n", "k.code", "k.key")
    crowded = keyed.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    met = join_sized(keyed, write_table(crowded, "variant-groups"), ["key"], spread=F.xxhash64("word"))
    dealt = blocks(met, "key", "word", F.ceil(F.col("many") / BLOCK)).select("cell", "code", "own", "cross", "word", "n")

    def take(run: pa.Table) -> pa.RecordBatch:
        cells, codes, own, cross, n = (run.column(c).to_numpy() for c in ("cell", "code", "own", "cross", "n"))
        order = np.lexsort((cells, codes))
        cells, codes, own, cross, n = cells[order], codes[order], own[order], cross[order], n[order]
        texts = run.column("word").take(pa.array(order)).to_pylist()
        words = [t.encode("latin-1") for t in texts]
        ranked = sorted(range(len(words)), key=lambda i: (-int(n[i]), words[i]))
        rank = np.empty(len(words), np.int64)
        rank[ranked] = np.arange(len(words))
        near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
        for a, b in zip(*(lambda e: (e[:-1].tolist(), e[1:].tolist()))(np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1], [True]])))):
            longer, side = divmod(int(codes[a]), 2)
            for x, y in tile_links(words[a:b], longer, side == 0, cells[a:b], own[a:b], cross[a:b]):
                x, y = x + a, y + a
                for u, v in ((x, y), (y, x)):
                    np.add.at(near, u, 1)
                    np.minimum.at(best, u, rank[v])
        at = np.flatnonzero(near)
        top = [ranked[i] for i in best[at].tolist()]
        return pa.RecordBatch.from_arrays(
            [pa.array([texts[i] for i in at.tolist()], pa.string()), pa.array(near[at]), pa.array(n[top] if top else [], pa.int64()), pa.array([texts[i] for i in top], pa.string())],
            names=["word", "near", "near_n", "near_word"],
        )

    parts = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(
        lambda batches: whole_cells(batches, take), "word string, near long, near_n long, near_word string"
    )
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near_word").alias("word"))).alias("best")
    return parts.groupBy("word").agg(F.sum("near").alias("n_near"), best).select("word", "n_near", "best.word", (-F.col("best.minus")).alias("n")).toDF("word", "n_near", "best", "best_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): forms followed to the last, twice as far in every round."""
    now = write_table(forms.select("word", F.col("form").alias("at")), "variant-roots")
    while True:
        further = now.select(F.col("word").alias("at"), F.col("at").alias("next"))
        stepped = join_sized(now, further, ["at"], "left", spread=F.xxhash64("word"))
        done = write_table(stepped.select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNotNull().alias("moved")), "variant-roots")
        now = done.select("word", "at")
        if done.where("moved").isEmpty():
            return now.withColumnRenamed("at", "root")


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_count: int = LEAST_COUNT, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every frequent word with its near word of largest n, if that has ``times`` its n."""
    words = write_table(occurrences(docs, doc_id, text).where(F.col("n") >= least_count), "variant-words")
    found = words.join(near_words(words), "word", "left")
    is_form = F.col("best_n") >= times * F.col("n")
    judged = found.select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n"),
    )
    judged = write_table(judged, "variant-forms")
    ended = roots(judged.where("form is not null"))
    return judged.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def digest(docs: DataFrame) -> DataFrame:
    return variants(docs)
