"""Fuzzy passages shared by documents, by collinear chaining of k-mer seeds.

1. Seeds: all word ``K``-mers. ``MIN_WORDS`` words of which ``1 - MIN_ALIKE`` are replaced, in whatever
   places, share seven of them. Besides them, as they are rarer, of every ``SPAN`` neighbouring word
   ``ANCHOR``-mers the one with the smallest hash.
2. Seeds are packed by bucket of their hash, so a seed takes few bytes in its one shuffle. In its bucket each
   occurrence is matched with the seed's first document, so a seed of n documents gives n - 1
   matches. Where a document shares ``LEAD`` words from such an anchor on, every run of ``MIN_WORDS`` words around it is
   matched with the run's own first document too, so each exact run has a partner that holds
   all of it, whatever document holds its parts first. Of exact copies of a text only the first
   takes part; the others are linked with it as a whole. What such passages leave of a document, where it has seeds enough for one, is matched again:
   a seed with six of the words beside it, chosen in eight ways, with the first document that has all of these.
3. The matches of a pair of documents are merged along diagonals and chained: in order of both
   texts, with costs for gaps, each match takes the best predecessor from a Fenwick tree.
4. The texts of a chain are aligned: along the merged diagonals, by longest common
   subsequences in the gaps, and outwards from its ends. What is long and alike enough stays;
   of a chain that is not, the longest parts that are.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from ..sizing import join_sized
from .common import bounds, column, small_batches, whole_cells

K, ANCHOR, SPAN = 4, 8, 16
MIN_WORDS = 50
MIN_ALIKE = 0.8
GAP_COST = 0.2  # per word left out in either text
JOIN = 32  # words from match to match on a diagonal that are one segment
REACH = 64  # words looked at beyond the ends of a chain
EDITS = round(MIN_WORDS * (1 - MIN_ALIKE))  # words that may be replaced in the shortest passage
LEAST_SPAN = MIN_WORDS - EDITS - (K - 1) * EDITS  # of the seeds of a chain: the other runs between replaced words are shorter than a seed

LEAST_SEEDS = MIN_WORDS - K + 1 - K * EDITS  # of the shortest passage
BESIDE = ((5, 7, 10, 12, 15, 20), (4, 8, 11, 14, 18, 22), (6, 9, 13, 16, 17, 21), (5, 8, 12, 16, 19, 20))  # words after the start of a seed, or as many before its end
NEAR = 23  # words that a seed and those beside it reach over: one side of a seed has as many in the shortest passage
FILTER_BITS = 27

LEAD = MIN_WORDS - SPAN + 1  # of MIN_WORDS equal words so many follow the start of their first anchor at least

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SIZES = (K, ANCHOR, LEAD, MIN_WORDS, NEAR)
BUCKET_BYTES, LEAST_BUCKETS = 16 << 20, 64  # text of a bucket of seeds
PACKED_FIELDS = "cell long, h binary, doc binary, pos binary"
MATCH_FIELDS = "doc long, other long, pos int, other_pos int, size int"
SEGMENT_FIELDS = "doc long, other long, segments binary, leads binary"
CHAIN_FIELDS = "doc long, other long, segments binary"
PASSAGE_FIELDS = (
    "doc_id long, other_id long, start_word int, end_word int, other_start int, other_end int, n_match int, identity double"
)


def symbols(data: bytes | None) -> np.ndarray:
    """One number per word (its crc32), A-Z as a-z."""
    words = data.translate(_LOWER).split() if data else []
    return np.fromiter(map(zlib.crc32, words), np.uint32, len(words))


def kmer_hashes(s: np.ndarray, k: int = K) -> np.ndarray:
    if len(s) < k:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(s) - k + 1, np.uint64)
    for j in range(k):
        h = (h ^ s[j : len(s) - k + 1 + j].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def seeds_of(s: np.ndarray, k: int = ANCHOR, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes): the smallest k-mer of each ``span`` neighbours, the first one of ties."""
    h = kmer_hashes(s, k)
    if not len(h):
        return np.zeros(0, np.int64), h
    if len(h) <= span:
        at = np.array([int(h.argmin())])
    else:
        view = np.lib.stride_tricks.sliding_window_view(h, span)
        at = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return at, h[at]


def run_hashes(s: np.ndarray, k: int) -> np.ndarray:
    """A number for each ``k`` words in a row, from sums of powers: as fast for long runs as for short ones."""
    if len(s) < k:
        return np.zeros(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    back = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    mixed = (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(s) - 1, base)]), dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum(mixed * power, dtype=np.uint64)])
    shift = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(s) - k, back)]), dtype=np.uint64)
    h = (total[k:] - total[:-k]) * shift
    return (h ^ h >> np.uint64(31)) * base


def _side_by_side(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts one after the other, and where each begins and ends."""
    words = [symbols(x) for x in datas]
    ends = np.cumsum([len(w) for w in words], dtype=np.int64)
    return np.concatenate([np.zeros(0, np.uint32), *words]), np.append(0, ends)[:-1], ends


def beside(s: np.ndarray, h: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash): the seeds ``at`` some places (``h`` has the hashes of all, ``lo`` and ``hi`` the ends of their texts), each with six words of ``NEAR`` after its start or before its end, in eight ways."""
    starts, keys = [], []
    for n, steps in enumerate(BESIDE):
        for way, (p, first, sign) in enumerate(((at[at + NEAR <= hi], 0, 1), (at[at - lo >= NEAR - K], K - 1, -1))):
            key = h[p] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(2 * n + way + 1)
            for step in steps:
                key = (key ^ s[p + first + sign * step].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            starts.append(p if not way else p + K - NEAR)
            keys.append(key)
    return np.concatenate(starts), np.concatenate(keys)


def dense(at: np.ndarray) -> np.ndarray:
    """Those of the sorted places of seeds that lie among ``LEAST_SEEDS`` within ``MIN_WORDS`` words: no others are in a passage."""
    if len(at) < LEAST_SEEDS:
        return at[:0]
    i = np.flatnonzero(at[LEAST_SEEDS - 1 :] - at[: len(at) - LEAST_SEEDS + 1] <= MIN_WORDS - K)
    step = np.bincount(i, minlength=len(at) + 1) - np.bincount(i + LEAST_SEEDS, minlength=len(at) + 1)
    return at[np.cumsum(step)[:-1] > 0]


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be among those of the filter; it has ``FILTER_BITS`` bits, so a full one only lets more through."""
    i = h >> np.uint64(64 - FILTER_BITS)
    return (bits[(i >> np.uint64(6)).astype(np.int64)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: those of small numbers are zeros, which shuffles pack away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def packed(doc: np.ndarray, pos: np.ndarray, h: np.ndarray, size: int, buckets: int) -> pa.RecordBatch:
    """Seeds of one size as a row per bucket of hashes: half of each hash, steps from document to document and from word to word."""
    bucket = (h & np.uint64(buckets - 1)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    doc, pos, bucket, half = doc[order].astype(np.int64), pos[order].astype(np.int32), bucket[order], (h[order] >> np.uint64(32)).astype(np.uint32)
    at = bounds(bucket) if len(bucket) else np.zeros(1, np.int64)
    cells, columns = [], ([], [], [])
    for a, b in zip(at[:-1], at[1:]):
        step = np.diff(doc[a:b], prepend=0)
        ahead = np.where(step != 0, pos[a:b], np.diff(pos[a:b], prepend=np.int32(0))).astype(np.int32)
        cells.append(int(bucket[a]) * len(SIZES) + SIZES.index(size))
        for values, data in zip(columns, (half[a:b].tobytes(), _planes(step), _planes(ahead))):
            values.append(data)
    return pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), *(pa.array(v, pa.binary()) for v in columns)], names=["cell", "h", "doc", "pos"])


def unpacked(h: bytes, doc: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    step, ahead = _unplanes(doc, np.int64), _unplanes(pos, np.int32).astype(np.int64)
    fresh = step != 0
    fresh[:1] = True
    went = np.cumsum(ahead)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(step)), 0))
    return np.frombuffer(h, np.uint32), np.cumsum(step), went - (went - ahead)[start]


def _joined(made: list[tuple[int, np.ndarray, np.ndarray]], size: int, buckets: int) -> pa.RecordBatch:
    """(document, positions, hashes) of many documents, packed."""
    doc = np.repeat(np.array([m[0] for m in made], np.int64), [len(m[1]) for m in made])
    none = np.zeros(0, np.int64)
    return packed(doc, np.concatenate([none, *(m[1] for m in made)]), np.concatenate([none.astype(np.uint64), *(m[2] for m in made)]), size, buckets)


def seeds(docs: DataFrame, buckets: int) -> DataFrame:
    """All ``K``-mers, the chosen ``ANCHOR``-mers, and the ``LEAD`` words that begin with one of these."""

    def run(batches):
        for batch in batches:
            made: dict[int, list] = {K: [], ANCHOR: [], LEAD: []}
            for owner, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                s = symbols(data)
                every = kmer_hashes(s)
                at, h = seeds_of(s)
                far = at[at + LEAD <= len(s)]
                made[K].append((owner, np.arange(len(every)), every))
                made[ANCHOR].append((owner, at, h))
                made[LEAD].append((owner, far, run_hashes(s, LEAD)[far]))
            for size, found in made.items():
                yield _joined(found, size, buckets)

    return docs.mapInArrow(run, PACKED_FIELDS)


def whole_runs(linked: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """All runs of ``MIN_WORDS`` words that can be in two documents, as seeds of that size."""

    def both(batches):
        for batch in batches:
            sides = [np.frombuffer(x, "<i4").reshape(-1, 2) for x in batch.column(2).to_pylist()]
            owners = pa.concat_arrays([batch.column(0), batch.column(1)])
            at = [np.ascontiguousarray(x[:, i]).tobytes() for i in range(2) for x in sides]
            yield pa.RecordBatch.from_arrays([owners, pa.array(at, pa.binary())], names=["doc", "at"])

    marks = linked.where("length(leads) > 0").select("doc", "other", "leads").mapInArrow(both, "doc long, at binary")
    spots = write_table(marks.groupBy("doc").agg(F.collect_list("at").alias("at")), "spots")
    met = of_documents(texts, spots).join(spots, "doc").select("doc", "at", "text")

    def run(batches):
        for batch in batches:
            made = []
            for doc, at, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist()):
                h = run_hashes(symbols(data), MIN_WORDS)
                pos = np.unique(np.unique(np.frombuffer(b"".join(at), "<i4"))[:, None] - np.arange(SPAN))
                pos = pos[(pos >= 0) & (pos < len(h))].astype(np.int64)
                made.append((doc, pos, h[pos]))
            yield _joined(made, MIN_WORDS, buckets)

    return met.mapInArrow(run, PACKED_FIELDS)


def of_documents(texts: DataFrame, some: DataFrame) -> DataFrame:
    """The texts of the documents in ``some``; texts that are not wanted are not shuffled where their ids fit a broadcast."""
    return join_sized(texts, some.select("doc").distinct(), ["doc"], "left_semi")


def open_words(linked: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc, at, free): places of seeds that can be in a passage besides those found, and the stretches of words that these leave free around them."""
    marks = linked.where("doc = other").select("doc", F.col("segments").alias("at"))
    spans = passages.groupBy(F.col("doc_id").alias("doc")).agg(F.collect_list(F.struct("start_word", "end_word")).alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for doc, at, spans in zip(*(c.to_pylist() for c in batch.columns)):
                at, lo, held, free = np.frombuffer(at, "<i4"), 0, [], []
                for start, end in [*sorted((x["start_word"], x["end_word"]) for x in spans or ()), (2**31 - 1,) * 2]:
                    some = dense(at[(at >= lo) & (at <= start - K)]) if start - lo >= MIN_WORDS else at[:0]
                    if len(some):
                        held.append(some)
                        free += [lo, start]
                    lo = max(lo, end)
                if held:
                    out.append((doc, np.concatenate(held).tobytes(), np.array(free, "<i4").tobytes()))
            kinds = (pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["doc", "at", "free"])

    return marks.join(spans, "doc", "left").select("doc", "at", "spans").mapInArrow(run, "doc long, at binary, free binary")


def filters(left: DataFrame, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filters of the hashes of open seeds, and of these with the words beside them."""

    def run(batches):
        for batch in batches:
            found = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]]
            s, begin, ends = _side_by_side(batch.column(1).cast(pa.binary()).to_pylist())
            places = [np.frombuffer(x, "<i4") for x in batch.column(0).to_pylist()]
            of = np.repeat(np.arange(len(places)), [len(x) for x in places])
            if len(of):
                at, h = np.concatenate(places) + begin[of], kmer_hashes(s)
                found = [[h[at]], [beside(s, h, at, begin[of], ends[of])[1]]]
            for kind, h in enumerate(found):
                i = np.unique(np.concatenate(h) >> np.uint64(64 - FILTER_BITS))
                if len(i):
                    word = (i >> np.uint64(6)).astype(np.int64)
                    bits = np.bitwise_or.reduceat(np.uint64(1) << (i & np.uint64(63)), bounds(word)[:-1]).view(np.int64)
                    word = np.unique(word)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), kind)), pa.array(word), pa.array(bits)], names=["kind", "word", "bits"])

    made = of_documents(texts, left).join(left.select("doc", "at"), "doc").select("at", "text").mapInArrow(run, "kind long, word long, bits long")
    kind, word, bits = (c.to_numpy() for c in made.groupBy("kind", "word").agg(F.bit_or("bits").alias("bits")).toArrow().columns)  # 32 MB at most
    both = np.zeros((2, 1 << FILTER_BITS - 6), np.uint64)
    both[kind, word] = bits.view(np.uint64)
    return both[0], both[1]


def seeds_beside(left: DataFrame, texts: DataFrame, buckets: int) -> DataFrame:
    """The open seeds wherever they occur, with the words beside them."""
    held = texts.sparkSession.sparkContext.broadcast(filters(left, texts))

    def run(batches):
        seed, whole = held.value
        for batch in batches:
            s, begin, ends = _side_by_side(batch.column(1).cast(pa.binary()).to_pylist())
            h = kmer_hashes(s)
            at = np.flatnonzero(_held(seed, h))
            of = np.searchsorted(ends, at, "right")
            at, of = (x[at + K <= ends[of]] for x in (at, of))
            pos, keys = beside(s, h, at, begin[of], ends[of])
            keep = _held(whole, keys)
            pos, keys = pos[keep], keys[keep]
            of = np.searchsorted(ends, pos, "right")
            yield packed(batch.column(0).to_numpy()[of], pos - begin[of], keys, NEAR, buckets)

    return texts.mapInArrow(run, PACKED_FIELDS)


def matches(found: DataFrame) -> DataFrame:
    """(doc, other, pos, other_pos, size): each occurrence of a seed with that in its first document."""

    def first(table: pa.Table) -> pa.RecordBatch:
        cells = table.column(0).to_numpy()
        rows = [table.column(i).to_pylist() for i in range(1, 4)]
        out = [[np.zeros(0, kind)] for kind in (np.int64, np.int64, np.int32, np.int32, np.int32)]
        edges = bounds(cells)
        for a, b in zip(edges[:-1], edges[1:]):
            h, doc, pos = (np.concatenate(x) for x in zip(*map(unpacked, *(r[a:b] for r in rows))))
            order = np.argsort(h)
            same = h[order[1:]] == h[order[:-1]]
            order = order[np.append(False, same) | np.append(same, False)]  # most seeds occur once
            if not len(order):
                continue
            h, doc, pos = h[order], doc[order], pos[order]
            order = np.lexsort((pos, doc, h))
            h, doc, pos = h[order], doc[order], pos[order]
            at = bounds(h)
            head = np.repeat(at[:-1], np.diff(at))
            far = doc != doc[head]
            size = np.full(int(far.sum()), SIZES[int(cells[a]) % len(SIZES)], np.int32)
            for values, made in zip(out, (doc[far], doc[head][far], pos[far].astype(np.int32), pos[head][far].astype(np.int32), size)):
                values.append(made)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["doc", "other", "pos", "other_pos", "size"])

    def run(batches):
        return whole_cells(batches, first)

    return found.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, MATCH_FIELDS)


def segments_of(a: np.ndarray, b: np.ndarray, k: int = K, join: int = JOIN) -> np.ndarray:
    """Rows (start in a, start in b, length): matches merged along a diagonal over short stretches without one."""
    order = np.lexsort((a, b - a))
    a, d = a[order], (b - a)[order]
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] - a[:-1] > join)])
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(a)) - 1
    made = np.stack([a[at], a[at] + d[at], a[last] - a[at] + k], axis=1)
    return made[np.lexsort((made[:, 1], made[:, 0]))]


def merged(seg: np.ndarray, k: int = K, join: int = JOIN) -> np.ndarray:
    """Like ``segments_of``, for matches (start, start, length) of any length."""
    d = seg[:, 1] - seg[:, 0]
    order = np.lexsort((seg[:, 0], d))
    seg, d = seg[order], d[order]
    last = seg[:, 0] + seg[:, 2] - k
    ahead = np.cumsum(np.concatenate([[0], d[1:] != d[:-1]])) * (last.max() + 1)
    top = np.maximum.accumulate(last + ahead) - ahead
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (seg[1:, 0] - top[:-1] > join)])
    at = np.flatnonzero(fresh)
    made = np.stack([seg[at, 0], seg[at, 1], top[np.append(at[1:], len(seg)) - 1] + k - seg[at, 0]], axis=1)
    return made[np.lexsort((made[:, 1], made[:, 0]))]


def chains_of(seg: np.ndarray, gap: float = GAP_COST) -> list[np.ndarray]:
    """Best chains of segments in order of both texts; every segment is in one chain at most."""
    n = len(seg)
    if n == 1:
        return [seg]
    starts, others, lengths = seg[:, 0].tolist(), seg[:, 1].tolist(), seg[:, 2].tolist()
    ranks = {v: i + 1 for i, v in enumerate(sorted({o + l for o, l in zip(others, lengths)}))}
    ends = sorted(ranks)
    tree: list[tuple[float, int]] = [(float("-inf"), -1)] * (len(ends) + 1)
    score, before = [0.0] * n, [-1] * n
    waiting: list[tuple[int, int]] = []  # (end in a, segment), entered once a segment may follow it
    for i in range(n):
        while waiting and waiting[0][0] <= starts[i]:
            _, j = heapq.heappop(waiting)
            worth = score[j] + gap * (starts[j] + lengths[j] + others[j] + lengths[j])
            r = ranks[others[j] + lengths[j]]
            while r < len(tree):
                if tree[r][0] < worth:
                    tree[r] = (worth, j)
                r += r & -r
        best = (float("-inf"), -1)
        r = bisect.bisect_right(ends, others[i])
        while r:
            if tree[r][0] > best[0]:
                best = tree[r]
            r -= r & -r
        gained = best[0] - gap * (starts[i] + others[i])
        score[i] = lengths[i] + max(0.0, gained)
        before[i] = best[1] if gained > 0 else -1
        heapq.heappush(waiting, (starts[i] + lengths[i], i))
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        if path:
            out.append(seg[path[::-1]])
    return out


def _worth_aligning(chain: np.ndarray) -> bool:
    first, last = chain[0], chain[-1]
    return min(last[0] + last[2] - first[0], last[1] + last[2] - first[1]) >= LEAST_SPAN


def segments(pairs: DataFrame) -> DataFrame:
    """One row per pair of documents that can share a passage: its merged matches, and where those of ``LEAD`` words are.

    A row of a document with itself holds the places of its seeds that can be in a passage, with whatever document."""

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(5)]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0  # that document may go on
            if last:
                yield _merged(*[x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield _merged(*held)

    return pairs.repartition("doc").sortWithinPartitions("doc", "other", "pos", "other_pos").mapInArrow(run, SEGMENT_FIELDS)


def _merged(doc, other, pos, other_pos, size) -> pa.RecordBatch:
    edges = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]), [True]]))
    reach = np.maximum.reduceat(pos + size, edges[:-1]) - np.minimum.reduceat(pos, edges[:-1])
    found = np.stack([pos, other_pos, size], axis=1).astype(np.int64)
    out: list[tuple[int, int, bytes, bytes]] = []
    seed = size == K
    owners, of = np.unique(doc[seed], return_inverse=True)
    at = dense(np.unique(of.astype(np.int64) << 32 | pos[seed]))
    for a, b in zip((x := bounds(at >> 32))[:-1], x[1:]) if len(at) else ():
        owner = int(owners[at[a] >> 32])
        out.append((owner, owner, (at[a:b] & 0xFFFFFFFF).astype("<i4").tobytes(), b""))
    for i in np.flatnonzero(reach >= LEAST_SPAN):
        a, b = edges[i], edges[i + 1]
        leads = found[a:b][size[a:b] == LEAD, :2]
        out.append((int(doc[a]), int(other[a]), merged(found[a:b]).astype("<i4").tobytes(), leads.astype("<i4").tobytes()))
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["doc", "other", "segments", "leads"])


def chains(linked: DataFrame) -> DataFrame:
    """The chains of each pair that are long enough, from all of its segments."""

    def run(batches):
        for batch in batches:
            keep, out = [], []
            for i, parts in enumerate(batch.column(2).to_pylist()):
                seg = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 3).astype(np.int64)
                found = chains_of(merged(seg) if len(parts) > 1 else seg)
                good = [np.column_stack([c, np.full(len(c), n)]) for n, c in enumerate(c for c in found if _worth_aligning(c))]
                if good:
                    keep.append(i)
                    out.append(np.concatenate(good).astype("<i4").tobytes())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(out, pa.binary())], names=["doc", "other", "segments"])

    return linked.where("doc <> other").groupBy("doc", "other").agg(F.collect_list("segments").alias("segments")).mapInArrow(run, CHAIN_FIELDS)


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if not len(a) or not len(b):
        return 0
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b.tolist():
        u = v & places.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def _outward(same: np.ndarray) -> int:
    """How far to go on along equal and other words: where equal ones (+1) outweigh the others (-2) most."""
    total = np.cumsum(np.where(same, 1, -2))
    return int(total.argmax()) + 1 if len(total) and total.max() > 0 else 0


def _back(a: np.ndarray, b: np.ndarray, a0: int, b0: int) -> tuple[int, int]:
    """(words, equal ones) to go on before a pair of starts."""
    n = min(a0, b0, REACH)
    same = a[a0 - n : a0][::-1] == b[b0 - n : b0][::-1]
    back = _outward(same)
    return back, int(same[:back].sum())


def _on(a: np.ndarray, b: np.ndarray, a1: int, b1: int) -> tuple[int, int]:
    """(words, equal ones) to go on after a pair of ends."""
    n = min(len(a) - a1, len(b) - b1, REACH)
    same = a[a1 : a1 + n] == b[b1 : b1 + n]
    on = _outward(same)
    return on, int(same[:on].sum())


def aligned(a: np.ndarray, b: np.ndarray, chain: np.ndarray) -> tuple[int, int, int, int, int, float]:
    """(start, end, start, end, words matched, share of the longer side) of a chain over two texts."""
    at_a, at_b = int(chain[0, 0]), int(chain[0, 1])
    back, matched = _back(a, b, at_a, at_b)
    start, other = at_a - back, at_b - back
    for x, y, size in chain.tolist():
        if x > at_a or y > at_b:
            matched += common_words(a[at_a:x], b[at_b:y])
        matched += int((a[x : x + size] == b[y : y + size]).sum())
        at_a, at_b = x + size, y + size
    on, more = _on(a, b, at_a, at_b)
    end, stop, matched = at_a + on, at_b + on, matched + more
    return start, end, other, stop, matched, matched / max(1, end - start, stop - other)


def equal_runs(a: np.ndarray, b: np.ndarray, chain: np.ndarray) -> np.ndarray:
    """The segments of a chain cut down to their runs of equal words."""
    out = []
    for x, y, size in chain.tolist():
        edge = np.diff(np.concatenate([[0], a[x : x + size] == b[y : y + size], [0]]).astype(np.int8))
        at, to = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        out.append(np.stack([x + at, y + at, to - at], axis=1))
    return np.concatenate(out)


def passages_of(a: np.ndarray, b: np.ndarray, chain: np.ndarray, min_words: int, min_alike: float) -> list[tuple[int, int, int, int, int, float]]:
    """The chain as ``aligned`` gives it if it is long and alike enough, else its longest parts that are.

    Parts begin and end with runs of equal words. The longest part is taken first, then the
    longest of those beside it, until no part is left; parts of one chain never overlap.
    """
    whole = aligned(a, b, chain)
    if min(whole[1] - whole[0], whole[3] - whole[2]) < min_words:
        return []
    if whole[5] >= min_alike:
        return [whole]
    runs = equal_runs(a, b, chain)
    n = len(runs)
    if not n:
        return []
    ends = runs[:, :2] + runs[:, 2:]
    gaps = [0, *(common_words(a[p:x], b[q:y]) for (p, q), (x, y) in zip(ends[:-1].tolist(), runs[1:, :2].tolist()))]
    upto = np.cumsum(runs[:, 2] + gaps)  # words matched from the first run to the end of each
    before = upto - runs[:, 2]
    back = np.array([_back(a, b, x, y) for x, y in runs[:, :2].tolist()])
    on = np.array([_on(a, b, x, y) for x, y in ends.tolist()])
    starts, stops = runs[:, :2] - back[:, :1], ends + on[:, :1]

    def part(i: int, j) -> tuple:
        sides = stops[j] - starts[i]
        matched = upto[j] - before[i] + back[i, 1] + on[j, 1]
        return sides, matched, matched / np.maximum(1, sides.max(axis=-1))

    out, todo = [], [(0, n, 0, 0, len(a), len(b))]
    while todo:
        lo, hi, least_a, least_b, most_a, most_b = todo.pop()  # runs, and the words that the parts beside leave free
        found = []
        for i in range(lo, hi):
            if starts[i, 0] < least_a or starts[i, 1] < least_b:
                continue
            sides, _, alike = part(i, slice(i, hi))
            good = (sides.min(axis=1) >= min_words) & (alike >= min_alike) & (stops[i:hi, 0] <= most_a) & (stops[i:hi, 1] <= most_b)
            if good.any():
                j = int(np.flatnonzero(good)[-1])
                found.append((-int(sides[j].min()), i, i + j))
        taken: list[tuple[int, int]] = []
        for _, i, j in sorted(found):
            if all((j < p and (stops[j] <= starts[p]).all()) or (i > q and (starts[i] >= stops[q]).all()) for p, q in taken):
                taken.append((i, j))
        taken.sort()
        for i, j in taken:
            sides, matched, alike = part(i, j)
            out.append((*(int(v) for v in (starts[i, 0], stops[j, 0], starts[i, 1], stops[j, 1], matched)), float(alike)))
        if taken:
            cuts = [lo - 1, *(x for ij in taken for x in ij), hi]
            for k in range(0, len(cuts), 2):
                left = (least_a, least_b) if not k else tuple(stops[cuts[k]].tolist())
                right = (most_a, most_b) if k + 2 == len(cuts) else tuple(starts[cuts[k + 1]].tolist())
                if cuts[k + 1] - cuts[k] > 1 and min(right[0] - left[0], right[1] - left[1]) >= min_words:
                    todo.append((cuts[k] + 1, cuts[k + 1], *left, *right))
    return sorted(out)


def apart(
    a: np.ndarray, b: np.ndarray, chains: list[np.ndarray], min_words: int, min_alike: float, free: list[tuple[int, int]] | None = None,
) -> list[tuple]:
    """The passages of all chains of a pair, none over words of ``a`` that an earlier one covers, or outside the stretches in ``free``.

    Chains with more seeded words go first; of the others, what lies in words still free is aligned anew.
    """
    out, free = [], [(0, len(a))] if free is None else free
    for chain in sorted(chains, key=lambda c: (-int(c[:, 2].sum()), c[0].tolist())):
        left = []
        for lo, hi in free:
            x, end = np.maximum(chain[:, 0], lo), np.minimum(chain[:, 0] + chain[:, 2], hi)
            part = np.stack([x - lo, chain[:, 1] + x - chain[:, 0], end - x], axis=1)[end > x]
            at = lo
            for p in sorted(passages_of(a[lo:hi], b, part, min_words, min_alike)) if len(part) else ():
                out.append((p[0] + lo, p[1] + lo, *p[2:]))
                left.append((at, p[0] + lo))
                at = p[1] + lo
            left.append((at, hi))
        free = [(lo, hi) for lo, hi in left if hi - lo >= min_words]
    return sorted(out)


def shared(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, min_alike: float = MIN_ALIKE) -> DataFrame:
    """One row per passage of a document and its counterpart in the first document that has its seeds, or one of its runs of ``MIN_WORDS`` words.

    Columns of ``PASSAGE_FIELDS``; word positions count from 0, ends are exclusive. Rows of a pair
    don't overlap in ``doc_id``'s words. Rows without
    an id or a text take no part; rows that share an id are one document, represented by the smallest text.
    """
    rows = docs.select(column(doc_id).cast("long").alias("doc"), column(text).alias("text")).where("doc is not null and text is not null")
    small_batches(docs)
    rows = one_text(rows)
    copies = write_table(copies_of(rows), "copies")
    texts = join_sized(rows, copies.select("doc"), ["doc"], "left_anti")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = min(1 << 16, 1 << max(LEAST_BUCKETS.bit_length() - 1, (size // BUCKET_BYTES).bit_length()))
    linked = write_table(segments(matches(seeds(texts, buckets))), "segments")
    again = segments(matches(whole_runs(linked, texts, buckets)))
    found = write_table(chains(linked.drop("leads").unionByName(again.drop("leads"))), "chains")
    passages = write_table(aligned_pairs(found.withColumn("free", F.lit(None).cast("binary")), texts, min_words, min_alike), "passages")
    left = write_table(open_words(linked, passages), "open")
    if not left.isEmpty():
        pairs = join_sized(matches(seeds_beside(left, texts, buckets)), left.select("doc"), ["doc"], "left_semi")
        found = write_table(chains(segments(pairs).drop("leads")).join(left.select("doc", "free"), "doc"), "open-chains")
        passages = passages.unionByName(aligned_pairs(found, texts, min_words, min_alike))
    return passages.unionByName(whole_copies(rows, copies, min_words))


def aligned_pairs(found: DataFrame, texts: DataFrame, min_words: int, min_alike: float) -> DataFrame:
    """The passages of the chains of each pair, in the words of ``free`` if it is not null."""
    texts = of_documents(texts, found.select("doc").unionByName(found.select(F.col("other").alias("doc"))))

    def crop(batches):
        for batch in batches:
            doc, other, seg, free, data = (batch.column(i) for i in range(5))
            at, cut, kept, words = [], [], None, None
            for i, (owner, chain) in enumerate(zip(doc.to_pylist(), seg.to_pylist())):
                if owner != kept:
                    kept, words = owner, symbols(data[i].cast(pa.binary()).as_py())
                c = np.frombuffer(chain, "<i4").reshape(-1, 4)
                lo = max(0, int(c[:, 0].min()) - REACH)
                at.append(lo)
                cut.append(words[lo : int((c[:, 0] + c[:, 2]).max()) + REACH].tobytes())
            yield pa.RecordBatch.from_arrays(
                [doc, other, seg, free, pa.array(at, pa.int32()), pa.array(cut, pa.binary())], names=["doc", "other", "segments", "free", "at", "cut"]
            )

    def align(batches):
        for batch in batches:
            *columns, data = (batch.column(i) for i in range(7))
            out, kept, words = [], None, None
            for i, (d, o, s, free, lo, mine) in enumerate(zip(*(x.to_pylist() for x in columns))):
                if o != kept:
                    kept, words = o, symbols(data[i].cast(pa.binary()).as_py())
                seg = np.frombuffer(s, "<i4").reshape(-1, 4).astype(np.int64)
                seg[:, 0] -= lo
                of_pair = np.split(seg[:, :3], np.flatnonzero(np.diff(seg[:, 3])) + 1)
                mine = np.frombuffer(mine, np.uint32)
                if free is not None:
                    free = [(x, y) for x, y in (np.clip(np.frombuffer(free, "<i4").reshape(-1, 2).astype(np.int64) - lo, 0, len(mine))).tolist() if y - x >= min_words]
                for a0, a1, b0, b1, n, alike in apart(mine, words, of_pair, min_words, min_alike, free):
                    out.append({
                        "doc_id": d, "other_id": o, "start_word": a0 + lo, "end_word": a1 + lo, "other_start": b0, "other_end": b1,
                        "n_match": n, "identity": round(alike, 6),
                    })
            yield pa.RecordBatch.from_pylist(out, schema=_PASSAGE)

    cropped = found.join(texts, "doc").select("doc", "other", "segments", "free", "text").mapInArrow(crop, CHAIN_FIELDS + ", free binary, at int, cut binary")
    return cropped.join(texts.withColumnRenamed("doc", "other"), "other").select("doc", "other", "segments", "free", "at", "cut", "text").mapInArrow(align, PASSAGE_FIELDS)


def one_text(rows: DataFrame) -> DataFrame:
    """The smallest text of each id; texts of ids with one row are not shuffled."""
    twice = write_table(rows.groupBy("doc").count().where("count > 1").select("doc"), "repeated-ids")
    if twice.isEmpty():
        return rows
    least = join_sized(rows, twice, ["doc"], "left_semi").groupBy("doc").agg(F.min("text").alias("text"))
    return join_sized(rows, twice, ["doc"], "left_anti").unionByName(least)


def copies_of(rows: DataFrame) -> DataFrame:
    """(doc, other): documents whose whole text is that of an earlier one, with the first of them."""
    keyed = rows.select("doc", F.unhex(F.md5(F.col("text").cast("binary"))).alias("h"))
    first = keyed.groupBy("h").agg(F.min("doc").alias("other"), F.count("*").alias("n")).where("n > 1").select("h", "other")
    return keyed.join(first, "h").where("doc <> other").select("doc", "other")


def whole_copies(rows: DataFrame, copies: DataFrame, min_words: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            n = np.array([len(x.split()) for x in batch.column(2).cast(pa.binary()).to_pylist()], np.int32)
            long = n >= min_words
            doc, other, n = batch.column(0).filter(pa.array(long)), batch.column(1).filter(pa.array(long)), n[long]
            zero = pa.array(np.zeros(len(n), np.int32))
            yield pa.RecordBatch.from_arrays([doc, other, zero, pa.array(n), zero, pa.array(n), pa.array(n), pa.array(np.ones(len(n)))], schema=_PASSAGE)

    return join_sized(rows, copies, ["doc"]).select("doc", "other", "text").mapInArrow(run, PASSAGE_FIELDS)


_PASSAGE = pa.schema([
    ("doc_id", pa.int64()), ("other_id", pa.int64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("other_start", pa.int32()),
    ("other_end", pa.int32()), ("n_match", pa.int32()), ("identity", pa.float64()),
])


def digest(docs: DataFrame) -> DataFrame:
    return shared(docs)
