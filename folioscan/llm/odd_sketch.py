"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct two-word shingles. Equal sets are one node. ``HASHES`` minima
are taken of every set: the first ``BANDS`` x ``ROWS`` of them make band keys, and each (function,
minimum) flips one of ``BITS`` bits of the odd sketch. Where two sketches differ in ``x`` bits, about
``-bits / 4 * ln(1 - 2 x / bits)`` minima differ, which is precise where sets are alike.

Nodes that share a band key meet in a bucket. There a pair is a candidate if its sizes and its
sketches allow the similarity; pairs that just reach it are kept up to five standard deviations
of the estimate. Buckets follow candidates from node to node and emit one edge per node, so
a family (nodes connected by candidates) holds every link of its nodes. Then the whole texts of
each family meet once, candidates are confirmed on full sets, and confirmed links again give one
edge per node. Buckets and families beyond a bound are dealt into blocks, and each pair of blocks is
a cell of its own. A link at exactly 0.8 shares no band with a chance of 5e-8.

Null and empty texts and texts without a word have an empty set, are linked with nothing and are
their own component. Null ids take part like others; a component's id is null only if all its ids
are. Repeated rows stay and share their component. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from ..sizing import join_sized
from .common import attach, blocks, bounds, column, lengths, slices, small_batches, whole_cells
from .simhash import components

ALIKE = 80  # hundredths of the union
HASHES = 512
BANDS, ROWS = 32, 4
BITS = 2048
SIGMAS = 5
BUCKET_ROWS = 4096  # nodes in a block of a bucket
FAMILY_ROWS = 2048  # nodes in a block of a family
FAMILY_BYTES = 16 << 20  # and about its text
SEED = 42

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(SEED)
_A, _B, _C = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(3))
_MIX = _RNG.integers(0, 1 << 62, 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def most_odd_bits(alike: int = ALIKE, hashes: int = HASHES, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """Differing bits that a pair of similarity ``alike`` has at most, up to ``sigmas`` standard deviations."""
    j = alike / 100
    odd = 2 * hashes * (1 - j)  # elements of one sample only
    mean = bits / 2 * (1 - np.exp(-2 * odd / bits))
    by_sample = 2 * np.exp(-2 * odd / bits) * np.sqrt(hashes * j * (1 - j))
    by_fold = np.sqrt(bits / 4 * (1 - np.exp(-4 * odd / bits)))
    return int(mean + sigmas * np.hypot(by_sample, by_fold))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[2]
    return (x ^ (x >> np.uint64(29))) * _MIX[3]


def shingle_sets(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct 64-bit shingle hashes of all texts one after the other, how many each has)."""
    words = [(t or b"").translate(_LOWER).split() for t in texts]
    counts = np.array([len(w) for w in words], np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), counts
    coded = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode()
    del words
    hashes = np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)[coded.indices.to_numpy()]
    left = hashes * _MIX[0]
    pairs = np.zeros(len(hashes), np.uint64)
    pairs[:-1] = _mixed(left[:-1] ^ ((hashes[1:] >> np.uint64(7)) + hashes[1:] * _MIX[1]))
    single = _mixed(left ^ _MIX[2])
    ends = np.cumsum(counts)
    found = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        found.append(np.unique(pairs[end - n : end - 1]) if n > 1 else single[end - n : end])
    return np.concatenate(found), np.array([len(f) for f in found], np.int64)


def minima(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(sets, HASHES) minima of sets that are not empty."""
    starts = np.cumsum(counts) - counts
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(counts), HASHES), np.uint32)
    for i in range(HASHES):
        out[:, i] = np.minimum.reduceat((low * _A[i]) ^ (high * _B[i]), starts)
    return out


def band_keys(mins: np.ndarray) -> np.ndarray:
    rows = mins[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for i in range(ROWS):
        key = _mixed(key * _MIX[1] + rows[:, :, i])
    return key.view(np.int64)


def sketches(mins: np.ndarray) -> np.ndarray:
    """(sets, BITS / 8) bytes: each minimum flips the bit that it hashes to."""
    at = (((mins ^ (mins >> np.uint32(15))) * _C) >> np.uint32(32 - BITS.bit_length() + 1)).astype(np.int64)
    at += (np.arange(len(mins), dtype=np.int64) * BITS)[:, None]
    flips = np.bincount(at.ravel(), minlength=len(mins) * BITS)
    return np.packbits((flips & 1).astype(np.uint8).reshape(len(mins), BITS), axis=1)


def _sketched(texts: list[bytes | None]) -> list[tuple]:
    rows = []
    for a in range(0, len(texts), 1024):
        values, counts = shingle_sets(texts[a : a + 1024])
        held = counts > 0
        if held.any():
            mins = minima(values, counts[held])
            keys, bits = iter(band_keys(mins).tolist()), iter(sketches(mins))
        ends = np.cumsum(counts).tolist()
        for end, n in zip(ends, counts.tolist()):
            if n:
                rows.append((n, xxhash.xxh3_128_digest(values[end - n : end].tobytes()), next(bits).tobytes(), next(keys)))
            else:
                rows.append((0, None, None, None))
    return rows


def sketched(docs: DataFrame, name: str = "sketched", text: str = "text") -> DataFrame:
    """``docs`` and a struct: n_shingles, node (digest of the set), sketch, bands; the last three null for an empty set."""
    return attach(docs, lambda: _sketched, "n_shingles long, node binary, sketch binary, bands array<bigint>", name, text)


def follow(sizes: np.ndarray, bits: np.ndarray, most: int, alike: int, confirm=None) -> tuple[list[int], list[int]]:
    """Edges (row, row met first) that connect what is alike: from each root on, links lead to further rows.

    ``confirm(row, rows)`` tells which candidates are links; without it every candidate is one.
    """
    order = np.argsort(sizes, kind="stable")
    rest = order
    left, right = [], []
    while len(rest) > 1:
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            grown = sizes[rest]
            for node in front.tolist():
                n = int(sizes[node])
                a = int(np.searchsorted(grown, -(-n * alike // 100), "left"))
                b = int(np.searchsorted(grown, n * 100 // alike, "right"))
                at = a + np.flatnonzero(~reached[a:b])
                at = at[np.bitwise_count(bits[rest[at]] ^ bits[node]).sum(axis=1, dtype=np.int64) <= most]
                if confirm is not None and len(at):
                    at = at[confirm(node, rest[at])]
                reached[at] = True
            front, rest = rest[reached], rest[~reached]
            left += front.tolist()
            right += [int(root)] * len(front)
    return left, right


def _bits(data: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(data.to_pylist()), np.uint64).reshape(len(data), -1)


def _edges(nodes: list[bytes], left: list[int], right: list[int]) -> pa.RecordBatch:
    pairs = [sorted((nodes[a], nodes[b])) for a, b in zip(left, right)]
    return pa.RecordBatch.from_arrays([pa.array([p[1] for p in pairs], pa.binary()), pa.array([p[0] for p in pairs], pa.binary())], names=["a", "b"])


def candidates(nodes: DataFrame, alike: int = ALIKE) -> DataFrame:
    """Edges (a, b) that connect all nodes (node, n, sketch, bands) which share a band and may be alike."""
    most = most_odd_bits(alike)
    banded = nodes.select("node", F.explode("bands").alias("band"))
    # buckets with the same members do the same work: one of them stays
    shared = banded.groupBy("band").agg(F.count("*").alias("many"), F.bit_xor(F.xxhash64("node")).alias("who")).where("many > 1")
    shared = write_table(shared.groupBy("many", "who").agg(F.min("band").alias("band")).select("band", "many"), "odd-buckets")
    met = join_sized(banded, shared, ["band"], spread=F.xxhash64("node")).join(nodes.select("node", "n", "sketch"), "node")
    dealt = blocks(met, "band", "node", F.ceil(F.col("many") / BUCKET_ROWS)).select("cell", "n", "node", "sketch")
    small_batches(nodes)

    def take(run: pa.Table) -> pa.RecordBatch:
        cells, sizes, bits = run.column(0).to_numpy(), run.column(1).to_numpy(), _bits(run.column(3))
        at, names = bounds(cells), run.column(2).to_pylist()
        two = at[:-1][np.diff(at) == 2]
        low, high = np.minimum(sizes[two], sizes[two + 1]), np.maximum(sizes[two], sizes[two + 1])
        near = two[(100 * low >= alike * high) & (np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int64) <= most)]
        left, right = (near + 1).tolist(), near.tolist()
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a > 2:
                x, y = follow(sizes[a:b], bits[a:b], most, alike)
                left += [a + i for i in x]
                right += [a + i for i in y]
        return _edges(names, left, right)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: whole_cells(batches, take), "a binary, b binary").distinct()


def confirmed(members: DataFrame, alike: int = ALIKE) -> DataFrame:
    """Edges (a, b) that connect what full sets link among ``members`` (family, node, n, sketch, text)."""
    most = most_odd_bits(alike)
    sizes = members.groupBy("family").agg(F.count("*").alias("many"), F.sum(F.octet_length("text")).alias("bytes"))
    parts = F.greatest(F.ceil(F.col("many") / FAMILY_ROWS), F.ceil(F.col("bytes") / FAMILY_BYTES))
    parts = F.when(F.col("many") < F.lit(3), F.lit(1)).otherwise(F.least(parts, F.col("many")))
    sized = join_sized(members, sizes.select("family", parts.cast("long").alias("parts")), ["family"], spread=F.xxhash64("node"))
    dealt = blocks(sized, "family", "node", F.col("parts")).select("cell", "n", "node", "sketch", "text")

    def take(run: pa.Table) -> pa.RecordBatch:
        at, counts, bits = bounds(run.column(0).to_numpy()), run.column(1).to_numpy(), _bits(run.column(3))
        text = pa.concat_arrays([c.cast(pa.binary()) for c in run.column(4).chunks])
        made = [shingle_sets(text.slice(a, b - a).to_pylist())[0] for a, b in slices(lengths(text))]
        values, ends = np.concatenate(made), np.cumsum(counts)

        def confirm(node: int, others: np.ndarray) -> np.ndarray:
            own = values[ends[node] - counts[node] : ends[node]]
            out = np.zeros(len(others), bool)
            for i, o in enumerate(others.tolist()):
                theirs = values[ends[o] - counts[o] : ends[o]]
                where = np.minimum(np.searchsorted(own, theirs), len(own) - 1)
                both = int((own[where] == theirs).sum())
                out[i] = 100 * both >= alike * (len(own) + len(theirs) - both)
            return out

        left, right = [], []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            x, y = follow(counts[a:b], bits[a:b], most, alike, lambda node, others, a=a: confirm(a + node, a + others))
            left += [a + i for i in x]
            right += [a + i for i in y]
        return _edges(run.column(2).to_pylist(), left, right)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda batches: whole_cells(batches, take), "a binary, b binary").distinct()


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", alike: int = ALIKE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row: the smallest id reachable over links, and whether it is the row's own."""
    own = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    keyed = own.withColumn("text_hash", F.xxhash64("text"))
    rows = write_table(sketched(keyed, "made").select("doc_id", "text_hash", "made.*"), "odd-rows")
    best = F.min(F.struct("text_hash", F.col("n_shingles").alias("n"), "sketch", "bands")).alias("best")
    nodes = rows.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), best)
    nodes = write_table(nodes.select("node", "least", "copies", "best.*"), "odd-nodes")
    families = write_table(components(candidates(nodes, alike)), "odd-families")
    wanted = write_table(nodes.join(families.withColumnRenamed("root", "family"), "node").select("family", "node", "n", "sketch", "text_hash"), "odd-wanted")
    texts = join_sized(keyed.select("text_hash", "text"), wanted.select("text_hash"), ["text_hash"], "left_semi", spread=F.xxhash64("text_hash"))
    texts = texts.groupBy("text_hash").agg(F.min("text").alias("text"))
    members = write_table(wanted.join(texts, "text_hash").drop("text_hash"), "odd-members")
    roots = write_table(components(confirmed(members, alike)), "odd-roots")
    named = nodes.where("copies > 1").select("node").unionByName(roots.select("node")).distinct().join(nodes.select("node", "least"), "node").join(roots, "node", "left")
    named = write_table(named.select("node", "least", F.coalesce("root", "node").alias("root")), "odd-named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    changed = named.join(least, "root").select("node", "component_id", F.lit(True).alias("named"))
    found = F.when(F.col("named"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")
    joined = rows.select("doc_id", "n_shingles", "node").join(changed, "node", "left").select("doc_id", "n_shingles", found)
    return joined.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def digest(docs: DataFrame) -> DataFrame:
    return grouped(docs)


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s
  FROM words),
nodes AS (SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT node, n, unnest(s) AS x FROM nodes),
pairs AS (
  SELECT a.node AS a, b.node AS b, a.n AS an, b.n AS bn, count(*) AS shared
  FROM items a JOIN items b ON a.x = b.x AND a.node < b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (an + bn - shared)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT node AS a, node AS b FROM nodes UNION SELECT r.a, e.b FROM reached r JOIN edges e ON r.b = e.a),
roots AS (SELECT a AS node, min(b) AS root FROM reached GROUP BY a)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN nodes k ON d.s = k.s LEFT JOIN roots r ON r.node = k.node
"""
