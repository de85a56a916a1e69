"""SimHash near-duplicates by pivot distance tables.

Equal fingerprints are one node. Nodes within ``radius`` bits must agree in some ``keep`` of
``keep + radius`` blocks of bits, which deals them into small cells without losing a link. Inside
a cell each node has a row of Hamming distances to the reference fingerprints (the pivots).
Two nodes whose distances to any pivot differ by more than the radius can't be linked; the
table is sorted by one pivot, so a node only meets a band of it, the largest difference over the
other pivots discards most of the band, and only survivors are compared bit by bit.

A cell never emits its pairs: it follows links from node to node and emits one edge per node
and cell. The edges are joined to components by rounds of star operations on tables in
the shared folder, so no component has to fit into a task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import write_table
from ..sizing import join_sized
from .common import attach, column, free_name

WORDS = 4
RADIUS = 4
SEED = 42
PIVOTS = 16
CELL = 64  # nodes that a cell may be expected to hold; more nodes in all take finer cells

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint_of(data: bytes | None, width: int = WORDS) -> int:
    words = (data or b"").translate(_LOWER).split()
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    of = xxhash.xxh64_intdigest
    if len(words) <= width:
        return of(text, SEED)
    ones = np.zeros(64, np.int64)
    many = len(words) - width + 1
    for at in range(0, many, 1 << 16):
        stop = min(many, at + (1 << 16))
        h = np.array([of(text[a:b], SEED) for a, b in zip(starts[at:stop], ends[at + width - 1 :])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((2 * ones > many).astype(np.uint64) << _BITS).sum(dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, name: str = "fingerprint", text: str = "text", width: int = WORDS) -> DataFrame:
    """``docs`` with the 64-bit fingerprint as a long; texts without a word have 0."""
    held = free_name(docs, "_made")
    made = attach(docs, lambda: lambda data: [(_signed(fingerprint_of(d, width)),) for d in data], "fp long", held, text)
    return made.withColumn(name, column(held)["fp"]).drop(held)


def pivots(many: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: hashes of the numbers from 0, the same on every machine."""
    return np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(many)], np.uint64)


def cell_keys(nodes: int, radius: int = RADIUS, cell: int = CELL) -> list[list[tuple[int, int]]]:
    """Bit ranges whose equality makes a cell: coarse enough for few copies, fine enough for ``nodes``.

    Of ``radius + keep`` blocks at least ``keep`` are equal in any linked pair, for every ``keep``.
    """
    for keep in (1, 2, 3, 4):
        blocks = radius + keep
        edges = [64 * i // blocks for i in range(blocks + 1)]
        if nodes >> (64 * keep // blocks) <= cell or keep == 4:
            return [[(edges[i], edges[i + 1]) for i in some] for some in combinations(range(blocks), keep)]
    raise AssertionError


def cell_edges(nodes: np.ndarray, radius: int, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node met first) that connect what is linked inside one cell."""
    distances = np.bitwise_count(nodes[:, None] ^ references[None, :]).astype(np.int16)
    spread = int(np.argmax(distances.var(axis=0)))
    order = np.argsort(distances[:, spread], kind="stable")
    rest, table = nodes[order], distances[order]  # not reached yet
    left, right = [], []
    while len(rest) > 1:
        root = rest[0]
        front, front_table = rest[:1], table[:1]
        rest, table = rest[1:], table[1:]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            lo = np.searchsorted(table[:, spread], front_table[:, spread] - radius, "left")
            hi = np.searchsorted(table[:, spread], front_table[:, spread] + radius, "right")
            for node, row, a, b in zip(front, front_table, lo.tolist(), hi.tolist()):
                at = a + np.flatnonzero(~reached[a:b])
                if not len(at):
                    continue
                near = at[np.abs(table[at] - row).max(axis=1) <= radius]
                reached[near[np.bitwise_count(rest[near] ^ node) <= radius]] = True
            front, front_table = rest[reached], table[reached]
            left.append(front)
            right.append(np.full(len(front), root))
            rest, table = rest[~reached], table[~reached]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _run_edges(cells: np.ndarray, nodes: np.ndarray, radius: int, references: np.ndarray):
    """Edges of all cells of a sorted run. Small cells are compared side by side, row i with row i + shift."""
    bounds = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1], [True]]))
    sizes = np.diff(bounds)
    left, right = [], []
    small = np.repeat((sizes <= 32) & (sizes > 1), sizes)
    own, kept = cells[small], nodes[small]
    table = np.bitwise_count(kept[:, None] ^ references[None, :]).astype(np.int8)
    for shift in range(1, int(sizes[(sizes <= 32)].max(initial=1))):
        at = np.flatnonzero(own[shift:] == own[:-shift])
        if not len(at):
            break
        at = at[np.abs(table[at] - table[at + shift]).max(axis=1) <= radius]
        at = at[np.bitwise_count(kept[at] ^ kept[at + shift]) <= radius]
        left.append(kept[at + shift])
        right.append(kept[at])
    for i in np.flatnonzero(sizes > 32):
        a, b = cell_edges(nodes[bounds[i] : bounds[i + 1]], radius, references)
        left.append(a)
        right.append(b)
    none = np.zeros(0, np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def links(nodes: DataFrame, radius: int = RADIUS, many_pivots: int = PIVOTS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column ``fp``, distinct) within ``radius`` bits."""
    keys = cell_keys(nodes.count(), radius)
    fp = F.col("fp")
    options = []
    for number, ranges in enumerate(keys):
        parts = [F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1) for a, b in ranges]
        options.append(F.xxhash64(F.lit(number), *parts))
    dealt = nodes.select(F.explode(F.array(*options)).alias("cell"), "fp")
    references = pivots(many_pivots)

    def run(batches):
        cells, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            held = np.concatenate([held, batch.column(1).to_numpy().view(np.uint64)])
            last = int(np.searchsorted(cells, cells[-1], "left")) if len(cells) else 0  # the last cell may go on
            if last:
                yield _batch(*_run_edges(cells[:last], held[:last], radius, references))
            cells, held = cells[last:], held[last:]
        if len(cells):
            yield _batch(*_run_edges(cells, held, radius, references))

    def _batch(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return dealt.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges, root the smallest node of its component.

    Large-star and small-star rounds: each node hands its neighbours to the smallest of them
    until every node points at its root. Only minima are gathered per node.
    """
    edges = write_table(edges.where("a <> b"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b as a", "m as b").where("a <> b").distinct()
        large = write_table(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        met = down.join(least, "a")
        small = met.selectExpr("b as a", "m as b").where("a <> b").unionByName(least.selectExpr("a", "m as b")).distinct()
        edges = write_table(small, "small-star")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.selectExpr("a as node", "b as root").unionByName(edges.selectExpr("b as node", "b as root").distinct())
        before = now


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``: the smallest doc_id reachable over links.

    Texts without a word share fingerprint 0 and are linked like any other. A null id never
    becomes a component's id unless it has no other; repeated rows stay and share theirs.
    """
    rows = write_table(fingerprints(docs.select(column(doc_id).alias("doc_id"), column(text).alias("text")), "fp", "text", width).select("doc_id", "fp"), "fingerprints")
    nodes = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    roots = write_table(components(links(nodes.select("fp"), radius)), "fingerprint-roots")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("fp", "root").join(best, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return grouped(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One row of each group stays: that with the smallest id (of rows with equal ids, the smallest text hash; null ids go last)."""
    fp, row = free_name(docs, "_fp"), free_name(docs, "_row")
    held = write_table(fingerprints(docs, fp, text, width).withColumn(row, F.monotonically_increasing_id()), "fingerprinted")
    key = F.struct(column(doc_id).isNull(), column(doc_id), F.xxhash64(column(text)), column(row).alias("row"))
    nodes = write_table(held.groupBy(column(fp).alias("fp")).agg(F.min(key).alias("least")), "fingerprint-nodes")
    roots = write_table(components(links(nodes.select("fp"), radius)), "fingerprint-roots")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    chosen = write_table(named.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias(row)), "fingerprint-chosen")
    return join_sized(held, chosen, [row], "left_semi").drop(row, fp)
