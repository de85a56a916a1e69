import random
import re

import numpy as np
import xxhash
from helpers import SF, documents, empty

from folioscan.llm import queries, simhash as H


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints):
    """Smallest position of each component, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_query_equals_all_pairs(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    prints = [fingerprint(t) for _, t in rows]
    want = {rows[i][0]: (f"{prints[i]:016x}", rows[g][0]) for i, g in enumerate(groups(prints))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_pivot_simhash(spark, SF).collect()} == want


def test_links_of_dense_groups(spark):
    rng = random.Random(4)
    nodes = {rng.getrandbits(64) for _ in range(300)}
    for centre in list(nodes)[:3]:
        at = centre
        for _ in range(150):  # chains and clouds, with cells of more than 32 nodes
            at ^= 1 << rng.randrange(64)
            nodes.add(at if rng.random() < 0.5 else centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    nodes = sorted(nodes)
    df = spark.createDataFrame([(H._signed(n),) for n in nodes], "fp long")
    made = {r.node: r.root for r in H.components(H.links(df)).collect()}
    want = groups(nodes)
    got = {}
    for n, g in zip(nodes, want):
        got.setdefault(made.get(H._signed(n), H._signed(n)), set()).add(g)
    assert all(len(v) == 1 for v in got.values()) and len(got) == len(set(want))


def test_cells_of_every_depth_keep_links():
    rng = random.Random(6)
    for many in (10, 10**6, 10**9, 10**12):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(all(a >> lo & (1 << hi - lo) - 1 == b >> lo & (1 << hi - lo) - 1 for lo, hi in key) for key in H.cell_keys(many))


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 63, 500).astype(np.uint64))
    p = H.pivots()
    table = lambda x: np.bitwise_count(x[:, None] ^ p[None, :]).astype(int)
    assert np.abs(table(a) - table(b)).max() <= 1


def test_awkward_rows(spark):
    got = H.digest(documents(spark)).collect()
    assert len(got) == 15
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert sorted(by[1]) == [1, 2, 3, 9, 9]
    assert sorted(by[4], key=str) == [4, 5, 6, None] and by[None] == [None]
    assert H.digest(empty(spark)).collect() == []
    kept = H.deduplicated(documents(spark))
    assert kept.columns == documents(spark).columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 10, 11, 12, 4, 7, 8, None]
    assert H.deduplicated(empty(spark)).collect() == []
