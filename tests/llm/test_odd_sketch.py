"""Odd-sketch near-duplicates against all pairs on full sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import odd_sketch

from helpers import SF, documents

LOWER = {c: c + 32 for c in range(65, 91)}
SPACE = " \t\n\v\f\r"


def shingles(text):
    out, word = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return frozenset(zip(out, out[1:])) if len(out) > 1 else frozenset((w,) for w in out)


def plain(rows, alike=80):
    """(doc_id, set size, component) of every row, by comparing all different sets."""
    sets = [shingles(t) for _, t in rows]
    nodes = sorted({s for s in sets if s}, key=len)
    root = {s: s for s in nodes}

    def find(s):
        while root[s] is not s:
            root[s] = s = root[root[s]]
        return s

    root = {s: s for s in nodes}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if 100 * len(a) < alike * len(b):
                break
            both = len(a & b)
            if 100 * both >= alike * (len(a) + len(b) - both):
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    return sorted(((i, len(s), least.get(find(s)) if s else i) for (i, _), s in zip(rows, sets)), key=repr)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


def near_groups(rng):
    """Chains of edits, groups around a text that is not there, pairs just below and just at the bound."""
    def word():
        return "".join(rng.choice("abcdefghijklmnop") for _ in range(5))

    rows = []
    for g in range(12):
        base = [word() for _ in range(rng.choice([3, 5, 8, 40, 90]))]
        for _ in range(14):
            own = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                own[rng.randrange(len(own))] = word()
            rows.append(" ".join(own))
        at = list(base)
        for _ in range(14):
            at[rng.randrange(len(at))] = word()
            rows.append(" ".join(at))
    for common, extra in ((80, 10), (80, 11), (8, 1), (4, 1), (400, 50), (400, 51)):
        x = [word() for _ in range(common + 1)]
        rows += [" ".join([word() for _ in range(extra)] + x), " ".join(x + [word() for _ in range(extra)])]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = near_groups(random.Random(7))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(odd_sketch.grouped(docs)) == plain(rows)


def test_split_buckets_and_families(spark, monkeypatch):
    rows = near_groups(random.Random(8))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(odd_sketch, "BUCKET_ROWS", 4)
    monkeypatch.setattr(odd_sketch, "FAMILY_ROWS", 5)
    monkeypatch.setattr(odd_sketch, "FAMILY_BYTES", 1 << 12)
    assert got(odd_sketch.grouped(docs)) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got(odd_sketch.grouped(docs)) == plain(rows)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    made = odd_sketch.grouped(docs)
    assert got(made) == plain(rows)
    for r in made.collect():
        assert r.kept == (r.doc_id == r.component_id)
    assert odd_sketch.digest(docs.limit(0)).count() == 0
    assert odd_sketch.digest(docs.where(F.col("text") == "")).count() == 1


@pytest.mark.parametrize("size", [9, 45, 450])
def test_estimates_at_the_bound(size):
    """At a similarity of 0.8 no sketch of 400 pairs differs by more bits than the limit, and bands meet."""
    rng = np.random.default_rng(size)
    one, values = size // 9, []
    for _ in range(400):
        common = rng.integers(0, 1 << 63, 8 * one, dtype=np.uint64)
        values += [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, one, dtype=np.uint64)])) for _ in range(2)]
    mins = odd_sketch.minima(np.concatenate(values), np.array([len(v) for v in values]))
    assert abs((mins[::2] == mins[1::2]).mean() - 0.8) < 0.01
    bits, keys = odd_sketch.sketches(mins).view(np.uint64), odd_sketch.band_keys(mins)
    differ = np.bitwise_count(bits[::2] ^ bits[1::2]).sum(axis=1)
    assert differ.max() <= odd_sketch.most_odd_bits()
    estimate = 1 + odd_sketch.BITS / 4 * np.log(1 - 2 * differ / odd_sketch.BITS) / odd_sketch.HASHES
    assert abs(estimate.mean() - 0.8) < 0.01
    assert ((keys[::2] == keys[1::2]).sum(axis=1) > 0).all()
