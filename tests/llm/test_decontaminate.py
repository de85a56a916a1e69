import hashlib
import random
import re

from helpers import SF, documents, empty

from folioscan.llm import decontaminate as D, queries


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(text, items):
    w, hit, found = tokens(text), set(), set()
    for i, item in items:
        v = tokens(item)
        for s in range(max(0, len(v) - 10) + 1 if v else 0):
            window = v[s : s + 10]
            for at in range(len(w) - len(window) + 1):
                if w[at : at + len(window)] == window:
                    hit.update(range(at, at + len(window)))
                    found.add(str(i))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_query_equals_plain_search(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    known = {w for _, t in items for w in tokens(t)}
    for r in queries.op10_prefix_windows(spark, SF).collect():
        got = (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
        assert got[0] == len(tokens(text[r.doc_id]))
        if known & set(tokens(text[r.doc_id])):
            assert got == plain(text[r.doc_id], items)


def test_short_items_ties_and_blocks(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(rng.choice("a b c é1 日本 dd".split()) for _ in range(n))
    items = [(1, "b"), (2, "a C"), (2, "c a"), (3, some(9)), (4, some(10)), (5, some(25)), (6, None), (None, "a b"), (7, "!?"), (8, "zz a"), (9, some(25))]
    rows = [(i, some(rng.randint(0, 60))) for i in range(60)] + [(60, items[5][1].upper()), (61, "x" + items[4][1] + ", y"), (61, "B!B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted((i, *plain(t, [x for x in items if x[0] is not None])) for i, t in rows)
    assert sorted(tuple(r) for r in D.digest(docs, bench).collect()) == want
    made = D.hits(docs, bench, block_bytes=80)  # many blocks, one after the other
    c = made["contamination"]
    got = made.select("doc_id", c["n_words"], D.n_hit(c["spans"]), c["items"]).collect()
    assert sorted((r[0], r[1], r[2], len(r[3])) for r in got) == sorted(w[:4] for w in want)


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "one"), (2, None)], "item_id long, text string")
    got = D.hits(documents(spark), bench, name="kept2").collect()
    assert len(got) == 15 and {r.doc_id for r in got if r.kept2.spans} == {7}
    assert D.digest(empty(spark), bench).collect() == []
    none = D.digest(documents(spark), bench.limit(0)).collect()
    assert len(none) == 15 and not any(r.contaminated for r in none)
