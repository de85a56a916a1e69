"""Fill-in-middle forms against a plain regular-expression version, and exact round trips."""

import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from folioscan.llm import middle

from helpers import documents


def plain(doc_id, text, seed=1):
    t = text or ""
    u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_cuts_with_tiny_caches():
    rng, cache = random.Random(3), middle.Chunks(2000)
    pieces = ["a", "Z", "é", "日", "\U0001f600", " ", "\n", "\x00", "word"]
    shared = "".join(rng.choice([*pieces, "x" * 40]) for _ in range(900))
    for i in range(1500):
        t = "".join(rng.choice([*pieces, "x" * rng.randint(1, 60)]) for _ in range(rng.randint(0, 150)))
        t = (t * 9, t + shared + t, t)[i % 3]
        x, y = rng.randint(0, 1 << 32), rng.randint(0, 1 << 32)
        u = re.findall("[A-Za-z]+|[^A-Za-z]", t)
        a, b = sorted((x % (len(u) + 1), y % (len(u) + 1)))
        assert middle.cuts_of(t.encode(), x, y, cache) == (len(u), len("".join(u[:a])), len("".join(u[a:b])))


def test_shared_chunks_are_summarised_once():
    rng = random.Random(4)
    shared = " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(8000))
    cache = middle.Chunks()
    middle.cuts_of(shared.encode(), 1, 2, cache)
    first = cache.made
    assert first > 20
    middle.cuts_of(("other words first " + shared).encode(), 1, 2, cache)
    assert cache.made - first <= 3
    ends = middle.chunk_ends(np.frombuffer(b"z" * 100_000, np.uint8))
    assert np.diff(ends, prepend=0).max() <= middle.CHUNK_MOST


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(middle, "SCAN", 1 << 12)
    t = "aé日 word, " * 9000
    whole = middle.cuts_of(t.encode(), 12345, 67890, middle.Chunks())
    monkeypatch.undo()
    assert whole == middle.cuts_of(t.encode(), 12345, 67890, middle.Chunks())


def test_awkward_rows_and_round_trip(spark):
    docs = documents(spark)
    marked = spark.createDataFrame([(20 + i, t) for i, t in enumerate(["has <P> in it", "<", "<P", "a<S", "x<", "M>y", "<S<S>"] * 9)], "doc_id long, text string")
    docs = docs.unionByName(marked, allowMissingColumns=True)
    m = F.col("made")
    rows = middle.transformed(docs, "made").select("doc_id", "text", "made.*", middle.restored(m["output"], m["form"]).alias("back")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert middle.digest(docs.limit(0)).count() == 0
    clash = docs.withColumn("_hash", F.lit(1)).withColumn("_cuts", F.lit(2)).withColumn("middle", F.lit(3)).withColumn("n", F.lit(4))
    again = middle.transformed(clash, "made")
    assert again.columns == [*clash.columns, "made"]
