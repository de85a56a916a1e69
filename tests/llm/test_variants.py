"""Spelling variants against a dictionary of all single edits."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from folioscan.llm import variants

from helpers import SF, documents


def counted(rows):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    return words


def plain(rows):
    words = {w: n for w, n in counted(rows).items() if n >= 5 and len(w) >= 6}
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
    for w in words:
        for i in range(len(w)):
            near[w] |= holes[w[:i], w[i + 1 :]]
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
        near[w].discard(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def misspelt(seed, size=60, many=9000):
    rng = random.Random(seed)
    letters = "abéÿ"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 11))) for _ in range(size)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "baaaaaa", "abaaaaa"]
    rows = []
    for i in range(75):
        out = []
        for _ in range(many // 75):
            w = base[min(int(rng.expovariate(0.12)), len(base) - 1)]
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice(letters) + w[at:], w[:at] + rng.choice(letters) + w[at + 1 :]])
            out.append(w.upper() if rng.random() < 0.1 else w)
        chain = ["chainaa"] * 30 + ["chainab"] * 4 + (["chainbb"] if i % 3 == 0 else []) + (["chbinbb"] if i % 15 == 0 else [])
        rows.append((i, ", ".join(out + chain)))
    return rows


def test_edits_of_few_letters(spark):
    rows = misspelt(1)
    expected = plain(rows)
    assert sum(r[1] is not None for r in expected) > 20 and any(r[1] not in (None, r[2]) for r in expected)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(variants.variants(docs)) == expected


def test_split_groups_and_small_tiles(spark, monkeypatch):
    rows = misspelt(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(variants, "BLOCK", 3)
    monkeypatch.setattr(variants, "TILE_ROWS", 4)
    monkeypatch.setattr(variants, "HELD_WORDS", 10)
    assert got(variants.variants(docs)) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert got(variants.digest(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = documents(spark)
    docs = docs.unionByName(docs.limit(3)).unionByName(docs)
    odd = spark.createDataFrame([(50, "×÷×÷×÷ straßenÉ " * 6), (51, "x" * 30_000 + " " + "x" * 30_001)] * 5, "doc_id long, text string")
    docs = docs.unionByName(odd, allowMissingColumns=True).withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    assert got(variants.variants(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])
    assert variants.digest(docs.limit(0)).count() == 0
