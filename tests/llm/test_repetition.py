import random
import re

import numpy as np
from helpers import SF, documents, empty

from folioscan.llm import queries, repetition as R


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, inside = {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            inside.update(j for i in at for j in range(i, i + 5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def repeats_by_hand(w):
    n = len(w)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_longest_repeats_of_many_texts_at_once():
    rng = random.Random(1)
    lists = [[rng.choice([b"a", b"b"]) for _ in range(rng.randint(0, 40))] for _ in range(60)] + [[b"x"] * 50, []]
    ids, bounds = R.numbered(lists)
    _, _, longest = R.longest_repeats(ids, bounds)
    assert longest.tolist() == [v for x in lists for v in repeats_by_hand(x)]


def test_query_equals_plain_counts(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op4_suffix_repeats(spark, SF).collect()
    assert len(got) == len(text)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_one_long_repeat_is_rejected_by_the_method_alone(spark):
    rng = random.Random(2)
    passage = " ".join(str(rng.random()) for _ in range(120))
    text = passage + " " + " ".join(str(rng.random()) for _ in range(2000)) + " " + passage
    row = R.judged(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().quality
    assert not row.base_failed and row.longest_repeat == 120 and row.n_maximal == 2 and not row.kept


def test_the_covered_limit_rejects_by_itself(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(str(rng.random()) for _ in range(n))
    long_, short = fresh(30), [fresh(6) for _ in range(5)]
    many = " ".join([long_, fresh(340), long_])  # 60 of 400 words
    few = " ".join([*short, fresh(340), *(x + " " + fresh(1) for x in short)])  # as many, in repeats of six words
    rows = spark.createDataFrame([(1, many), (2, few)], "doc_id long, text string")
    a, b = (r.quality for r in R.judged(rows).orderBy("doc_id").collect())
    assert (a.n_repeat_words, a.covered_words, a.longest_repeat, a.base_failed, a.kept) == (60, 60, 30, False, False)
    assert (b.n_repeat_words, b.covered_words, b.base_failed, b.kept) == (60, 0, False, True)


def test_a_paragraph_repeated_for_20_mb_takes_linear_memory():
    import resource

    rng = random.Random(4)
    paragraph = [rng.randbytes(3).hex().encode() for _ in range(200)]
    ids, bounds = R.numbered([paragraph * 14_400])
    held = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    order, rank = R.suffix_order(ids, bounds)
    shared = R.shared_prefixes(ids, bounds, order, rank)
    assert shared.max() == len(ids) - 200 and np.array_equal(np.sort(shared[rank == 0]), [0])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - held < 1_500_000


def test_awkward_rows(spark):
    df = documents(spark)
    got = R.judged(df, "quality").collect()
    assert len(got) == 15 and got[0].kept == "x"
    assert [r.quality.kept for r in got if not (r.text or "").strip()] == [False] * 4
    for r in got:
        assert plain(r.text)[0] == r.quality.n_words and plain(r.text)[1] == r.quality.word_chars
    assert R.digest(empty(spark)).collect() == []
    assert np.array_equal(R.covered(np.array([3, 2, 0, 0]), 3), [True, True, True, False])
