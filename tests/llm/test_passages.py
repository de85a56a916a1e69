import random

import numpy as np
from helpers import SF, documents, empty, words

from folioscan.llm import passages as Q, queries


def test_planted_passages_are_found_and_clean_texts_are_not(spark):
    rng = random.Random(8)
    passage = words(rng, 60).split()
    fuzzy = [w if i % 15 else "changed" for i, w in enumerate(words(rng, 90).split())]
    source = [w if i % 15 else "first" for i, w in enumerate(fuzzy)]
    filler = lambda n: words(rng, n).split()
    rows = {
        1: filler(100) + passage + filler(50), 2: passage + filler(30), 3: filler(400) + passage, 10: filler(80) + source + filler(20),
        11: filler(10) + fuzzy + filler(9), 20: filler(300), 21: filler(500), 22: filler(90) + passage[:30] + filler(90),
    }
    df = spark.createDataFrame([(i, " ".join(w).upper() if i == 3 else " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in Q.shared(df).collect()}
    assert set(got) == {(2, 1), (3, 1), (11, 10)}
    exact = got[(3, 1)]
    assert (exact.start_word, exact.end_word, exact.other_start, exact.other_end, exact.n_match, exact.identity) == (400, 460, 100, 160, 60, 1.0)
    near = got[(11, 10)]
    assert near.start_word <= 12 and near.end_word >= 98 and 0.9 < near.identity < 1


def test_exact_passages_with_other_words_between_them_stay(spark):
    rng = random.Random(11)
    one, two, three = (words(rng, n).split() for n in (60, 60, 200))
    filler = lambda n: words(rng, n).split()
    rows = {
        1: filler(30) + one + filler(60) + two + filler(30), 2: filler(9) + one + filler(60) + two + filler(9),
        3: filler(30) + three + filler(5) + one[::-1] + filler(5), 4: filler(7) + three + filler(300) + one[::-1] + filler(7),
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = sorted((r.doc_id, r.other_id, r.start_word, r.end_word, r.other_start, r.other_end, r.identity) for r in Q.shared(df).collect())
    assert got == [(2, 1, 9, 69, 30, 90, 1.0), (2, 1, 129, 189, 150, 210, 1.0), (4, 3, 7, 207, 30, 230, 1.0), (4, 3, 507, 567, 235, 295, 1.0)]


def test_a_passage_of_lines_that_occur_earlier_is_matched_as_a_whole(spark):
    rng = random.Random(13)
    lines = [words(rng, 20).split() for _ in range(3)]
    filler = lambda n: words(rng, n).split()
    passage = sum(lines, [])
    rows = {i + 1: filler(60) + line + filler(60) for i, line in enumerate(lines)}
    rows |= {8: filler(33) + passage + filler(40), 9: filler(71) + passage + filler(9)}
    run = filler(50)  # parts of an exact run of the least length, in one document before
    rows |= {20: filler(40) + run[25:] + filler(90) + run[:25], 21: filler(8) + run + filler(8), 22: filler(64) + run}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = sorted((r.doc_id, r.other_id, r.start_word, r.end_word, r.other_start, r.other_end, r.identity) for r in Q.shared(df).collect())
    assert got == [(9, 8, 71, 131, 33, 93, 1.0), (22, 21, 64, 114, 8, 58, 1.0)]


def test_a_changed_passage_of_lines_that_occur_earlier_is_found(spark):
    # each of its short seeds occurs first in another document, which shares no passage with it
    rng = random.Random(22)
    lines = [words(rng, 6).split() for _ in range(10)]
    filler = lambda n: words(rng, n).split()
    passage = sum(lines, [])
    changed = [w if i % 6 != 2 or i < 12 else "changed" for i, w in enumerate(passage)]
    rows = {i: filler(30) + lines[i % 10] + lines[(i + 3) % 10] + filler(30) for i in range(10)}
    joints = {100 + i: filler(30) + passage[6 * i + 1 : 6 * i + 11] + filler(30) for i in range(9)}
    rows |= joints | {200: filler(33) + passage + filler(40), 201: filler(71) + changed + filler(9)}
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in Q.shared(df).collect()}
    assert set(got) == {(201, 200)}
    row = got[(201, 200)]
    assert row.start_word - row.other_start == 71 - 33 and row.end_word - row.start_word >= 50 and row.identity >= 0.8


def test_places_of_seeds_that_can_be_in_a_passage():
    assert Q.dense(np.array([1, 2, 3, 4, 5, 6])).tolist() == []
    assert Q.dense(np.array([0, 1, 2, 3, 4, 5, 46, 93, 200])).tolist() == [0, 1, 2, 3, 4, 5, 46]
    assert Q.dense(np.array([0, 1, 2, 3, 4, 5, 47, 93])).tolist() == []


def test_run_hashes_name_equal_runs():
    s = np.random.default_rng(14).integers(0, 3, 400).astype(np.uint32)
    for k in (1, 5, 35, 50, 400):
        runs = [tuple(s[i : i + k]) for i in range(len(s) - k + 1)]
        assert len(set(runs)) == len(set(zip(runs, Q.run_hashes(s, k).tolist()))) == len(set(Q.run_hashes(s, k).tolist()))
    assert not len(Q.run_hashes(s, 401))


def test_packed_seeds_are_small_and_come_back_whole():
    rng = np.random.default_rng(19)
    doc = np.repeat(np.array([7, -3, 7, 0, 1 << 40]), [4000, 1, 900, 2, 3000])
    pos = np.concatenate([np.arange(n) for n in (4000, 1, 900, 2, 3000)])
    h = rng.integers(0, 1 << 64, len(doc), np.uint64)
    batch = Q.packed(doc, pos, h, Q.ANCHOR, 64)
    got = []
    for cell, *data in zip(*(c.to_pylist() for c in batch.columns)):
        assert cell % len(Q.SIZES) == Q.SIZES.index(Q.ANCHOR)
        got += [(x, y, (int(z) << 32) | cell // len(Q.SIZES)) for z, x, y in zip(*Q.unpacked(*data))]
    assert sorted(got) == sorted(zip(doc.tolist(), pos.tolist(), (h & ~np.uint64((1 << 32) - 64)).tolist()))
    import pyarrow as pa

    kept = sum(len(pa.compress(x, codec="lz4", asbytes=True)) for c in batch.columns[1:] for x in c.to_pylist())
    assert kept < 12 * len(doc)  # a row of its own took 23 bytes
    assert Q.packed(doc[:0], pos[:0], h[:0], Q.K, 64).num_rows == 0


def test_merged_segments_equal_those_of_single_seeds():
    rng = np.random.default_rng(20)
    for _ in range(50):
        a, size = rng.integers(0, 300, 12), rng.choice([4, 8, 35, 50], 12)
        b = a + rng.integers(-1, 2, 12) * 40
        every = np.array(sorted({(x + i, y + i) for x, y, n in zip(a.tolist(), b.tolist(), size.tolist()) for i in range(n - Q.K + 1)}))
        assert Q.merged(np.stack([a, b, size], axis=1)).tolist() == Q.segments_of(every[:, 0], every[:, 1]).tolist()


def test_a_copy_is_linked_over_its_whole_text(spark):
    rng = random.Random(21)
    one, two = words(rng, 70), words(rng, 70)
    rows = [(1, one + " " + words(rng, 40)), (2, words(rng, 40) + " " + two), (3, one + " then " + two), (4, one + " then " + two), (5, words(rng, 20)), (6, "short copy"), (7, "short copy")]
    got = {(r.doc_id, r.other_id): (r.start_word, r.end_word, r.other_start, r.other_end, r.identity) for r in Q.shared(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {(3, 1), (3, 2), (4, 3)} and got[(4, 3)] == (0, 141, 0, 141, 1.0)


def test_passages_with_many_changed_words_are_found(spark):
    rng = random.Random(15)
    filler = lambda n: words(rng, n).split()
    change = lambda w, at: [x if i not in at else "changed" for i, x in enumerate(w)]
    eighth, fifth, two = filler(200), filler(101), filler(50)
    rows = {
        1: filler(40) + eighth + filler(20), 2: filler(15) + change(eighth, range(7, 200, 8)) + filler(30),
        3: filler(40) + fifth + filler(20), 4: filler(15) + change(fifth, range(4, 99, 5)) + filler(30),
        5: filler(40) + two + filler(20), 6: filler(15) + change(two, (16, 33)) + filler(30),
    }
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows.items()], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in Q.shared(df).collect()}
    assert {(2, 1), (4, 3), (6, 5)} <= set(got)
    assert got[(2, 1)].end_word - got[(2, 1)].start_word >= 199 and got[(4, 3)].end_word - got[(4, 3)].start_word >= 99
    assert got[(6, 5)].identity == 0.96


def test_least_alike_passages_share_seven_seeds():
    rng = np.random.default_rng(16)
    s = rng.integers(0, 1 << 32, 50).astype(np.uint32)
    spread = np.arange(4, 50, 5)
    for at in [spread, *(rng.choice(50, 10, replace=False) for _ in range(300))]:
        t = s.copy()
        t[at] += np.uint32(1)
        same = np.flatnonzero(Q.kmer_hashes(s) == Q.kmer_hashes(t))
        assert len(same) >= 7 and same[-1] + Q.K - same[0] >= Q.LEAST_SPAN


def test_parts_of_a_chain_are_cut_where_the_words_differ():
    rng = np.random.default_rng(12)
    same = rng.integers(0, 1 << 30, 80)
    a = np.concatenate([same, rng.integers(0, 1 << 30, 25), same[:15], rng.integers(0, 1 << 30, 25), same[::-1]])
    b = np.concatenate([same, rng.integers(0, 1 << 30, 25), same[:15], rng.integers(0, 1 << 30, 25), same[::-1]])
    whole = np.array([[0, 0, len(a)]])
    assert Q.passages_of(a, b, whole, 50, 0.8) == [(0, 80, 0, 80, 80, 1.0), (145, 225, 145, 225, 80, 1.0)]
    assert Q.passages_of(a, b, whole, 50, 0.7) == [Q.aligned(a, b, whole)]
    assert Q.passages_of(a, b[::-1].copy() + 1, whole, 50, 0.8) == []


def test_chains_of_a_pair_share_no_words():
    rng = np.random.default_rng(17)
    b = rng.integers(0, 1 << 30, 400)
    a = np.concatenate([b[:170], b[60:180]])
    chains = [np.array([[0, 0, 170]]), np.array([[37, 37, 120]]), np.array([[97, 97, 60]]), np.array([[150, 40, 140]])]
    assert Q.apart(a, b, chains, 50, 0.8) == [(0, 170, 0, 170, 170, 1.0), (170, 290, 60, 180, 120, 1.0)]
    assert Q.apart(a, b, [], 50, 0.8) == []


def test_words_shared_with_earlier_documents_are_recalled(spark):
    """Against all pairs of documents that share seven seeds, by the same chains and alignments, over planted edits and the given texts."""
    rng = random.Random(18)
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text]
    held = [w for _, t in texts if len(w := t.split()) > 120][:25]
    for n, w in enumerate(held):
        at = rng.randrange(len(w) - 100)
        passage = list(w[at : at + 100])
        for i in rng.sample(range(100), 10):
            passage[i : i + 1] = [["other"], [], [passage[i] if i < len(passage) else "x", "more"]][n % 3]
        texts.append((10_000_000 + n, " ".join(words(rng, 40).split() + passage + words(rng, 40).split())))
    symbols = {i: Q.symbols(t.encode()) for i, t in texts}
    places = {}
    for i in sorted(symbols):
        for at, h in enumerate(Q.kmer_hashes(symbols[i]).tolist()):
            places.setdefault(h, []).append((i, at))
    pairs = {}
    for owners in places.values():
        for i, at in owners:
            for j, to in owners:
                if j < i:
                    pairs.setdefault((i, j), []).append((at, to))
    want, got = {}, {}
    for (i, j), met in pairs.items():
        if len(met) >= 7:
            met = np.array(sorted(met))
            for p in Q.apart(symbols[i], symbols[j], Q.chains_of(Q.segments_of(met[:, 0], met[:, 1])), 50, 0.8):
                want.setdefault(i, set()).update(range(p[0], p[1]))
    for r in Q.shared(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    all_words = sum(map(len, want.values()))
    found = sum(len(x & got.get(i, set())) for i, x in want.items())
    planted = [i for i in want if i >= 10_000_000]
    print("recall of words", found, all_words, "planted documents", sum(i in got for i in planted), len(planted), "documents", len(set(want) & set(got)), len(want))
    assert found >= 0.9 * all_words and sum(i in got for i in planted) >= 0.9 * len(planted) and len(set(want) & set(got)) >= 0.9 * len(want)


def test_every_document_with_a_long_shared_run_is_listed(spark):
    text = {r.doc_id: (r.text or "").lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {}
    for i, w in text.items():
        for j in range(len(w) - 50):
            seen.setdefault(tuple(w[j : j + 51]), set()).add(i)
    need = {i for owners in seen.values() if len(owners) > 1 for i in owners}
    rows = queries.op9_chained_passages(spark, SF).collect()
    spans = {}
    for r in rows:
        spans.setdefault((r.doc_id, r.other_id), []).append((r.start_word, r.end_word))
    assert all(a[1] <= b[0] for x in map(sorted, spans.values()) for a, b in zip(x, x[1:]))
    assert need <= {i for r in rows for i in (r.doc_id, r.other_id)}
    for r in rows:
        assert min(r.end_word - r.start_word, r.other_end - r.other_start) >= 50 and r.identity >= 0.8 and r.doc_id != r.other_id


def test_chains_are_best_and_in_order():
    rng = random.Random(9)
    for _ in range(50):
        seg = np.array(sorted((rng.randrange(60), rng.randrange(60), rng.randint(3, 9)) for _ in range(6)))
        chains = Q.chains_of(seg, gap=0.3)
        assert sum(map(len, chains)) == 6
        for c in chains:
            assert all(a[0] + a[2] <= b[0] and a[1] + a[2] <= b[1] for a, b in zip(c, c[1:]))

        def worth(c):
            gaps = sum(b[0] - a[0] - a[2] + b[1] - a[1] - a[2] for a, b in zip(c, c[1:]))
            return sum(s[2] for s in c) - 0.3 * gaps

        def all_chains(done):
            yield done
            for s in seg.tolist():
                if not done or done[-1][0] + done[-1][2] <= s[0] and done[-1][1] + done[-1][2] <= s[1]:
                    yield from all_chains([*done, s])

        assert abs(worth(chains[0].tolist()) - max(worth(c) for c in all_chains([]) if c)) < 1e-9


def test_common_words_is_the_longest_common_subsequence():
    rng = random.Random(10)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert Q.common_words(np.array(a), np.array(b)) == best[-1][-1]


def test_awkward_rows(spark):
    got = Q.shared(documents(spark)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2, 1), (3, 1), (9, 1)}
    assert Q.shared(empty(spark)).collect() == []
