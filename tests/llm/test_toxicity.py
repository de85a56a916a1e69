import zlib

import numpy as np
import pytest
from helpers import documents, empty, words

from folioscan.llm import toxicity as X


def test_gradients_are_slopes():
    f = X.Features([b"abc", b"hello", b"idiot"])
    windows = np.array([[0, 1, 2, 3] * 4, [2, 1, 0, 3] * 4])
    y, weight = np.array([1.0, 0.0], np.float32), np.array([1.0, 2.0])
    net = X.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = X._sigmoid(net.run(net.inputs(f).astype(np.float64), windows))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / weight.sum()

    g = net.gradients(f, windows, y, weight)
    for name, at in (("Uf", (1, 3)), ("Wb", (2, 20)), ("bf", (5,)), ("a", (3,)), ("v", (9,)), ("gram", (int(f.gram[2]), 1)), ("word", (int(f.word[2]), 4))):
        old, step = net.p[name][at], 1e-2
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        slope = (up - loss()) / (2 * step)
        net.p[name][at] = old
        assert slope == pytest.approx(g[name][at], rel=2e-2, abs=1e-6)


def test_windows_cover_every_word():
    for n in (0, 1, 15, 16, 17, 40, 100):
        _, windows, owner = X.windows_of([[b"w%d" % i for i in range(n)], [b"z"]])
        assert set(windows[owner == 0].ravel()) - {-1} == set(range(n))
        assert (owner == 1).sum() == 1


def test_held_out_accuracy(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        text = words(rng, rng.randint(5, 200)).split()
        bad = i % 3 == 0
        if bad:
            for _ in range(2):
                text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron"]) if i % 2 else "vequ" + rng.choice(["ta", "no", "mo", "u", "ée"]))
        rows.append((i, " ".join(text), int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.digest(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[r[0]].held_out for r in held) and sum(g.held_out for g in got.values()) == len(held)
    assert np.mean([got[i].predicted == y for i, _, y in held]) > 0.9
    assert all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5) for g in got.values())


def test_awkward_rows(spark):
    net = X.trained([b"you idiot", b"fine words"] * 20, [1, 0] * 20, rounds=2)
    got = X.scored(documents(spark), net).collect()
    assert len(got) == 15 and all(0 <= r.toxicity <= 1 for r in got)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert X.digest(empty(spark), labels).collect() == []
    assert {r.predicted for r in X.digest(documents(spark, False), labels).collect()} == {0}
