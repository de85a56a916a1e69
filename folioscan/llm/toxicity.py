"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters the network as two vectors: one of the word itself and the sum of those of its
character 3- to 5-grams, both hashed. Forward and backward gates read windows of ``WIDTH`` words
that overlap by half; attention pools their states, and a text scores as its worst window, so a
single line is found in a text of any length. The network is trained in numpy on a bounded
sample of labelled rows: a toxic text must have a toxic window, a clean one none, so each round
takes the highest windows of every text and descends on them. Embeddings start
from the log odds of their feature among the sampled labels.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, free_name

WIDTH, STRIDE = 16, 8
STATE = 8  # per direction
EMBED = 8  # of each input
BUCKETS = 1 << 15
GRAMS = (3, 4, 5)
SAMPLE = 1500  # training rows of each class at most: those with the smallest hashes of their ids
SAMPLE_CHARS = 20_000  # longer texts are not trained on (they are scored like any other)
ROUNDS, BATCH, RATE = 10, 128, 0.01
FOLDS = 5  # ids whose crc32 is divisible by this are held out

_LETTERS = bytes(c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words_of(data: bytes | None) -> list[bytes]:
    if not data:
        return []
    low = data.lower() if data.isascii() else data.decode().lower().encode()
    return low.translate(_LETTERS).split()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Features:
    """Hashed features of distinct words: a bucket of the word, buckets of its character grams."""

    def __init__(self, words: list[bytes]):
        text = np.frombuffer(b"".join(b"^" + w + b"$" for w in words), np.uint8).astype(np.uint64)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(len(words)), sizes)
        grams, owners = [], []
        for n in GRAMS:
            if len(text) < n:
                continue
            h = np.full(len(text) - n + 1, n, np.uint64)
            for j in range(n):
                h = _mix(h + text[j : len(text) - n + 1 + j])
            inside = np.arange(len(h)) + n <= ends[owner[: len(h)]]
            grams.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
            owners.append(owner[: len(h)][inside])
        self.gram, self.owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (grams, owners))
        order = np.argsort(self.owner, kind="stable")
        self.gram, self.owner = self.gram[order], self.owner[order]
        self.first = np.searchsorted(self.owner, np.arange(len(words) + 1))
        total = np.zeros(len(words), np.uint64)
        if len(words):
            powers = _mix(text + _mix((np.arange(len(text)) - np.repeat(ends - sizes, sizes)).astype(np.uint64)))
            total = np.add.reduceat(powers, ends - sizes)
        self.word = (_mix(total) % np.uint64(BUCKETS)).astype(np.int64)


def windows_of(lists: list[list[bytes]], width: int = WIDTH, stride: int = STRIDE):
    """(distinct words, window matrix of word numbers with -1 behind short texts, text of each window)."""
    number: dict[bytes, int] = {}
    flat = [number.setdefault(w, len(number)) for w in chain.from_iterable(lists)]
    ids = np.array(flat + [-1] * width, np.int64)
    rows, owners, at = [], [], 0
    for i, x in enumerate(lists):
        starts = np.arange(0, max(1, len(x) - width + stride), stride)
        starts[-1] = max(0, min(starts[-1], len(x) - width))
        rows.append(at + starts)
        owners.append(np.full(len(starts), i))
        at += len(x)
    start = np.concatenate(rows)
    owner = np.concatenate(owners)
    ends = np.cumsum([len(x) for x in lists])[owner]
    place = start[:, None] + np.arange(width)
    return list(number), np.where(place < ends[:, None], ids[np.minimum(place, len(ids) - 1)], -1), owner


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters in single precision; word and gram embeddings feed both directions."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.p = {"word": small(BUCKETS, EMBED) * 0.1, "gram": small(BUCKETS, EMBED) * 0.1}
        for d in "fb":
            self.p["W" + d] = small(2 * EMBED, 3 * STATE)
            self.p["U" + d] = small(STATE, 3 * STATE)
            self.p["b" + d] = np.zeros(3 * STATE, np.float32)
        self.p |= {"a": small(2 * STATE), "v": small(2 * STATE), "c": np.zeros(1, np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        """Input vectors of distinct words, with a row of zeros at the end for places behind a text."""
        n = len(f.word)
        x = np.zeros((n + 1, 2 * EMBED), np.float32)
        if n:
            x[:n, :EMBED] = self.p["word"][f.word]
            some = f.first[:-1] < f.first[1:]
            x[:n, EMBED:][some] = np.add.reduceat(self.p["gram"][f.gram], f.first[:-1][some], axis=0) if some.any() else 0
        return x

    def run(self, x: np.ndarray, windows: np.ndarray, keep: bool = False):
        """Logit of each window; with ``keep`` also what the gradients need."""
        many, width = windows.shape
        states = np.empty((width, many, 2 * STATE), np.float32)
        tape = []
        for k, d in enumerate("fb"):
            projected = x @ self.p["W" + d] + self.p["b" + d]
            U = self.p["U" + d]
            h = np.zeros((many, STATE), np.float32)
            for t in range(width) if d == "f" else range(width - 1, -1, -1):
                g = projected[windows[:, t]]
                u = h @ U
                zr = _sigmoid(g[:, : 2 * STATE] + u[:, : 2 * STATE])
                z, r = zr[:, :STATE], zr[:, STATE:]
                n = np.tanh(g[:, 2 * STATE :] + r * u[:, 2 * STATE :])
                if keep:
                    tape.append((d, t, h, z, r, n, u[:, 2 * STATE :]))
                h = n + z * (h - n)
                states[t, :, k * STATE : (k + 1) * STATE] = h
        e = states @ self.p["a"]
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tm,tms->ms", w, states)
        logit = pooled @ self.p["v"] + self.p["c"][0]
        return (logit, (states, w, pooled, tape)) if keep else logit

    def gradients(self, f: Features, windows: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        x = self.inputs(f)
        logit, (states, w, pooled, tape) = self.run(x, windows, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "gram")}
        dl = ((_sigmoid(logit) - labels) * weights / weights.sum()).astype(np.float32)
        g["v"], g["c"] = pooled.T @ dl, np.array([dl.sum()], np.float32)
        dpooled = dl[:, None] * self.p["v"]
        dw = np.einsum("ms,tms->tm", dpooled, states)
        de = w * (dw - (w * dw).sum(axis=0))
        dstates = w[:, :, None] * dpooled + de[:, :, None] * self.p["a"]
        g["a"] = np.einsum("tm,tms->s", de, states)
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            W, U = self.p["W" + d], self.p["U" + d]
            dh = np.zeros((len(windows), STATE), np.float32)
            for d2, t, h, z, r, n, un in reversed(tape):
                if d2 != d:
                    continue
                dh = dh + dstates[t, :, k * STATE : (k + 1) * STATE]
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (h - n) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                du = np.concatenate([dz, dr, dn * r], axis=1)
                dg = np.concatenate([dz, dr, dn], axis=1)
                g["U" + d] += h.T @ du
                g["b" + d] += dg.sum(axis=0)
                g["W" + d] += x[windows[:, t]].T @ dg
                np.add.at(dx, windows[:, t], dg @ W.T)
                dh = dh * z + du @ U.T
        g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
        np.add.at(g["word"], f.word, dx[:-1, :EMBED])
        np.add.at(g["gram"], f.gram, dx[f.owner, EMBED:])
        return g

    def scores(self, lists: list[list[bytes]], piece: int = 8192):
        """(highest logit, window of it) of each text, over all its windows."""
        words, windows, owner = windows_of(lists)
        x = self.inputs(Features(words))
        logits = np.concatenate([self.run(x, windows[a : a + piece]) for a in range(0, len(windows), piece)])
        order = np.lexsort((-logits, owner))
        best = order[np.unique(owner[order], return_index=True)[1]]
        return logits[best], (words, windows, owner, logits, best)


def trained(texts: list[bytes | None], labels: list[int], rounds: int = ROUNDS, seed: int = 7) -> Network:
    """A network for labelled texts. With one class or none the scores stay near that class's side."""
    net = Network(seed)
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.p["v"][:] = 0
        net.p["c"][0] = 3.0 if len(y) and y[0] else -3.0
        return net
    lists = [words_of(t) for t in texts]
    _start_from_log_odds(net, lists, y)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    rng = np.random.default_rng(seed)
    step = 0
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(rounds):
        _, (words, windows, owner, logits, best) = net.scores(lists)
        order = np.lexsort((-logits, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        clean = order[(rank < 3) & (y[owner[order]] == 0)]
        picked = np.concatenate([best[y == 1], clean])
        rng.shuffle(picked)
        for a in range(0, len(picked), BATCH):
            some = picked[a : a + BATCH]
            used, local = np.unique(windows[some], return_inverse=True)
            local = local.reshape(len(some), -1)
            pad = len(used) and used[0] == -1
            known = [words[i] for i in (used[1:] if pad else used)]
            rows = np.where(windows[some] == -1, len(known), local - (1 if pad else 0))
            g = net.gradients(Features(known), rows, y[owner[some]], share[owner[some]])
            step += 1
            for k, v in net.p.items():
                m, s = moment[k]
                m += 0.1 * (g[k] - m)
                s += 0.01 * (g[k] ** 2 - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
    return net


def _start_from_log_odds(net: Network, lists: list[list[bytes]], y: np.ndarray) -> None:
    """First coordinate of each embedding: how much likelier its bucket is in toxic texts."""
    seen = {k: np.zeros((2, BUCKETS)) for k in ("word", "gram")}
    for words, label in zip(lists, y):
        f = Features(list(dict.fromkeys(words)))
        for k, bucket in (("word", f.word), ("gram", f.gram)):
            seen[k][int(label), np.unique(bucket)] += 1
    totals = np.array([(y == 0).sum(), (y == 1).sum()])
    for k, s in seen.items():
        odds = np.log((s[1] + 0.5) / (totals[1] + 1)) - np.log((s[0] + 0.5) / (totals[0] + 1))
        odds[s.sum(axis=0) < 3] = 0
        net.p[k][:, 0] = np.clip(odds, -1, 4) * 0.25


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> tuple[list, list]:
    """At most ``size`` training rows of each class; held-out ids, null labels and null ids take no part."""
    held = F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held)
    picked = None
    for label in (0, 1):
        some = rows.where((F.col("toxic") > 0) == F.lit(bool(label))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
        picked = some if picked is None else picked.unionByName(some)
    texts = docs.select("doc_id", "text").where(F.coalesce(F.length("text"), F.lit(0)) <= SAMPLE_CHARS)
    joined = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    got = joined.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return [r.text.encode() if r.text is not None else None for r in got], [int(r.toxic > 0) for r in got]


def scored(docs: DataFrame, net: Network, text: str = "text", name: str = "toxicity") -> DataFrame:
    """``docs`` with the score (0 to 1) of each whole text as ``name``; null and empty texts score as such."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    held = free_name(docs, "_score")

    def make():
        def work(data):
            top, _ = shared.value.scores([words_of(d) for d in data])
            return [(float(s),) for s in _sigmoid(top.astype(np.float64))]

        return work

    return attach(docs, make, "s double", held, text).withColumn(name, F.col(held)["s"]).drop(held)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    net = trained(*sample(docs, labels))
    made = scored(docs.select("doc_id", "text"), net)
    return made.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
