"""Accounts: batch forms against loops, streams against batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from folioscan.functions.embedding import embedded, hashed_vectors
from folioscan.operators import usage
from folioscan.streaming import jobs, keyed
from folioscan.streaming.runner import appended, stream_of


@pytest.fixture(scope="module")
def log():
    rng = random.Random(1)
    at = {"hot": 0, "a": 0, "b": 0}
    rows = []
    for i in range(3000):
        key = rng.choice(["hot"] * 8 + ["a", "b"])
        at[key] += rng.choice([0, 1, 5, 40, 40, 200 if key == "hot" else 3000])
        rows.append((key, i, at[key], rng.choice([1, 1, 2, 7])))
    return rows




def loop_admit(rows, cap, window):
    held, out = {}, {}
    for key, i, ms, cost in sorted(rows, key=lambda r: (r[2], r[1])):
        mine = [(m, c) for m, c in held.get(key, []) if m > ms - window]
        ok = sum(c for _, c in mine) + cost <= cap
        held[key] = mine + ([(ms, cost)] if ok else [])
        out[i] = ok
    return out


def test_admission_equals_a_loop(spark, log):
    df = spark.createDataFrame(log, "bucket string, event_id long, ms long, cost long").repartition(6)
    got = {r.event_id: r.outcome for r in usage.admitted(df, 10, 300).collect()}
    assert got == loop_admit(log, 10, 300)
    assert 0 < sum(got.values()) < len(got)


def test_admission_stream_in_steps_equals_batch(spark, log, tmp_path):
    rows = [(k, i, ms, c) for k, i, ms, c in log if ms < 200000]
    df = spark.createDataFrame(rows, "bucket string, event_id long, ms long, cost long")
    path = str(tmp_path / "steps")
    edges = [0, 20000, 45000, 90000, 200000]
    for low, high in zip(edges, edges[1:]):
        df.where((F.col("ms") >= low) & (F.col("ms") < high)).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(path)
    out = appended(keyed.admitted(stream_of(spark, path, df.schema, files_per_batch=1), 10, 300), "t")
    got = {r.event_id: r.admitted for r in out.collect()}
    assert got == loop_admit(rows, 10, 300)


def test_trailing_sum_equals_a_loop(spark, log):
    df = spark.createDataFrame(log, "bucket string, event_id long, ms long, cost long")
    for block in (None, 301):
        got = {r.event_id: r.used for r in usage.trailing_sum(df, "bucket", "ms", "cost", 300, block).collect()}
        for key, i, ms, cost in log[::17]:
            want = sum(c for k, _, m, c in log if k == key and ms - 300 < m <= ms) - cost
            assert got[i] == want


def test_ledger_equals_a_loop_over_any_blocks(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.randint(0, 900), rng.choice(["consume", "consume", "refund"])) for i in range(1500)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ms long, op string")
    balance, want = {}, {}
    for user, i, _ms, op in sorted(rows, key=lambda r: (r[2], r[1])):
        have = balance.get(user, 3)
        want[i] = (have + 1, None) if op == "refund" else (max(have - 1, 0), have > 0)
        balance[user] = want[i][0]
    for block in (7, 100, 10**6):
        got = {r.event_id: (r.balance, r.granted) for r in usage.credit_ledger(df, block_ms=block).collect()}
        assert got == want
    assert min(b for b, _ in want.values()) == 0


def test_reuse_equals_a_loop(spark):
    rng = random.Random(7)
    rows = [(rng.choice("aaab"), i, rng.randint(0, 20000)) for i in range(800)]
    df = spark.createDataFrame(rows, "cache_key string, event_id long, ms long")
    since, want = {}, {}
    for key, i, ms in sorted(rows, key=lambda r: (r[2], r[1])):
        want[i] = key in since and ms < since[key] + 90
        if not want[i]:
            since[key] = ms
    assert {r.event_id: r.outcome for r in usage.answer_reuse(df, 90).collect()} == want


def test_reuse_stream_in_steps_equals_batch(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("aab"), i, 1_700_000_000_000 + i * rng.choice([900_000, 1_300_000])) for i in range(120)]
    df = spark.createDataFrame(rows, "cache_key string, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    path = str(tmp_path / "reuse")
    ordered = sorted(r[2] for r in rows)
    edges = [0, ordered[30], ordered[60], ordered[90], ordered[-1] + 1]
    for low, high in zip(edges, edges[1:]):
        df.where((F.col("ms") >= low) & (F.col("ms") < high)).coalesce(1).write.mode("append").parquet(path)
    out = appended(keyed.answer_reuse(stream_of(spark, path, df.schema, files_per_batch=1), 3_600_000, "2 hours"), "t")
    batch = {r.event_id: r.outcome for r in usage.answer_reuse(df, 3_600_000).collect()}
    assert {r.event_id: r.hit for r in out.collect()} == batch
    assert any(batch.values()) and not all(batch.values())


def test_completion_in_any_order(spark, tmp_path):
    rows = [(1, "embedded", 2, False), (1, "expected", 3, False), (2, "expected", 1, True), (1, "embedded", 1, False),
            (2, "embedded", 1, False), (3, "expected", 2, False), (3, "embedded", 1, False), (4, "expected", 0, False)]
    path = str(tmp_path / "c")
    schema = "document_id long, kind string, n long, partial boolean"
    for r in rows:
        df = spark.createDataFrame([r], schema)
        df.coalesce(1).write.mode("append").parquet(path)
    out = appended(keyed.completed(stream_of(spark, path, df.schema, files_per_batch=3)), "t")
    assert {tuple(r) for r in out.collect()} == {(1, "ready", 3), (2, "partial", 1), (4, "ready", 0)}


def test_ingest_stream_ignores_redelivery(spark, tables, tmp_path):
    from folioscan.catalog.sources import upload_bodies
    from folioscan.plans import ingest

    bodies = upload_bodies(tables).where("id < 30").select("body")
    path = str(tmp_path / "up")
    bodies.coalesce(1).write.mode("append").parquet(path)
    bodies.coalesce(1).write.mode("append").parquet(path)
    pages = tables.pages.where("document_id < 40")
    out = jobs.ingested(stream_of(spark, path, bodies.schema, files_per_batch=1), pages)
    want = ingest.ingest(pages.where("document_id < 30"))
    assert sorted(r.id for r in out.select("id").collect()) == sorted(r.id for r in want.select("id").collect())


def test_embedding_in_small_batches(spark, tables):
    some = tables.chunks.where("document_id < 5").select("id", "document_id", "content")
    embed = hashed_vectors(16)
    out = {r.id: r.embedding for r in embedded(some, embed, "long", 3).collect()}
    for r in some.collect():
        assert out[r.id] == pytest.approx(list(embed([r.content])[0]))


def test_finalized_counts_like_the_keyed_processor(spark, tmp_path):
    rows = [(1, "embedded", 2, False), (1, "expected", 3, False), (2, "expected", 1, True), (1, "embedded", 1, False),
            (2, "embedded", 1, False), (3, "expected", 2, False), (3, "embedded", 1, False), (4, "expected", 0, False), (1, "embedded", 5, False)]
    path = str(tmp_path / "f")
    schema = "document_id long, kind string, n long, partial boolean"
    for r in rows:
        df = spark.createDataFrame([r], schema)
        df.coalesce(1).write.mode("append").parquet(path)
    out = jobs.finalized(stream_of(spark, path, df.schema, files_per_batch=1))
    assert {tuple(r) for r in out.select("document_id", "status", "chunk_count").collect()} == {(1, "ready", 3), (2, "partial", 1), (4, "ready", 0)}


def test_passages_of_one_delivery_are_not_compared(spark, tables, tmp_path):
    from folioscan.catalog.sources import upload_bodies

    bodies = upload_bodies(tables).where("id < 30").select("body")
    path = str(tmp_path / "one")
    bodies.coalesce(1).write.parquet(path)
    out = jobs.ingested(stream_of(spark, path, bodies.schema), tables.pages.where("document_id < 40"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "LeftSemi" in plan  # only repeated documents reach the aggregate
    assert out.count() == out.select("id").distinct().count() > 0
