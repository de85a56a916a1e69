"""Streams run to the end of the given tables, and what they left behind."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embedding import hashed_vectors
from ..session import fresh_path
from ..streaming import jobs, keyed
from ..streaming.runner import appended, stream_of
from . import query
from .accounts import LEDGER, REUSE, _admit
from .sources import upload_bodies


def replay(t, df, label: str, files: int = 0):
    """Write rows once and stream them back; in ``files`` steps of time when ordered rows are needed."""
    path = fresh_path(t.spark, label)
    rows = df.repartitionByRange(files, "ms").sortWithinPartitions("ms") if files else df
    rows.write.parquet(path)
    return stream_of(t.spark, path, df.schema)


def event_stream(t):
    events = t.raw("events")
    raw = stream_of(t.spark, t.dir, events.schema, "events.parquet")
    ts = F.col("ts").cast("timestamp")
    return raw.withColumn("ts", ts).withColumn("ms", F.unix_millis(ts))


@query("st_ingest")
def _(t):
    uploads = replay(t, upload_bodies(t).select("body"), "uploads")
    out = jobs.ingested(uploads, t.pages)
    return out.select("id", "document_id", "chunk_index", "content_type", "heading", "content")


@query("st_embed", "SELECT id, document_id, 64 AS dimension FROM fx_chunks WHERE embedding IS NULL")
def _(t):
    chunks = replay(t, t.chunks.select("id", "document_id", "content", "embedding"), "chunks")
    out = appended(jobs.embedded_stream(chunks, hashed_vectors(64), "long"), "vectors")
    return out.select("id", "document_id", F.size("embedding").alias("dimension"))


@query("st_finalize", """SELECT document_id, CASE WHEN document_id % 7 = 3 THEN 'partial' ELSE 'ready' END AS status, count(*) AS chunk_count
 FROM fx_chunks WHERE document_id % 11 <> 5 GROUP BY 1""")
def _(t):
    done = t.bare_chunks.select("document_id", F.lit("embedded").alias("kind"), F.lit(1).cast("long").alias("n"), F.lit(False).alias("partial"))
    d = F.col("document_id")
    told = t.bare_chunks.groupBy("document_id").agg(F.count("*").alias("n")).select(
        "document_id", F.lit("expected").alias("kind"), (F.col("n") + F.when(d % 11 == 5, 1).otherwise(0)).alias("n"), (d % 7 == 3).alias("partial")
    )
    return jobs.finalized(replay(t, done.unionByName(told), "completion"))


@query("st_progress", "SELECT document_id, count(*) AS chunk_count FROM fx_chunks GROUP BY 1")
def _(t):
    return jobs.progress(replay(t, t.chunks.select("id", "document_id"), "chunks"))


@query("st_rate_admit_stream", "SELECT bucket, event_id, ok AS admitted FROM fx_admit", True, _admit(60))
def _(t):
    return appended(keyed.admitted(replay(t, t.token_log, "tokens")), "admitted")


@query("st_credit_ledger_stream", "SELECT user_id, event_id, balance, granted FROM fx_ledger", True, LEDGER)
def _(t):
    return appended(keyed.credit_ledger(replay(t, t.credit_log, "credits")), "ledger")


@query("st_answer_cache_stream", "SELECT cache_key, event_id, hit FROM fx_held", True, REUSE)
def _(t):
    rows = t.reuse_log.withColumn("ts", F.timestamp_millis("ms"))
    return appended(keyed.answer_reuse(replay(t, rows, "reuse")), "reused")


@query("st_job_latest", """SELECT job_id, user_id, status, written_ms FROM fx_result_log QUALIFY row_number() OVER
 (PARTITION BY job_id ORDER BY written_ms DESC, seq DESC) = 1""")
def _(t):
    return jobs.job_states(replay(t, t.result_log, "results")).select("job_id", "user_id", "status", "written_ms")


@query("st_job_bins", """SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, ts)) // 1000 AS bin_ms, count(*) AS jobs, count(*) FILTER (status = 'done') AS done,
 count(*) FILTER (status <> 'done') AS failed FROM fx_job_log GROUP BY 1 HAVING bin_ms + 300000 <= (SELECT max(ms) - 600000 FROM fx_events)""")
def _(t):
    status = F.when(F.col("event_type") == "error", "error").otherwise("done")
    out = appended(jobs.job_bins(event_stream(t).withColumn("status", status)), "job-bins")
    return out.select(F.unix_millis("bin_start").alias("bin_ms"), "jobs", "done", "failed")


@query("st_dedup_redelivery", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    copies = F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int")))
    twice = event_stream(t).withColumn("delivery", copies)
    return appended(jobs.without_redelivery(twice), "once").select("event_id", "user_id", "event_type")


@query("st_poison", """SELECT event_id, CASE WHEN event_id % 13 = 4 OR event_id % 17 = 2 THEN 'poison' WHEN event_type = 'error' THEN 'retry' ELSE 'done' END AS fate FROM events""")
def _(t):
    e = F.col("event_id")
    good = F.to_json(F.struct(e.cast("string").alias("job_id"), F.when(e % 17 == 2, "  ").otherwise(F.col("event_type")).alias("query")))
    body = F.when(e % 13 == 4, "{broken").otherwise(good)
    told = event_stream(t).select("event_id", body.alias("body"), (F.col("event_type") == "error").alias("waits"))
    return jobs.separated(told).select("event_id", "fate")
