"""Usage accounts in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import usage
from . import query


@query("win_rate_usage", """SELECT event_id, used, greatest(0, 60 - used) AS available FROM (SELECT event_id,
 (sum(cost) OVER (PARTITION BY bucket ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND CURRENT ROW) - cost)::BIGINT AS used FROM fx_token_log)""")
def _(t):
    out = usage.trailing_sum(t.token_log, "bucket", "ms", "cost")
    return out.select("event_id", F.col("used").cast("long"), usage.available(F.col("used")).cast("long").alias("available"))


LEDGER = {
    "fx_ops": "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) AS rn FROM fx_credit_log",
    "fx_ledger": """SELECT user_id, event_id, rn, CASE WHEN op = 'consume' THEN 2 ELSE 4 END::BIGINT AS balance,
 CASE WHEN op = 'consume' THEN true END AS granted FROM fx_ops WHERE rn = 1 UNION ALL
 SELECT o.user_id, o.event_id, o.rn, CASE WHEN o.op = 'consume' THEN greatest(l.balance - 1, 0) ELSE l.balance + 1 END,
 CASE WHEN o.op = 'consume' THEN l.balance > 0 END FROM fx_ledger l JOIN fx_ops o ON o.user_id = l.user_id AND o.rn = l.rn + 1""",
}


@query("st_credit_ledger", "SELECT user_id, event_id, balance, granted FROM fx_ledger", True, LEDGER)
def _(t):
    return usage.credit_ledger(t.credit_log).select("user_id", "event_id", "balance", "granted")


def _admit(capacity: int) -> dict[str, str]:
    # The admitted requests are carried as a list; a request is admitted when those of the last minute leave room.
    room = f"""list_sum(list_transform(list_filter(a.held, lambda h: h.ms > r.ms - 60000), lambda h: h.cost))"""
    return {
        "fx_req": "SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY ms, event_id) AS rn FROM fx_token_log",
        "fx_admit": f"""SELECT bucket, event_id, rn, cost <= {capacity} AS ok, CASE WHEN cost <= {capacity} THEN [{{'ms': ms, 'cost': cost}}] ELSE [] END AS held
 FROM fx_req WHERE rn = 1 UNION ALL
 SELECT bucket, event_id, rn, used + cost <= {capacity}, CASE WHEN used + cost <= {capacity} THEN list_append(kept, {{'ms': ms, 'cost': cost}}) ELSE kept END
 FROM (SELECT r.bucket, r.event_id, r.rn, r.ms, r.cost, list_filter(a.held, lambda h: h.ms > r.ms - 60000) AS kept, coalesce({room}, 0) AS used
 FROM fx_admit a JOIN fx_req r ON r.bucket = a.bucket AND r.rn = a.rn + 1)""",
    }


@query("st_rate_admit", "SELECT bucket, event_id, ok AS admitted FROM fx_admit", True, _admit(60))
def _(t):
    return usage.admitted(t.token_log).select("bucket", "event_id", F.col("outcome").alias("admitted"))


REUSE = {
    "fx_asks": "SELECT *, row_number() OVER (PARTITION BY cache_key ORDER BY ms, event_id) AS rn FROM fx_reuse_log",
    "fx_held": """SELECT cache_key, event_id, rn, false AS hit, ms AS since FROM fx_asks WHERE rn = 1 UNION ALL
 SELECT a.cache_key, a.event_id, a.rn, a.ms < h.since + 3600000, CASE WHEN a.ms < h.since + 3600000 THEN h.since ELSE a.ms END
 FROM fx_held h JOIN fx_asks a ON a.cache_key = h.cache_key AND a.rn = h.rn + 1""",
}


@query("st_answer_cache", "SELECT cache_key, event_id, hit FROM fx_held", True, REUSE)
def _(t):
    return usage.answer_reuse(t.reuse_log).select("cache_key", "event_id", F.col("outcome").alias("hit"))


SPEND = {"fx_jobs": """SELECT user_id % 10 AS user_id, path, CASE WHEN path IN ('conversational', 'cache') THEN 0
 WHEN path IN ('direct', 'direct_fallback') THEN router + 2
 ELSE router + 2 + CASE WHEN second AND n_docs <= 1 THEN 1 ELSE 0 END + CASE WHEN n_docs > 1 THEN 1 ELSE 0 END END::BIGINT AS tokens
 FROM (SELECT *, CASE event_type WHEN 'signup' THEN 'conversational' WHEN 'click' THEN 'cache' WHEN 'error' THEN 'direct' ELSE 'rag' END AS path,
 CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END AS router, job_id % 4 = 1 AS second, job_id % 5 AS n_docs FROM fx_job_log)"""}


@query("agg_token_spend", """SELECT user_id, path, sum(tokens)::BIGINT AS tokens, count(*) AS jobs, grouping(path)::INT AS is_total
 FROM fx_jobs GROUP BY ROLLUP (user_id, path)""", views=SPEND)
def _(t):
    e = F.col("event_type")
    path = F.when(e == "signup", "conversational").when(e == "click", "cache").when(e == "error", "direct").otherwise("rag")
    jobs = t.job_log.select(
        (F.col("user_id") % 10).alias("user_id"), path.alias("path"),
        usage.token_cost(path, F.col("user_id") % 3 != 0, F.col("job_id") % 4 == 1, F.col("job_id") % 5).alias("tokens"),
    )
    return usage.spend_report(jobs).withColumn("is_total", F.col("path").isNull().cast("int"))
