"""Usage accounts: rate windows, credits, answer reuse, token cost."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import carry

CAPACITY = 60
WINDOW_MS = 60_000
START_CREDITS = 3
CACHE_TTL_MS = 3_600_000
# Tokens per model step.
TOKENS = {"router": 1, "second_pass": 1, "generate": 2, "model_choice": 1}


def trailing_sum(
    log: DataFrame, key: str, ms: str, value: str, window_ms: int = WINDOW_MS, block_ms: int | None = None
) -> DataFrame:
    """Adds ``used``: the sum of ``value`` over the other rows of the key in the last ``window_ms``.

    Every row enters the sum at its time and leaves it one window later, so a
    plain running sum gives the trailing one at the cost of two rows each,
    however many rows a window holds. Time is cut into blocks; rows that are
    still inside the window when the next block begins are handed to it as
    context, so the busiest key is spread over as many tasks as it has blocks.
    """
    block_ms = block_ms or 10 * window_ms
    own = F.floor(F.col(ms) / block_ms)
    spill = F.floor((F.col(ms) + window_ms - 1) / block_ms)
    copies = F.filter(
        F.array(
            F.struct(own.alias("b"), F.col(ms).alias("at"), F.col(value).alias("v"), F.lit(True).alias("keep")),
            F.struct(own.alias("b"), (F.col(ms) + window_ms).alias("at"), (-F.col(value)).alias("v"), F.lit(False).alias("keep")),
            F.struct(spill.alias("b"), F.col(ms).alias("at"), F.col(value).alias("v"), F.lit(False).alias("keep")),
            F.struct(spill.alias("b"), (F.col(ms) + window_ms).alias("at"), (-F.col(value)).alias("v"), F.lit(False).alias("keep")),
        ),
        lambda c, i: (i < 2) | (spill > own),
    )
    rows = log.withColumn("_c", F.explode(copies)).select(
        *log.columns, F.col("_c.b").alias("_b"), F.col("_c.at").alias("_at"), F.col("_c.v").alias("_v"), F.col("_c.keep").alias("_keep")
    )
    frame = Window.partitionBy(key, "_b").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return (
        rows.withColumn("used", F.sum("_v").over(frame) - F.col(value))
        .where("_keep")
        .drop("_b", "_at", "_v", "_keep")
    )


def available(used: Column, capacity: int = CAPACITY) -> Column:
    return F.greatest(F.lit(0), F.lit(capacity) - used)


def sessions(log: DataFrame, key: str, ms: str, tie: str, gap_ms: int) -> DataFrame:
    """Adds ``session``: a number that grows whenever a key was idle for ``gap_ms`` or more.

    Whatever a rule remembers for less than ``gap_ms`` never crosses a session.
    """
    rows = log.withColumn("_block", F.floor(F.col(ms) / (60 * gap_ms)))
    rows = carry.previous(rows, [key], "_block", [ms, tie], {"_last": F.col(ms)})
    starts = F.when(F.col("_last").isNull() | (F.col(ms) - F.col("_last") >= gap_ms), 1).otherwise(0)
    rows = rows.withColumn("_start", starts)
    rows = carry.running_before(rows, [key], "_block", [ms, tie], F.col("_start"), "session")
    return rows.withColumn("session", (F.col("session") + F.col("_start")).cast("long")).drop("_block", "_last", "_start")


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], fold: Callable, schema: str) -> DataFrame:
    """Run ``fold(state, row) -> (state, value)`` down each key's rows in order.

    Rows stream through the task in sorted order; only the state of the current
    key is held, so a long key needs time but not memory.
    """
    columns = df.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for part in parts:
            values = []
            for row in part.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if key != current:
                    current, state = key, None
                state, value = fold(state, row)
                values.append(value)
            part["outcome"] = values
            yield part[columns + ["outcome"]]

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def admit_step(capacity: int, window_ms: int) -> Callable:
    """One admission decision; the state holds the admitted (time, cost) pairs of the window."""

    def fold(state, row):
        held, used = state if state is not None else (deque(), 0)
        while held and held[0][0] <= row.ms - window_ms:
            used -= held.popleft()[1]
        ok = used + row.cost <= capacity
        if ok:
            held.append((row.ms, row.cost))
            used += row.cost
        return (held, used), bool(ok)

    return fold


def admitted(log: DataFrame, capacity: int = CAPACITY, window_ms: int = WINDOW_MS) -> DataFrame:
    """Requests with ``outcome``: true when the tokens admitted in the window leave room.

    ``log``: bucket, event_id, ms, cost. Each decision depends on those before
    it, so a bucket is serial by nature, but only within a busy spell: after an
    idle window nothing is remembered, and spells run side by side.
    """
    rows = sessions(log.select("bucket", "event_id", "ms", "cost"), "bucket", "ms", "event_id", window_ms)
    schema = "bucket string, event_id long, ms long, cost long, session long, outcome boolean"
    rows = rows.select("bucket", "event_id", "ms", F.col("cost").cast("long").alias("cost"), "session")
    return sorted_fold(rows, ["bucket", "session"], ["ms", "event_id"], admit_step(capacity, window_ms), schema)


def credit_ledger(log: DataFrame, start: int = START_CREDITS, block_ms: int = 86_400_000) -> DataFrame:
    """Balance after every operation and whether a consume was granted.

    ``log``: user_id, event_id, ms, op (consume or refund). A balance that steps
    by one and stops at 0 equals its free running sum plus the deepest shortfall
    so far, so two scans replace the loop; both are cut into time blocks.
    """
    order = ["ms", "event_id"]
    rows = log.withColumn("_step", F.when(F.col("op") == "consume", -1).otherwise(1)).withColumn(
        "_block", F.floor(F.col("ms") / block_ms)
    )
    inside = Window.partitionBy("user_id", "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_s", F.sum("_step").over(upto)).withColumn("_low", F.min("_s").over(upto))
    blocks = rows.groupBy("user_id", "_block").agg(
        F.sum("_step").alias("_sum"), F.min("_s").alias("_least")
    )
    before = Window.partitionBy("user_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    blocks = blocks.withColumn("_deep", F.min(F.col("_base") + F.col("_least")).over(before))
    out = rows.join(blocks.select("user_id", "_block", "_base", "_deep"), ["user_id", "_block"])
    total = F.col("_base") + F.col("_s")
    deepest = F.least(F.col("_base") + F.col("_low"), F.coalesce(F.col("_deep"), F.lit(0)), F.lit(0))
    balance = total + F.greatest(F.lit(start), -deepest)
    prior_total = total - F.col("_step")
    prior_low = F.lag("_low").over(inside)
    prior_deepest = F.least(
        F.coalesce(F.col("_base") + prior_low, F.lit(0)), F.coalesce(F.col("_deep"), F.lit(0)), F.lit(0)
    )
    prior = prior_total + F.greatest(F.lit(start), -prior_deepest)
    return out.select(
        *log.columns, balance.cast("long").alias("balance"),
        F.when(F.col("op") == "consume", prior > 0).alias("granted"),
    )


def reuse_step(ttl_ms: int) -> Callable:
    """Hit or miss of one question; the state is the time of the answer now held."""

    def fold(state, row):
        if state is not None and row.ms < state + ttl_ms:
            return state, True
        return row.ms, False

    return fold


def answer_reuse(questions: DataFrame, ttl_ms: int = CACHE_TTL_MS) -> DataFrame:
    """Questions with ``outcome``: true when the answer of an earlier one is still held.

    ``questions``: cache_key, event_id, ms. Reuse does not prolong an answer.
    """
    rows = sessions(questions.select("cache_key", "event_id", "ms"), "cache_key", "ms", "event_id", ttl_ms)
    schema = "cache_key string, event_id long, ms long, session long, outcome boolean"
    rows = rows.select("cache_key", "event_id", "ms", "session")
    return sorted_fold(rows, ["cache_key", "session"], ["ms", "event_id"], reuse_step(ttl_ms), schema)


def token_cost(path: Column, has_documents: Column, second_pass: Column, n_docs: Column) -> Column:
    """Tokens of one job. Small talk and reused answers are free."""
    router = F.when(has_documents, 0).otherwise(TOKENS["router"])
    second = F.when(second_pass & (n_docs <= 1), TOKENS["second_pass"]).otherwise(0)
    choice = F.when(n_docs > 1, TOKENS["model_choice"]).otherwise(0)
    full = router + second + choice + TOKENS["generate"]
    return (
        F.when(path.isin("conversational", "cache"), 0)
        .when(path.isin("direct", "direct_fallback"), router + TOKENS["generate"])
        .otherwise(full)
        .cast("long")
    )


def spend_report(jobs: DataFrame) -> DataFrame:
    """Tokens per user and path with subtotals."""
    return jobs.rollup("user_id", "path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("jobs"))


def live(results: DataFrame, now_ms: Column, ttl_ms: int = CACHE_TTL_MS) -> DataFrame:
    """Rows still within their time to live."""
    return results.where(F.col("written_ms") + ttl_ms > now_ms)


def polled(requests: DataFrame, results: DataFrame, ttl_ms: int = CACHE_TTL_MS) -> DataFrame:
    """Status of each polled job at its poll time; ``not_found`` when missing or expired."""
    met = requests.join(results.select("job_id", "written_ms", "status"), "job_id", "left")
    fresh = F.coalesce(
        (F.col("written_ms") <= F.col("asked_ms")) & (F.col("written_ms") + ttl_ms > F.col("asked_ms")), F.lit(False)
    )
    return met.withColumn("status", F.when(fresh, F.col("status")).otherwise("not_found"))


def credit_balance(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """Current credits, 0 without a profile."""
    return users.join(profiles.select("user_id", "voice_credits"), "user_id", "left").withColumn(
        "voice_credits", F.coalesce("voice_credits", F.lit(0)).cast("long")
    )
