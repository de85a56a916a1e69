"""Multi-party perspective rotation of chats.

For every participant of a conversation the dialogue is rendered once with that speaker as
the assistant and all others as users with their names; masks are the character ranges that
the assistant speaks. Conversations come in numbered parts of ``TURNS`` turn numbers, so a
very long one is spread over many rows and tasks; the parts of a perspective, joined in
order, are its dialogue, and the ranges of a part count from the part's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 64
UNKNOWN = "unknown"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotated(turns: DataFrame, part_turns: int = TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, rendered, masks) for turns (conv_id, turn, role, text).

    Turns are ordered by number (null first), then role and text; repeated rows are
    repeated turns. A null role is the participant ``unknown``, a null text is empty. A
    perspective has a row for every part of its conversation, also for parts where it only listens.
    """
    rows = turns.select(
        "conv_id", F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"), "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = rows.groupBy("conv_id", "part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    speakers = rows.select("conv_id", F.col("role").alias("speaker")).distinct()
    met = parts.alias("p").join(speakers.alias("s"), F.col("p.conv_id").eqNullSafe(F.col("s.conv_id"))).select("p.conv_id", "speaker", "part", "turns")
    pieces = met.withColumn("pieces", F.transform("turns", lambda t: _piece(t, F.col("speaker"))))
    joined = pieces.withColumn("rendered", F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), ""))
    return joined.select(
        "conv_id", "speaker", "part", F.size("turns").cast("long").alias("n_turns"), "rendered", _masks(F.col("pieces")).alias("masks"),
    )


def _piece(turn: Column, speaker: Column) -> Column:
    own = turn["role"] == speaker
    head = F.when(own, F.lit(OPEN + "assistant\n")).otherwise(F.concat(F.lit(OPEN + "user name="), turn["role"], F.lit("\n")))
    return F.struct(own.alias("own"), head.alias("head"), turn["text"].alias("body"))


def _masks(pieces: Column) -> Column:
    """[start, end) of what the assistant says, its closing mark included, in code points."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc, p):
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"]) + len(CLOSE)
        mine = F.when(p["own"], F.array(F.struct(begin.alias("start"), (end - 1).alias("end")))).otherwise(F.array().cast("array<struct<start:long,end:long>>"))
        return F.struct(end.alias("at"), F.concat(acc["out"], mine).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def digest(turns: DataFrame) -> DataFrame:
    """Masks as start-end pairs, comma-joined."""
    made = rotated(turns)
    text = F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return made.select("conv_id", "speaker", "part", "n_turns", "rendered", text.alias("masks"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, CAST(coalesce(floor(turn / 64), -1) AS BIGINT) AS part, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
p AS (
  SELECT t.conv_id, speaker, part, turn, role, text, role = speaker AS own,
         CASE WHEN role = speaker THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || role || chr(10) END AS head
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, row_number() OVER w AS n,
         sum(length(head) + length(text) + 11) OVER (w ROWS UNBOUNDED PRECEDING) AS stop
  FROM p WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, speaker, part, count(*) AS n_turns,
       string_agg(head || text || '<|im_end|>' || chr(10), '' ORDER BY n) AS rendered,
       coalesce(string_agg(CAST(stop - length(text) - 11 AS BIGINT) || '-' || CAST(stop - 1 AS BIGINT), ',' ORDER BY n) FILTER (own), '') AS masks
FROM o GROUP BY conv_id, speaker, part
"""
