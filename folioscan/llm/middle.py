"""Fill-in-the-middle forms, cut where memoised chunk counts say.

A text is a row of units: runs of ASCII letters, and single other code points. A rolling hash
over 32 bytes cuts texts into chunks that depend on content alone, so passages that many texts
share give equal chunks. A task keeps a summary per chunk (units, code points, whether its first
and last code points are letters), looked up by the chunk's bytes themselves, so equal hashes
never mix chunks up. The summaries of a text's chunks are added; a run of letters that goes on
over a chunk's end counts once. The sums give the number of units and name the chunk that holds
a cut, and only that chunk is looked at unit by unit.

Null texts count as empty. A null id is drawn like an empty id text. Rows are independent:
repeated rows and ids get equal results, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column, free_name, lengths, slices, small_batches

SEED = 1
WINDOW = 32  # bytes that the rolling hash sees
CHUNK_BITS = 10  # a chunk ends at one of 1,024 positions
CHUNK_MOST = 1 << 14
SCAN = 1 << 22  # bytes hashed at once
CACHE_BYTES = 16 << 20  # of chunks that a task remembers, twice

_GEAR = np.random.default_rng(SEED).integers(0, 1 << 32, 256, dtype=np.uint32)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CUTS = "n long, prefix_chars long, middle_chars long"


def _next_point(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Positions moved on to where a code point starts."""
    for _ in range(3):
        inner = at < len(data)
        inner[inner] = (data[at[inner]] & 0xC0) == 0x80
        if not inner.any():
            break
        at = at + inner
    return at


def chunk_ends(data: np.ndarray, bits: int = CHUNK_BITS, most: int = CHUNK_MOST) -> np.ndarray:
    """Ends of the chunks of one text (its bytes), the text's end last."""
    found = []
    for at in range(0, len(data), SCAN):
        begin = max(0, at - WINDOW + 1)
        h = _GEAR[data[begin : at + SCAN]]
        for step in (1, 2, 4, 8, 16):
            h[step:] += h[:-step] << np.uint32(step)
        hits = begin + np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
        found.append(hits[(hits > max(at, WINDOW))])
    ends = np.unique(_next_point(data, np.concatenate([*found, [len(data)]])))
    gaps = np.diff(ends, prepend=0)
    if len(gaps) and gaps.max() > most:
        extra = [np.arange(e - g + most, e, most) for e, g in zip(ends[gaps > most], gaps[gaps > most])]
        ends = np.unique(np.concatenate([ends, _next_point(data, np.concatenate(extra))]))
    return ends


def _unit_starts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = _LETTER[data]
    point = (data & 0xC0) != 0x80
    start = point.copy()
    start[1:] &= ~(letter[1:] & letter[:-1])
    return start, point, letter


class Chunks:
    """Summaries of the chunks that a task has met: two generations, each of ``CACHE_BYTES`` at most."""

    def __init__(self, limit: int = CACHE_BYTES):
        self.young: dict[bytes, tuple] = {}
        self.old: dict[bytes, tuple] = {}
        self.held, self.limit, self.made = 0, limit, 0

    def summaries(self, chunks: list[bytes]) -> np.ndarray:
        """(units, code points, first is a letter, last is a letter) of each chunk."""
        missing = {c for c in chunks if c not in self.young and c not in self.old}
        if missing:
            order = list(missing)
            self.made += len(order)
            fresh = dict(zip(order, self._summed(order)))
        else:
            fresh = {}
        rows = [fresh.get(c) or self.young.get(c) or self.old[c] for c in chunks]
        for c, row in zip(chunks, rows):
            if c not in self.young:
                self.young[c] = row
                self.held += len(c)
        if self.held > self.limit:
            self.young, self.old, self.held = {}, self.young, 0
        return np.array(rows, np.int64).reshape(-1, 4)

    @staticmethod
    def _summed(chunks: list[bytes]) -> list[tuple]:
        data = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum([len(c) for c in chunks])
        begins = ends - [len(c) for c in chunks]
        start, point, letter = _unit_starts(data)
        start[begins] = True
        units, points = (np.add.reduceat(x, begins, dtype=np.int64) for x in (start, point))
        return list(zip(units.tolist(), points.tolist(), letter[begins].tolist(), letter[ends - 1].tolist()))


def cuts_of(text: bytes, first: int, second: int, cache: Chunks) -> tuple[int, int, int]:
    """(units, code points of the prefix, of the middle) of one text; the draws are taken modulo units + 1."""
    if not text:
        return 0, 0, 0
    data = np.frombuffer(text, np.uint8)
    ends = chunk_ends(data)
    begins = np.concatenate([[0], ends[:-1]])
    made = [cache.summaries([text[a:b] for a, b in zip(begins[i : i + 1024].tolist(), ends[i : i + 1024].tolist())]) for i in range(0, len(ends), 1024)]
    table = np.concatenate(made)
    joint = np.zeros(len(table), np.int64)
    joint[1:] = table[1:, 2] & table[:-1, 3]
    units = np.cumsum(table[:, 0] - joint)
    points = np.cumsum(table[:, 1])
    n = int(units[-1])

    def chars(k: int) -> int:
        """Code points before unit k."""
        if k >= n:
            return int(points[-1])
        c = int(np.searchsorted(units, k, "right"))
        start, point, _ = _unit_starts(data[begins[c] : ends[c]])
        at = np.flatnonzero(start)[k - (int(units[c - 1]) if c else 0) + int(joint[c])]
        return (int(points[c - 1]) if c else 0) + int(point[:at].sum())

    a, b = sorted((first % (n + 1), second % (n + 1)))
    prefix = chars(a)
    return n, prefix, chars(b) - prefix


def _with_cuts(docs: DataFrame, name: str, text: str, first: str, second: str) -> DataFrame:
    """``docs`` and a struct of ``_CUTS``: each task memoises the chunks of its rows."""
    small_batches(docs)
    at = [docs.columns.index(c) for c in (text, first, second)]
    kind = pa.struct([("n", pa.int64()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Chunks()
        for batch in batches:
            data = batch.column(at[0]).cast(pa.binary())
            for a, b in slices(lengths(data)):
                part = batch.slice(a, b - a)
                draws = zip(data.slice(a, b - a).to_pylist(), part.column(at[1]).to_pylist(), part.column(at[2]).to_pylist())
                rows = [cuts_of(t or b"", x, y, cache) for t, x, y in draws]
                made = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], fields=list(kind))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(f"struct<{_CUTS}>"))]))


def transformed(
    docs: DataFrame, name: str = "middle", doc_id: str = "doc_id", text: str = "text", seed: int = SEED, share: int = 90, suffix_first: int = 20,
) -> DataFrame:
    """``docs`` and a struct ``name``: n, form (plain, psm, spm), prefix_chars, middle_chars, output.

    ``share`` of 100 texts are rearranged, ``suffix_first`` of 100 of these as spm. Texts that are
    empty or hold a marker stay plain. Draws hang on ``seed`` and the id alone.
    """
    hashed, drawn, cuts = (free_name(docs, c) for c in ("_hash", "_drawn", "_cuts"))
    first, second = free_name(docs, "_first"), free_name(docs, "_second")
    own = F.coalesce(column(text), F.lit(""))

    def draw(i: int) -> Column:
        return F.conv(F.substring(column(hashed), 8 * i + 1, 8), 16, 10).cast("long")

    id_text = F.concat(F.lit(f"{seed}:"), F.coalesce(column(doc_id).cast("string"), F.lit("")))
    marked = own.contains("<P>") | own.contains("<S>") | own.contains("<M>")
    form = F.when((own == "") | marked | (draw(2) % 100 >= share), "plain").when(draw(3) % 100 < suffix_first, "spm").otherwise("psm")
    ready = docs.withColumn(hashed, F.sha2(id_text, 256)).withColumn(drawn, form).withColumn(first, draw(0)).withColumn(second, draw(1))
    made = _with_cuts(ready, cuts, text, first, second)
    at, many = column(cuts)["prefix_chars"].cast("int"), column(cuts)["middle_chars"].cast("int")
    prefix, middle, suffix = F.substring(own, F.lit(1), at), F.substring(own, at + 1, many), F.substring(own, at + many + 1, F.length(own))
    plain = column(drawn) == "plain"
    output = (
        F.when(plain, own)
        .when(column(drawn) == "psm", F.concat(F.lit("<P>"), prefix, F.lit("<S>"), suffix, F.lit("<M>"), middle))
        .otherwise(F.concat(F.lit("<S>"), suffix, F.lit("<P>"), prefix, F.lit("<M>"), middle))
    )
    whole = F.struct(
        column(cuts)["n"].alias("n"),
        column(drawn).alias("form"),
        F.when(~plain, column(cuts)["prefix_chars"]).alias("prefix_chars"),
        F.when(~plain, column(cuts)["middle_chars"]).alias("middle_chars"),
        output.alias("output"),
    )
    return made.withColumn(name, whole).drop(hashed, drawn, first, second, cuts)


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of: a rearranged text holds each marker once."""
    parts = F.split(output, "<[PSM]>")
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .otherwise(F.concat(parts[2], parts[3], parts[1]))
    )


def digest(docs: DataFrame) -> DataFrame:
    made = transformed(docs.select("doc_id", "text"))
    m = F.col("middle")
    return made.select(
        "doc_id", m["n"].alias("n"), m["form"].alias("form"), m["prefix_chars"].alias("prefix_chars"), m["middle_chars"].alias("middle_chars"),
        F.sha2(m["output"], 256).alias("output_sha256"), F.sha2(restored(m["output"], m["form"]), 256).alias("restored_sha256"),
    )


ORACLE = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
numbered AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
  FROM drawn),
cut AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, u,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM cut)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
