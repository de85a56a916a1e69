"""SentencePiece encoding and decoding with a max-plus scan over giant documents.

A sequence of pieces is the model's merge result exactly if every two neighbours are the
merge result of their joint text. So the encoding is the one path of finite weight through a
lattice whose edges are pieces, and any stretch of it is the encoding of that stretch. A
giant text is cut at fixed places. The state at a cut is the piece that covers the last
character before it; for each chunk a matrix holds the weight (sum of piece scores) of the
path from a state at its left end to one at its right end, or minus infinity where there is
none. The matrices are multiplied over (max, +), which is associative, forwards and backwards
along the document; the one state that keeps a finite weight from both sides is where the
chunks really meet, and each chunk is then encoded by itself between its two meeting points.

Merges never cross a place before a space that follows another character, nor a character
that is in no piece. Inside a chunk with such places the states don't interact, and
its matrix is a column plus a row.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import write_table
from ..sizing import join_sized
from .common import column, free_name, lengths, slices, small_batches

CHUNK = 16384  # code points; texts up to this length are encoded in one go
BLOCK = 64  # chunk matrices that are multiplied in one step
CUT_CHUNKS = 128  # chunks of a text that are passed on at a time
NONE = -np.inf

_LOADED: dict = {}


class Pieces:
    """A SentencePiece model that encodes any stretch of a text without a space of its own in front."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.known = {
            self.model.id_to_piece(i).replace("▁", " "): i
            for i in range(size)
            if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i) or self.model.is_unused(i))
        }
        self.longest = max(map(len, self.known))
        self.letters = {c for p in self.known for c in p}
        self.inner_space = any(" " in p[1:] and p.strip(" ") for p in self.known)
        self.mark = len(self.model.encode("\n"))  # a line end is in no piece: nothing merges with it
        if "\n" in self.letters:
            raise ValueError("the model has pieces with line ends")

    def whole(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)

    def stretch(self, text: str) -> list[int]:
        return self.model.encode("\n" + text)[self.mark :]

    def pieces(self, text: str) -> list[tuple[int, int, float]]:
        """(start, end, score) of the pieces of a stretch; a character in no piece is one piece."""
        out, at, ids, i = [], 0, self.stretch(text), 0
        while i < len(ids):
            if self.model.is_byte(ids[i]):
                n = len(text[at].encode())
                out.append((at, at + 1, 0.0))
                i, at = i + n, at + 1
            else:
                n = len(self.model.id_to_piece(ids[i]))
                out.append((at, at + n, self.model.get_score(ids[i])))
                i, at = i + 1, at + n
        return out

    def states(self, text: str, cut: int) -> list[tuple[int, int]]:
        """Pieces (start, end) that may cover the character before ``cut``."""
        found = [
            (a, b)
            for a in range(max(0, cut - self.longest), cut)
            for b in range(cut, min(len(text), a + self.longest) + 1)
            if text[a:b] in self.known
        ]
        return found or [(cut - 1, cut)]

    def free_cuts(self, text: str) -> tuple[int, int] | None:
        """First and last place inside ``text`` that no merge can cross."""
        first = last = None
        for at in self._free(text):
            first = at if first is None else first
            last = at
            break
        for at in self._free(text, True):
            last = at
            break
        return None if first is None else (first, last)

    def _free(self, text: str, back: bool = False) -> Iterable[int]:
        order = range(len(text) - 1, 0, -1) if back else range(1, len(text))
        for at in order:
            a, b = text[at - 1], text[at]
            if (not self.inner_space and b == " " and a != " ") or a not in self.letters or b not in self.letters:
                yield at


def pieces(path: str) -> Pieces:
    """The model of a path, loaded once in each process."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def matrix(model: Pieces, text: str, left: list[tuple[int, int]], right: list[tuple[int, int]]) -> np.ndarray:
    """Path weights from each left state to each right one, without the left piece, with the right one.

    ``text`` holds the chunk with the characters of all states; places count from its start.
    """
    out = np.full((len(left), len(right)), NONE)
    lo, hi = max(b for _, b in left), min(a for a, _ in right)
    free = model.free_cuts(text[lo:hi]) if lo < hi else None
    if free:
        first, last = lo + free[0], lo + free[1]
        head = np.full(len(left), NONE)
        for i, (a, b) in enumerate(left):
            path = model.pieces(text[a:first])
            if path and path[0][:2] == (0, b - a):
                head[i] = sum(s for _, _, s in path[1:])
        for j, (a, b) in enumerate(right):
            path = model.pieces(text[last:b])
            if path and path[-1][:2] == (a - last, b - last):
                out[:, j] = head + sum(s for _, _, s in path)  # what lies between is the same for all
        return out
    for i, (a, b) in enumerate(left):
        for j, (c, d) in enumerate(right):
            if (a, b) == (c, d):
                out[i, j] = 0.0
                continue
            path = model.pieces(text[a:d]) if c >= b else []
            if len(path) > 1 and path[0][:2] == (0, b - a) and path[-1][:2] == (c - a, d - a):
                out[i, j] = sum(s for _, _, s in path[1:])
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), NONE)


def crossings(matrices: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> list[int]:
    """The state at every inner cut on the best path from weights ``left`` to weights ``right``."""
    ahead = [left]
    for m in matrices[:-1]:
        ahead.append((ahead[-1][:, None] + m).max(axis=0))
    behind = [right]
    for m in reversed(matrices[1:]):
        behind.append((m + behind[-1][None, :]).max(axis=1))
    behind.reverse()
    return [int(np.argmax(a + b)) for a, b in zip(ahead[1:], behind[:-1])]


def in_runs(df: DataFrame, many: int, keys: list[str], order: str, work, schema: str) -> DataFrame:
    """``work`` on the rows (as dicts, in order) of each key; a key's rows are one run of a sorted partition."""
    arrow = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches):
        held: list[dict] = []
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    out += work(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if held:
            yield pa.RecordBatch.from_pylist(work(held), schema=arrow)

    return df.repartition(many, *keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def _packed(m: np.ndarray) -> bytes:
    return np.array(m.shape, "<i4").tobytes() + np.ascontiguousarray(m, "<f8").tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<f8", offset=8).reshape(np.frombuffer(b, "<i4", 2))


def encoded(docs: DataFrame, model_path: str, text: str = "text", name: str = "ids", chunk: int = CHUNK, check: str | None = None) -> DataFrame:
    """``docs`` with an array ``name`` of piece ids, the same as the library gives for the whole text.

    With ``check`` also a boolean of that name: whether the ids decode to the text again.
    Null and empty texts have no ids. A giant text leaves its row in chunks (see the module
    text) and its ids come back by a row number, so ids or texts may repeat.
    """
    row = free_name(docs, "_n")
    small_batches(docs)
    long_ = F.coalesce(F.length(column(text)), F.lit(0)) > chunk
    where = docs.columns.index(text)

    def direct(batches):
        model = pieces(model_path)
        for batch in batches:
            for a, b in slices(lengths(batch.column(where))):
                part = batch.slice(a, b - a)
                some = [t or "" for t in part.column(where).to_pylist()]
                made = model.whole(some)
                new = [_lists(made)]
                if check:
                    new.append(pa.array([x == y for x, y in zip(some, model.model.decode(made, num_threads=1))]))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, name, *([check] if check else [])])

    fields = [T.StructField(name, T.ArrayType(T.IntegerType())), *([T.StructField(check, T.BooleanType())] if check else [])]
    schema = T.StructType([*docs.schema.fields, *fields])
    if docs.where(long_).isEmpty():
        return docs.mapInArrow(direct, schema)
    near = docs.where(~long_).mapInArrow(direct, schema)
    far = write_table(docs.where(long_).withColumn(row, F.monotonically_increasing_id()), "giant-texts")
    ids = giant_ids(far.select(column(row).alias("n"), column(text).alias("t")), model_path, chunk)
    back = far.join(ids.withColumnRenamed("n", row).withColumnRenamed("ids", name), row)
    if check:
        held = free_name(back, "_decoded")
        back = decoded(back, model_path, name, held).withColumn(check, column(held) == column(text))
    back = back.select(*[column(f.name) for f in schema.fields])
    return near.unionByName(back)


def giant_ids(texts: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(n, ids) for texts (n, t) that are longer than a chunk.

    The library puts a space in front of a text; here it is the text's first character. Each
    chunk row carries the characters around its ends that states can reach.
    """
    reach = pieces(model_path).longest

    def cut(batches):
        for batch in batches:
            for n, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = " " + t.as_py()
                size = len(t)
                starts = range(0, size, chunk)
                for i in range(0, len(starts), CUT_CHUNKS):
                    made = [
                        (k, max(0, a - reach), a, min(size, a + chunk), t[max(0, a - reach) : min(size, a + chunk) + reach])
                        for k, a in enumerate(starts[i : i + CUT_CHUNKS], i)
                    ]
                    longs = [pa.array([m[j] for m in made], pa.int64()) for j in range(4)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([n] * len(made), pa.int64()), *longs, pa.array([size] * len(made), pa.int64()), pa.array([m[4] for m in made], pa.string()),
                    ], names=["n", "k", "at", "a", "b", "size", "t"])

    spread = texts.select(F.col("n").cast("long").alias("n"), "t").mapInArrow(cut, "n long, k long, at long, a long, b long, size long, t string")
    spread = write_table(spread.repartition("n", "k"), "piece-chunks")

    def ends(model, r):
        text, at = r.t, r.at
        left = model.states(text, r.a - at) if r.a else [(0, 0)]
        right = model.states(text, r.b - at) if r.b < r.size else [(r.b - at, r.b - at)]
        return text, left, right

    def matrices(frames):
        model = pieces(model_path)
        for frame in frames:
            made = []
            for r in frame.itertuples():
                text, left, right = ends(model, r)
                made.append(_packed(_edge_matrix(model, text, left, right, r.a == 0, r.b == r.size)))
            yield frame[["n", "k"]].assign(m=made)

    steps = write_table(spread.mapInPandas(matrices, "n long, k long, m binary"), "piece-matrices")

    # up: the product of each block of chunks; down: the states at its ends, then at every cut inside
    def up(rows):
        out = _unpacked(rows[0]["m"])
        for r in rows[1:]:
            out = product(out, _unpacked(r["m"]))
        return [{"n": rows[0]["n"], "block": rows[0]["block"], "m": _packed(out)}]

    def down(rows):
        ms = [_unpacked(r["m"]) for r in rows]
        first, last = rows[0]["i"], rows[-1]["j"]
        left = np.where(np.arange(ms[0].shape[0]) == first, 0.0, NONE) if first >= 0 else np.zeros(ms[0].shape[0])
        right = np.where(np.arange(ms[-1].shape[1]) == last, 0.0, NONE) if last >= 0 else np.zeros(ms[-1].shape[1])
        inner = crossings(ms, left, right)
        at = "k" if "k" in rows[0] else "block"
        return [{"n": r["n"], at: r[at], "i": i, "j": j} for r, i, j in zip(rows, [max(first, 0), *inner], [*inner, max(last, 0)])]

    many = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    block = F.floor(F.col("k") / BLOCK).cast("long").alias("block")
    steps = steps.select("n", "k", "m", block)
    blocks = write_table(in_runs(steps, many, ["n", "block"], "k", up, "n long, block long, m binary"), "piece-blocks")
    open_ = blocks.select("n", "block", "m", F.lit(-1).cast("long").alias("i"), F.lit(-1).cast("long").alias("j"))
    tops = in_runs(open_, many, ["n"], "block", down, "n long, block long, i long, j long")
    inner = steps.join(tops, ["n", "block"])
    met = in_runs(inner, many, ["n", "block"], "k", down, "n long, k long, i long, j long")

    def backtrace(frames):
        model = pieces(model_path)
        for frame in frames:
            made = []
            for r in frame.itertuples():
                text, left, right = ends(model, r)
                ids = model.stretch(text[left[r.i][1] : right[r.j][1]])
                made.append(np.array(ids, np.int32))
            yield frame[["n", "k"]].assign(ids=made)

    found = join_sized(spread, write_table(met, "piece-states"), ["n", "k"]).mapInPandas(backtrace, "n long, k long, ids array<int>")
    ordered = found.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    return ordered.select("n", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))


def _edge_matrix(model, text, left, right, first: bool, last: bool) -> np.ndarray:
    """As ``matrix``; the ends of the text are one state that any piece may follow or precede."""
    if not first and not last:
        return matrix(model, text, left, right)
    out = np.full((len(left), len(right)), NONE)
    for i, (a, b) in enumerate(left):
        for j, (c, d) in enumerate(right):
            free = model.free_cuts(text[b:c]) if b < c else None
            if first:
                start = b + free[1] if free else b
                path = model.pieces(text[start:d])
                fits = path and path[-1][:2] == (c - start, d - start)
                rest = sum(s for _, _, s in path)
            else:
                stop = b + free[0] if free else d
                path = model.pieces(text[a:stop])
                fits = path and path[0][:2] == (0, b - a)
                rest = sum(s for _, _, s in path[1:])
            if fits:
                out[i, j] = rest
    return out


def _lists(made: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0] + [len(m) for m in made], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(made), np.int32, ends[-1])))


def decoded(docs: DataFrame, model_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``docs`` with the text of an id array; null for a null array."""
    where = docs.columns.index(ids)

    def run(batches):
        model = pieces(model_path).model
        for batch in batches:
            sizes = pc.fill_null(pc.list_value_length(batch.column(where)), 0).to_pylist()
            for a, b in slices(4 * n for n in sizes):
                part = batch.slice(a, b - a)
                lists = part.column(where).to_pylist()
                texts = model.decode([x or [] for x in lists], num_threads=1)
                made = [None if x is None else y for x, y in zip(lists, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made, pa.string())], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())]))


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, ids, and whether the ids decode to the text again (null texts: to an empty one)."""
    made = encoded(docs.select("doc_id", "text"), model_path, check="round_trip")
    return made.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
