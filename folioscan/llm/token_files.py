"""Token ids in binary files of patched frame-of-reference blocks.

Documents are dealt into ranges of ids and sorted; each task encodes the texts of its range and
writes shards of at most ``SHARD_TOKENS`` ids (a longer document has a shard of its own size).
A shard is

    magic, counts | blocks | block starts | documents (id, first token) | footer with the places

A block holds ``BLOCK`` ids as differences to its smallest one, packed at a width that
``SHARE`` of them fit in; the others keep their low bits in place and their position and
high bits in the block's list of exceptions. Block starts are byte offsets, so any token
range is read with one look-up. Shards are written under a name of the attempt and then
renamed, so a task that runs again replaces its files by equal ones.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import fresh_path
from .common import column, lengths, slices, small_batches

BLOCK = 512
SHARE = 0.9
SHARD_TOKENS = 1 << 20
SLICE = 8 << 20  # bytes of text whose new words are encoded together
END_ID = 1
END = np.array([END_ID], "<u4").tobytes()
MAGIC = b"PFB1"
_FOOT = "<qqqqq"  # tokens, blocks, documents, offset of block starts, offset of documents
_HEAD = "<IBBH"  # minimum, width, bytes of an exception's high bits, exceptions
_NO_ID = -(1 << 63)  # a null doc_id


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of values, each packed at ``width`` bits, low bit first; eight values make ``width`` bytes."""
    rows, count = values.shape
    kind = np.uint32 if width <= 25 else np.uint64  # holds a value behind a shift of up to 7 bits
    full = np.zeros((rows, -(-count // 8) * 8), kind)
    full[:, :count] = values & kind((1 << width) - 1)
    eights = full.reshape(rows, -1, 8)
    out = np.zeros((rows, eights.shape[1], width), np.uint8)
    for i in range(8):
        byte, shift = divmod(i * width, 8)
        moved = eights[:, :, i] << kind(shift)
        for j in range((shift + width + 7) // 8):
            out[:, :, byte + j] |= (moved >> kind(8 * j)).astype(np.uint8)
    return out.reshape(rows, -1)[:, : (count * width + 7) // 8]


def _unpack(data: np.ndarray, count: int, width: int) -> np.ndarray:
    rows = len(data)
    whole = np.zeros((rows, -(-count // 8) * width), np.uint8)
    whole[:, : data.shape[1]] = data
    eights = whole.reshape(rows, -1, width)
    kind = np.uint32 if width <= 25 else np.uint64
    out = np.empty((rows, eights.shape[1], 8), np.uint32)
    for i in range(8):
        byte, shift = divmod(i * width, 8)
        value = np.zeros(eights.shape[:2], kind)
        for j in range((shift + width + 7) // 8):
            value |= eights[:, :, byte + j].astype(kind) << kind(8 * j)
        out[:, :, i] = (value >> kind(shift)) & kind((1 << width) - 1)
    return out.reshape(rows, -1)[:, :count]


def _widths(values: np.ndarray) -> np.ndarray:
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack_blocks(ids: np.ndarray, share: float = SHARE, block: int = BLOCK) -> list[bytes]:
    """The blocks of ``ids`` (unsigned 32-bit); the last may be shorter."""
    whole = len(ids) // block * block
    out = _pack_rows(ids[:whole].reshape(-1, block), share) if whole else []
    return out + (_pack_rows(ids[whole:].reshape(1, -1), share) if whole < len(ids) else [])


def _pack_rows(rows: np.ndarray, share: float) -> list[bytes]:
    low = rows.min(axis=1)
    rest = (rows - low[:, None]).astype(np.uint32)
    count = rows.shape[1]
    width = _widths(np.partition(rest, int(share * (count - 1)), axis=1)[:, int(share * (count - 1))])
    high = rest >> np.minimum(width, 31).astype(np.uint32)[:, None]
    high[width >= 32] = 0
    high_bytes = np.array([1, 1, 2, 4, 4])[(_widths(high.max(axis=1)) + 7) // 8]
    packed: list[bytes] = [b""] * len(rows)
    for w in np.unique(width):
        some = np.flatnonzero(width == w)
        data = _pack(rest[some], int(w)) if w else np.zeros((len(some), 0), np.uint8)
        for i, row in zip(some, data):
            packed[i] = row.tobytes()
    out = []
    odd_row, odd_at = np.nonzero(high)
    bounds = np.searchsorted(odd_row, np.arange(len(rows) + 1)).tolist()
    for i in range(len(rows)):
        at = odd_at[bounds[i] : bounds[i + 1]]
        extra = b""
        if len(at):
            extra = at.astype("<u2").tobytes() + high[i, at].astype(f"<u{high_bytes[i]}").tobytes()
        out.append(struct.pack(_HEAD, int(low[i]), int(width[i]), int(high_bytes[i]), len(at)) + packed[i] + extra)
    return out


def unpack_blocks(data: bytes, starts: np.ndarray, tokens: int, block: int = BLOCK) -> np.ndarray:
    """The ids of consecutive blocks that begin at ``starts`` within ``data`` and hold ``tokens`` ids."""
    out = np.empty(tokens, np.uint32)
    heads = [struct.unpack_from(_HEAD, data, s) for s in starts]
    buffer = np.frombuffer(data, np.uint8)
    full = tokens // block
    width = np.array([h[1] for h in heads])
    for w in np.unique(width):
        some = np.flatnonzero((width == w) & (np.arange(len(starts)) < full))
        size = (block * int(w) + 7) // 8
        if len(some) and w:
            begin = np.asarray(starts)[some] + struct.calcsize(_HEAD)
            rows = np.stack([buffer[a : a + size] for a in begin.tolist()])
            out[: full * block].reshape(-1, block)[some] = _unpack(rows, block, int(w))
        elif len(some):
            out[: full * block].reshape(-1, block)[some] = 0
    for i, (s, (low, w, hw, many)) in enumerate(zip(starts, heads)):
        a, b = i * block, min(tokens, (i + 1) * block)
        size = ((b - a) * w + 7) // 8
        s = int(s) + struct.calcsize(_HEAD)
        if i >= full:
            out[a:b] = _unpack(buffer[s : s + size][None, :], b - a, w)[0] if w else 0
        if many:
            at = np.frombuffer(data, "<u2", many, s + size).astype(np.int64)
            high = np.frombuffer(data, f"<u{hw}", many, s + size + 2 * many).astype(np.uint32)
            out[a + at] |= high << np.uint32(w)
        out[a:b] += np.uint32(low)
    return out


def shard_bytes(documents: list[tuple[int, np.ndarray]]) -> bytes:
    """One shard of (doc_id, ids)."""
    ids = np.concatenate([x for _, x in documents]) if documents else np.zeros(0, np.uint32)
    blocks = pack_blocks(ids.astype(np.uint32))
    starts = np.cumsum([len(MAGIC)] + [len(b) for b in blocks])[:-1] if blocks else np.zeros(0)
    first = np.cumsum([0] + [len(x) for _, x in documents])[:-1]
    body = MAGIC + b"".join(blocks)
    index = np.asarray(starts, "<i8").tobytes()
    table = np.array([(i, f) for (i, _), f in zip(documents, first)], "<i8").reshape(-1, 2).tobytes()
    return body + index + table + struct.pack(_FOOT, len(ids), len(blocks), len(documents), len(body), len(body) + len(index)) + MAGIC


class Shard:
    """A shard opened for reading; only the parts asked for are read."""

    def __init__(self, file, size: int):
        self.file = file
        tail = struct.calcsize(_FOOT) + len(MAGIC)
        foot = self._at(size - tail, tail)
        if foot[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.tokens, blocks, documents, at_blocks, at_documents = struct.unpack_from(_FOOT, foot)
        self.starts = np.frombuffer(self._at(at_blocks, 8 * blocks), "<i8")
        self.ends = np.append(self.starts[1:], at_blocks)
        rows = np.frombuffer(self._at(at_documents, 16 * documents), "<i8").reshape(-1, 2)
        self.doc_ids, self.first = rows[:, 0], np.append(rows[:, 1], self.tokens)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def read(self, a: int, b: int) -> np.ndarray:
        """Tokens a to b of the shard."""
        if a >= b:
            return np.zeros(0, np.uint32)
        lo, hi = a // BLOCK, (b - 1) // BLOCK + 1
        data = self._at(int(self.starts[lo]), int(self.ends[hi - 1] - self.starts[lo]))
        ids = unpack_blocks(data, self.starts[lo:hi] - self.starts[lo], min(self.tokens, hi * BLOCK) - lo * BLOCK)
        return ids[a - lo * BLOCK : b - lo * BLOCK]


#: letters whose case and composition need no context, beside a-z: Latin-1 and Latin Extended-A
PLAIN = "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįĵķĺļľłńņňōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżž"
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that byte-level models write as themselves
_SHOWN_AS = np.arange(256, dtype="<u4")
_SHOWN_AS[[b for b in range(256) if b not in _SHOWN]] = 256 + np.arange(256 - len(_SHOWN))
_SHOWN_AS[32] = 32  # stays the gap between cuts

_OTHER, _DIGIT, _LETTER, _ODD = 1, 2, 3, 4
_KIND = np.array([
    _LETTER if 97 <= c <= 122 or c >= 128 else _DIGIT if 48 <= c <= 57 else _OTHER if 33 <= c < 127 and c != 39 and not 65 <= c <= 90 else _ODD
    for c in range(256)
], np.uint8)
_PAIR = np.zeros(1 << 16, bool)  # the two bytes of each letter of PLAIN
_PAIR[[int.from_bytes(c.encode(), "big") for c in PLAIN]] = True


class Encoder:
    """Ids of whole texts by the tokenizers library.

    The model's rules never join characters over ASCII white space and ignore case, so a text is
    encoded by its lower-case words between white space. The ids of words are kept; words that
    were not met before are handed to the library many at a time. Of these, the ones made of
    plain letters, digits and signs are cut where the model's rules cut them (a run of
    letters, one digit, a run of signs) and need only its merges; each cut ends with a piece that
    is marked as the end of a word. Any other word goes through all of the model's rules.
    """

    KEPT, LONG, GROUP = 1_000_000, 64, 4096

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        # added tokens are cut out of the text as it stands; what is left of it is ordinary text, also what only lower-casing turns into one
        self.added = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in self.model.get_added_tokens_decoder().items()}
        self.cut_added = re.compile(b"(%s)" % b"|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        self.model.encode_special_tokens = True
        self.kept: dict[bytes, bytes] = {b"": b""}  # ids as 32-bit numbers
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.model.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        probe = [w.encode() for w in "a word größe, œuvre. niñas!! thththing (ŵ7) 2024-11-03 x=y&&&z".split()]
        ways: list[dict[bytes, bytes]] = [{}, {}]
        self._by_rules(probe, ways[0])
        self.cuts = True
        self._by_cuts(probe, ways[1])
        self.cuts = ways[0] == ways[1]  # else the model has other rules, and every word goes through them

    def _by_rules(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        for at in range(0, len(words), self.GROUP):
            some = words[at : at + self.GROUP]
            made = self.model.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            into.update((w, np.array(m.ids, "<u4").tobytes()) for w, m in zip(some, made))

    def _by_cuts(self, words: list[bytes], into: dict[bytes, bytes]) -> None:
        for at in range(0, len(words), self.GROUP):
            some = words[at : at + self.GROUP]
            text = np.frombuffer(b" ".join(some) + b" ", np.uint8)
            gap = np.flatnonzero(text == 32)
            kind = _KIND[text]
            kind[gap] = 0
            high = text >= 128
            lead = high & (text >= 0xC0)
            pair = np.zeros(len(text), np.int64)
            pair[:-1] = text[:-1].astype(np.int64) << 8 | text[1:]
            fits = lead & _PAIR[pair]
            fits[1:] |= fits[:-1]
            odd = (kind == _ODD) | (high & ~fits)
            begin = np.concatenate([[0], gap[:-1] + 1])
            bad = np.logical_or.reduceat(odd, begin)
            if bad.any():
                self._by_rules([some[i] for i in np.flatnonzero(bad)], into)
                some = [some[i] for i in np.flatnonzero(~bad)]
                if not some:
                    continue
                stays = np.repeat(~bad, np.diff(np.append(begin, len(text))))
                text, kind = text[stays], kind[stays]
                gap = np.flatnonzero(text == 32)
                begin = np.concatenate([[0], gap[:-1] + 1])
            cut = np.zeros(len(text), bool)
            cut[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
            pieces = np.add.reduceat(cut.astype(np.int64), begin) + 1
            line = _SHOWN_AS[np.insert(text, np.flatnonzero(cut), 32)].tobytes().decode("utf-32-le")
            # the library takes short texts faster: lines of 512 words, cut at gaps between words
            edges = [0, *(gap + np.cumsum(cut)[gap])[511::512].tolist(), len(line)]
            lines = [line[a:b] for a, b in zip(edges, edges[1:])]
            made = self.merges.encode_batch_fast(lines, add_special_tokens=False)
            ids = np.concatenate([np.array(m.ids, "<u4") for m in made])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != pieces.sum():
                self._by_rules(some, into)
                continue
            stop = (4 * ends[np.cumsum(pieces) - 1]).tolist()
            data = ids.tobytes()
            into.update(zip(some, [data[a:b] for a, b in zip([0, *stop], stop)]))

    @staticmethod
    def _lower(data: bytes | None) -> bytes:
        if not data:
            return b""
        return data.lower() if data.isascii() else data.decode().replace("Σ", "σ").lower().encode()

    def __call__(self, documents: list[bytes | None]) -> list[np.ndarray]:
        """Ids of whole texts, each with the end id."""
        cut = {i: self.cut_added.split(d) for i, d in enumerate(documents) if d and any(t in d for t in self.added)}
        if not cut:
            return self._plain(documents, END)
        parts = [p for i, d in enumerate(documents) for p in (cut[i][::2] if i in cut else [d])]
        made, out = iter(self._plain(parts, b"")), []
        for i in range(len(documents)):
            ids = next(made).tobytes()
            for token in cut.get(i, [])[1::2]:
                ids += self.added[token] + next(made).tobytes()
            out.append(np.frombuffer(ids + END, "<u4"))
        return out

    def _plain(self, documents: list[bytes | None], end: bytes) -> list[np.ndarray]:
        """Ids of texts without added tokens, each followed by ``end``."""
        texts = pa.array([self._lower(d) for d in documents], pa.large_binary()).cast(pa.large_string())
        split = pc.ascii_split_whitespace(texts)  # gaps at the ends give empty words, which have no ids
        coded = split.values.dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        made = np.empty(len(words), object)
        made[:] = self._ids_of(words)
        row = made[coded.indices.to_numpy()].tolist()
        bounds = split.offsets.to_pylist()
        return [np.frombuffer(b"".join(row[a:b]) + end, "<u4") for a, b in zip(bounds, bounds[1:])]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words, as bytes."""
        made = list(map(self.kept.get, words))
        if None not in made:
            return made
        new = list(compress(words, map(is_, made, repeat(None))))
        found: dict[bytes, bytes] = {}
        long_ = [w for w in new if len(w) > self.LONG]
        short = list(set(new).difference(long_)) if long_ else new
        (self._by_cuts if self.cuts else self._by_rules)(short, found)
        if len(self.kept) + len(short) > self.KEPT:
            self.kept = {b"": b""}
        self.kept.update(found)
        self._by_rules(long_, found)
        filled = map(found.__getitem__, new)
        return [next(filled) if m is None else m for m in made]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each process, so its words are kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def write_shards(docs: DataFrame, path: str, model_path: str, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Encode, append the end id, and write shards below ``path``, in ascending doc_id order.

    Gives (part, shard, file, n_tokens, n_docs), one row per shard: ordered by part and shard they hold
    the documents in order. Null ids come first; equal ids are ordered by their texts' hash. A null or empty text
    has only the end id. Run by an action of the caller.
    """
    rows = docs.select(column(doc_id).cast("long").alias("i"), column(text).alias("t"))
    keyed = rows.withColumn("h", F.xxhash64("t"))
    number = ranges or max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    small_batches(docs)
    dealt = keyed.repartitionByRange(number, "i", "h").sortWithinPartitions("i", "h")

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encode = encoder(model_path)
        fs, root = pafs.FileSystem.from_uri(path)
        held, size, shard = [], 0, 0
        for batch in batches:
            owners, data = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for a, b in slices(lengths(data), SLICE):
                for i, ids in zip(owners[a:b], encode(data.slice(a, b - a).to_pylist())):
                    if held and size + len(ids) > SHARD_TOKENS:
                        yield _written(fs, root, part, shard, held, size)
                        held, size, shard = [], 0, shard + 1
                    held.append((_NO_ID if i is None else i, ids))
                    size += len(ids)
        if held:
            yield _written(fs, root, part, shard, held, size)

    return dealt.select("i", "t").mapInArrow(run, "part long, shard long, file string, n_tokens long, n_docs long")


def _written(fs, root: str, part: int, shard: int, held: list, size: int) -> pa.RecordBatch:
    name = f"part-{part:06d}-{shard:06d}.pfb"
    draft = f"{root}/_draft-{uuid.uuid4().hex}"
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(draft) as out:
        out.write(shard_bytes(held))
    fs.move(draft, f"{root}/{name}")
    return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "file": [name], "n_tokens": [size], "n_docs": [len(held)]})


def read_shards(shards: DataFrame, path: str, piece: int = 1 << 18) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document from the files of ``shards`` (file, base)."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = f"{root}/{name}"
                with fs.open_input_file(file) as opened:
                    shard = Shard(opened, fs.get_file_info(file).size)
                    ends = shard.first.tolist()
                    sums = [0] * len(shard.doc_ids)
                    d = 0
                    for a in range(0, shard.tokens, piece):
                        ids = shard.read(a, min(shard.tokens, a + piece)).astype("<u4")
                        at = a
                        while at < a + len(ids):
                            stop = min(ends[d + 1], a + len(ids))
                            sums[d] = zlib.crc32(ids[at - a : stop - a].tobytes(), sums[d])
                            at = stop
                            d += at == ends[d + 1]
                starts = shard.first[:-1]
                owners = [None if i == _NO_ID else i for i in shard.doc_ids.tolist()]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(owners, pa.int64()), "start": pa.array(starts + base), "n_tokens": pa.array(np.diff(shard.first)),
                    "ids_crc32": pa.array(sums, pa.int64()),
                })

    few = shards.select("file", "base")
    return few.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """Write the files of ``docs`` to a fresh shared folder and give what is read back from them."""
    spark = docs.sparkSession
    path = fresh_path(spark, "token-files")
    target = path if "://" in path or path.startswith("file:") else "file://" + path
    log = fresh_path(spark, "token-shards")
    write_shards(docs.select("doc_id", "text"), target, model_path).write.parquet(log)
    shards = spark.read.parquet(log)
    # two levels, so that no task orders all shards: parts, then the shards of a part
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    based = shards.withColumn("inside", inside).join(before, "part").select("file", (F.col("before") + F.col("inside")).alias("base"))
    readers = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number of its own: few rows, but much to read
    return read_shards(based.repartition(readers, "file"), target)
