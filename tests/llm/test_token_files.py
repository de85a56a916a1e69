import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import SF, documents, empty
from tokenizers import Tokenizer

from folioscan.llm import queries, token_files as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def model():
    return Tokenizer.from_file(PATH)


def expected(model, rows):
    out, at = [], 0
    for i, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [K.END_ID]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 3000])
@pytest.mark.parametrize("top", [1, 2, 300, 49408, 2**32 - 1])
def test_blocks_give_the_ids_back(n, top):
    rng = np.random.default_rng(n + 1)
    ids = rng.integers(0, top, n).astype(np.uint32)
    if n > 10:
        ids[rng.integers(0, n, 5)] = 2**32 - 1
    blocks = K.pack_blocks(ids)
    starts = np.cumsum([0] + [len(b) for b in blocks])[:-1]
    assert (K.unpack_blocks(b"".join(blocks), starts, n) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.zeros(512, np.uint32)
    ids[7] = 1 << 20
    assert len(K.pack_blocks(ids)[0]) < 20


def test_odd_texts_encode_like_the_library(model):
    texts = [
        "it's don't  I'LL", "ΑΣ ΣΑΣ İstanbul", "é é ́x", "a\x1cb\x85c d", "<|endoftext|> x", "日本語 text", "x²³ ½ 1२3",
        "hello <|endoftext|> world", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext|", "E\u0301<|endoftext|>\u0301x <|EndOfText|>", "<|<|endoftext|>|> 's<|startoftext|>'s", "<|endoftext|>",
        "ﬁ Straße ẞ", "z​z y", "É7É!!ü8", "w" * 300, "", "...,,!!",
    ]
    made = K.Encoder(PATH)([t.encode() for t in texts])
    assert [list(m[:-1]) for m in made] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_texts_with_added_tokens_encode_like_the_library(model):
    rng = random.Random(6)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "Word", "\u0301", "don't", "9", "é", "\n", "endoftext"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    made = K.Encoder(PATH)([t.encode() for t in texts])
    assert [list(m[:-1]) for m in made] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_query_equals_plain_encoding(spark, model):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in queries.op1_patched_tokens(spark, SF).collect())
    assert got == sorted(expected(model, rows))


def test_awkward_rows(spark, model):
    got = K.digest(documents(spark), PATH).collect()
    assert len(got) == 15 and sum(r.doc_id is None for r in got) == 2
    by_start = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in by_start[2:]] == [1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 11, 12]
    assert by_start[0].start == 0 and all(b.start == a.start + a.n_tokens for a, b in zip(by_start, by_start[1:]))
    assert [r.n_tokens for r in by_start if r.doc_id in (4, 5, 6)] == [1, 1, 1]


def test_empty_table(spark):
    assert K.digest(empty(spark), PATH).collect() == []
