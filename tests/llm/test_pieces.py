import random

import public_tokenizers
import pytest
from helpers import SF, documents, empty

from folioscan.llm import pieces as S, queries

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return S.pieces(PATH)


@pytest.fixture
def odd(spark):
    rng = random.Random(1)
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/=") for _ in range(900))
    texts = [
        blob, "a" * 700, " " * 500, "the" * 200, "\n" * 300 + " x " * 100, "日本語テキスト" * 80, "é" * 400, " leading" * 40, "", None,
        "thethethe      and   \t  and" * 30, blob[:100] + " " * 99 + blob[:200], "the cat sat on the mat. " * 60, "\U0001f600" * 200,
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


@pytest.mark.parametrize(("chunk", "block"), [(64, 3), (100, 64), (257, 2)])
def test_chunks_give_the_ids_of_the_whole(odd, model, monkeypatch, chunk, block):
    monkeypatch.setattr(S, "BLOCK", block)
    rows = S.encoded(odd, PATH, chunk=chunk, check="same").collect()
    assert len(rows) == 14
    for r in rows:
        assert list(r.ids) == model.model.encode(r.text or "") and r.same


def test_products_are_associative():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random((4, 4)) < 0.4, S.NONE, rng.integers(0, 9, (4, 4))) for _ in range(3))
    assert np.array_equal(S.product(S.product(a, b), c), S.product(a, S.product(b, c)))


def test_query_equals_the_library(spark, model):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op8_piece_scan(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert list(r.ids) == model.model.encode(texts[r.doc_id] or "") and r.round_trip and r.n_pieces == len(r.ids)


def test_a_text_of_20_mb_is_cut_and_encoded(spark, model):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)) + " é日\n"
    text *= 20_000_000 // len(text)
    row = S.encoded(spark.createDataFrame([(1, text)], "doc_id long, text string"), PATH).first()
    assert list(row.ids) == model.model.encode(text)


def test_awkward_rows(spark, model):
    df = documents(spark)
    rows = S.decoded(S.encoded(df, PATH), PATH).collect()
    assert len(rows) == 15 and rows[0].kept == "x"
    for r in rows:
        assert list(r.ids) == model.model.encode(r.text or "") and r.decoded == (r.text or "")
    assert S.digest(empty(spark), PATH).collect() == []
    none = spark.createDataFrame([(None,)], "ids array<int>")
    assert S.decoded(none, PATH).first().decoded is None
