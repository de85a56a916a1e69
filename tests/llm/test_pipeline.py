import duckdb
import corpus_pipeline
import public_tokenizers
from helpers import SF, documents, empty
from test_decontaminate import plain as contaminated
from test_repetition import plain as counted
from test_secrets import base
from test_simhash import fingerprint, groups

from __spark_entry__ import oracle_sql, queries
from folioscan.llm import pieces, repetition, secrets


def test_run_equals_plain_stages(spark):
    con = duckdb.connect()
    docs = con.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()
    items = con.sql(f"select * from '{SF}/benchmark.parquet'").fetchall()
    verdict = repetition.rules()([(t or "").encode() for _, t in docs])
    kept = [d for d, v in zip(docs, verdict) if v[-1]]
    assert all(not counted(t)[-1] for _, t in kept)
    roots = groups([fingerprint(t) for _, t in kept])
    kept = [d for i, d in enumerate(kept) if roots[i] == i]
    kept = [d for d in kept if not contaminated(d[1], items)[-1]]
    model = pieces.pieces(public_tokenizers.path("piece_bpe_32k.model")).model
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {i for i, _ in kept}
    for i, text in kept:
        out, at = [], 0
        for a, _, b in base(text):
            if a >= at:
                out += [text[at:a], secrets.MASK]
            at = max(at, b)
        assert got[i] == model.encode("".join(out) + text[at:])


def test_stages_keep_the_columns_of_documents(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.columns == docs.columns, name
        docs = made
    assert docs.where("text is null").isEmpty()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_empty_table(spark):
    docs = empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.collect() == []


def test_registered():
    names = [n for n in queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in queries() and "op2_perspectives" in oracle_sql()
