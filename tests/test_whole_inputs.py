"""Nothing is left out: all records of a message, all buckets of a store, all passages of a document, whole texts."""

import pytest
from pyspark.sql import functions as F

from folioscan.functions.embedding import embedded
from folioscan.operators import condense
from folioscan.plans import retrieve, summarize
from folioscan.sources import sinks, tables


def test_every_record_of_a_message(spark):
    rec = '{"s3":{"bucket":{"name":"b"},"object":{"key":"uploads/u1/%d/f.pdf"}}}'
    bodies = ['{"Records":[%s,%s]}' % (rec % 1, rec % 2), '{"Records":[]}', "no json"]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    got = sorted((r.i, r.document_id) for r in tables.decoded_uploads(df).collect() if r.document_id)
    assert got == [(0, "1"), (0, "2")]
    assert tables.decoded_uploads(df).where("i > 0").count() == 2


@pytest.mark.parametrize("buckets", [1, 16, 64])
def test_every_user_of_a_store(spark, tmp_path, buckets):
    rows = spark.range(120).select(
        "id", F.col("id").alias("document_id"), (F.col("id") % 12).alias("user_id"), F.lit("text").alias("content")
    )
    path = str(tmp_path / "store")
    sinks.append_chunks(rows.where("id < 60"), path, buckets)
    sinks.append_chunks(rows.where("id >= 60"), path, buckets)
    for user in range(12):
        assert tables.read_chunks(spark, path, user).count() == 10
    with pytest.raises(ValueError, match="user buckets"):
        sinks.append_chunks(rows, path, buckets + 1)
    assert tables.read_chunks(spark, path).count() == 120


def test_five_thousand_passages(spark):
    chunks = spark.range(5000).select(
        "id", F.lit(1).cast("long").alias("document_id"), F.lit(1).alias("user_id"), F.col("id").alias("chunk_index"),
        F.concat(F.lit("passage "), F.col("id").cast("string")).alias("content"),
    ).repartition(7)
    text = condense.document_text(chunks).first()
    want = [f"passage {i}" for i in range(5000)]
    assert text.text == "\n\n".join(want) and text.n_chunks == 5000 and text.total_chars == sum(map(len, want))
    assert condense.document_text(chunks, 3).first().text == "\n\n".join(want[:3])
    numbers = [r.batch for r in condense.greedy_batches(chunks, max_chars=100).orderBy("nth").collect()]
    assert numbers == condense.next_batches([len(w) for w in want], 100)[0] and len(numbers) == 5000
    docs = spark.createDataFrame([(1, 1, "f.pdf", "ready")], "id long, user_id long, filename string, status string")
    inputs = summarize.document_inputs(docs, chunks, 1000, 1500).orderBy("batch").collect()
    assert "\n\n".join(r.input.split("\n\n", 1)[1] for r in inputs) == "\n\n".join(want)


def test_whole_texts_reach_the_embedder(spark):
    df = spark.createDataFrame([("a", 1, "x" * 20_000)], "id string, document_id long, content string")
    whole = embedded(df, lambda texts: [[float(len(t))] for t in texts]).first()
    cut = embedded(df, lambda texts: [[float(len(t))] for t in texts], max_chars=8000).first()
    assert whole.embedding == [20_000.0] and cut.embedding == [8000.0]


def test_look_ups_take_five_passages(spark):
    rows = [(1, "what is on page 4", 3), (2, "explain the theory of everything in this book please", 3), (3, "what does chapter 2 say about it", 9)]
    got = retrieve.labelled_questions(spark.createDataFrame(rows, "query_id long, query_text string, n_docs long"))
    assert [r.k for r in got.orderBy("query_id").collect()] == [5, 12, 5]


def test_evidence_moves_no_passage(spark):
    """Whole texts meet the few messages; passages are neither joined with vectors nor collected by message."""
    from folioscan.catalog import queries
    from folioscan.views import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    for df in (t.evidence, queries()["prj_evidence"](spark, "/root/testdata/sf0.001")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "embedding" not in plan and "ollect_list" not in plan and "hashpartitioning" not in plan
    got = {(r.message_id, r.chunk_id): r for r in t.evidence.collect()}
    rows = t.asked.join(t.bare_chunks, "document_id").collect()
    want = {(r.message_id, r.id): r for r in rows}
    assert len(got) == t.evidence.count() == len(rows) and got.keys() == want.keys()
    for key, r in got.items():
        c = want[key]
        assert (r.document_id, r.page_number, r.filename, r.section, r.content, r.position) == (c.document_id, c.page_number, c.filename, c.heading, c.content, c.chunk_index)
        assert abs(r.rrf_score - 1 / (61 + c.chunk_index)) < 1e-15
    assert "embedding" not in t.bare_chunks.columns


def test_long_texts_go_to_python_in_small_batches(spark):
    from folioscan.operators import chunking
    from folioscan.plans import ingest

    key, text = "spark.sql.execution.arrow.maxBytesPerBatch", "one two three. " * 400
    rows = spark.createDataFrame([(i, "prose", text) for i in range(3)], "document_id long, content_type string, text string")
    want = chunking.split_text(text)
    before = spark.conf.get(key)
    try:
        for make in (lambda: chunking.cut_sections(rows), lambda: ingest.page_passages(rows.withColumn("page_number", F.lit(1)), ["document_id"])):
            spark.conf.unset(key)
            out = make()
            assert spark.conf.get(key) == f"{4 << 20}b" and out.count() >= 3
        got = chunking.cut_sections(rows).where("document_id = 1").orderBy("piece_no").collect()
        assert [r.raw for r in got] == want
    finally:
        spark.conf.set(key, before)
