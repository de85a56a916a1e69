"""From pages over the store and its vectors to search results, with text ids all the way."""

import numpy as np
from pyspark.sql import functions as F

from folioscan.functions.embedding import embedded, hashed_vectors
from folioscan.operators import mmr
from folioscan.plans.ingest import ingest
from folioscan.plans.search import search_document, search_set, search_user, with_passages
from folioscan.sources import sinks, tables

TOPICS = ["rivers carry sand and water", "engines burn fuel and air", "poems hold rhyme and metre"]


def test_pages_to_answers(spark, tmp_path):
    rows = [
        (f"d{d}", f"u{d % 2}", f"{d}.pdf", p, f"{TOPICS[d % 3]} number {d} page {p} " + "more words follow here. " * 4, False)
        for d in range(6) for p in range(1, 4)
    ]
    pages = spark.createDataFrame(rows, "document_id string, user_id string, filename string, page_number long, text string, has_images boolean")
    path, calls, embed = str(tmp_path / "store"), spark.sparkContext.accumulator(0), hashed_vectors(32)

    def counted(texts):
        calls.add(len(texts))
        return embed(texts)

    sinks.append_chunks(ingest(pages), path, 8)
    assert tables.read_chunks(spark, path).where("embedding is not null").isEmpty()
    sinks.embed_stored(spark, path, counted)
    stored = tables.read_chunks(spark, path)
    assert stored.count() == calls.value == 18 and stored.where("embedding is null").isEmpty()
    sinks.embed_stored(spark, path, counted)  # nothing is left to do
    assert calls.value == 18 and tables.read_chunks(spark, path).count() == 18
    assert tables.read_chunks(spark, path, "u1").select("user_id").distinct().collect() == [("u1",)]

    asked = spark.createDataFrame([("q1", "u0", "rivers"), ("q2", "u1", "engines")], "id string, document_id string, content string")
    made = embedded(asked, embed).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    questions = asked.select(
        F.col("id").alias("query_id"), F.col("document_id").alias("user_id"), F.col("content").alias("query_text")
    ).join(made, "query_id")
    found = search_user(stored, questions, 5).collect()
    vectors = {r.id: (r.user_id, np.array(r.embedding), r.content) for r in stored.collect()}
    for q in questions.collect():
        mine = [r for r in found if r.query_id == q.query_id]
        assert len(mine) == 5 and {vectors[r.id][0] for r in mine} == {q.user_id}
        own = {i: 1 - float(v @ np.array(q.query_embedding)) / float(np.linalg.norm(v)) for i, (u, v, _) in vectors.items() if u == q.user_id}
        best = min(own, key=lambda i: (round(own[i], 9), i))
        assert best in {r.id for r in mine if r.v_rank == 1} or own[best] == min(own[r.id] for r in mine)
        words = [r for r in mine if r.k_rank]
        assert words and all(q.query_text in vectors[r.id][2] for r in words)
    one = search_document(stored, questions.withColumn("doc_id", F.when(F.col("query_id") == "q1", "d0").otherwise("d1")), 9).collect()
    assert {(r.query_id, r.document_id) for r in one} == {("q1", "d0"), ("q2", "d1")}
    some = search_set(stored, questions.withColumn("doc_ids", F.array(F.lit("d0"), F.lit("d1"))), 9)
    assert {(r.query_id, r.document_id) for r in some.collect()} == {("q1", "d0"), ("q2", "d1")}
    picked = mmr.rerank(with_passages(some, stored, ["embedding"]), questions.withColumn("k", F.lit(2).cast("long"))).collect()
    assert sorted((r.query_id, r.pick) for r in picked) == [("q1", 1), ("q1", 2), ("q2", 1), ("q2", 2)]


def test_end_to_end_stores_no_postings(spark):
    # a row per word and passage was written beside the store, which filled the disk
    import glob

    from conftest import SF_DIR

    from folioscan import catalog
    from folioscan.operators import keyword, postings
    from folioscan.session import fresh_path, shared_dir
    from folioscan.sources import tables as stored

    before = set(glob.glob(f"{shared_dir(spark)}/store-*"))
    found = catalog.queries()["pipe_end_to_end"](spark, SF_DIR)
    rows = sorted(map(tuple, found.select("query_id", "id", "k_rank").collect()), key=repr)
    (path,) = set(glob.glob(f"{shared_dir(spark)}/store-*")) - before
    assert rows and not glob.glob(f"{path}/_postings")
    asked = catalog.tables(spark, SF_DIR).queries
    path_of_postings = fresh_path(spark, "postings")
    postings.write_postings(stored.read_chunks(spark, path), path_of_postings)
    by_postings = keyword.ranked(postings.read_postings(spark, path_of_postings), asked)
    by_words = keyword.ranked(keyword.lexicon(stored.read_chunks(spark, path, vectors=False)), asked)
    columns = ["query_id", "id", "document_id", "score", "rank"]
    assert sorted(by_words.select(columns).collect()) == sorted(by_postings.select(columns).collect())
