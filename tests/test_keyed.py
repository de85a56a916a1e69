"""Keyed tables: replays, ties, deletes and the buckets that a change rewrites."""

import os
import random

from pyspark.sql import functions as F

from folioscan.sources.keyed import KeyedTable, delete_cascade

SCHEMA = "id string, owner string, at long, seq long, note string"


def table(spark, path, **more):
    return KeyedTable(spark, str(path), ("id", "owner"), ("at", "seq"), buckets=4, **more)


def rows(df):
    return sorted((tuple(r) for r in df.select("id", "owner", "at", "seq", "note").collect()), key=repr)


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_any_order_of_batches_gives_the_newest_rows(spark, tmp_path):
    rng = random.Random(2)
    log = [(rng.choice(["a", "b", "é", None, "d9"]), rng.choice(["x", None]), rng.randint(0, 5), i, f"n{i}") for i in range(120)]
    newest = {}
    for r in log:
        newest[r[:2]] = max(newest.get(r[:2], r), r, key=lambda r: r[2:4])
    batches = [log[i::5] for i in range(5)]
    for turn, order in enumerate(([0, 1, 2, 3, 4], [4, 4, 2, 0, 1, 3, 2])):
        held = table(spark, tmp_path / str(turn))
        for i in order:
            held.upsert(spark.createDataFrame(batches[i], SCHEMA))
        assert rows(held.read()) == sorted(newest.values(), key=repr)
    held.upsert(spark.createDataFrame([], SCHEMA))
    assert rows(held.read()) == sorted(newest.values(), key=repr)


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    held = table(spark, tmp_path / "t")
    held.upsert(spark.createDataFrame([(f"k{i}", "x", 1, i, "old") for i in range(40)], SCHEMA))
    before = files(tmp_path / "t")
    held.upsert(spark.createDataFrame([("k7", "x", 2, 0, "new")], SCHEMA))
    after = files(tmp_path / "t")
    kept = before.keys() & after.keys()
    assert len({os.path.dirname(f) for f in before}) == 4
    assert len({os.path.dirname(f) for f in kept}) == 3 and all(before[f] == after[f] for f in kept)
    assert [r.note for r in held.read().where("id = 'k7'").collect()] == ["new"] and held.read().count() == 40


def test_delete_empties_buckets_and_rows_can_come_back(spark, tmp_path):
    held = table(spark, tmp_path / "t", by=("owner",))
    held.delete(spark.createDataFrame([("x",)], "owner string"))  # nothing is stored yet
    held.upsert(spark.createDataFrame([(f"k{i}", "xyz"[i % 3], 1, i, "old") for i in range(30)], SCHEMA))
    for _ in range(2):
        held.delete(spark.createDataFrame([("x",), ("none",)], "owner string"))
        assert held.read().select("owner").distinct().count() == 2 and held.read().count() == 20
    held.delete(held.read().select("owner").distinct())
    assert held.read().count() == 0
    held.upsert(spark.createDataFrame([("k1", "x", 0, 0, "again")], SCHEMA))
    assert rows(held.read()) == [("k1", "x", 0, 0, "again")]


def test_cascade_takes_what_hangs_on_a_document(spark, tmp_path):
    data = {
        "documents": ("id string", [("d1",), ("d2",)]),
        "chunks": ("id string, document_id string", [("p1", "d1"), ("p2", "d2")]),
        "conversations": ("id string, document_id string", [("c1", "d1"), ("c2", "d2"), ("c3", None)]),
        "conversation_documents": ("conversation_id string, document_id string", [("c1", "d2"), ("c2", "d1"), ("c3", "d2")]),
        "messages": ("id string, conversation_id string", [("m1", "c1"), ("m2", "c2"), ("m3", "c3")]),
        "summaries": ("id string, document_id string, conversation_id string", [("s1", "d1", None), ("s2", None, "c1"), ("s3", None, "c3")]),
        "flashcard_decks": ("id string, document_id string, conversation_id string", [("f1", "d1", None), ("f2", None, "c1"), ("f3", "d2", None)]),
        "flashcards": ("id string, deck_id string", [("k1", "f1"), ("k2", "f2"), ("k3", "f3")]),
    }
    held = {}
    for name, (schema, values) in data.items():
        keys = ("conversation_id", "document_id") if name == "conversation_documents" else ("id",)
        held[name] = KeyedTable(spark, str(tmp_path / name), keys, buckets=2)
        held[name].upsert(spark.createDataFrame(values, schema))
    for _ in range(2):
        delete_cascade(held, spark.createDataFrame([("d1",)], "id string"))
    left = {name: sorted(t.read().select(F.coalesce(*t.keys)).toPandas().iloc[:, 0]) for name, t in held.items()}
    assert left == {
        "documents": ["d2"], "chunks": ["p2"], "conversations": ["c2", "c3"], "conversation_documents": ["c3"], "messages": ["m2", "m3"],
        "summaries": ["s3"], "flashcard_decks": ["f3"], "flashcards": ["k3"],
    }


def test_a_first_batch_is_written_once_and_stored_rows_are_not_shuffled(spark, tmp_path):
    from folioscan.session import shared_dir

    before = set(os.listdir(shared_dir(spark)))
    held = table(spark, tmp_path / "t")
    held.upsert(spark.createDataFrame([(f"k{i}", "x", 1, i, "old") for i in range(40)], SCHEMA))
    assert set(os.listdir(shared_dir(spark))) == before
    seen = []
    put = KeyedTable._put
    try:
        KeyedTable._put = lambda self, rows, touched: (seen.append(rows), put(self, rows, touched))[1]
        held.upsert(spark.createDataFrame([("k7", "x", 2, 0, "new"), ("k8", "x", 0, 0, "late")], SCHEMA))
        held.delete(spark.createDataFrame([("k9",)], "id string"))
    finally:
        KeyedTable._put = put
    for df in seen:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" in plan and "hashpartitioning" not in plan
    assert not [n for n in set(os.listdir(shared_dir(spark))) - before if n.startswith("changed")]
    assert [r.note for r in held.read().where("id in ('k7', 'k8', 'k9')").orderBy("id").collect()] == ["new", "old"]
