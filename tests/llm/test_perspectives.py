import random

from pyspark.sql import functions as F

from folioscan.llm.perspectives import rotated


def test_each_speaker_is_the_assistant_once(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "héllo"), (1, 70, "ann", "late"), (2, 0, None, None), (None, None, "x", "y"), (None, None, "x", "y")]
    got = rotated(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((str(r.conv_id), r.speaker, r.part) for r in got) == [
        ("1", "ann", 0), ("1", "ann", 1), ("1", "bob", 0), ("1", "bob", 1), ("2", "unknown", 0), ("None", "x", -1),
    ]
    for r in got:
        said = [r.rendered[m.start : m.end] for m in r.masks]
        own = [t or "" for c, n, s, t in rows if c == r.conv_id and (s or "unknown") == r.speaker and (-1 if n is None else n // 64) == r.part]
        assert said == [t + "<|im_end|>" for t in own]
    first = next(r for r in got if r.speaker == "bob" and r.part == 0)
    assert first.rendered == "<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nhéllo<|im_end|>\n"


def test_empty(spark):
    assert rotated(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def plain(rows):
    """(conv, speaker, part, rendered, ranges) by walking every conversation once per speaker."""
    out = []
    turns = [(c, -1 if n is None else n // 64, n, "unknown" if r is None else r, t or "") for c, n, r, t in rows]
    for conv, speaker in {(c, r) for c, _, _, r, _ in turns}:
        for part in {p for c, p, *_ in turns if c == conv}:
            text, ranges = "", []
            for _, _, n, r, t in sorted((x for x in turns if x[:2] == (conv, part)), key=lambda x: (x[2] is not None, x[2] or 0, x[3], x[4])):
                text += "<|im_start|>" + ("assistant\n" if r == speaker else f"user name={r}\n")
                if r == speaker:
                    ranges.append((len(text), len(text) + len(t) + 10))
                text += t + "<|im_end|>\n"
            out.append((conv, speaker, part, text, ranges))
    return sorted(out, key=repr)


def test_awkward_rows(spark):
    rng = random.Random(1)
    texts = ["", None, "a", "two\nlines", "日本 \U0001f600", "<|im_end|>", "x" * 70_000]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1, 63, 64, 200]), rng.choice(["ann", "bob", "", None, "unknown"]), rng.choice(texts)) for _ in range(90)]
    rows += rows[:10] + [(7, i, "ann" if i % 3 else "bob", f"turn {i}") for i in range(700)]  # repeated rows, and a long chat
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("speaker", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("masks", F.lit("x")).repartition(5)
    got = [(r.conv_id, r.speaker, r.part, r.rendered, [(m.start, m.end) for m in r.masks]) for r in rotated(df).collect()]
    assert sorted(got, key=repr) == plain(rows)
