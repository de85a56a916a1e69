"""Page text to passages against plain loops over the same pages."""

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscan.functions import lines
from folioscan.functions.text import rstrip
from folioscan.operators import chunking, structure
from folioscan.plans import ingest

SCHEMA = "document_id long, user_id long, filename string, page_number long, text string, has_images boolean"

def random_line(rng):
    words = ["alpha", "beta", "Gamma", "delta.", "Epsilon!", "zeta", "eta?", "theta", "école", "über", "part of", "the"]
    body = " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))
    return rng.choice([
        body, body, body.lower(), body + ".", "# " + body[:60], "1. " + body[:50], "- " + body, "-" + body, "    " + body,
        "\t" + body, "a|" + body + "|b", "x\ty\t" + body, "```", "```python", "", "   ", "RESULTS AND NOTES", "def run(x):",
        "if (x) {", "a) " + body, "• " + body, "section 4 " + body[:30], "\x0c" + body, body + "\r",
        "one two three", "one two three", "lower again", "Section " + body * 6,
    ])

@pytest.fixture(scope="module")
def documents():
    rng = random.Random(11)
    docs = {}
    for doc in range(40):
        n = rng.randint(1, 14) if doc else 140
        pages = []
        for page in range(1, n + 1):
            text = "\n".join(random_line(rng) for _ in range(rng.randint(1, 25)))
            if rng.random() < 0.3:
                text += "\n" + " ".join(rng.choice(["word", "Long.", "tail"]) for _ in range(400))
            if rng.random() < 0.15:
                text = "only " + " ".join(["lower"] * rng.randint(9, 20))
            pages.append((page, text))
        docs[doc] = pages
    return docs

@pytest.fixture(scope="module")
def pages(spark, documents):
    rows = [(d, d % 3, f"{d}.pdf", n, text, False) for d, ps in documents.items() for n, text in ps]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)

def test_line_types(spark):
    sample = [
        "1. item", "- item", "-item", "RESULTS", "part of it", "1. " + "x" * 117, "a|b|c", "\t\t", "    x", "def f", "",
        "A. b", "ABCDEF. b", "##### five", "#### four", "Part II", "PARTY", "  1) x", "for (;;)", "format (x)", "1.2.3 Title",
    ]
    df = spark.createDataFrame(list(enumerate(sample)), "i int, x string")
    got = [r[1] for r in df.select("i", lines.line_type(rstrip(F.col("x")))).orderBy("i").collect()]
    assert got == [
        "heading", "prose", "list", "heading", "heading", "list", "table", "prose", "code", "code", "prose",
        "heading", "prose", "prose", "heading", "heading", "heading", "list", "code", "prose", "heading",
    ]
    named = dict(zip(sample, got))
    assert named["1. item"] == "heading" and named["- item"] == "prose" and named["-item"] == "list"
    assert named["part of it"] == "heading" and named["RESULTS"] == "heading" and named["1. " + "x" * 117] == "list"

SECTIONED = {
    "Intro text\ngoes on.\n\n-one\n-two": [("prose", "Intro text\ngoes on."), ("list", "-one\n-two")],
    "# First\n# Second\nbody": [("heading", "# First\n# Second"), ("prose", "body")],
    "text\n```py\nx = 1\n\n# no heading\n```\nafter": [("prose", "text"), ("code", "x = 1\n\n# no heading"), ("prose", "after")],
    "```\nnever closed": [("code", "never closed")],
    "a|b|c\nd|e|f\n\nrest": [("table", "a|b|c\nd|e|f"), ("prose", "rest")],
    "RESULTS AND NOTES\n    x = 1\n\ttab": [("heading", "RESULTS AND NOTES"), ("code", "x = 1\n\ttab")],
}


def test_sections_of_hand_made_pages(spark):
    rows = [(i, i, "f", 1, text, False) for i, text in enumerate(SECTIONED)]
    made = structure.page_sections(spark.createDataFrame(rows, SCHEMA), ["document_id"]).orderBy("document_id", "section_no").collect()
    for i, want in enumerate(SECTIONED.values()):
        assert [(r.content_type, r.text) for r in made if r.document_id == i] == want


def test_sections_keep_every_word(pages, documents):
    got = defaultdict(list)
    for r in structure.page_sections(pages, ["document_id"]).orderBy("document_id", "page_number", "section_no").collect():
        got[(r.document_id, r.page_number)] += r.text.split()
    for d, ps in documents.items():
        for n, text in ps:
            lines = [line for line in text.splitlines() if not line.startswith("```")]
            assert got[(d, n)] == " ".join(lines).split(), (d, n)


LONG = "This opening line has more than fifty characters in it."
GOLDEN_PAGES = [
    (1, f"# Top\n{LONG} It ends. And an open"), (2, "short"), (3, f"end of the sentence that began before, on page one.\n-{LONG}\n"),
    (4, f"{LONG}\n# Next\n{LONG}"), (5, f"{LONG}\n# Next\n{LONG}"),
]
GOLDEN_PASSAGES = [
    (0, 1, "# Top", "prose", f"[Page 1] [Section: # Top]\n{LONG} It ends. And an open"),
    (1, 3, "# Top", "prose", "[Page 3] [Section: # Top]\nAnd an open end of the sentence that began before, on page one."),
    (2, 3, "# Top", "list", f"[Page 3] [Section: # Top]\n-{LONG}"),
    (3, 4, "# Top", "prose", f"[Page 4] [Section: # Top]\n{LONG}"),
    (4, 4, "# Next", "prose", f"[Page 4] [Section: # Next]\n{LONG}"),
    (5, 5, "# Next", "prose", f"[Page 5] [Section: # Next]\n{LONG}"),
]


@pytest.mark.parametrize("block", [1, 2, 64])
def test_passages_of_a_hand_made_document(spark, monkeypatch, block):
    monkeypatch.setattr(ingest, "SUMMARY_BLOCK", block)
    pages = spark.createDataFrame([(7, 1, "f.pdf", n, text, False) for n, text in GOLDEN_PAGES], SCHEMA)
    made = ingest.ingest(pages, 200, 60).orderBy("chunk_index").collect()
    assert [(r.chunk_index, r.page_number, r.heading, r.content_type, r.content) for r in made] == GOLDEN_PASSAGES


def test_one_window_is_the_whole_document(pages):
    columns = ["document_id", "page_number", "heading", "content_type", "content"]
    whole = ingest.ingest(pages, 200, 60).select(*columns)
    window = ingest.ingest_by_window(pages, 1000, 2, 200, 60).select(*columns)
    assert whole.exceptAll(window).isEmpty() and window.exceptAll(whole).isEmpty()


def test_ids_are_the_same_in_every_run(pages):
    a = {r.id for r in ingest.ingest(pages).select("id").collect()}
    b = {r.id for r in ingest.ingest(pages.repartition(3)).select("id").collect()}
    assert a == b and len(a) == ingest.ingest(pages).count()

def test_windows_of_pages(spark):
    want = {1: [[1]], 5: [[1, 2, 3, 4, 5]], 6: [[1, 2, 3, 4, 5], [4, 5, 6]], 8: [[1, 2, 3, 4, 5], [4, 5, 6, 7, 8]],
            9: [[1, 2, 3, 4, 5], [4, 5, 6, 7, 8], [7, 8, 9]]}
    rows = [(n, p) for n in want for p in range(1, n + 1)]
    placed = structure.page_windows(spark.createDataFrame(rows, "document_id long, page_number long"), 5, 2).collect()
    for n, windows in want.items():
        got = defaultdict(list)
        for r in placed:
            if r.document_id == n:
                got[r.window_no].append(r.page_number)
        assert [sorted(got[w]) for w in sorted(got)] == windows


def test_split_keeps_text_and_size():
    """Passages keep their size, come in order, overlap by at most 25 characters and leave no word out."""
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice(["a", "bb.", "ccc\n", "dddd\n\n", "eeeee", "x" * 90]) for _ in range(rng.randint(1, 120))]
        text = " ".join(words).strip()
        whole = chunking.split_text(text, True, 80, 25)
        assert "".join("".join(whole).split()) == "".join(text.split())
        at = 0
        for part in chunking.split_text(text, False, 80, 25):
            assert 0 < len(part) <= 80 and part == part.strip()
            gap = at + len(text[at:]) - len(text[at:].lstrip())
            found = text.rfind(part, max(0, at - 25), gap + len(part))
            assert found >= 0
            at = max(at, found + len(part))
        assert text[at:].strip() == ""


def test_row_level_bridge_over_many_blocks(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for doc in range(30):
        last = None
        for at in range(rng.randint(1, 40)):
            k = rng.choice(["prose", "prose", "prose", "list"])
            raw = rng.choice(["go on", "go on and on", "Stop. here", "end.", "Open", "and. then", "more of it"])
            text = f"{last} {raw}" if last and k == "prose" and raw[0].islower() else raw

            last = re.split(r"(?<=[.!?])\s+", text)[-1].strip()
            rows.append((doc, at, 0, 0, k, raw))
            want[(doc, at)] = text
    df = spark.createDataFrame(
        rows, "document_id long, page_number long, section_no long, piece_no long, content_type string, raw string"
    ).withColumn("block", F.floor(F.col("page_number") / 3))
    got = {(r.document_id, r.page_number): r.raw for r in chunking.bridged(df, ["document_id"], "block").collect()}
    assert got == want
