"""Hand-made cases of the text rules."""

import random

from pyspark.sql import functions as F

from folioscan.functions import keys, outputs, routing, text, vectors
from folioscan.operators import condense, mmr, scope


def test_page_and_section_lookup(spark):
    cases = {
        "what is on page 4": ("page", 4, None), "pg. #12": ("page", 12, None), "PAGE NUMBER 7 please": ("page", 7, None),
        "page4": ("page", 4, None), "homepage 4": (None, None, None), "what is in section 3": (None, None, None),
        "what does chapter 2 say": ("section", None, "2 say"), "part of the plan": ("section", None, "of the plan"),
        "section 'Über uns' now": ("section", None, "Über uns"), "page 3 of section two": ("page", 3, None),
        "section intro, please": ("section", None, "intro"), "nothing": (None, None, None),
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, q string")
    q = F.col("q")
    got = df.select(
        "i", routing.lookup_kind(q), routing.lookup_page(q), routing.lookup_section(q)
    ).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == list(cases.values())


def test_lookups_read_odd_characters_as_the_sql_does(one):
    # only blanks are cut off the ends, a line end stays; edges, digits and white space are those of ASCII
    odd = ["see section 3 plan.\n", "see section 3 plan \x0b", "Épage 4", "page 4é", "page ٣", "section\xa0two"]
    assert one(routing.lookup_section, odd) == ["3 plan.\n", "3 plan", None, None, None, None]
    assert one(routing.lookup_page, odd) == [None, None, 4, 4, None, None]


def test_last_verdict_over_odd_letters(one):
    # edges of words are those of ASCII, as in the SQL; a letter that has two capitals is no part of the word
    odd = ["yes, Éno", "no, yesé", "YES noß", "yes nota", "no yeſ", "yes_no"]
    assert one(outputs.last_verdict, odd) == [False, True, False, True, True, True]


def test_strict_section_variant_takes_a_last_number(one):
    assert one(routing.lookup_section_strict, ["what is in section 3", "chapter 2 say", "part of it"]) == ["3", "2", "of it"]


def test_small_talk_and_reply(one):
    cases = {
        "hi": "greeting", "hi, what is liquidity?": "thanks", "good night": "farewell", "ok": "acknowledgement",
        "gradient descent": "default", "why": None, "": "default", "what can you do": "what_can_you_do",
        "Thanks a lot": "thanks", "how are you today": "how_are_you", "help me with quality": None, "help!": "greeting",
        "perfect!": "acknowledgement", "cool story about it": None, "see ya": "greeting",
    }
    assert one(routing.small_talk_key, list(cases)) == list(cases.values())
    assert one(lambda c: routing.reply_text(routing.small_talk_key(c)), ["why", "hi"])[0] is None


def test_knowledge_source(one):
    got = one(routing.knowledge_source, ["Define my notes", "define entropy", "how many days", "tell me", "WHEN WAS it"])
    assert got == ["document", "general", "general", "document", "general"]


def test_rewrite_gate(spark):
    df = spark.createDataFrame(
        [(0, "x", 0), (1, "x", 1), (2, " ".join(["word"] * 11), 2), (3, " ".join(["word"] * 11) + " them", 2),
         (4, " ".join(["word"] * 11) + " explain", 2)], "i int, q string, n int")
    got = [r[1] for r in df.select("i", routing.needs_rewrite(F.col("q"), F.col("n"))).orderBy("i").collect()]
    assert got == [False, True, False, True, True]


def test_cleaning_of_responses(one):
    assert one(outputs.strip_think, ["<think>a\nb</think> x <think>c</think>y", "<think>open", None, " a "]) == [
        "x y", "<think>open", "", "a"]
    assert one(outputs.last_verdict, ["<think>yes</think> No.", "no YES", "nothing", "", "yesterday", "NO\nyes!"]) == [
        False, True, True, True, True, True]
    labels = one(lambda c: outputs.last_label(c, ("big", "tiny"), F.lit("none")), ["big tiny", "TINY\nbig", "", "tinybig"])
    assert labels == ["tiny", "big", "none", "big"]


def test_card_parsing(one):
    good = '[{"question": "q", "answer": "a"}]'
    cases = [good, f"Sure: {good} done", '[{"question": "q]", "answer": "a"}]', "none", 'x [{"question": "q]", "answer": "a"}]',
             '[{"question": " ", "answer": "a"}, {"question": "q", "answer": null}, {"question": " q ", "answer": "b "}]']
    got = one(lambda c: F.transform(outputs.valid_cards(outputs.parse_cards(c)), lambda k: F.concat(k["question"], F.lit("/"), k["answer"])), cases)
    assert got[0] == ["q/a"] and got[1] == ["q/a"] and got[2] == ["q]/a"] and got[3] is None and not got[4]
    assert got[5] == ["q/b"]


def test_sentence_pack(one):
    cases = {
        "": [], "  ": [], "a" * 30: ["a" * 20, "a" * 10], "Short. " + "b" * 45 + ". End.": ["Short.", "b" * 20, "b" * 20, "b" * 5 + ".", "End."],
        "One. Two! Three? Four": ["One. Two! Three?", "Four"], "Ends here. x\n y": ["Ends here. x y"], "no stop at all in it here": ["no stop at all in it", " here"],
    }
    assert one(lambda c: text.sentence_pack(c, 20), list(cases)) == list(cases.values())


def test_sentence_pack_keeps_every_word(one):
    rng = random.Random(2)
    texts = [
        " ".join(rng.choice(["aa", "bbb.", "c!", "d" * 25, "\n"]) for _ in range(rng.randint(1, 60))) for _ in range(150)
    ]
    got = one(lambda c: text.sentence_pack(c, 20), texts)
    assert all(len(p) <= 20 for g in got for p in g)
    assert all("".join("".join(g).split()) == "".join(t.split()) for g, t in zip(got, texts))


def test_vector_text(one):
    got = one(vectors.parse_vector, ["[0.5, -1]", "1,2,", "", None, "[]", "[a]", " [3] "])
    assert got == [[0.5, -1.0], [1.0, 2.0], [], [], [], [], [3.0]]


def test_titles_and_whitespace(one):
    got = one(text.conversation_title, ["  hi ", "", "x" * 39 + " yz", "y" * 41])
    assert got == ["hi", "New Conversation", "x" * 39 + "…", "y" * 40 + "…"]
    assert one(text.strip, ["\x1c a b\x85\n", "\xa0"]) == ["a b", ""]
    assert one(text.normalise, ["Eﬃ ﬁne  ﬂow—Été, 3.5!"]) == ["e fine flowt 35"]


def test_lines_keep_their_ends(one):
    sample = "a\r\nb\rc\n\nd\x0be\x0cf\x1cg\x85h i j"
    assert one(text.lines_keeping_ends, [sample, "", "x\n"]) == [sample.splitlines(keepends=True), [], ["x\n"]]


def test_keys(one):
    assert one(keys.audio_key, ["https://h/audio/u/x.wav?s=1", "https://h/img/x", "audio/x", None]) == [
        "audio/u/x.wav", None, "audio/x", None]


def test_set_key_does_not_depend_on_order(spark):
    df = spark.createDataFrame([([3, 1, 22],), ([22, 3, 1],)], "ids array<long>")
    assert df.select(keys.docset_key(F.col("ids")).alias("k")).distinct().count() == 1


def test_picks(one):
    assert one(mmr.picks_for, [0, 1, 2, 3, 4, 9], "long") == [5, 5, 8, 12, 12, 12]


def test_batches_equal_a_loop():
    rng = random.Random(9)
    lists = [[rng.randint(0, 30) for _ in range(rng.randint(0, 25))] for _ in range(100)] + [[50, 1, 50, 20]]
    for lengths in lists:
        batches, open_, held = [], 0, 0
        for at in range(0, len(lengths), 7):  # handed over in pieces
            made, open_, held = condense.next_batches(lengths[at : at + 7], 40, open_, held)
            batches += made
        want, size, batch, filled = [], 0, 1, False
        for n in lengths:
            if size and size + n > 40:
                batch, size = batch + 1, 0
            size += n
            want.append(batch)
        assert batches == want


def test_request_checks(spark):
    df = spark.createDataFrame(
        [(0, " ", 1, "concise", None), (1, "q", None, "x", None), (2, "q" * 2001, 1, None, None), (3, "q", 1, "concise", "a.doc"), (4, "q", 1, "loud", "a.PDF")],
        "i int, question string, conversation_id long, response_style string, filename string")
    got = [(r.reject_reason, r.response_style) for r in scope.checked_requests(df).orderBy("i").collect()]
    assert got == [("question is empty", "concise"), ("conversation is missing", "explanatory"), ("question is too long", "explanatory"),
                   ("file is not a PDF", "concise"), (None, "explanatory")]
