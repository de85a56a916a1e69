"""Terms, stems and what they match."""

from pyspark.sql import functions as F

from folioscan.functions import stems, terms
from folioscan.operators import keyword


def test_published_examples(spark):
    pairs = (
        "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled "
        "motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall "
        "hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit "
        "rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic "
        "differentli differ vileli vile analogousli analog vietnamization vietnam predication predic operator oper "
        "feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit "
        "sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr "
        "hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop "
        "adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust dependent depend "
        "adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog "
        "effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll"
    ).split()
    pairs += ["yes", "ye", "größen", "größen", "a1s", "a1s", "as", "as", "oyblyying", "oybli", "saying", "sai", "crying", "cry"]
    words = spark.createDataFrame([(pairs[::2],), ([],), (None,)], "w array<string>")
    made = [r[0] for r in words.select(stems.stems(F.col("w"))).collect()]
    assert list(zip(pairs[::2], made[0])) == list(zip(pairs[::2], pairs[1::2]))
    assert made[1:] == [[], None]
    each = words.select(F.explode("w").alias("w")).select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert [r.s for r in each] == made[0]


def test_terms_drop_stop_words_and_keep_repeats(one):
    got = one(terms.terms, ["The Été of 2024, the été!", "and of", None])
    assert got == [["été", "2024", "été"], [], None]


def test_stems_widen_the_match(spark):
    chunks = spark.createDataFrame(
        [(1, 1, 1, "Running connections were conditional"), (2, 1, 1, "run connect condition"), (3, 1, 2, "run connection")],
        "id long, document_id long, user_id long, content string")
    asked = spark.createDataFrame([(1, 1, "connected runs"), (2, 1, "connect"), (3, 1, "the of")],
                                  "query_id long, user_id long, query_text string")
    plain = {(r.query_id, r.id) for r in keyword.matching(chunks, asked, stem=False).collect()}
    wide = {(r.query_id, r.id, r.score) for r in keyword.matching(chunks, asked, stem=True).collect()}
    assert plain == {(2, 2)}
    assert wide == {(1, 1, 2), (1, 2, 2), (2, 1, 1), (2, 2, 1)}


def test_anchor_is_the_longest_term(spark):
    df = spark.createDataFrame([(["aa", "bbb", "ccc"],), ([],)], "w array<string>")
    assert [r[0] for r in df.select(terms.anchor_term(F.col("w"))).collect()] == ["bbb", None]
