"""Secret scans with DataFrame functions only.

Three fixed patterns give the base spans. A battery of randomness tests adds spans:

1. A candidate is a run of 20 or more characters of the usual encodings. Its encoding is
   inferred from its characters: hex, base32 or base64 (either alphabet).
2. Alphabet uniformity: the chi-squared statistic of its symbols, held against what text of
   that length would give (a noncentral chi-squared law whose centre grows with the length).
3. Runs: how often the string changes between two symbol classes, again against text.
4. Serial correlation of neighbouring symbol values, against the wider spread that text gives.
   A candidate whose correlation is too far from zero for any random string (counters,
   keyboard rows, repeated blocks) is no secret at all.
5. The p-values of 2, 3 and 4 are combined by Fisher's rule. The false discovery rate is controlled
   per length class (powers of two) over all candidates of all documents, because a
   short string can't give strong evidence: the p-values are counted in bins, and
   the Benjamini-Hochberg line gives each class the last bin that it accepts.

Places of matches come from the texts between them (``split`` with the same pattern), in code
points. Documents are never shuffled; only bin counts are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, free_name

# The base patterns. The last two hold the length of a match, which changes no match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
RATE = 0.001  # false discoveries among what is found, in each length class
SERIAL_Z = 3.9
BIN = 0.05  # width of a bin of -log10(p)
LAST_BIN = 400
MASK = "[SECRET]"

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: the symbols of class 1 in the runs test
CLASS_ONE = {"hex": "abcdef", "base32": "234567", "base64": "abcdefghijklmnopqrstuvwxyz"}
#: how far the symbol shares of text are from uniform (alphabet size times the sum of squared shares, minus 1)
TEXT_SHIFT = {"hex": 0.6, "base32": 1.1, "base64": 3.2}
TEXT_SWITCH = 0.2  # chance that text changes the class from one symbol to the next
TEXT_SERIAL = 0.3  # spread of the serial correlation of text, over that of chance
SERIAL_FLOOR = 1e-3  # of the p-value of the serial correlation: one value near zero proves little

_BLOCK = 256
_SYMBOLS = 4096  # of a string whose values are held at a time


def _held(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_blocks(values: Column, size: int | Column = _BLOCK) -> Column:
    """The array as an array of blocks; one empty block if there is nothing."""
    count = F.greatest(F.lit(1), F.ceil(F.size(values) / size).cast("int"))
    return F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * size + 1, size))


def _running(values: Column, add: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """Sums (or what ``add`` gives, from 0) before each element. Two levels of blocks, so that arrays are not copied once per element."""
    zero = F.lit(0).cast("long")
    none = F.array().cast("array<long>")

    def before(block: Column) -> Column:
        start = F.struct(zero.alias("s"), none.alias("o"))
        return F.aggregate(block, start, lambda acc, v: F.struct(add(acc["s"], v).alias("s"), F.concat(acc["o"], F.array(acc["s"])).alias("o")), lambda acc: acc["o"])

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
        return F.flatten(F.zip_with(blocks, before(sums), lambda b, at: F.transform(before(b), lambda x: add(x, at))))

    return _held(values, lambda v: _held(_in_blocks(v), joined))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost matches that don't overlap, in code points."""
    def made(found: Column) -> Column:
        between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        sizes = F.zip_with(between, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("own"), m.alias("match")))

        def placed(sizes: Column) -> Column:
            at = _running(F.transform(sizes, lambda x: x["gap"] + x["own"]))
            return F.zip_with(at, sizes, lambda p, x: F.struct(
                (p + x["gap"]).alias("start"), (p + x["gap"] + x["own"]).alias("end"), x["match"].alias("match"),
            ))

        return F.when(F.size(found) > 0, _held(sizes, placed)).otherwise(F.array().cast("array<struct<start:long,end:long,match:string>>"))

    return _held(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), made)


def _kind(spans: Column, number: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, kind number, end) of the three base kinds."""
    assign = F.filter(spans_of(text, ASSIGN), lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 2)) >= 8)
    return {
        "assign": _kind(assign, 0), "access": _kind(spans_of(text, ACCESS), 1), "hex": _kind(spans_of(text, HEX), 2),
    }


def _normal(z: Column) -> Column:
    """Lower tail of the normal law (error below 1e-7, relative error small in the tail)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    tail = 0.3989422804014327 * F.exp(-x * x / 2) * t * (
        0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))
    )
    return F.greatest(F.when(z < 0, tail).otherwise(1.0 - tail), F.lit(1e-30))


def _serial(plain: Column, alphabet: str) -> Column:
    """Sums over the symbol values of a string: s1, s2 (squares), pairs (products of neighbours), head, tail. Some thousand symbols at a time."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)

    def sums(values: Column) -> Column:
        count = F.size(values)
        return F.struct(
            total(values).alias("s1"), total(F.transform(values, lambda v: v * v)).alias("s2"),
            total(F.zip_with(F.slice(values, 1, count - 1), F.slice(values, 2, count - 1), lambda a, b: a * b)).alias("pairs"),
            F.element_at(values, 1).alias("head"), F.element_at(values, -1).alias("tail"),
        )

    def block(part: Column) -> Column:
        values = F.transform(F.filter(F.split(part, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c).cast("double"))
        return _held(values, sums)

    def after(acc: Column, b: Column) -> Column:
        return F.struct(
            (acc["s1"] + b["s1"]).alias("s1"), (acc["s2"] + b["s2"]).alias("s2"), (acc["pairs"] + acc["tail"] * b["head"] + b["pairs"]).alias("pairs"),
            F.coalesce(acc["head"], b["head"]).alias("head"), b["tail"].alias("tail"),
        )

    none = F.expr("named_struct('s1', 0D, 's2', 0D, 'pairs', 0D, 'head', cast(null as double), 'tail', 0D)")
    parts = F.regexp_extract_all(plain, F.lit(f"[^ ]{{1,{_SYMBOLS}}}"), F.lit(0))
    return F.aggregate(F.transform(parts, block), none, after)


def _tests(token: Column, encoding: str) -> Column:
    """Fisher's p-value of uniformity, runs and serial correlation; 1 where the correlation is off."""
    alphabet, one, k = ALPHABETS[encoding], CLASS_ONE[encoding], len(ALPHABETS[encoding])
    plain = F.lower(token) if encoding == "hex" else F.translate(token, "-_", "+/") if encoding == "base64" else token
    n = F.length(token).cast("double")
    squares = F.aggregate(
        F.array(*[F.lit(c) for c in alphabet]), F.lit(0.0),
        lambda acc, c: acc + F.pow((F.length(plain) - F.length(F.replace(plain, c, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    chi = squares * k / n - n
    shift = n * TEXT_SHIFT[encoding]
    z_chi = (chi - (k - 1 + shift)) / F.sqrt(2 * (k - 1 + 2 * shift))
    classes = F.translate(plain, alphabet, "".join("1" if c in one else "0" for c in alphabet))
    switches = sum((F.length(classes) - F.length(F.replace(classes, F.lit(x), F.lit("")))) / 2.0 for x in ("01", "10"))
    z_runs = -(switches - TEXT_SWITCH * (n - 1)) / F.sqrt(TEXT_SWITCH * (1 - TEXT_SWITCH) * (n - 1))
    serial = _held(_serial(plain, alphabet), lambda v: F.struct(
        (v["s2"] - v["s1"] * v["s1"] / n).alias("spread"),
        (v["pairs"] - v["s1"] / n * (2 * v["s1"] - v["head"] - v["tail"]) + (n - 1) * F.pow(v["s1"] / n, F.lit(2.0))).alias("product"),
    ))
    z_serial = _held(serial, lambda v: F.when(v["spread"] > 0, F.abs(v["product"] / v["spread"] + 1 / n) * F.sqrt(n)))

    def combined(z: Column) -> Column:
        p_serial = F.greatest(2 * _normal(z["serial"] / F.sqrt(1 + TEXT_SERIAL * TEXT_SERIAL * n)) - 1, F.lit(SERIAL_FLOOR))
        x = -F.log(_normal(z["chi"])) - F.log(_normal(z["runs"])) - F.log(p_serial)
        fisher = _held(x, lambda x: F.exp(-x) * (1 + x + x * x / 2))
        return F.when(z["serial"] <= SERIAL_Z, fisher).otherwise(F.lit(1.0))

    return _held(F.struct(z_chi.alias("chi"), z_runs.alias("runs"), z_serial.alias("serial")), combined)


def p_value(token: Column) -> Column:
    """Evidence that a string is random, small for random strings."""
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), _tests(token, "hex"))
        .when(token.rlike("^[A-Z2-7]+$"), _tests(token, "base32"))
        .otherwise(_tests(token, "base64"))
    )


def bin_of(token: Column) -> Column:
    """Bins of falling p; the highest bin holds the strongest evidence."""
    return F.least(F.lit(LAST_BIN), F.floor(-F.log10(F.greatest(p_value(token), F.lit(1e-30))) / BIN).cast("int"))


def length_class(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double"))).cast("int")


def thresholds(docs: DataFrame, text: str = "text", rate: float = RATE) -> dict[int, int]:
    """The lowest accepted bin of each length class that accepts any, over all candidates of all documents.

    At most one row per class (31 lengths in powers of two) reaches the driver.
    """
    token = F.explode(F.regexp_extract_all(column(text), F.lit(CANDIDATE), F.lit(0))).alias("t")
    counts = docs.select(token).select(length_class(F.col("t")).alias("c"), bin_of(F.col("t")).alias("b")).groupBy("c", "b").agg(F.count("*").alias("n"))
    strong = Window.partitionBy("c").orderBy(F.desc("b"))
    whole = Window.partitionBy("c")
    line = counts.select("c", "b", F.sum("n").over(strong).alias("found"), F.sum("n").over(whole).alias("m"))
    accepted = line.where(F.pow(F.lit(10.0), -F.col("b") * BIN) <= rate * F.col("found") / F.col("m"))
    return {r.c: r.b for r in accepted.groupBy("c").agg(F.min("b").alias("b")).collect()}


def random_spans(text: Column, accept: dict[int, int]) -> Column:
    found = spans_of(text, CANDIDATE)
    if not accept:
        return _kind(F.filter(found, lambda s: F.lit(False)), 3)
    least = F.create_map(*[F.lit(x) for c, b in sorted(accept.items()) for x in (c, b)])
    return _kind(F.filter(found, lambda s: F.coalesce(bin_of(s["match"]) >= F.element_at(least, length_class(s["match"])), F.lit(False))), 3)


def scanned(docs: DataFrame, text: str = "text", name: str = "secrets", rate: float = RATE) -> DataFrame:
    """``docs`` with a struct ``name``: assign, access, hex, random, each an array of (start, kind, end).

    Null texts have no spans. A random span that touches a base span is left out. Repeated
    rows each count as evidence in the false discovery control and get the same spans.
    """
    accept = thresholds(docs, text, rate)
    parts = free_name(docs, "_parts")
    base = base_spans(F.coalesce(column(text), F.lit("")))
    held = docs.withColumn(parts, F.struct(
        *[v.alias(k) for k, v in base.items()], random_spans(F.coalesce(column(text), F.lit("")), accept).alias("random"),
    ))
    p = column(parts)
    fixed = F.concat(p["assign"], p["access"], p["hex"])
    apart = F.filter(p["random"], lambda r: ~F.exists(fixed, lambda s: (s["start"] < r["end"]) & (r["start"] < s["end"])))
    return held.withColumn(name, F.struct(p["assign"].alias("assign"), p["access"].alias("access"), p["hex"].alias("hex"), apart.alias("random"))).drop(parts)


def listed(spans: Column) -> Column:
    """kind:start:end of spans, by start, then kind, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def masked(text: Column, spans: Column, mask: str = MASK) -> Column:
    """The text with each group of overlapping spans replaced by ``mask``; null stays null."""

    def cut(ends: Column, spans: Column) -> Column:
        # what stays before each mask: from the last end so far to the start
        kept = F.filter(
            F.zip_with(_running(ends, lambda a, b: F.greatest(a, b)), spans, lambda at, s: F.struct(at.alias("a"), s["start"].alias("b"))), lambda g: g["b"] >= g["a"],
        )
        # texts are cut in two steps, as a cut goes through its text from the start
        blocks = _held(kept, lambda k: _in_blocks(k, F.ceil(F.sqrt(F.size(k))).cast("int")))
        part = lambda t, a, b, first: F.substring(t, (a - first + 1).cast("int"), (b - a).cast("int"))
        zero = F.lit(0).cast("long")
        wide = F.transform(blocks, lambda k: F.struct(
            k.alias("k"), k[0]["a"].alias("first"), part(text, k[0]["a"], F.element_at(k, -1)["b"], zero).alias("t"),
        ))
        before = F.transform(wide, lambda w: F.array_join(F.transform(w["k"], lambda g: part(w["t"], g["a"], g["b"], w["first"])), mask))
        rest = F.substring(text, (F.array_max(ends) + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(before, mask), F.lit(mask), rest)

    done = _held(F.array_sort(spans), lambda s: _held(F.transform(s, lambda x: x["end"]), lambda ends: cut(ends, s)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def all_spans(secrets: Column) -> Column:
    return F.concat(secrets["assign"], secrets["access"], secrets["hex"], secrets["random"])


def redacted(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """``docs`` with every secret of the text masked."""
    name = free_name(docs, "_secrets")
    return scanned(docs, text, name, rate).withColumn(text, masked(column(text), all_spans(column(name)))).drop(name)


def digest(docs: DataFrame) -> DataFrame:
    s = F.col("secrets")
    return scanned(docs.select("doc_id", "text")).select(
        "doc_id", *[F.size(s[k]).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(F.concat(s["assign"], s["access"], s["hex"])), 256).alias("base_sha256"),
        listed(all_spans(s)).alias("spans"),
    )

