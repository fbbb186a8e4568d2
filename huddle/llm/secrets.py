"""Secret scans: base patterns and sliding-window entropy, built-ins only.

Base kinds (``assign``, ``access``, ``hex``) are regular expressions whose
failing matches (too short) are dropped after matching.  Places come from the
lengths of the pieces between matches, so offsets are code points.

Method kind ``entropy``: candidates are runs of key characters of at least
``WIDTH``.  A window of ``WIDTH`` slides over a candidate; counts per
character, the sum of ``c * log2(c)`` and the numbers of characters of each
kind are kept up by adding the new and taking out the old character.  Every
window is judged, by the entropy limit of its class: digits, small or capital
hexadecimal, letters (one digit at most) of one case, of one case with
symbols, or of both cases, and all else as mixed.  Letters of both cases of
which one case is rare are words written together, so their limit is higher.
Windows above the limit that touch form one span, which is extended on both
sides to the token it lies in: up to the next ``/`` or ``=`` (``=`` after it
included) or place on the allow-list.  Windows on the allow-list (published
placeholders, UUIDs, counting-up runs) are left out: those that hold a whole
match, or half of whose characters lie in one.  Base spans always stay.

Defined results: null or empty text has no spans; text may be of any length;
repeated rows give repeated rows; other columns are ignored by ``scan`` and
kept by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
# every shorter run fails, so the length may stand in the pattern
HEX = r"[0-9a-f]{24,}"
MIN_ASSIGN, MIN_ACCESS = 6, 20

WIDTH = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: Kinds of characters; base-32 places of one number: a window's counts by kind.
KIND_SETS = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/_=-")
HEX_LIMIT, MIXED_LIMIT = 2.95, 3.55
# of 5000 random strings of 20 (40) characters 5.4 % (0.02 %) of digits, 8.1 %
# (0.02 %) of both cases and 41.5 % (3.0 %) of one case stay below: words of
# one case are as even as short random strings
DIGIT_LIMIT, ONE_CASE_LIMIT, SYMBOL_LIMIT, TWO_CASE_LIMIT = 2.65, 3.65, 3.9, 3.75
#: Letters of both cases with at most so many of the rarer case: identifiers.
RARE_CASE, WORDS_LIMIT = 6, 4.1
#: What is no secret: UUIDs, placeholders, runs that count up.
ALLOW = (r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])",
         r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",
         r"(?i)example|sample|dummy|placeholder|changeme|redacted|your[_-]",
         r"(?i)0123456789|1234567890|abcdefghijkl|(.)\1{5}")
MASK = "[SECRET]"
_BLOCK = 256


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def running_sums(lengths: Column) -> Column:
    """Sum of all values before each one; by blocks, so that an array of k
    values takes about 256 k steps, not k * k."""
    def with_blocks(v: Column) -> Column:
        n_blocks = F.floor((F.size(v) + (_BLOCK - 1)) / _BLOCK).cast("int")
        sums = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: _sum(F.slice(v, b * _BLOCK + 1, _BLOCK)))

        def with_starts(s: Column) -> Column:
            starts = F.transform(s, lambda _, b: _sum(F.slice(s, F.lit(1), b)))
            return _let(starts, lambda first: F.transform(v, lambda _, i: F.get(first, F.floor(i / _BLOCK).cast("int")) + _sum(
                F.slice(v, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK))))
        return _let(sums, with_starts)
    return _let(lengths, lambda v: F.when(F.size(v) > 0, with_blocks(v)).otherwise(F.array().cast("array<int>")))


def matches(text: Column, pattern: str) -> Column:
    """(start, match) of the leftmost non-overlapping matches, in code points."""
    def placed(found: Column) -> Column:
        between = F.slice(F.split(text, pattern), F.lit(1), F.size(found))
        lengths = F.zip_with(between, found, lambda p, m: F.length(p) + F.length(m))
        return F.when(F.size(found) > 0, F.zip_with(
            running_sums(lengths), F.arrays_zip(F.transform(between, F.length).alias("p"), found.alias("m")),
            lambda s, x: F.struct((s + x["p"]).alias("start"), x["m"].alias("match")))).otherwise(
                F.array().cast("array<struct<start:int,match:string>>"))
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: _span(m["start"], F.lit(KINDS.index(kind)), m["start"] + F.length(m["match"])))


def _span(start: Column, kind: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), kind.cast("int").alias("kind"), end.cast("int").alias("end"))


def _f(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def entropy_spans(candidate: Column) -> Column:
    """Spans (start, end within the candidate) of the windows above the limit,
    each with its whole token."""
    n = F.length(candidate)
    # code 0 has no kind
    places = F.array(F.lit(0), *[F.lit(32 ** next(k for k, chars in enumerate(KIND_SETS) if ch in chars)) for ch in ALPHABET])
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("kinds"), F.lit(0).alias("token"), F.lit(-1).alias("start"), F.lit(-1).alias("end"),
        F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    slash, equals = (ALPHABET.index(ch) + 1 for ch in "/=")

    def step(codes: Column, listed: Column):
        def on_list(i: Column) -> Column:
            return F.exists(listed, lambda r: (r["start"] <= i) & (i < r["end"]))

        def one(a: Column, i: Column) -> Column:
            new = F.get(codes, i)
            old = F.when(i >= WIDTH, F.get(codes, i - WIDTH)).otherwise(F.lit(0))
            moved = F.struct(new.alias("new"), old.alias("old"))

            def counted(m: Column) -> Column:
                same = m["new"] == m["old"]
                c_new, c_old = F.get(a["counts"], m["new"]), F.get(a["counts"], m["old"])
                # code 0 stands for "no character leaves"
                gone = F.when(m["old"] > 0, _f(c_old - 1) - _f(c_old)).otherwise(F.lit(0.0))
                s = F.when(same, a["s"]).otherwise(a["s"] + _f(c_new + 1) - _f(c_new) + gone)
                counts = F.when(same, a["counts"]).otherwise(F.transform(
                    a["counts"], lambda c, k: c + (k == m["new"]).cast("int") - ((k == m["old"]) & (k > 0)).cast("int")))
                kinds = a["kinds"] + F.get(places, m["new"]) - F.get(places, m["old"])
                # start of the token that the window's first character is in
                token = F.when((m["old"] == slash) | (m["old"] == equals) | ((i >= WIDTH) & on_list(i - WIDTH)), i - (WIDTH - 1)).otherwise(a["token"])
                # whether the character belongs to the token before it
                goes_on = (m["new"] == equals) | (m["new"] != slash) & (F.get(codes, i - 1) != equals)
                return F.struct(counts.alias("counts"), s.alias("s"), kinds.alias("kinds"), token.alias("token"), goes_on.alias("goes_on"))

            def judged(x: Column) -> Column:
                entropy = F.lit(F.log2(F.lit(float(WIDTH)))) - x["s"] / WIDTH
                first = i - (WIDTH - 1)
                high = (i >= WIDTH - 1) & (entropy >= DIGIT_LIMIT) & (entropy >= limit(x["kinds"])) & ~F.exists(
                    listed, lambda r: F.least(r["end"], i + 1) - F.greatest(r["start"], first) >= F.least(r["end"] - r["start"], F.lit(WIDTH // 2)))
                joins = a["end"] >= first
                closed = F.when(high & ~joins & (a["end"] >= 0), F.array_append(
                    a["spans"], F.struct(a["start"].alias("start"), a["end"].alias("end")))).otherwise(a["spans"])
                longer = (a["end"] == i) & x["goes_on"] & ~on_list(i)
                return F.struct(
                    x["counts"].alias("counts"), x["s"].alias("s"), x["kinds"].alias("kinds"), x["token"].alias("token"),
                    F.when(high & ~joins, F.greatest(x["token"], a["end"])).otherwise(a["start"]).alias("start"),
                    F.when(high | longer, i + 1).otherwise(a["end"]).alias("end"), closed.alias("spans"))
            return _let(_let(moved, counted), judged)
        return one

    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    return _let(codes, lambda v: _let(allowed(candidate), lambda listed: F.aggregate(
        F.sequence(F.lit(0), n - 1), zero, step(v, listed),
        lambda a: F.when(a["end"] >= 0, F.array_append(a["spans"], F.struct(a["start"].alias("start"), a["end"].alias("end"))))
        .otherwise(a["spans"]))))


def limit(kinds: Column) -> Column:
    """The entropy limit of a window's class, by its counts of each kind."""
    digits, hex_small, small, hex_capital, capital, symbols = (F.shiftright(kinds, 5 * k).bitwiseAND(F.lit(31)) for k in range(len(KIND_SETS)))
    rare = F.least(hex_small + small, hex_capital + capital)
    return F.when(digits == WIDTH, F.lit(DIGIT_LIMIT)).when(
        (digits > 0) & ((digits + hex_small == WIDTH) | (digits + hex_capital == WIDTH)), F.lit(HEX_LIMIT)).when(
        digits > 1, F.lit(MIXED_LIMIT)).when(rare > RARE_CASE, F.lit(TWO_CASE_LIMIT)).when(rare > 0, F.lit(WORDS_LIMIT)).when(symbols > 0, F.lit(SYMBOL_LIMIT)).otherwise(F.lit(ONE_CASE_LIMIT))


def allowed(candidate: Column) -> Column:
    """(start, end) of the places of a candidate that the allow-list matches."""
    return F.flatten(F.array(*[F.transform(matches(candidate, pattern), lambda m: F.struct(
        m["start"].alias("start"), (m["start"] + F.length(m["match"])).alias("end"))) for pattern in ALLOW]))


def spans_of(text: Column) -> tuple[Column, Column]:
    """Base and entropy spans: arrays of (start, kind number, end)."""
    assign = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= MIN_ASSIGN)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["match"]) >= MIN_ACCESS)
    base = F.concat(_spans("assign", assign), _spans("access", access), _spans("hex", matches(text, HEX)))
    high = F.flatten(F.transform(matches(text, CANDIDATE), lambda m: F.transform(entropy_spans(m["match"]), lambda s: _span(
        m["start"] + s["start"], F.lit(KINDS.index("entropy")), m["start"] + s["end"]))))
    return F.array_sort(base), high


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base and spans (all), as sorted arrays of (start, kind, end);
    and the columns in ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
                       *([F.struct(*keep).alias("kept_columns")] if keep else []))
    base, high = spans_of(F.col("text"))
    rows = rows.withColumns({"base": base, "high": high})
    return rows.select("doc_id", "text", *(["kept_columns"] if keep else []), "base",
                       F.array_sort(F.concat("base", "high")).alias("spans"))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans."""
    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs).select("doc_id", n("assign"), n("access"), n("hex"),
                             F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``[SECRET]`` (spans
    that overlap by one); ``n_chars``, if there, follows.  Null stays null."""
    rows = scan(docs, tuple(docs.columns))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def add(a: Column, s: Column) -> Column:
        text = F.col("text")
        piece = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(MASK))).otherwise(F.lit(""))
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.array_append(a["parts"], piece).alias("parts"))

    masked = F.aggregate("spans", start, add, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    rows = rows.select("kept_columns", F.when(F.size("spans") > 0, masked).otherwise(F.col("kept_columns.text")).alias("masked"))
    out = []
    for name, kind in docs.dtypes:
        c = F.col(f"kept_columns.`{name}`")
        if name == "text":
            c = F.col("masked")
        elif name == "n_chars":
            c = F.when(F.col("masked") != F.col("kept_columns.text"), F.length("masked")).otherwise(c)
        out.append(c.cast(kind).alias(name))
    return rows.select(*out)
