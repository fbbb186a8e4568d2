"""Quality rules: base counts, then distribution divergence per language.

Built-in functions only.  For every document two histograms are compared with
each language's reference by Jensen-Shannon distance (base 2, 0 to 1): its
character classes (counts by class) and its common words (counts of each of
the reference's most frequent words, the rest as one more bin).  Each distance
is judged by its own unit, below which a histogram says little: classes from
``MIN_CHARS`` characters on, words from ``MIN_JUDGED_WORDS`` words on, else it
is null.  A document is judged by the language whose references lie nearest
(by the judged distances); it is rejected when one is above its limit.  Texts
mostly of a script without blanks are compared without the class of blanks.

References are learned from the table itself, over all rows with a non-null
``lang``: class counts per language, and the ``top_words`` most frequent words
per language by an exact count over all words.  They hold a few rows per
language, with the number of languages checked against ``MAX_LANGS``, and are
constants of the plan.

Defined results: null text has no words; a document without words fails the
base rule; documents of a null or rare language are judged against all
references like any other; without any reference nothing is rejected for
divergence; repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huddle.llm.common import written

MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Shorter documents are not judged by the classes, or by the words.
MIN_CHARS, MIN_JUDGED_WORDS = 500, 100
TOP_WORDS = 30
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.36
MAX_LANGS = 200

CLASSES = ("upper", "digit", "space", "stop", "n_symbols", "rest")
# Insides of the classes of characters, as regular expressions.
_UPPER, _DIGIT, _STOP = "A-Z", "0-9", ".,;:!?'\"()\\-"
_SPACE, _SYMBOL = r"\x20\x09-\x0D", "#*$%&|<>"
# Thai, Lao, Tibetan, Myanmar, Khmer, kana and Han; with blanks in less than
# one of LEAST_BLANKS characters a text is looked at for them
_NO_BLANKS, LEAST_BLANKS = (r"\x{0E00}-\x{0FFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3001}-\x{30FF}\x{3400}-\x{4DBF}"
                            r"\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"), 20


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{_SPACE}]+"))


def _count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are of the class ``[chars]``."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a run of ``window`` words found twice or more."""
    n = F.size(words)
    grams = F.when(n >= window, F.transform(F.sequence(F.lit(1), n - (window - 1)),
                                            lambda i: F.xxhash64(F.slice(words, i, window))))

    def covered(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            last = F.size(s) - 1
            found = F.filter(s, lambda e, k: ((k > 0) & (F.get(s, k - 1)["h"] == e["h"]))
                             | ((k < last) & (F.get(s, k + 1)["h"] == e["h"])))
            starts = F.array_sort(F.transform(found, lambda e: e["i"]))
            return F.aggregate(
                starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("end")),
                lambda a, s0: F.struct((a["n"] + F.lit(window) - F.greatest(F.lit(0), a["end"] - s0)).cast("long").alias("n"),
                                       (s0 + window).alias("end")), lambda a: a["n"])
        return _let(pairs, twice)

    # the sort is only needed where some window occurs again
    return F.coalesce(_let(grams, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h))), F.lit(0).cast("long"))


def character_counts(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (null: empty), lang, n_chars and the class counts."""
    t = F.col("text")
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(t.cast("string"), F.lit("")).alias("text"),
                       lang.alias("lang"), *([F.struct(*keep).alias("kept_columns")] if keep else []))
    counts = {"upper": _count_of(t, _UPPER), "digit": _count_of(t, _DIGIT), "space": _count_of(t, _SPACE),
              "stop": _count_of(t, _STOP), "n_symbols": _count_of(t, _SYMBOL)}
    rows = rows.withColumns({"n_chars": F.length(t).cast("long")} | {k: c.cast("long") for k, c in counts.items()})
    # small letters of any alphabet, and whatever is in no other class
    rows = rows.withColumn("rest", F.col("n_chars") - sum((F.col(k) for k in counts), F.lit(0)))
    return rows.withColumn("no_blanks", F.when(LEAST_BLANKS * F.col("space") < F.col("n_chars"),
                                               2 * _count_of(t, _NO_BLANKS) >= F.col("n_chars")).otherwise(F.lit(False)))


def base_counts(docs: DataFrame, keep: tuple[str, ...] = (), reference_words: list[str] | None = None) -> DataFrame:
    """``character_counts`` with the base counts and the common words."""
    t = F.col("text")
    rows = character_counts(docs, keep).withColumn("words", words_of(t)).withColumn("lines", F.filter(
        F.split(t, "\n"), lambda x: x.rlike(f"[^{_SPACE}]")))
    return rows.select(
        "doc_id", "lang", *(["kept_columns"] if keep else []), "n_chars", *CLASSES, "no_blanks", F.size("words").cast("long").alias("n_words"),
        (F.col("n_chars") - F.col("space")).alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        common_words(reference_words or [], F.col("words")).alias("common"))


def _js_term(p: Column, q: Column) -> Column:
    """What one bin adds to the Jensen-Shannon divergence, in bits."""
    m = p + q
    return (F.when(p > 0, p * F.log2(2 * p / m)).otherwise(F.lit(0.0))
            + F.when(q > 0, q * F.log2(2 * q / m)).otherwise(F.lit(0.0))) / 2


def class_references(counts: DataFrame) -> DataFrame:
    """Per language the share of each character class (columns ref_<class>)."""
    sums = counts.where(F.col("lang").isNotNull() & (F.col("n_chars") > 0)).groupBy("lang").agg(
        F.sum("n_chars").alias("n"), *[F.sum(c).alias(c) for c in CLASSES])
    return sums.select("lang", *[(F.col(c) / F.col("n")).alias(f"ref_{c}") for c in CLASSES])


def word_references(docs: DataFrame, top_words: int) -> DataFrame:
    """(lang, word, q): the most frequent words of each language (ties by the
    word) and their share of all its words."""
    rows = docs.where("lang is not null and text is not null").select(
        F.col("lang").cast("string").alias("lang"), F.explode(words_of(F.lower(F.col("text").cast("string")))).alias("word"))
    counts = written(rows.groupBy("lang", "word").agg(F.count("*").alias("n")), "quality-words")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= top_words)
    return top.join(totals, "lang").select("lang", "word", (F.col("n") / F.col("total")).alias("q"))


def common_by_language(docs: DataFrame, top_words: int = TOP_WORDS) -> dict[str, list[tuple[str, float]]]:
    words: dict[str, list] = {}
    for r in word_references(docs, top_words).limit(MAX_LANGS * top_words + 1).collect():
        words.setdefault(r["lang"], []).append((r["word"], r["q"]))
    if len(words) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    return words


def references(counts: DataFrame, words: dict[str, list[tuple[str, float]]]) -> Column | None:
    """All references as one constant array (a few rows per language)."""
    classes = {r["lang"]: r for r in class_references(counts).limit(MAX_LANGS + 1).collect()}
    if len(classes) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    refs = []
    for lang in sorted(classes):
        top = sorted(words.get(lang, []))
        pairs = [F.lit(x) for pair in top for x in pair]
        refs.append(F.struct(
            F.lit(lang).alias("lang"), F.array(*[F.lit(float(classes[lang][f"ref_{c}"])) for c in CLASSES]).alias("classes"),
            F.map_from_arrays(F.array(*pairs[::2]), F.array(*pairs[1::2])).alias("q") if top
            else F.create_map().cast("map<string,double>").alias("q"),
            F.lit(float(sum(q for _, q in top))).alias("total")))
    return F.array(*refs) if refs else None


def common_words(refs_words: list[str], words: Column) -> Column:
    """(word, n) of the reference words that a document has."""
    found = F.filter(words, lambda w: F.lower(w).isin(refs_words)) if refs_words else F.array().cast("array<string>")
    return _let(F.transform(found, F.lower), lambda all_: F.transform(
        F.array_distinct(all_), lambda w: F.struct(w.alias("word"), F.size(F.filter(all_, lambda x: x == w)).alias("n"))))


def distances(refs: Column) -> Column:
    """Nearest language as (sum, class_distance, word_distance, lang), a
    distance that is not judged as null; reads the class counts, ``no_blanks``,
    ``n_chars``, ``n_words`` and ``common``."""
    chars = F.greatest(F.col("n_chars") - F.when(F.col("no_blanks"), F.col("space")).otherwise(F.lit(0)), F.lit(1))
    n_words = F.greatest("n_words", F.lit(1))

    def one(r: Column) -> Column:
        share = F.when(F.col("no_blanks"), F.greatest(1 - r["classes"][CLASSES.index("space")], F.lit(1e-9))).otherwise(F.lit(1.0))
        terms = {c: _js_term(F.col(c) / chars, r["classes"][k] / share) for k, c in enumerate(CLASSES)}
        terms["space"] = F.when(F.col("no_blanks"), F.lit(0.0)).otherwise(terms["space"])
        by_class = sum(terms.values(), F.lit(0.0))
        seen = F.aggregate(
            "common", F.struct(F.lit(0.0).alias("js"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q")),
            lambda a, e: _let(r["q"][e["word"]], lambda q: F.when(q.isNull(), a).otherwise(F.struct(
                (a["js"] + _js_term(e["n"] / n_words, q)).alias("js"), (a["p"] + e["n"] / n_words).alias("p"),
                (a["q"] + q).alias("q")))))
        by_word = _let(seen, lambda x: x["js"] + F.greatest(r["total"] - x["q"], F.lit(0.0)) / 2
                       + _js_term(F.greatest(1 - x["p"], F.lit(0.0)), F.greatest(1 - r["total"], F.lit(0.0))))
        root = [F.when(enough, F.sqrt(F.greatest(x, F.lit(0.0)))) for enough, x in (
            (F.col("n_chars") >= MIN_CHARS, by_class), (F.col("n_words") >= MIN_JUDGED_WORDS, by_word))]
        return F.struct((F.coalesce(root[0], F.lit(0.0)) + F.coalesce(root[1], F.lit(0.0))).alias("sum"), root[0].alias("class_distance"), root[1].alias("word_distance"),
                        r["lang"].alias("nearest"))

    return F.array_min(F.transform(refs, one))


def judged(rows: DataFrame, refs: Column | None) -> DataFrame:
    """``rows`` (base counts) with base_failed, kept, and the distances to the
    nearest language."""
    if refs is None:
        near = F.lit(None).cast("struct<sum:double,class_distance:double,word_distance:double,nearest:string>")
    else:
        near = F.when((F.col("n_chars") >= MIN_CHARS) | (F.col("n_words") >= MIN_JUDGED_WORDS), distances(refs))
    rows = rows.withColumn("near", near)
    far = F.coalesce(F.col("near.class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) | F.coalesce(
        F.col("near.word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~far})


def _distinct_words(words: dict[str, list[tuple[str, float]]]) -> list[str]:
    return sorted({w for top in words.values() for w, _ in top})


def quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``, by the references of ``docs`` itself:
    doc_id, base counts, base_failed, kept, distances.  The counts are one
    pass over the texts, written as a table that the references of the
    character classes and the verdicts are read from."""
    words = common_by_language(docs)
    rows = written(base_counts(docs, (), _distinct_words(words)), "quality-counts")
    return judged(rows, references(rows, words)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "near.class_distance", "near.word_distance", "near.nearest")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, columns as they are.  The
    counts are written with the rows, so that the verdict's filter is not
    pushed below them and worked out again for every use."""
    words = common_by_language(docs)
    rows = written(base_counts(docs, tuple(docs.columns), _distinct_words(words)), "quality-counts")
    rows = judged(rows, references(rows, words)).where("kept")
    return rows.select(*[F.col(f"kept_columns.`{c}`").alias(c) for c in docs.columns])
