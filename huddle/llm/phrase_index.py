"""Benchmark decontamination by a positional inverted index, built-ins only.

1. The index: one posting (term, document, position) per occurrence of a
   benchmark term in the documents, sorted by term within its files, written
   to the shared folder.  A term no document has needs no list; a word no
   item has is never looked up.
2. Every window of every item is searched from its rarest term: the postings
   of that term, moved by the term's offset, are candidate places, and are
   intersected with the (equally moved) postings of its second rarest term.
3. The remaining places are intersected with the postings of all terms of the
   item at once; a window occurs where all its words are present (exact
   phrases).  ``proximity`` gives the looser matches: a window's rarest terms
   in any order within a span of words.

The benchmark side (terms, windows) is broadcast only up to ``MAX_TERMS``
rows, the candidate documents only up to ``MAX_DOCS``; beyond, the joins
shuffle.  Documents are keyed by a 64-bit hash of doc_id and text.

Defined results: null text has no words; an item without words is no item; an
item shorter than the window is one window; repeated items count by their
item_id; repeated rows give repeated rows; an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import small, written

WINDOW = 10
MAX_TERMS = 200_000
MAX_DOCS = 2_000_000
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: No word has this character; its posting holds the number of words.
LENGTH_MARK = "\x00"


def words_of(text: Column) -> Column:
    low = F.translate(text, _CAPITALS, _SMALL)
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def doc_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def item_words(items: DataFrame, window: int) -> DataFrame:
    """(item, item_id, n, at, word): the words of each item with their place."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.xxhash64("item_id", "text").alias("item"),
                        words_of(F.col("text").cast("string")).alias("words")).distinct()
    return rows.select("item", "item_id", F.size("words").alias("n"), F.posexplode("words").alias("at", "word"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, doc, at) for the words in ``terms`` (word, term), and the number
    of words of each document under the term of ``LENGTH_MARK``."""
    rows = docs.select(doc_key().alias("doc"), words_of(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words"))
    marked = rows.select("doc", F.concat("words", F.array(F.lit(LENGTH_MARK))).alias("words"))
    postings = marked.select("doc", F.posexplode("words").alias("at", "word")).join(small(terms, MAX_TERMS), "word")
    return written(postings.select("term", "doc", "at").sortWithinPartitions("term", "doc", "at"), "phrase-postings")


def windows_of(words: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """(item, start, width, rare): each window's terms as (n, term, offset)
    from the rarest on, by the number of postings; windows with a term
    without postings are left out."""
    width = F.least(F.lit(window), F.col("n"))
    first, last = F.greatest(F.lit(0), F.col("at") - width + 1), F.least(F.col("at"), F.col("n") - width)
    cells = words.select("item", "term", "at", width.alias("width"), F.explode(F.sequence(first, last)).alias("start"))
    cells = cells.join(frequency, "term")
    return cells.groupBy("item", "start", "width").agg(F.sort_array(F.collect_list(F.struct(
        F.col("postings"), "term", F.col("at")))).alias("rare")).where(F.size("rare") == F.col("width"))


def exact_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches, lengths, words): occurring windows as (doc, item, start in
    the document, width); number of words by document; the items' words."""
    words = item_words(items, window).withColumn("term", F.xxhash64("word"))
    words = written(words, "phrase-items")
    mark = docs.sparkSession.range(1).select(F.lit(LENGTH_MARK).alias("word"), F.xxhash64(F.lit(LENGTH_MARK)).alias("term"))
    terms = written(words.select("word", "term").union(mark).distinct(), "phrase-terms")
    index = build_index(docs, terms)
    is_length = F.col("term") == F.xxhash64(F.lit(LENGTH_MARK))
    lengths = index.where(is_length).select("doc", F.col("at").cast("long").alias("n_words")).distinct()
    index = index.where(~is_length)

    frequency = index.groupBy("term").agg(F.count("*").alias("postings"))
    windows = windows_of(words, frequency, window)
    pairs = windows.select("item", F.col("rare")[0].alias("a"), F.when(F.size("rare") > 1, F.col("rare")[1]).otherwise(F.col("rare")[0]).alias("b"))
    pairs = written(pairs.select("item", F.col("a.term").alias("term"), F.col("a.at").alias("item_at"),
                                 F.col("b.term").alias("term_b"), (F.col("b.at") - F.col("a.at")).alias("shift")).distinct(), "phrase-pairs")
    places = index.join(small(pairs, MAX_TERMS), "term").select(
        "doc", "item", (F.col("at") - F.col("item_at")).alias("diagonal"), F.col("term_b").alias("term"),
        (F.col("at") + F.col("shift")).alias("at")).distinct()
    second = index.join(small(written(pairs.select(F.col("term_b").alias("term")).distinct(), "phrase-second"), MAX_TERMS), "term", "left_semi")
    places = written(places.join(second, ["doc", "term", "at"], "left_semi").select("doc", "item", "diagonal").distinct(), "phrase-places")

    candidates = written(places.select("doc").distinct(), "phrase-documents")
    near = index.join(small(candidates, MAX_DOCS), "doc", "left_semi")
    cells = places.join(F.broadcast(words) if _few(words) else words, "item").select(
        "doc", "item", "diagonal", "n", F.col("at").alias("item_at"), "term", (F.col("diagonal") + F.col("at")).alias("at"))
    present = cells.join(near, ["doc", "term", "at"], "left_semi")
    width = F.least(F.lit(window), F.col("n"))
    first, last = F.greatest(F.lit(0), F.col("item_at") - width + 1), F.least(F.col("item_at"), F.col("n") - width)
    present = present.select("doc", "item", "diagonal", width.alias("width"), F.explode(F.sequence(first, last)).alias("start"))
    found = present.groupBy("doc", "item", "diagonal", "width", "start").agg(F.count("*").alias("cells")).where("cells = width")
    return found.select("doc", "item", (F.col("diagonal") + F.col("start")).alias("start"), "width"), lengths, words


def _few(df: DataFrame) -> bool:
    return df.limit(MAX_TERMS + 1).count() <= MAX_TERMS


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document key: n_words, n_hit, n_items, item_ids (sorted)."""
    matches, lengths, words = exact_matches(docs, items, window)
    matches = written(matches, "phrase-matches")
    hit = matches.select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("width") - 1)).alias("at")).distinct()
    n_hit = hit.groupBy("doc").agg(F.count("*").alias("n_hit"))
    names = words.select("item", "item_id").distinct()
    by_doc = matches.select("doc", "item").distinct().join(names, "item").groupBy("doc").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = lengths.join(n_hit, "doc", "left").join(by_doc, "doc", "left")
    return out.select("doc", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(docs, items, window)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), doc_key().alias("doc")).join(found, "doc").select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without an exact match, columns as they are."""
    dirty = written(contamination(docs, items, window).where("n_hit > 0").select(F.col("doc").alias("phrase_doc")), "phrase-dirty")
    dirty = small(dirty, MAX_DOCS)
    return docs.join(dirty, doc_key() == dirty.phrase_doc, "left_anti")


def proximity(docs: DataFrame, items: DataFrame, window: int = WINDOW, rare_terms: int = 3, span: int = 12) -> DataFrame:
    """(doc, item, start of the window in the item, at): places where the
    ``rare_terms`` rarest terms of a window lie, in any order, within ``span``
    words of the rarest one's posting ``at``."""
    words = written(item_words(items, window).withColumn("term", F.xxhash64("word")), "phrase-items")
    index = build_index(docs, written(words.select("word", "term").distinct(), "phrase-terms"))
    frequency = index.groupBy("term").agg(F.count("*").alias("postings"))
    rare = windows_of(words, frequency, window).select(
        "item", F.col("start").alias("item_start"), F.transform(F.slice("rare", 1, rare_terms), lambda r: r["term"]).alias("terms"))
    rare = written(rare.select("item", "item_start", F.array_distinct("terms").alias("terms")), "phrase-rare")
    anchors = index.join(small(rare.select(F.col("terms")[0].alias("term"), "item", "item_start", "terms"), MAX_TERMS), "term")
    # a posting and its neighbours within the span lie in the same or the next bin of positions
    probe = anchors.select("doc", "item", "item_start", "at", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    probe = probe.withColumn("bin", F.explode(F.sequence(F.floor((F.col("at") - span) / span), F.floor((F.col("at") + span) / span))))
    near = index.select("doc", "term", F.col("at").alias("found"), F.floor(F.col("at") / span).alias("bin"))
    hits = probe.join(near, ["doc", "term", "bin"]).where(F.abs(F.col("found") - F.col("at")) <= span)
    return hits.groupBy("doc", "item", "item_start", "at", "n").agg(F.countDistinct("term").alias("seen")).where("seen = n").select(
        "doc", "item", "item_start", "at")
