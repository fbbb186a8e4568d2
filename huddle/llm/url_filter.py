"""URL filters: rules first, then gradient-boosted trees on lexical features.

A rule is a host and the start of a path, ``allow`` or ``block``; it fits its
host and all subdomains where the path starts with the rule's.  The longest
fitting rule (host and path together) decides; of equally long ones the first
by (rule, verdict).  URLs without a rule are judged by second-order boosted
trees (``huddle.operators.boosting``) on: lengths of URL, host and path; depth;
host labels; digit ratio; Shannon entropy of the characters; number of
parameters; hyphens of the host; and, for the last host label, the last two and
the first path segment, the smoothed share of blocked URLs and how many
labelled URLs there are.

The trees are trained from labelled URLs, by default those a rule decides:
each distinct URL once.  Suffix statistics count all labelled URLs; the trees
are fitted on about ``sample`` of them at most, those whose hash lies below a
bound, which is every one while there are no more.  The fitted trees are
constants of the plan, so judging is one scan with the small table of suffix
statistics joined (broadcast while it has few rows).

Built-in functions only.  Rules are constants of the plan, at most
``MAX_RULES``.

Defined results: a null URL, or one without ``://``, has an empty host and
path and fits no rule; a URL with both labels counts as each; without
labelled URLs of both kinds, every URL without a rule gets the kind there is
(``allow`` if none); a null ``page_id`` is carried through; repeated rows give
repeated rows; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import let, small, written
from huddle.operators.boosting import BoostedModel, BoostSpec, binned, candidate_thresholds, fit_boosted

MAX_RULES = 1000
SAMPLE = 50_000
#: Weight of the overall share in a suffix's share of blocked URLs.
PRIOR = 20.0
FEW_SUFFIXES = 100_000
TREES = BoostSpec(rounds=20, depth=4, rate=0.3)

LEXICAL = ("n_url", "n_host", "n_path", "depth", "n_labels", "digit_ratio", "entropy", "n_params", "n_hyphens")
SUFFIX = ("share1", "count1", "share2", "count2", "share3", "count3")
FEATURES = LEXICAL + SUFFIX


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    """``org/`` is host org, path /; the path begins at the first slash."""
    if verdict not in ("allow", "block"):
        raise ValueError(verdict)
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), rest.alias("rest"))
    rows = rows.withColumn("raw_host", F.regexp_extract("rest", "^[^/?#]*", 0))
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    after = F.substring(F.col("rest"), F.length("raw_host") + 1, F.length("rest"))
    return rows.select("page_id", "url", F.translate("raw_host", upper, upper.lower()).alias("host"),
                       F.regexp_extract(after, "^[^?#]*", 0).alias("path"))


def deciding_rule(rules: Sequence[Rule], host: Column, path: Column) -> Column:
    """Struct (rule, verdict) of the longest fitting rule; null if none fits."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(set(rules), key=lambda r: (-len(r.name), r.name, r.verdict), reverse=True):
        of_host = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        found = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(of_host & F.startswith(path, F.lit(r.path)), found).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters of ``text``, 0 if empty."""
    n = F.length(text)

    def bits(c: Column) -> Column:
        share = (n - F.length(F.replace(text, c, F.lit("")))) / n
        return -share * F.log2(share)

    kinds = F.array_sort(F.array_distinct(F.split(text, "")))
    return F.when(n == 0, 0.0).otherwise(
        F.aggregate(F.filter(kinds, lambda c: c != ""), F.lit(0.0), lambda s, c: s + bits(c)))


def lexical(rows: DataFrame) -> DataFrame:
    """``with_parts`` rows with the lexical features, the suffixes and the first
    path segment (``suffix3``)."""
    def count_of(text: Column, chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))

    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.length(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    bare = F.regexp_replace(host, "^.*@|:[0-9]*$", "")
    return rows.withColumns({
        "n_url": n, "n_host": F.length(host), "n_path": F.length(path), "depth": count_of(path, "/"),
        "n_labels": F.when(host == "", 0).otherwise(count_of(host, ".") + 1),
        "digit_ratio": F.when(n > 0, count_of(url, "0-9") / n).otherwise(0.0), "entropy": let(url, entropy),
        "n_params": F.when(query == "", 0).otherwise(count_of(query, "&;") + 1), "n_hyphens": count_of(host, r"\-"),
        "suffix1": F.substring_index(bare, ".", -1), "suffix2": F.substring_index(bare, ".", -2),
        "suffix3": F.regexp_extract(path, "^/([^/]*)", 1)})


def suffix_statistics(labelled: DataFrame) -> list[DataFrame]:
    """For the last label, the last two and the segment: (suffix, share, count)."""
    whole = labelled.agg(F.avg(F.col("blocked").cast("double")).alias("s")).first()["s"] or 0.0
    n, bad = F.count("*"), F.count_if("blocked")
    return [labelled.groupBy(f"suffix{k}").agg(((bad + PRIOR * whole) / (n + PRIOR)).alias(f"share{k}"),
                                               n.cast("double").alias(f"count{k}")) for k in (1, 2, 3)]


def with_statistics(rows: DataFrame, statistics: Sequence[DataFrame]) -> DataFrame:
    """Suffixes never seen get the share -1 and the count 0."""
    for k, s in enumerate(statistics, 1):
        rows = rows.join(small(s, FEW_SUFFIXES), f"suffix{k}", "left")
    return rows.fillna(0.0, ["count1", "count2", "count3"]).fillna(-1.0, ["share1", "share2", "share3"])


class Filter(NamedTuple):
    """A fitted model with the statistics its features need."""
    model: BoostedModel
    statistics: list[DataFrame]

    def blocked(self, rows: DataFrame) -> DataFrame:
        """``lexical`` rows with ``blocked``, the model's verdict."""
        rows = with_statistics(rows, self.statistics)
        return rows.withColumn("blocked", self.model.margin() > 0)


def fit(labelled: DataFrame, sample: int = SAMPLE, spec: BoostSpec = TREES) -> Filter:
    """``labelled``: ``with_parts`` rows with a boolean ``blocked``."""
    rows = written(lexical(labelled.select("url", "host", "path", "blocked").distinct()), "url-labelled")
    statistics = [written(s, "url-suffixes") for s in suffix_statistics(rows)]
    n = rows.count()
    if n > sample:  # about `sample` of them, the same on every run
        rows = rows.where(F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < int((1 << 30) * sample / n))
    rows = written(with_statistics(rows, statistics), "url-sample")
    thresholds = candidate_thresholds(rows, FEATURES, exact=True)
    rows = rows.select(F.lit(0).alias("model"), F.lit(True).alias("fit"), F.col("blocked").cast("double").alias("y"),
                       binned(FEATURES, thresholds).alias("bins"))
    return Filter(fit_boosted(rows, [spec], FEATURES, thresholds)[0], statistics)


def judge(pages: DataFrame, rules: Sequence[Rule], labelled: DataFrame | None = None, sample: int = SAMPLE,
          spec: BoostSpec = TREES) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict.

    ``labelled`` (url, blocked) trains the model; without it the pages that a
    rule decides do."""
    rows = with_parts(pages).withColumn("found", deciding_rule(rules, F.col("host"), F.col("path")))
    if labelled is None:
        known = rows.where(F.col("found").isNotNull()).withColumn("blocked", F.col("found.verdict") == "block")
    else:
        known = with_parts(labelled.select("url", F.col("blocked").cast("long").alias("page_id"))).withColumn(
            "blocked", F.col("page_id") == 1).where(F.col("blocked").isNotNull())
    model = fit(known, sample, spec)
    out = model.blocked(lexical(rows))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
