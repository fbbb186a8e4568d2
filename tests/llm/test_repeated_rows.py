"""Suffix-array and substring dedup with many rows of the same id and text."""

import random
from collections import Counter

import pytest

from huddle.llm import substring_dedup, suffix_dedup, windows
from tests.llm.test_operators import brute_bytes, brute_words


def make():
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(200)]
    text = [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(3)]
    return [(None, text[0])] * 40 + [(7, text[1])] * 5 + [(8, text[1][200:] + " z")] + [(9, text[2]), (None, None), (None, None), (9, "")]


@pytest.mark.parametrize("solve, spec", [(suffix_dedup.solve, windows.BYTES_400), (substring_dedup.solve, windows.WORDS_50)])
def test_repeated_rows_are_one_document(spark, solve, spec):
    df = spark.createDataFrame(make(), "doc_id long, text string").repartition(4)
    suspects, verdicts = windows.repeated(df, spec, solve(spec))
    rows = suspects.collect()
    assert Counter((r.doc_id, r.copies) for r in rows) == {(None, 40): 1, (7, 5): 1, (8, 1): 1}
    # each spot of a text is there once, not once a row
    for r in rows:
        assert len(r.spots) == len({(s["core"], s["spot"]) for s in r.spots}) < len(r.text)
    assert verdicts.where("doc_id is null").agg({"n": "max"}).first()[0] == 40


def test_results_of_repeated_rows(spark):
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for report, brute in ((suffix_dedup.report, brute_bytes), (substring_dedup.report, brute_words)):
        assert sorted(str(tuple(r)) for r in report(df).collect()) == sorted(str(tuple(r)) for r in brute(rows))
