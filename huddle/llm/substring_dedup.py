"""Substring dedup: removes word runs that an earlier document has.

The reference is the corpus itself, cut into shards: ``windows`` puts all
passages that share a core (see there) into one shard, copies as one passage.
For each shard a suffix automaton of its passages is built, every state with
the least doc_id of its occurrences; each passage is streamed through it for
matching statistics, held at the window's length, and where the match is that
long the state tells which document has it first.

The automata are not broadcast: the reference grows with the corpus, and a
broadcast needs a proven bound.  Passages are shuffled to their shard instead,
which gives the same statistics; shards have a fixed greatest size.

Defined results: null or empty text has no words; rows with the same doc_id
are one document (nothing is removed for each other's sake); a null doc_id
comes after all others, and rows without one keep what only they share; other
columns are ignored; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks
from huddle.llm.windows import WORDS_50, Spec, Text, covered, documents, ranges, repeated

_LATE = 1 << 63


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.len = [-1], [0]
        self.first, self.count = [_LATE], [0]

    def _state(self, length: int, nxt: dict, link: int) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.first.append(_LATE)
        self.count.append(0)
        return len(self.len) - 1

    def _clone(self, p: int, c, q: int) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, c) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        new = self._state(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return new

    def add(self, words: list, first: int, count: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.first[last] = min(self.first[last], first)
            self.count[last] += count

    def finish(self) -> None:
        """Carry every state's occurrences to the states of its suffixes."""
        for s in sorted(range(1, len(self.len)), key=self.len.__getitem__, reverse=True):
            p = self.link[s]
            self.first[p] = min(self.first[p], self.first[s])
            self.count[p] += self.count[s]

    def matches(self, words: list, width: int) -> Iterator[tuple[int, int, int]]:
        """(end, least document, occurrences) wherever the last ``width``
        words up to ``end`` are in the reference."""
        state = length = 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            while state and self.len[self.link[state]] >= width:
                state = self.link[state]
                length = self.len[state]
            if length >= width:
                yield i, self.first[state], self.count[state]


def solve(spec: Spec):
    def run(rows: list[tuple]) -> Iterator[tuple]:
        at = 0
        while at < len(rows):
            end = at
            while end < len(rows) and rows[end][0] == rows[at][0]:
                end += 1
            yield from _shard(rows[at:end])
            at = end

    def _shard(rows: list[tuple]) -> Iterator[tuple]:
        texts = [r[6].split(b" ") for r in rows]
        sam = SuffixAutomaton()
        for (_, _, _, _, n, least, _), words in zip(rows, texts):
            sam.add(words, _LATE if least is None else least, n)
        sam.finish()
        for (core, full, lo, hi, _, _, _), words in zip(rows, texts):
            places, first = [], []
            for i, doc, count in sam.matches(words, spec.width):
                if count > 1:
                    places.append(hi - (i - spec.width + 1))
                    first.append(doc)
            for b, a, doc in _falling(places, first):
                if doc != _LATE:
                    yield core, full, a, b, 2, doc
    return run


def _falling(places: list[int], first: list[int]) -> list[tuple]:
    return [(b, a, v) for a, b, v in ranges(places[::-1], first[::-1])]


RESULT = "doc long, doc_id long, n_words long, n_removed long, kept string"


def _remove(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = []
            for doc, doc_id, text, marks in zip(block["doc"], block["doc_id"], block["text"], block["marks"]):
                words = text.encode("utf-8", "surrogatepass").split()
                gone = covered(spec, len(words), marks)
                kept = b" ".join(w for w, x in zip(words, gone.tolist()) if not x)
                out.append((doc, doc_id, len(words), int(np.count_nonzero(gone)), kept.decode("utf-8", "surrogatepass")))
            names = [f.split()[0] for f in RESULT.split(", ")]
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    return run


def removed(docs: DataFrame, spec: Spec = WORDS_50) -> DataFrame:
    """The documents that lose words: doc, doc_id, n_words, n_removed, kept
    (the remaining words, joined by one blank)."""
    suspects, verdicts = repeated(docs, spec, solve(spec))
    later = (F.col("least") < F.col("doc_id")) | (F.col("doc_id").isNull() & F.col("least").isNotNull())
    marks = verdicts.where(later).groupBy("doc").agg(F.collect_list(F.struct("spot", "first", "last")).alias("marks"))
    return suspects.select("doc", "doc_id", "text").join(marks, "doc").mapInArrow(_remove(spec), RESULT)


def report(docs: DataFrame, spec: Spec = WORDS_50) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    found = removed(docs, spec).select("doc", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")).distinct()
    words = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = documents(docs).select("doc", "doc_id", F.size(words).cast("long").alias("n_words"),
                                  F.sha2(F.array_join(words, " ").cast("binary"), 256).alias("whole"))
    return rows.join(found, "doc", "left").select(
        "doc_id", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
