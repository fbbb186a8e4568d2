"""Suffix-array dedup: removes bytes of strings that occur twice or more.

The corpus's suffix array is sparse: ``windows`` finds the places that can
start a repeated string (see there), and the suffixes around them are sorted
by ``deep_shallow_sort``, group by group: multikey quicksort on eight bytes at
a time to ``SHALLOW`` bytes, then a blind trie orders each group that still
has a long common prefix.  A group's windows reach to both sides of its core,
so two suffix arrays are made: of what follows the core's start, and (read
backwards) of what precedes it.  Windows are equal where both arrays' LCP says
so; counts are summed over equal windows.

A full suffix array of all bytes would shuffle eight bytes and more per byte
of text (over 13 times the compressed input); the sparse one gives the same
result from about one place per 170 bytes.

Defined results: null or empty text has no bytes; rows that repeat count as
documents of their own (their text occurs twice); texts shorter than the
window lose nothing; other columns are ignored; nulls in doc_id stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks
from huddle.llm.windows import BYTES_400, Spec, Text, covered, documents, ranges, repeated

SHALLOW = 16


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    x = int.from_bytes(a) ^ int.from_bytes(b)
    return n - (x.bit_length() + 7) // 8


class _Node:
    __slots__ = ("depth", "kids")

    def __init__(self, depth: int):
        self.depth, self.kids = depth, {}


def _at(s: bytes, depth: int) -> int:
    return s[depth] if depth < len(s) else -1


class BlindTrie:
    """Inner nodes keep a depth and the byte there by child; leaves are lists
    of equal strings.  To insert, descend by those bytes only, compare with
    the one leaf found, and branch where the strings first differ."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is _Node:
            node = node.kids.get(_at(s, node.depth)) or next(iter(node.kids.values()))
        t = self.strings[node[0]]
        depth = common_prefix(s, t)
        if depth == len(s) == len(t):
            node.append(i)
            return
        above, node = None, self.root
        while type(node) is _Node and node.depth < depth:
            above, node = node, node.kids[_at(s, node.depth)]
        if type(node) is _Node and node.depth == depth:
            node.kids[_at(s, depth)] = [i]
            return
        new = _Node(depth)
        new.kids[_at(t, depth)], new.kids[_at(s, depth)] = node, [i]
        if above is None:
            self.root = new
        else:
            above.kids[_at(s, above.depth)] = new

    def order(self) -> tuple[list[int], list[int]]:
        """Strings in order; common prefix of each with the one before."""
        out, lcp = [], []
        stack = [(self.root, 0)]
        while stack:
            node, before = stack.pop()
            if type(node) is _Node:
                keys = sorted(node.kids)
                stack += [(node.kids[k], node.depth) for k in keys[:0:-1]]
                stack.append((node.kids[keys[0]], before))
            else:
                out += node
                lcp += [before] + [len(self.strings[node[0]])] * (len(node) - 1)
        return out, lcp


def deep_shallow_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``strings``, and each one's common prefix with the one before
    it in that order."""
    order: list[int] = []
    lcp: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        rows, depth = stack.pop()
        if not rows:
            continue
        if len(rows) == 1 or depth >= SHALLOW:
            if len(rows) == 1:
                own, prefix = rows, [0]
            else:
                trie = BlindTrie(strings)
                for i in rows:
                    trie.insert(i)
                own, prefix = trie.order()
            if order:
                prefix[0] = common_prefix(strings[order[-1]], strings[own[0]])
            order += own
            lcp += prefix
            continue
        digits = [strings[i][depth:depth + 8] for i in rows]
        pivot = sorted((digits[0], digits[len(digits) // 2], digits[-1]))[1]
        parts: tuple[list, list, list] = [], [], []
        for i, x in zip(rows, digits):
            parts[(x >= pivot) + (x > pivot)].append(i)
        # a string that ends here is equal to all others in its part
        deeper = depth + 8 if len(pivot) == 8 else SHALLOW
        stack += [(parts[2], depth), (parts[1], deeper), (parts[0], depth)]
    return np.array(order, np.int64), np.array(lcp, np.int64)


def _by_prefix(strings: list[bytes]):
    """A function of a length: class numbers of the strings by that prefix."""
    order, lcp = deep_shallow_sort(strings)

    def classes(length: int) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = np.cumsum(lcp < length)
        return out
    return classes


def solve(spec: Spec):
    def run(rows: list[tuple]) -> Iterator[tuple]:
        core, full, lo, hi, n, least, units = (list(c) for c in zip(*rows))
        lo, hi, n = (np.array(c, np.int64) for c in (lo, hi, n))
        group = np.unique(np.array(core, np.int64), return_inverse=True)[1]
        # places are counted from the least of the core, whatever its chunk
        lowest = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, group, lo)
        base = lowest[group]
        split = (hi - base).tolist()
        after = _by_prefix([u[k:] for u, k in zip(units, split)])
        ahead = _by_prefix([u[:k][::-1] for u, k in zip(units, split)])
        places: list[list[int]] = [[] for _ in rows]
        for e in range(int((hi - base).max()) + 1):
            on = np.flatnonzero((lo - base <= e) & (e <= hi - base))
            if len(on) < 1:
                continue
            key = np.stack([group[on], ahead(e)[on], after(spec.width - e)[on]], 1)
            code = (key[:, 0] * (len(rows) + 1) + key[:, 1]) * (len(rows) + 1) + key[:, 2]
            same = np.unique(code, return_inverse=True)[1]
            total = np.bincount(same, weights=n[on])
            for i in on[total[same] > 1].tolist():
                places[i].append(int(base[i]) + e)
        for i, found in enumerate(places):
            for first, last, _ in ranges(found, [2] * len(found)):
                yield core[i], full[i], first, last, 2, least[i]
    return run


RESULT = "doc long, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            out = []
            for doc, doc_id, text, marks in zip(block["doc"], block["doc_id"], block["text"], block["marks"]):
                t = Text(text, spec)
                gone = covered(spec, t.n, marks)
                spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(np.int8)]) == 1))
                kept = np.frombuffer(t.raw, np.uint8)[~gone].tobytes()
                out.append((doc, doc_id, t.n, int(gone.sum()), spans, kept))
            names = [f.split()[0] for f in RESULT.split(", ")]
            kinds = [pa.int64()] * 5 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    return run


def removed(docs: DataFrame, spec: Spec = BYTES_400) -> DataFrame:
    """The documents that lose bytes: doc, doc_id, n_bytes, n_removed,
    n_spans (maximal removed runs), kept (the remaining bytes)."""
    suspects, verdicts = repeated(docs, spec, solve(spec))
    marks = verdicts.groupBy("doc").agg(F.collect_list(F.struct("spot", "first", "last")).alias("marks"))
    return suspects.select("doc", "doc_id", "text").join(marks, "doc").mapInArrow(_remove(spec), RESULT)


def report(docs: DataFrame, spec: Spec = BYTES_400) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    found = removed(docs, spec).select("doc", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).distinct()
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = documents(docs).select("doc", "doc_id", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return rows.join(found, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
