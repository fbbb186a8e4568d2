"""Repeated windows of a corpus: shared candidate search of two operators.

A document is a sequence of units (bytes, or words of its text joined by one
blank).  A window is ``width`` consecutive units.  Which windows occur more
than once is found without moving every window:

1. Anchors.  Each window has one anchor: the place of the smallest hash among
   its ``gram``-unit n-grams (leftmost on ties), which depends on the window's
   content alone.  Neighbouring windows share anchors, about one per
   ``(width - gram) / 2`` units.  A *spot* is a run of windows with the same
   anchor, cut to ``chunk`` places of the anchor in the window.
2. Cores.  All windows of a spot contain its *core*, the units that every
   place of the chunk has in common.  Equal windows have equal cores, so spots
   whose core occurs once in the corpus are done.  (Only hashes are moved.)
3. Documents with remaining spots are written with their spots.  Equal spots
   (128-bit hash of all their units) become one *class* with the number of
   spots and the least doc_id, before anything else is shuffled: a group of
   copies is one class.
4. Cores with one class are decided by its count.  For cores with several
   classes, one text of each is sent to the core's group, where the operator's
   own method compares the windows (``solve``).  Where a core has more than
   ``Spec.group`` classes, its chunk of places is split in the next finer chunks
   (``Spec.finer``): windows of fewer places have more units in common, so the
   parts have longer cores, equal parts are one class again, and step 4 starts
   anew with them, down to parts of one place, which are their own cores.
5. Verdicts go back from parts to classes, by class to the spots, and by
   document to the texts.

Rows that repeat doc_id (null included) and text are one document here, with
their number as ``copies``: every spot of it counts as often.  Callers give a
document's verdict to each of its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks, small, written

PIECE = 1 << 20
#: Keys of repeated rows that are broadcast at most; beyond, joins shuffle.
MAX_KEYS = 200_000
_PLACE = np.uint64((1 << 24) - 1)
_R = 0x9E3779B97F4A7C15 | 1
_SPOT_BITS = 10


@dataclass(frozen=True)
class Spec:
    words: bool
    width: int
    gram: int
    chunk: int
    #: classes of one core that one task compares at most
    group: int
    #: chunks that larger cores are split in, level by level; each divides the
    #: one before, the last is one place
    finer: tuple[int, ...]


BYTES_400 = Spec(False, 400, 64, 169, 2_000, (13, 1))
WORDS_50 = Spec(True, 50, 8, 22, 500, (11, 1))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    r, inv = _R, pow(_R, -1, 1 << 64)
    out = []
    for base in (r, inv):
        p = np.full(n + 1, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Text:
    """A document as bytes, with the bounds of its units."""

    def __init__(self, text: str, spec: Spec):
        raw = text.encode("utf-8", "surrogatepass")
        self.spec = spec
        if spec.words:
            words = raw.split()
            self.raw, self.n = b" ".join(words), len(words)
            blank = np.flatnonzero(np.frombuffer(self.raw, np.uint8) == 32)
            self.start = np.r_[0, blank + 1] if words else np.zeros(0, np.int64)
            self.end = np.r_[blank, len(self.raw)] if words else np.zeros(0, np.int64)
        else:
            self.raw, self.n = raw, len(raw)

    def span(self, a: int, b: int) -> bytes:
        """Units a to b, b not included (a < b)."""
        return self.raw[self.start[a]:self.end[b - 1]] if self.spec.words else self.raw[a:b]

    def unit_hashes(self, a: int, b: int) -> np.ndarray:
        if not self.spec.words:
            return _BYTE[np.frombuffer(self.raw, np.uint8, b - a, a)]
        first, last = int(self.start[a]), int(self.end[b - 1])
        h = _BYTE[np.frombuffer(self.raw, np.uint8, last - first, first)]
        p, inv = _powers(max(PIECE, 1 << (len(h)).bit_length()))
        total = np.r_[np.uint64(0), np.cumsum(h * p[:len(h)], dtype=np.uint64)]
        s, e = self.start[a:b] - first, self.end[a:b] - first
        return _mix((total[e] - total[s]) * inv[s])


def spots(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, least and greatest place of the anchor) of every spot."""
    spec, out = text.spec, []
    for a in range(0, max(0, text.n - spec.width + 1), PIECE):
        b = min(text.n, a + PIECE + spec.width - 1)
        out.append(_spots(text.unit_hashes(a, b), spec, a))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate([o[k] for o in out]) for k in range(3))


def _spots(units: np.ndarray, spec: Spec, offset: int):
    k, n = spec.gram, len(units)
    p, inv = _powers(max(PIECE, 1 << n.bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(units * p[:n], dtype=np.uint64)]
    grams = _mix((total[k:] - total[:-k]) * inv[:n - k + 1])
    keyed = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)
    w = spec.width - k + 1
    pad = -len(keyed) % w
    rows = np.r_[keyed, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))].reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    m = len(keyed) - w + 1
    anchor = (np.minimum(behind[:m], ahead[w - 1:w - 1 + m]) & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], m] - 1
    at = anchor[first]
    lo, hi = at - last, at - first
    c0, c1 = lo // spec.chunk, hi // spec.chunk
    times = c1 - c0 + 1
    which = np.repeat(np.arange(len(at)), times)
    c = c0[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return at[which] + offset, np.maximum(lo[which], c * spec.chunk), np.minimum(hi[which], (c + 1) * spec.chunk - 1)


def pack_spot(at, lo, hi):
    return (at << 2 * _SPOT_BITS) | (lo << _SPOT_BITS) | hi


def unpack_spot(spot):
    mask = (1 << _SPOT_BITS) - 1
    return spot >> 2 * _SPOT_BITS, (spot >> _SPOT_BITS) & mask, spot & mask


def core_bounds(spec: Spec, at: int, lo: int) -> tuple[int, int]:
    """The units that all windows of a chunk have whose anchor is at ``at``."""
    c = lo // spec.chunk
    last = min((c + 1) * spec.chunk - 1, spec.width - spec.gram)
    return at - c * spec.chunk, at - last + spec.width


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _find_spots(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest
        for block in blocks(batches):
            docs, cores, all_spots, all_copies = [], [], [], []
            for key, text, copies in zip(block["doc"], block["text"], block["copies"]):
                t = Text(text, spec)
                at, lo, hi = spots(t)
                docs.append(np.full(len(at), key, np.int64))
                all_spots.append(pack_spot(at, lo, hi))
                all_copies.append(np.full(len(at), copies, np.int64))
                cores += [_signed(xxh3_64_intdigest(t.span(*core_bounds(spec, a, x)), x // spec.chunk))
                          for a, x in zip(at.tolist(), lo.tolist())]
            yield pa.record_batch([pa.array(cores, pa.int64()), pa.array(np.concatenate(docs)),
                                   pa.array(np.concatenate(all_spots)), pa.array(np.concatenate(all_copies))],
                                  ["core", "doc", "spot", "copies"])
    return run


def _classify(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest
        for block in blocks(batches):
            out = {"core": [], "full": [], "doc": [], "doc_id": [], "spot": [], "copies": []}
            for doc, doc_id, text, copies, found in zip(*(block[c] for c in ("doc", "doc_id", "text", "copies", "spots"))):
                t = Text(text, spec)
                for s in found:
                    at, lo, hi = unpack_spot(s["spot"])
                    out["core"].append(s["core"])
                    out["full"].append(xxh3_128_digest(t.span(at - hi, at - lo + spec.width), lo << _SPOT_BITS | hi))
                    out["doc"].append(doc)
                    out["doc_id"].append(doc_id)
                    out["spot"].append(s["spot"])
                    out["copies"].append(copies)
            yield pa.record_batch([pa.array(out["core"], pa.int64()), pa.array(out["full"], pa.binary()),
                                   *[pa.array(out[c], pa.int64()) for c in ("doc", "doc_id", "spot", "copies")]], list(out))
    return run


CLASS = "core long, full binary, lo int, hi int, n long, least long, units binary"


def _fetch(spec: Spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["core", "full", "lo", "hi", "n", "least", "units"]
        kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        for block in blocks(batches):
            rows = []
            for text, wanted in zip(block["text"], block["wanted"]):
                t = Text(text, spec)
                for x in wanted:
                    at, lo, hi = unpack_spot(x["spot"])
                    rows.append((x["core"], x["full"], lo, hi, x["n"], x["least"], t.span(at - hi, at - lo + spec.width)))
                if len(rows) > 8000:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
    return run


PART = CLASS.replace("core long, full binary", "core long, full binary, part_core long, part_full binary")


def _split(spec: Spec):
    """Every class of a large core in parts by the chunks of ``spec``, which
    are finer than the class's; each part with its own core."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in PART.split(", ")]
        for block in blocks(batches, "units", 1 << 19):
            out: list[tuple] = []
            for core, full, lo, hi, n, least, units in zip(*(block[c] for c in ("core", "full", "lo", "hi", "n", "least", "units"))):
                t = units.split(b" ") if spec.words else units
                for c in range(lo // spec.chunk, hi // spec.chunk + 1):
                    a, b = max(lo, c * spec.chunk), min(hi, (c + 1) * spec.chunk - 1)
                    # the class's units start where the anchor has the place hi
                    start, end = core_bounds(spec, hi, a)
                    common, own = t[start:end], t[hi - b:hi - a + spec.width]
                    if spec.words:
                        common, own = b" ".join(common), b" ".join(own)
                    part = _signed(xxh3_64_intdigest(core.to_bytes(8, "little", signed=True) + common, c))
                    out.append((core, full, part, xxh3_128_digest(own, a << _SPOT_BITS | b), a, b, n, least, own))
            if out:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
    return run


VERDICT = "core long, full binary, first int, last int, n long, least long"


def ranges(places: list[int], value: list) -> list[tuple]:
    """(first, last, value) of runs of following places with equal values."""
    out: list[list] = []
    for p, v in zip(places, value):
        if out and out[-1][1] == p - 1 and out[-1][2] == v:
            out[-1][1] = p
        else:
            out.append([p, p, v])
    return [tuple(x) for x in out]


def _solve_groups(solve: Callable):
    """``solve(classes)`` for each core's classes, which come together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done(rows):
            cols = ["core", "full", "first", "last", "n", "least"]
            kinds = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            out = list(solve(rows))
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], cols) if out else None

        for batch in batches:
            d = batch.to_pydict()
            for row in zip(d["core"], d["full"], d["lo"], d["hi"], d["n"], d["least"], d["units"]):
                # several small groups are solved together
                if len(held) >= 2000 and held[-1][0] != row[0]:
                    if (x := done(held)) is not None:
                        yield x
                    held = []
                held.append(row)
        if held and (x := done(held)) is not None:
            yield x
    return run


def documents(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text) with a key of the row: a hash of doc_id and text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select(F.xxhash64("doc_id", "text").alias("doc"), "doc_id", "text")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """``documents`` without repeated rows, and the number of rows of each as
    ``copies``.  Only rows that share their key are grouped, by counts that
    Spark adds up in parts; the texts of all others stay where they are."""
    rows = documents(docs)
    keys = written(rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc"), "window-keys")
    keys = small(keys, MAX_KEYS)
    again = written(rows.join(keys, "doc", "left_semi").groupBy("doc", "doc_id", "text").agg(F.count("*").alias("copies")), "window-copies")
    once = rows.join(keys, "doc", "left_anti").select("doc", "doc_id", "text", F.lit(1).cast("long").alias("copies"))
    return once.union(again)


def repeated(docs: DataFrame, spec: Spec, solve: Callable) -> tuple[DataFrame, DataFrame]:
    """(suspects, verdicts).  ``suspects``: distinct documents with shared
    cores, as (doc, doc_id, text, copies, spots).  ``verdicts``: (doc, doc_id, spot,
    first, last, n, least): the spot's windows with the anchor at the places
    from first to last (null: all of the spot) occur ``n`` times or more,
    first in document ``least``; windows that occur once are left out.
    ``solve``: verdicts of the classes of whole cores, whatever their chunk."""
    rows = distinct_documents(docs)
    found = rows.select("doc", "text", "copies").mapInArrow(_find_spots(spec), "core long, doc long, spot long, copies long")
    found = written(found, "window-found")
    shared = written(found.groupBy("core").agg(F.sum("copies").alias("n")).where("n > 1").select("core"), "window-cores")
    by_doc = found.join(shared, "core", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("core", "spot")).alias("spots"))
    suspects = written(rows.join(by_doc, "doc"), "window-suspects")

    seen = suspects.mapInArrow(_classify(spec), "core long, full binary, doc long, doc_id long, spot long, copies long")
    seen = written(seen, "window-spots")
    classes = seen.groupBy("core", "full").agg(F.sum("copies").alias("n"), F.min("doc_id").alias("least"),
                                               F.min(F.struct("doc", "spot")).alias("one"))
    classes = written(classes, "window-classes")
    mixed = written(classes.groupBy("core").agg(F.count("*").alias("classes")).where("classes > 1"), "window-mixed")
    whole = classes.join(mixed, "core", "left_anti").where("n > 1").select(
        "core", "full", F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"), "n", "least")

    wanted = classes.join(mixed, "core").select("core", "full", "n", "least", "one.doc", "one.spot")
    wanted = wanted.groupBy("doc").agg(F.collect_list(F.struct("core", "full", "spot", "n", "least")).alias("wanted"))
    texts = suspects.select("doc", "text").dropDuplicates(["doc"]).join(wanted, "doc").mapInArrow(_fetch(spec), CLASS)
    texts = written(texts, "window-texts")
    verdicts = whole.union(_compare(texts, spec, solve, spec.finer))
    return suspects, seen.join(verdicts, ["core", "full"]).select("doc", "doc_id", "spot", "first", "last", "n", "least")


def _compare(classes: DataFrame, spec: Spec, solve: Callable, finer: tuple[int, ...]) -> DataFrame:
    """Verdicts on the classes (``CLASS``, written) of cores with several."""
    large = classes.groupBy("core").agg(F.count("*").alias("classes")).where(F.col("classes") > spec.group).select("core")
    large = written(large, "window-large") if finer else None
    split = large is not None and not large.isEmpty()
    normal = classes.join(large, "core", "left_anti") if split else classes
    normal = normal.repartition("core").sortWithinPartitions("core", "full")
    verdicts = normal.mapInArrow(_solve_groups(solve), VERDICT)
    if not split:
        return verdicts

    spec, finer = replace(spec, chunk=finer[0]), finer[1:]
    parts = classes.join(large, "core", "left_semi").mapInArrow(_split(spec), PART)
    parts = written(parts, "window-parts")
    equal = parts.groupBy(F.col("part_core").alias("core"), F.col("part_full").alias("full")).agg(
        F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"), F.sum("n").alias("n"), F.min("least").alias("least"),
        F.any_value("units").alias("units"))
    equal = written(equal, "window-part-classes")
    mixed = written(equal.groupBy("core").agg(F.count("*").alias("classes")).where("classes > 1").select("core"), "window-part-mixed")
    whole = equal.join(mixed, "core", "left_anti").where("n > 1").select(
        "core", "full", F.col("lo").alias("first"), F.col("hi").alias("last"), "n", "least")
    several = written(equal.join(mixed, "core", "left_semi"), "window-part-texts")
    found = whole.union(_compare(several, spec, solve, finer)).withColumnsRenamed({"core": "part_core", "full": "part_full"})
    back = parts.select("core", "full", "part_core", "part_full").join(found, ["part_core", "part_full"])
    return verdicts.union(back.select("core", "full", "first", "last", "n", "least"))


def covered(spec: Spec, n_units: int, marks: list) -> np.ndarray:
    """Which units lie in a window of ``marks`` (spot, first, last)."""
    edge = np.zeros(n_units + 1, np.int64)
    if marks:
        spot = np.array([m["spot"] for m in marks], np.int64)
        at, lo, hi = unpack_spot(spot)
        first, last = (np.array([-1 if m[c] is None else m[c] for m in marks], np.int64) for c in ("first", "last"))
        np.add.at(edge, at - np.where(last < 0, hi, last), 1)
        np.add.at(edge, at - np.where(first < 0, lo, first) + spec.width, -1)
    return np.cumsum(edge[:-1]) > 0
