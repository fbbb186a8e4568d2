"""Fill-in-middle transformation with cuts at line borders.

A text is a sequence of lines; a hash of the document's id picks two of the
n + 1 borders, which part it in prefix, middle and suffix, and the order in
which the parts are written (``spm`` or ``psm``), each after its marker.

Where the borders lie is found by memoized chunks.  A rolling hash (gear, 16
bytes, all positions of a block at once) cuts each text where its content says
so, so passages that texts share fall into equal chunks wherever they stand.
A chunk's summary (line breaks with their places, code points, markers, first
and last bytes) is computed once per content and kept in a cache bounded by
bytes; an entry answers only for bytes equal to its own.  A document's line
count is the sum over its chunks, and a border is found by the running counts
of its chunks and then inside one of them.  A text is never joined or shuffled:
each task works on the rows it reads.

Defined results: null text is empty; a null ``doc_id`` hashes as no digits;
empty texts, texts with a marker and those not chosen (``rate``) stay plain;
repeated rows give repeated rows; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks, id_and_text

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = (PREFIX, SUFFIX, MIDDLE)
WINDOW = 16
#: Chunks have 1 KB on average, and at least and at most so many bytes.
AVERAGE_BITS, LEAST, MOST = 10, 64, 8192
CACHE_BYTES = 64 << 20

LOCATED = "doc_id long, text string, n long, marked boolean, cut1 long, cut2 long"

_GEAR = np.random.default_rng(WINDOW).integers(0, 1 << 32, 256, dtype=np.uint32)
_MARKER_BYTES = tuple(m.encode() for m in MARKERS)


@dataclass(frozen=True)
class Spec:
    """``rate`` percent of the documents are transformed, ``spm`` percent of
    those with the suffix first."""
    seed: int = 7
    rate: int = 100
    spm: int = 50


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """For each byte the gear hash of the 16 bytes that end there: twice the
    window at each step."""
    h = _GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_ends(candidates: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of the text in [start, end): the first candidate at
    least LEAST bytes on, at most MOST bytes on."""
    found = candidates[np.searchsorted(candidates, start + LEAST):np.searchsorted(candidates, end)].tolist()
    out, at = [], start
    for c in found:
        while c - at > MOST:
            at += MOST
            out.append(at)
        if c - at >= LEAST:
            out.append(c)
            at = c
    while end - at > MOST:
        at += MOST
        out.append(at)
    if end > at:
        out.append(end)
    return out


class Summary:
    """What a document needs to know of a chunk."""

    __slots__ = ("content", "lines", "chars", "marked", "head", "tail", "after")

    def __init__(self, content: bytes):
        raw = np.frombuffer(content, np.uint8)
        lead = (raw & 0xC0) != 0x80
        breaks = np.flatnonzero(raw == 10)
        self.content, self.lines = content, len(breaks)
        if len(content) == (chars := int(lead.sum())):
            after = breaks + 1
        else:
            after = np.cumsum(lead)[breaks]
        #: code points of the chunk up to each line break, itself included
        self.after = after.astype(np.uint16)
        self.chars, self.marked = chars, any(m in content for m in _MARKER_BYTES)
        self.head, self.tail = content[:2], content[-2:]


class ChunkCache:
    """Summaries by content: found by a hash, given only for equal bytes.  Two
    generations of half the limit each: what was asked for lately stays."""

    def __init__(self, limit: int = CACHE_BYTES, digest=xxhash.xxh64_intdigest):
        self.half, self.digest = limit // 2, digest
        self.young, self.old, self.held = {}, {}, 0
        self.hits = self.misses = 0

    def get(self, content: bytes) -> Summary:
        key = self.digest(content)
        found = self.young.get(key)
        if found is not None and found.content == content:
            self.hits += 1
            return found
        found = self.old.get(key)
        if found is not None and found.content == content:
            self.hits += 1
        else:
            self.misses += 1
            found = Summary(content)
        self.young[key] = found
        self.held += 3 * len(content) + 400
        if self.held > self.half:
            self.old, self.young, self.held = self.young, {}, 0
        return found


def line_count(parts: list[Summary]) -> int:
    """Lines of the text that ``parts`` make up; the last may lack its break."""
    whole = sum(p.lines for p in parts)
    return whole + (1 if parts and not parts[-1].tail.endswith(b"\n") else 0)


def has_marker(parts: list[Summary]) -> bool:
    """Whether a marker lies in a chunk or across the border of two."""
    return any(p.marked for p in parts) or any(
        m in a.tail + b.head for a, b in zip(parts, parts[1:]) for m in _MARKER_BYTES)


def place(parts: list[Summary], k: int) -> int:
    """Code points of the first ``k`` lines."""
    chars = 0
    for p in parts:
        if k == 0:
            break
        if k <= p.lines:
            return chars + int(p.after[k - 1])
        k -= p.lines
        chars += p.chars
    return chars


@lru_cache(maxsize=1)
def _chunk_cache() -> ChunkCache:
    """One a worker, kept over its tasks."""
    return ChunkCache()


def _locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = _chunk_cache()
    limit = np.uint32(1 << (32 - AVERAGE_BITS))
    for block in blocks(batches):
        raw = [t.encode() for t in block["text"]]
        data = b"".join(raw)
        candidates = np.flatnonzero(rolling_hash(np.frombuffer(data, np.uint8)) < limit) + 1
        at, out = 0, []
        for r, h1, h2 in zip(raw, block["h1"], block["h2"]):
            start, at = at, at + len(r)
            parts, low = [], start
            for end in chunk_ends(candidates, start, at):
                parts.append(cache.get(data[low:end]))
                low = end
            n = line_count(parts)
            k1, k2 = sorted((h1 % (n + 1), h2 % (n + 1)))
            out.append((n, has_marker(parts), place(parts, k1), place(parts, k2)))
        n, marked, cut1, cut2 = zip(*out)
        yield pa.record_batch([
            pa.array(block["doc_id"], pa.int64()), pa.array(block["text"], pa.string()), pa.array(n, pa.int64()),
            pa.array(marked, pa.bool_()), pa.array(cut1, pa.int64()), pa.array(cut2, pa.int64())],
            ["doc_id", "text", "n", "marked", "cut1", "cut2"])


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document, from SHA-256 of its id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def transform(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form (plain, psm, spm),
    prefix_chars, middle_chars (null if plain), output."""
    h = draws(F.col("doc_id"), spec.seed)
    rows = id_and_text(docs).select("doc_id", "text", h[0].alias("h1"), h[1].alias("h2"))
    rows = rows.mapInArrow(_locate, LOCATED)
    plain = (F.col("text") == "") | F.col("marked") | (h[2] % 100 >= spec.rate)
    rows = rows.withColumn("form", F.when(plain, "plain").when(h[3] % 100 < spec.spm, "spm").otherwise("psm"))
    text, cut1, cut2 = F.col("text"), F.col("cut1").cast("int"), F.col("cut2").cast("int")
    prefix = F.concat(F.lit(PREFIX), F.substring(text, F.lit(1), cut1))
    middle = F.concat(F.lit(MIDDLE), F.substring(text, cut1 + 1, cut2 - cut1))
    suffix = F.concat(F.lit(SUFFIX), F.substring(text, cut2 + 1, F.length(text)))
    output = F.when(F.col("form") == "plain", text).when(
        F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    moved = F.col("form") != "plain"
    return rows.select("doc_id", "n", "form", F.when(moved, F.col("cut1")).alias("prefix_chars"),
                       F.when(moved, F.col("cut2") - F.col("cut1")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text an ``output`` of that ``form`` was made of.  Its text has no
    marker and markers cannot overlap, so the first of each kind is the one
    that was written."""
    def parts(second: str) -> list[Column]:
        body = F.substring(output, F.lit(len(PREFIX) + 1), F.length(output))
        one = F.substring_index(body, second, 1)
        rest = F.substring(body, F.length(one) + (len(second) + 1), F.length(body))
        two = F.substring_index(rest, MIDDLE, 1)
        return [one, two, F.substring(rest, F.length(two) + (len(MIDDLE) + 1), F.length(rest))]

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(
        F.concat(prefix2, middle2, suffix2))


def digests(docs: DataFrame, spec: Spec = Spec()) -> DataFrame:
    """``transform`` with SHA-256 of the output and of the text rebuilt from it."""
    out, form = F.col("output"), F.col("form")
    return transform(docs, spec).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out.cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(out, form).cast("binary"), 256).alias("restored_sha256"))
