"""SimHash near-duplicates: fingerprints, BK-trees, connected components.

* Fingerprints: majority bits of the XXH64 (seed 42) of word shingles.
* Equal fingerprints are one node, represented by the smallest doc_id, so a
  group of exact copies costs one row from here on.
* Shards: a fingerprint is cut into ``radius + 2`` bit blocks.  Two that
  differ in at most ``radius`` bits agree in two blocks at least, so each goes
  to one shard per pair of blocks (15 for radius 4), keyed by their value, and
  every link is found in some shard.
* Each shard is searched with a BK-tree (children keyed by their Hamming
  distance to the parent; a query follows only edges within the radius of its
  own distance).  The trees of a task are built and searched level by level,
  all at once, in numpy.  A shard above ``SHARD`` fingerprints is copied to
  several tasks, each of which takes an equal part of its queries: the tree is
  "broadcast" to as many tasks as it needs.  A plain broadcast of all trees
  has no size bound: it would grow with the corpus.
* A shard puts out a star of links per component, never all pairs; the stars
  of all shards are joined by minimum-label contraction in Spark.

Defined results: null or empty text and text without words have fingerprint
zero and are linked like any other; a null doc_id counts as larger than any
other and is ``component_id`` only where all ids of the component are null;
repeated rows give repeated rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huddle.llm.common import blocks, id_and_text, written

SEED = 42
#: Fingerprints of one shard that one task queries at most.
SHARD = 4096
#: (query, node) pairs held at a time while trees are searched.
FRONTIER = 1 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, shingle: int) -> int:
    """The SimHash of one text as an unsigned 64-bit integer."""
    from xxhash import xxh64_intdigest
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    if n == 1:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    counts = np.zeros(64, np.int64)
    part: list[int] = []
    for g in grams:
        part.append(xxh64_intdigest(g, SEED))
        if len(part) == 8192:
            counts += _bit_counts(part)
            part = []
    if part:
        counts += _bit_counts(part)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _bit_counts(hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1).sum(0, dtype=np.int64)


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash and fp (the fingerprint's 64 bits as a signed long)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            fps = np.array([fingerprint(t, shingle) for t in block["text"]], np.uint64)
            yield pa.record_batch([pa.array(block["doc_id"], pa.int64()), pa.array(block["text_hash"], pa.int64()),
                                   pa.array(fps.view(np.int64))], ["doc_id", "text_hash", "fp"])
    rows = id_and_text(docs).withColumn("text_hash", F.xxhash64("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def bit_blocks(radius: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``radius + 2`` blocks that cover 64 bits."""
    n = radius + 2
    edges = [round(64 * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(fp, radius: int):
    """Array of one key per pair of blocks: the pair's number and both values."""
    def bits(at, width):
        return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))
    pairs = list(combinations(bit_blocks(radius), 2))
    return F.array(*[F.shiftleft(F.shiftleft(F.lit(k).cast("long"), a[1]) + bits(*a), b[1]) + bits(*b)
                     for k, (a, b) in enumerate(pairs)])


def bk_forest(shard: np.ndarray, fp: np.ndarray) -> dict:
    """BK-trees of all shards (rows sorted by shard, fingerprints distinct
    within one).  A row is a node; arrays give its children by edge."""
    n = len(fp)
    root = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
    at = np.repeat(root, np.diff(np.r_[root, n]))
    parent, edge = np.full(n, -1), np.zeros(n, np.int64)
    rest = np.flatnonzero(at != np.arange(n))
    while len(rest):
        d = np.bitwise_count(fp[rest] ^ fp[at[rest]]).astype(np.int64)
        key = at[rest] * 65 + d
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        child = rest[first]
        parent[child], edge[child] = at[child], d[first]
        below = child[inverse]
        at[rest] = below
        rest = rest[below != rest]
    order = np.lexsort((edge, parent))
    kids = order[parent[order] >= 0]
    key = parent[kids] * 65 + edge[kids]
    return {"root": root, "kids": kids, "key": key}


def bk_links(forest: dict, fp: np.ndarray, root_of: np.ndarray, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, row of the same shard within the radius)."""
    stack = [(query[a:a + FRONTIER], root_of[query[a:a + FRONTIER]]) for a in range(0, len(query), FRONTIER)]
    while stack:
        q, node = stack.pop()
        d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
        near = (d <= radius) & (q != node)
        if near.any():
            yield q[near], node[near]
        lo = np.searchsorted(forest["key"], node * 65 + np.maximum(d - radius, 0), "left")
        hi = np.searchsorted(forest["key"], node * 65 + np.minimum(d + radius, 64), "right")
        n = hi - lo
        total = int(n.sum())
        if not total:
            continue
        ends = np.cumsum(n)
        for a in range(0, len(q), max(1, len(q) * FRONTIER // max(total, FRONTIER))):
            b = min(len(q), a + max(1, len(q) * FRONTIER // max(total, FRONTIER)))
            m = n[a:b]
            rows = np.repeat(np.arange(a, b), m)
            if len(rows):
                step = np.arange(len(rows)) - np.repeat(ends[a:b] - m - (ends[a - 1] if a else 0), m)
                stack.append((q[rows], forest["kids"][lo[rows] + step]))


def _least_labels(n: int, links: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest row of each row's component."""
    label = np.arange(n)
    if not links:
        return label
    a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        if (label == before).all():
            return label


def _search(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_shards(batches):
            shard, fp, mine = (table.column(n).to_numpy() for n in ("shard", "fp", "mine"))
            fp = fp.view(np.uint64)
            forest = bk_forest(shard, fp)
            root_of = np.repeat(forest["root"], np.diff(np.r_[forest["root"], len(fp)]))
            links = []
            for a, b in bk_links(forest, fp, root_of, np.flatnonzero(mine), radius):
                links.append((a, b))
                if sum(len(x) for x, _ in links) > FRONTIER:  # keep a star per component
                    label = _least_labels(len(fp), links)
                    links = [(np.arange(len(fp)), label)]
            label = _least_labels(len(fp), links)
            k = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.record_batch([pa.array(fp[k].view(np.int64)), pa.array(fp[label[k]].view(np.int64))], ["a", "b"])
    return run


def _whole_shards(batches: Iterator[pa.RecordBatch], rows: int = 1 << 19) -> Iterator[pa.Table]:
    """Tables of whole shards (rows come sorted by shard and part; a copy of a
    shard for another part counts as another shard)."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            key = table.column("shard").to_numpy()
            cut = int(np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[-1])
            if cut:
                yield table.slice(0, cut)
                held, n = table.slice(cut).to_batches(), len(table) - cut
    if held:
        yield pa.Table.from_batches(held)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """``nodes``: distinct fingerprints (column fp).  Pairs (a, b) that connect
    the same fingerprints as all pairs within ``radius`` bits do."""
    rows = nodes.select("fp", F.explode(shard_keys(F.col("fp"), radius)).alias("key"))
    rows = written(rows, "simhash-shards")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(
        "key", F.ceil(F.col("n") / SHARD).cast("int").alias("parts"))
    rows = rows.join(sizes, "key").select("fp", "key", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    rows = rows.select("fp", "key", "part", (F.pmod(F.xxhash64("fp"), F.col("parts")) == F.col("part")).alias("mine"))
    rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    rows = rows.select(F.xxhash64("key", "part").alias("shard"), "fp", "mine")
    return rows.mapInArrow(_search(radius), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b): rows (node, root) for every node
    with a link.  Each round points every node at the smallest neighbour
    (large star), then links smaller neighbours among each other (small star);
    ends when a round changes nothing.  Each round is a written table."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    pairs = written(pairs, "components-0")

    def checked(x: DataFrame):
        return x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    last = checked(pairs)
    for k in range(1, max_rounds + 1):
        both = pairs.union(pairs.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        new = least.select("a", F.col("m").alias("b")).union(small).distinct()
        pairs = written(new, f"components-{k}")
        before, last = last, checked(pairs)
        if before == last:
            break
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, fp, component_id
    (smallest doc_id that can be reached by links, its own included) and root
    (the component's own fingerprint)."""
    fps = written(fingerprints(docs, shingle), "simhash-fingerprints")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    nodes = written(nodes, "simhash-nodes")
    roots = components(links(nodes.select("fp"), radius))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    by_root = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = nodes.join(by_root, "root").select("fp", "component_id", "root")
    return fps.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id", "root")


def near_duplicate_report(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """``near_duplicates`` with the fingerprint as 16 hex digits."""
    return near_duplicates(docs, shingle, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """The rows of ``docs`` that come first in their component (by doc_id,
    nulls last, then by a hash of the text), one each, columns as they are."""
    found = near_duplicates(docs, shingle, radius)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash")
    first = written(first.distinct(), "simhash-first")
    rows = docs.withColumns({"simhash_id": F.col("doc_id").cast("long"), "simhash_text": F.xxhash64(F.col("text").cast("string"))})
    kept = rows.join(first, F.col("simhash_id").eqNullSafe(first.doc_id) & (F.col("simhash_text") == first.text_hash), "left_semi")
    return kept.dropDuplicates(["simhash_id", "simhash_text"]).select(*docs.columns)
