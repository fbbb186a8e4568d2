"""Random forests of all segments (or all trial settings) in one job.

Every model's every tree grows in step, one level at a time, over a table of
(model, row) that holds each row's open node in every tree as one array: the
counts by (model, tree, node, feature, bin) are made in the tasks by numpy and
added up by one aggregate, the best cut of every node is found by running sums
over its bins, and the level's cuts (``MAX_NODES`` at most) go to every task,
which sends its rows to the children.  A level with more nodes goes on, as do
all below, with a long table of (model, tree, row) whose rows join their node's
cut.  Rows are spread over tasks whatever their model or tree, so a segment
with a third of all rows is no task of its own.

Models of up to ``LOCAL_ROWS`` rows need no job a level: their trees are dealt
over tasks in blocks, and a task, which holds the model's rows once, grows its
block's trees to the end, a few together (``_Trees``).  Both ways make the same
trees.  Models that share all their rows give them once.

As in the reference's learner: bootstrap rows a tree (here Poisson(1) weights
from a hash of row and tree), a random subset of features a node (further
subsets are tried while none has a valid cut), weighted Gini, ``min_split`` and
``min_leaf`` counted in distinct rows, and depth without bound (up to 60
levels).  Cuts lie between bins: with as many bins as a feature has values,
every cut is a candidate.  Equal gains go to the first feature, then to the
lowest cut.  A tree's probability at a leaf is the weighted share of its rows;
a forest's is the mean over its trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huddle.session import cut_lineage

MAX_DEPTH = 60
#: Nodes of a level whose cuts are sent to every task (about 100 bytes each).
MAX_NODES = 1_000_000
#: Cells that a task holds as dense arrays; beyond, it counts slice by slice.
MAX_DENSE = 2_000_000
#: (row, tree) pairs that a task looks at together.
SLICE = 1_000_000
#: Rows of a model (about 250 bytes each) that a task may hold for a block of trees.
LOCAL_ROWS = 1 << 21
#: Trees of a block at most.
BLOCK = 256
#: A count of rows and their weight in one number, exact in a double: weights are 9 at most.
UNIT = 1 << 26
KEY = ("model", "tree", "node")


@dataclass(frozen=True)
class ForestSpec:
    trees: int = 190
    depth: int | None = 11
    min_split: int = 5
    min_leaf: int = 3
    features: str = "log2"

    def tried(self, n_features: int) -> int:
        size = {"log2": math.log2, "sqrt": math.sqrt}[self.features](n_features)
        return max(1, int(size))


@dataclass
class Forests:
    """``nodes``: the models, one row per node: model, tree, node (heap
    number), feature and threshold (null at leaves: a row goes left if its
    value is at most the threshold), gain, rows (distinct), weight, share (of
    the positive label).  ``said``: model, row, y, said, the probabilities by
    some of the model's trees, and their number; every tree is in one of a
    held-out row's lists.  Where only the scores were asked for, there are no
    nodes, and ``said`` may hold the sum of its trees' probabilities instead."""
    nodes: DataFrame | None
    said: DataFrame

    @property
    def votes(self) -> DataFrame:
        """model, row, y, p, one row per held-out row and tree."""
        return self.said.select("model", "row", "y", F.explode("said").alias("p"))

    def predictions(self) -> DataFrame:
        """model, row, y, p (mean over the trees), hit."""
        total = F.aggregate("said", F.lit(0.0), lambda a, p: a + p)
        out = self.said.groupBy("model", "row").agg(F.max("y").alias("y"), (F.sum(total) / F.sum("number")).alias("p"))
        return out.withColumn("hit", (F.col("p") > 0.5) == (F.col("y") == 1))

    def accuracy(self) -> DataFrame:
        return self.predictions().groupBy("model").agg(
            F.count(F.lit(1)).alias("n_test"), F.avg(F.col("hit").cast("double")).alias("accuracy"))

    def confusion(self) -> DataFrame:
        """model, y, pred_0, pred_1: held-out rows by true and predicted label."""
        said = F.col("p") > 0.5
        return self.predictions().groupBy("model", "y").agg(
            F.count_if(~said).alias("pred_0"), F.count_if(said).alias("pred_1"))

    def importances(self) -> DataFrame:
        """model, feature, importance: a feature's share of its tree's gain,
        averaged over the model's trees."""
        cuts = self.nodes.where(F.col("feature").isNotNull())
        by_tree = cuts.groupBy("model", "tree", "feature").agg(F.sum("gain").alias("gain"))
        total = by_tree.groupBy("model", "tree").agg(F.sum("gain").alias("total"))
        trees = self.nodes.groupBy("model").agg(F.max("tree").alias("trees"))
        share = by_tree.join(total.where("total > 0"), ["model", "tree"]).groupBy("model", "feature").agg(
            F.sum(F.col("gain") / F.col("total")).alias("s"))
        return share.join(trees, "model").select("model", "feature", (F.col("s") / F.col("trees")).alias("importance"))


def _poisson_bounds() -> list[float]:
    below, bounds = 0.0, []
    for k in range(9):
        below += math.exp(-1) / math.factorial(k)
        bounds.append(below)
    return bounds


def poisson_weight(row: str, seed: int) -> Column:
    """How often a bootstrap of its tree takes a row: Poisson(1) by a hash."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("tree"), F.col(row)), F.lit(1 << 52)) / float(1 << 52)
    out, bounds = F.lit(9), _poisson_bounds()
    for k in range(8, -1, -1):
        out = F.when(u < bounds[k], k).otherwise(out)
    return out


def feature_order(node: Column, n_features: int, seed: int) -> Column:
    """All features in the random order in which a node tries them."""
    drawn = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)),
                        lambda i: F.struct(F.xxhash64(F.lit(seed), F.col("tree"), node, i).alias("h"), i.alias("i")))
    return F.transform(F.array_sort(drawn), lambda s: s["i"])


def _gini(n: Column, s: Column) -> Column:
    """n times the Gini impurity of n rows, s of them positive."""
    return F.when(n > 0, 2.0 * s * (n - s) / n).otherwise(0.0)


def _level(node: Column) -> Column:
    return F.length(F.bin(node)) - 1


def _may_split(node: Column, c: Column, n: Column, s: Column) -> Column:
    return (c >= F.col("min_split")) & (c >= 2 * F.col("min_leaf")) & (s > 0) & (s < n) & (_level(node) < F.col("depth"))


def _cells(state: DataFrame) -> DataFrame:
    """Of a long table: distinct rows, weight and positive weight by cell."""
    cells = state.where("fit").select(*KEY, "tried", "w", "y", "bins", F.explode("feats").alias("f"))
    cells = cells.select(*KEY, "tried", "f", F.get("bins", F.col("f")).alias("b"), "w", (F.col("w") * F.col("y")).alias("wy"))
    return cells.groupBy(*KEY, "tried", "f", "b").agg(F.count(F.lit(1)).alias("c"), F.sum("w").alias("n"), F.sum("wy").alias("s"))


def _best_cuts(hist: DataFrame, specs: DataFrame | dict[str, int], n_features: int, seed: int) -> DataFrame:
    """One row per node of ``hist``: its totals, its best cut if it has one,
    and what its children (or its next try) need."""
    whole = Window.partitionBy(*KEY, "tried", "f")
    run = whole.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    cuts = hist.select(*KEY, "tried", "f", "b", *[F.sum(x).over(run).alias(x + "l") for x in "cns"],
                       *[F.sum(x).over(whole).alias(x) for x in "cns"])
    cuts = _with_specs(cuts, specs)
    c, n, s, cl, nl, sl = (F.col(x) for x in ("c", "n", "s", "cl", "nl", "sl"))
    gain = F.round(_gini(n, s) - _gini(nl, sl) - _gini(n - nl, s - sl), 9)
    valid = _may_split(F.col("node"), c, n, s) & (cl >= F.col("min_leaf")) & (c - cl >= F.col("min_leaf"))
    best = F.max(F.when(valid, F.struct(gain.alias("gain"), (-F.col("f")).alias("f"), (-F.col("b")).alias("b"), "cl", "nl", "sl")))
    nodes = cuts.groupBy(*KEY, "tried", "depth", "min_split", "min_leaf", "n_try").agg(
        *[F.max(x).alias(x) for x in "cns"], best.alias("best"))
    again = F.col("best").isNull() & _may_split(F.col("node"), c, n, s) & (F.col("tried") + F.col("n_try") < n_features)
    left, right = 2 * F.col("node"), 2 * F.col("node") + 1
    nodes = nodes.select(
        *KEY, "c", "n", "s", "depth", "min_split", "min_leaf", "n_try", F.col("best.gain").alias("gain"),
        (-F.col("best.f")).alias("f"), (-F.col("best.b")).alias("b"), *[F.col("best." + x).alias(x) for x in ("cl", "nl", "sl")],
        F.when(F.col("best").isNotNull(), "split").when(again, "again").otherwise("leaf").alias("action"),
        (F.col("tried") + F.col("n_try")).alias("next_tried"))
    split = F.col("action") == "split"

    def subset(node: Column, skip: Column) -> Column:
        return F.slice(feature_order(node, n_features, seed), skip + 1, F.col("n_try"))

    nodes = nodes.withColumns({
        "open_l": split & _may_split(left, cl, nl, sl), "open_r": split & _may_split(right, c - cl, n - nl, s - sl)})
    return nodes.withColumns({
        "feats_l": F.when(F.col("open_l"), subset(left, F.lit(0))), "feats_r": F.when(F.col("open_r"), subset(right, F.lit(0))),
        "feats_again": F.when(F.col("action") == "again", subset(F.col("node"), F.col("next_tried")))})


def _with_specs(df: DataFrame, specs: DataFrame | dict[str, int]) -> DataFrame:
    """One row of settings per model, or single ones for all as constants of the plan."""
    if isinstance(specs, DataFrame):
        return df.join(F.broadcast(specs.drop("trees")), "model")
    return df.withColumns({c: F.lit(v) for c, v in specs.items()})


def _routed(state: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows one level down.  ``done`` rows stand at a leaf with probability
    ``p``; of those only the held-out ones are kept."""
    rows = state.drop("feats", "tried").join(nodes, list(KEY))
    goes_right = F.get("bins", F.col("f")) > F.col("b")
    split, again = F.col("action") == "split", F.col("action") == "again"
    stays_open = F.when(split, F.when(goes_right, F.col("open_r")).otherwise(F.col("open_l"))).otherwise(again)
    n, s, nl, sl = (F.col(x).cast("double") for x in ("n", "s", "nl", "sl"))
    p = F.when(split, F.when(goes_right, (s - sl) / (n - nl)).otherwise(sl / nl)).otherwise(s / n)
    feats = F.when(split, F.when(goes_right, F.col("feats_r")).otherwise(F.col("feats_l"))).otherwise(F.col("feats_again"))
    out = rows.select(
        "model", "tree", F.when(split, 2 * F.col("node") + goes_right.cast("long")).otherwise(F.col("node")).alias("node"),
        F.when(split, 0).otherwise(F.col("next_tried")).alias("tried"), "row", "fit", "w", "y", "bins", feats.alias("feats"),
        (~stays_open).alias("done"), p.alias("p"))
    return out.where(~(F.col("done") & F.col("fit")))


@dataclass
class _Open:
    """A model's open nodes of a level, by the number that rows hold."""
    tree: np.ndarray
    node: np.ndarray
    tried: np.ndarray
    feats: np.ndarray  # by node, -1 where fewer are left to try


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of any lengths by row, filled up with -1."""
    n = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    out = np.full((len(n), int(n.max(initial=0))), -1, np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """One binary value a row of the flat ``values``; row k ends at ``ends[k]``."""
    offsets = np.r_[0, ends * values.itemsize].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights and root numbers of each row's trees from their hashes."""
    bounds = np.array(_poisson_bounds())
    for batch in batches:
        hashes = batch.column("h")
        n = np.asarray(hashes.value_lengths(), np.int64)
        fit = np.repeat(np.asarray(batch.column("fit"), bool), n)
        u = hashes.flatten().to_numpy(zero_copy_only=False) % (1 << 52) / float(1 << 52)
        w = np.where(fit, np.searchsorted(bounds, u, "right"), 0).astype(np.uint8)
        tree = np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
        at = np.where(fit & (w == 0), -1, tree).astype(np.int32)
        kept = [c for c in batch.schema.names if c != "h"]
        yield pa.record_batch([*[batch.column(c) for c in kept], _binary(w, np.cumsum(n)), _binary(at, np.cumsum(n))], [*kept, "w", "at"])


def _slices(batch: pa.RecordBatch, pairs: int) -> Iterator[tuple]:
    """(model, rows, fit, w, at, bins) of up to ``pairs`` pairs of one model."""
    coded = batch.column("model").dictionary_encode()
    codes = coded.indices.to_numpy()
    for k, model in enumerate(coded.dictionary.to_pylist()):
        of = np.flatnonzero(codes == k)
        trees = len(batch.column("w")[int(of[0])].as_py())
        step = max(1, pairs // max(trees, 1))
        for start in range(0, len(of), step):
            part = batch.take(pa.array(of[start:start + step]))
            w, at = (np.frombuffer(b"".join(part.column(c).to_pylist()), kind).reshape(len(part), trees)
                     for c, kind in (("w", np.uint8), ("at", np.int32)))
            bins = part.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)
            yield model, part, np.asarray(part.column("fit"), bool), w, at, bins


CELLS = "model string, tree int, node long, tried int, f int, b int, c long, n long, s long"


def _count(level: Mapping[str | None, _Open], width: int):
    """``CELLS`` of the fit rows, to be added up; ``width``: bins a feature."""
    names = [c.split()[0] for c in CELLS.split(", ")]

    def cells(model, code, sums):
        nodes = level.get(model) or level[None]
        i, f = code // width // nodes.feats.shape[1], nodes.feats.ravel()[code // width]
        cols = [nodes.tree[i].astype(np.int32), nodes.node[i], nodes.tried[i].astype(np.int32), f.astype(np.int32), (code % width).astype(np.int32),
                *[x.astype(np.int64) for x in sums]]
        return pa.record_batch([pa.array([model] * len(code), pa.string()), *map(pa.array, cols)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            for model, part, fit, w, at, bins in _slices(batch, SLICE):
                nodes = level.get(model) or level.get(None)
                if nodes is None:
                    continue
                y = np.asarray(part.column("y").fill_null(0), np.int64)
                r, t = np.nonzero((at >= 0) & fit[:, None])
                i, weight = at[r, t].astype(np.int64), w[r, t].astype(np.int64)
                tries = nodes.feats.shape[1]
                f = nodes.feats[i]
                ok = f >= 0
                code = ((i[:, None] * tries + np.arange(tries)) * width + bins[r[:, None], f])[ok]
                weight = np.broadcast_to(weight[:, None], ok.shape)[ok]
                positive = weight * np.broadcast_to(y[r][:, None], ok.shape)[ok]
                size = nodes.feats.size * width
                dense = size <= MAX_DENSE
                if not dense:
                    seen, code = np.unique(code, return_inverse=True)
                    size = len(seen)
                sums = [np.bincount(code, x, size) for x in (None, weight, positive)]
                if not dense:
                    yield cells(model, seen, sums)
                elif model in held:
                    for total, x in zip(held[model], sums):
                        total += x
                else:
                    held[model] = [x.astype(np.float64) for x in sums]
                    if sum(len(x[0]) for x in held.values()) > MAX_DENSE:
                        for m, x in held.items():
                            seen = np.flatnonzero(x[0])
                            yield cells(m, seen, [v[seen] for v in x])
                        held = {}
        for m, x in held.items():
            seen = np.flatnonzero(x[0])
            yield cells(m, seen, [v[seen] for v in x])
    return run


def _sent(nodes: DataFrame) -> pa.Table:
    """What rows need of a level's nodes."""
    n, s, nl, sl = (F.col(x).cast("double") for x in ("n", "s", "nl", "sl"))
    split = F.col("action") == "split"
    return nodes.select(
        *KEY, F.when(split, F.col("f")).otherwise(-1).cast("int").alias("f"), F.coalesce("b", F.lit(0)).cast("int").alias("b"), "next_tried",
        F.when(split, sl / nl).otherwise(s / n).alias("p"), F.when(split, (s - sl) / (n - nl)).alias("pr"),
        "feats_l", "feats_r", "feats_again").toArrow()


def _below(level: Mapping[str | None, _Open], found: pa.Table) -> tuple[dict[str, dict], dict[str, _Open]]:
    """By model: the cuts of ``found`` in the order of the level's nodes, with
    the numbers of the children that stay open, and those children."""
    cuts, opened = {}, {}
    coded = found.column("model").combine_chunks().dictionary_encode()
    codes = coded.indices.to_numpy()
    for k, model in enumerate(coded.dictionary.to_pylist()):
        mine = found.take(pa.array(np.flatnonzero(codes == k))).combine_chunks()
        col = {c: mine.column(c).to_numpy() for c in ("tree", "node", "f", "b", "next_tried", "p", "pr")}
        nodes = level.get(model) or level[None]
        # both sides in the order of (tree, node)
        own, its = np.lexsort((nodes.node, nodes.tree)), np.lexsort((col["node"], col["tree"]))
        place = dict(zip(zip(nodes.tree[own].tolist(), nodes.node[own].tolist()), own.tolist()))
        at = np.array([place[x] for x in zip(col["tree"][its].tolist(), col["node"][its].tolist())], np.int64)
        cut = {"f": np.full(len(own), -1), "b": np.zeros(len(own), np.int64), "known": np.zeros(len(own), bool),
               **{c: np.full(len(own), np.nan) for c in ("p", "pr")}, **{c: np.full(len(own), -1) for c in ("low", "high")}}
        for c in ("f", "b", "p", "pr"):
            cut[c][at] = col[c][its]
        cut["known"][at] = True
        parts, feats, first = [], [], 0
        for name, side, node, tried in (("feats_l", "low", 2 * col["node"], None), ("feats_r", "high", 2 * col["node"] + 1, None),
                                        ("feats_again", "low", col["node"], col["next_tried"])):
            lists = mine.column(name).combine_chunks()
            # a node that is tried again has no sides: its rows go to the low one
            on = its[np.asarray(lists.is_valid())[its]]
            cut[side][at[np.asarray(lists.is_valid())[its]]] = first + np.arange(len(on))
            first += len(on)
            parts.append((col["tree"][on], node[on], np.zeros(len(on), np.int64) if tried is None else tried[on]))
            feats.append(_matrix(lists.take(pa.array(on))))
        cuts[model] = cut
        if first:
            wide = max(x.shape[1] for x in feats)
            feats = [np.pad(x, ((0, 0), (0, wide - x.shape[1])), constant_values=-1) for x in feats]
            opened[model] = _Open(*(np.concatenate(x).astype(np.int64) for x in zip(*parts)), np.concatenate(feats))
    return cuts, opened


def _route(cuts: Mapping[str, dict]):
    """Rows one level down, and ``said``: the probabilities of the leaves that
    a held-out row has come to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, part, fit, w, at, bins in _slices(batch, SLICE):
                cut = cuts.get(model)
                if cut is None:
                    continue
                r, t = np.nonzero(at >= 0)
                i = at[r, t]
                f = cut["f"][i]
                right = (f >= 0) & (bins[r, f] > cut["b"][i])
                to = np.where(right, cut["high"][i], cut["low"][i])
                moved = np.full(at.shape, -1, np.int32)
                moved[r, t] = to
                done = (to < 0) & cut["known"][i] & ~fit[r]
                p = np.where(right, cut["pr"][i], cut["p"][i])[done]
                ends = np.cumsum(np.bincount(r[done], minlength=len(part)))
                said = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(p, pa.float64()))
                ends = np.arange(1, len(part) + 1) * at.shape[1]
                cols = {c: part.column(c) for c in part.schema.names} | {
                    "at": _binary(moved.ravel(), ends), "live": pa.array((moved >= 0).any(axis=1)), "said": said}
                yield pa.record_batch(list(cols.values()), list(cols))
    return run


def _unpack(level: Mapping[str | None, _Open]):
    """The long table of (model, tree, row) at open nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for model, part, fit, w, at, bins in _slices(batch, SLICE):
                nodes = level.get(model) or level.get(None)
                if nodes is None:
                    continue
                r, t = np.nonzero(at >= 0)
                i, rows = at[r, t], part.take(pa.array(r))
                cols = {"model": rows.column("model"), "tree": pa.array(nodes.tree[i].astype(np.int32)), "node": pa.array(nodes.node[i]),
                        "tried": pa.array(nodes.tried[i].astype(np.int32)), **{c: rows.column(c) for c in ("row", "fit")},
                        "w": pa.array(w[r, t].astype(np.int32)), **{c: rows.column(c) for c in ("y", "bins")}}
                yield pa.record_batch(list(cols.values()), list(cols))
    return run


def _model_rows(nodes: DataFrame, features: Sequence[str], thresholds: Sequence[Sequence[float]]) -> DataFrame:
    """Nodes of one level as rows of the model table, closed children included."""
    name, threshold = _named(features, thresholds)
    split = F.col("action") == "split"

    def row(node, feature, threshold, gain, c, n, s):
        return F.struct(node.alias("node"), feature.alias("feature"), threshold.alias("threshold"), gain.alias("gain"),
                        c.alias("rows"), n.alias("weight"), (s / n).alias("share"))

    c, n, s, cl, nl, sl = (F.col(x) for x in ("c", "n", "s", "cl", "nl", "sl"))
    no_name, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    own = row(F.col("node"), name, threshold, F.col("gain"), c, n, s)
    left = row(2 * F.col("node"), no_name, no_number, no_number, cl, nl, sl)
    right = row(2 * F.col("node") + 1, no_name, no_number, no_number, c - cl, n - nl, s - sl)
    rows = F.array_compact(F.array(own, F.when(split & ~F.col("open_l"), left), F.when(split & ~F.col("open_r"), right)))
    return nodes.where("action <> 'again'").select("model", "tree", F.inline(rows))


def _grow_long(state: DataFrame, nodes: DataFrame, settings: DataFrame | dict[str, int], features: Sequence[str],
               thresholds: Sequence[Sequence[float]], seed: int, model_rows: list, votes: list) -> None:
    """The levels from ``nodes`` on over a long table, by joins."""
    while True:
        moved = _routed(state, nodes)
        moved = cut_lineage(moved, "forest-rows", moved.schema)
        votes.append(moved.where("done").select("model", "row", "y", F.array("p").alias("said"), F.lit(1).alias("number")))
        state = moved.where("not done").drop("done", "p")
        if state.where("fit").isEmpty():
            return
        nodes = _best_cuts(_cells(state), settings, len(features), seed)
        nodes = cut_lineage(nodes, "forest-nodes", nodes.schema)
        model_rows.append(_model_rows(nodes, features, thresholds))


def _named(features: Sequence[str], thresholds: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """The name of feature ``f`` and its threshold ``b``."""
    names = F.array(*[F.lit(f) for f in features])
    bounds = F.array(*[F.array(*[F.lit(float(v)) for v in t]).cast("array<double>") for t in thresholds])
    return F.get(names, F.col("f")), F.get(F.get(bounds, F.col("f")), F.col("b"))


_PRIME = [np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _xxhash64(value: np.ndarray, seed: np.ndarray, is_long: bool) -> np.ndarray:
    """``F.xxhash64`` of an int or long after ``seed``, the hash so far."""
    p1, p2, p3, p4, p5 = _PRIME
    v = value.astype(np.int64).view(np.uint64)
    if is_long:
        h = seed + p5 + np.uint64(8) ^ _rotl(v * p2, 31) * p1
        h = _rotl(h, 27) * p1 + p4
    else:
        h = seed + p5 + np.uint64(4) ^ (v & np.uint64(0xFFFFFFFF)) * p1
        h = _rotl(h, 23) * p2 + p3
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def feature_orders(tree: np.ndarray, node: np.ndarray, n_features: int, seed: int) -> np.ndarray:
    """``feature_order`` of many nodes, one a line."""
    with np.errstate(over="ignore"):
        h = _xxhash64(np.full(len(tree), seed), np.full(len(tree), 42, np.uint64), False)
        h = _xxhash64(node, _xxhash64(tree, h, False), True)
        h = _xxhash64(np.tile(np.arange(n_features), (len(tree), 1)), h[:, None], False).view(np.int64)
    low = (1 << n_features.bit_length()) - 1
    keys = np.sort(h & ~low | np.arange(n_features), axis=1)
    if (keys[:, 1:] & ~low == keys[:, :-1] & ~low).any():
        return np.argsort(h, axis=1, kind="stable")
    return keys & low


def _impurity(n: np.ndarray, s: np.ndarray) -> np.ndarray:
    """``_gini`` of arrays, n above 0."""
    return 2.0 * s * (n - s) / n


def _cells_of(code: np.ndarray, held: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells that occur in ``code`` (cell and label as 2 * cell + y), in
    order, their rows and weight (``held``, in units) and positive weight."""
    if 2 * size <= max(4 * len(code), 1 << 16):
        sums = np.bincount(code, held, 2 * size).astype(np.int64).reshape(size, 2)
        both = sums[:, 0] + sums[:, 1]
        cell = np.flatnonzero(both)
        return cell, both[cell], sums[cell, 1] & (UNIT - 1)
    order = np.argsort(code)
    code, held = code[order], held[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, code[1:] >> 1 != code[:-1] >> 1])
    return code[starts] >> 1, np.add.reduceat(held, starts), np.add.reduceat((held & (UNIT - 1)) * (code & 1), starts)


def _look(values: np.ndarray, at: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``values[at]`` in the first places of ``out``; faster than indexing."""
    return values.take(at, out=out[:len(at)], mode="clip")


class _Trees:
    """Trees of one model, their open nodes and the rows at them; ``bins``,
    twice each row's bins, row by row, so that code 2 * cell + y is a sum.
    ``w``: by tree the weights of the rows ``own``; ``held``: those that vote."""

    def __init__(self, bins: np.ndarray, y: np.ndarray, own: np.ndarray, w: Sequence[np.ndarray], held: np.ndarray, trees: np.ndarray,
                 spec: tuple[int, int, int, int], widths: np.ndarray, seed: int):
        self.flat, self.p, self.spec, self.widths, self.seed = bins.reshape(-1), bins.shape[1], spec, widths, seed
        taken = [np.flatnonzero(x) for x in w]
        on, c = np.concatenate([own[x] for x in taken]), np.array([len(x) for x in taken])
        self.at, self.pos, self.y = np.repeat(np.arange(len(w)), c), on * self.p, y[on].astype(np.int64)
        self.w = np.concatenate([v[x] for v, x in zip(w, taken)]) + float(UNIT)
        self.held_at, self.held_pos = np.repeat(np.arange(len(w)), len(held)), np.tile(held * self.p, len(w))
        self.held = np.arange(len(self.held_at))
        self.said = np.full(len(self.held), np.nan)
        most = max(len(on), len(self.held))
        self.codes, self.places, self.found = (np.empty(most, kind) for kind in (np.int64, np.int64, bins.dtype))
        n, s = (np.bincount(self.at, x, len(w)).astype(np.int64) for x in (self.w - UNIT, (self.w - UNIT) * self.y))
        self.tree, self.node, self.tried, self.level = trees.astype(np.int64), *(np.full(len(w), v) for v in (1, 0, 0))
        opens = self.may(self.level, c, n, s)
        leaf = np.flatnonzero((c > 0) & ~opens)
        none = np.full(len(leaf), -1)
        self.roots = [self.tree[leaf], self.node[leaf], none, none, np.full(len(leaf), np.nan), c[leaf], n[leaf], s[leaf]]
        share = np.full(len(w), np.nan)
        share[leaf] = s[leaf] / n[leaf]
        kept = np.flatnonzero(opens)
        to = np.full(len(w), -1)
        to[kept] = np.arange(len(kept))
        self._move(np.repeat(to, 2), np.repeat(share, 2), 2 * self.at, 2 * self.held_at)
        self.tree, self.node, self.tried, self.level = (x[kept] for x in (self.tree, self.node, self.tried, self.level))
        self.sums = [x[kept] for x in (c, n, s)]

    def _move(self, to: np.ndarray, share: np.ndarray, own: np.ndarray, held: np.ndarray) -> None:
        """Rows to the nodes ``to`` by the sides ``own`` and ``held`` (2 * node + right); of those that end the
        held-out ones take their ``share``."""
        for name, i in (("", own), ("held_", held)):
            at = to.take(i, mode="clip")
            live = at >= 0
            if live.all():
                setattr(self, name + "at", at)
                continue
            if name:
                self.said[self.held[~live]] = share[i[~live]]
            live = np.flatnonzero(live)
            for kept, x in ((name + "at", at), (name + "pos", getattr(self, name + "pos")), *([("held", self.held)] if name else [("y", self.y), ("w", self.w)])):
                setattr(self, kept, x.take(live, mode="clip"))

    def _bins(self, f: np.ndarray, at: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Twice the bin of each row in its node's feature."""
        place = _look(f, at, self.places)
        place += pos
        return _look(self.flat, place, self.found)

    def may(self, level, c, n, s):
        depth, min_split, min_leaf, _ = self.spec
        return (c >= min_split) & (c >= 2 * min_leaf) & (s > 0) & (s < n) & (level < depth)

    def cuts(self, feats: np.ndarray) -> tuple[np.ndarray, ...]:
        """By open node the best cut of its features: gain (-inf where it has
        none), feature, bin, and rows, weight and positive weight on its left.
        The largest gain, then the first feature, then the lowest bin."""
        k, min_leaf, (c, n, s) = len(feats), self.spec[2], self.sums
        gain, whole = np.full(k, -np.inf), _impurity(n, s)
        f_best, b_best, cl, nl, sl = (np.zeros(k, np.int64) for _ in range(5))
        for f in feats.T:
            tried, f = f >= 0, np.maximum(f, 0)
            ends = np.cumsum(self.widths[f])
            first = ends - self.widths[f]
            code = _look(2 * first, self.at, self.codes)
            code += self.y
            code += self._bins(f, self.at, self.pos)
            cell, both, positive = _cells_of(code, self.w, int(ends[-1]))
            starts = np.searchsorted(cell, first)
            at = np.repeat(np.arange(k), np.diff(np.r_[starts, len(cell)]))
            run, up = np.cumsum(both), np.cumsum(positive)
            run -= (run[starts] - both[starts])[at]
            up -= (up[starts] - positive[starts])[at]
            rows = run >> 26
            on = np.flatnonzero((rows >= min_leaf) & (c[at] - rows >= min_leaf) & tried[at])
            if not len(on):
                continue
            at, rows, w, up = at[on], rows[on], run[on] & (UNIT - 1), up[on]
            g = np.round(whole[at] - _impurity(w, up) - _impurity(n[at] - w, s[at] - up), 9)
            new = np.r_[True, at[1:] != at[:-1]]
            most = np.maximum.reduceat(g, np.flatnonzero(new))
            top = np.flatnonzero(g == most[np.cumsum(new) - 1])
            top = top[np.r_[True, at[top[1:]] != at[top[:-1]]]]
            i = at[top]
            better = (most > gain[i]) | ((most == gain[i]) & (f[i] < f_best[i]))
            top, i = top[better], i[better]
            gain[i], f_best[i], b_best[i] = g[top], f[i], cell[on[top]] - first[i]
            cl[i], nl[i], sl[i] = rows[top], w[top], up[top]
        return gain, f_best, b_best, cl, nl, sl

    def step(self) -> list[np.ndarray]:
        """One level down; the nodes that are done as columns (tree, node, f,
        b, gain, c, n, s; f -1 at leaves)."""
        n_try, k, (c, n, s) = self.spec[3], len(self.node), self.sums
        place = self.tried[:, None] + np.arange(n_try)
        feats = np.take_along_axis(feature_orders(self.tree, self.node, self.p, self.seed), np.minimum(place, self.p - 1), axis=1)
        feats[place >= self.p] = -1
        gain, f, b, cl, nl, sl = self.cuts(feats)
        split = gain > -np.inf
        again = ~split & (self.tried + n_try < self.p)
        sides = (cl, nl, sl), (c - cl, n - nl, s - sl)
        opens = [split & self.may(self.level + 1, *x) for x in sides]
        on = [np.flatnonzero(x) for x in (*opens, again)]
        to, share = np.full((k, 2), -1), np.empty((k, 2))
        to[on[0], 0] = np.arange(len(on[0]))
        to[on[1], 1] = len(on[0]) + np.arange(len(on[1]))
        to[on[2]] = (len(on[0]) + len(on[1]) + np.arange(len(on[2])))[:, None]
        done = np.flatnonzero(~again)
        out = [[x[done] for x in (self.tree, self.node, np.where(split, f, -1), b, np.where(split, gain, np.nan), c, n, s)]]
        for side, (kept, sums) in enumerate(zip(opens, sides)):
            leaf = np.flatnonzero(split & ~kept)
            none = np.full(len(leaf), -1)
            out.append([self.tree[leaf], 2 * self.node[leaf] + side, none, none, np.full(len(leaf), np.nan), *[x[leaf] for x in sums]])
            share[:, side] = np.where(split, sums[2], s) / np.where(split, sums[1], n)
        ways = []
        for at, pos in ((self.at, self.pos), (self.held_at, self.held_pos)):
            right = self._bins(f, at, pos) > _look(2 * b, at, self.codes)
            ways.append(2 * at)
            ways[-1] += right
        self._move(to.ravel(), share.ravel(), *ways)
        own, level, tried = self.node, self.level, self.tried
        self.tree = np.concatenate([self.tree[x] for x in on])
        self.node = np.r_[2 * own[on[0]], 2 * own[on[1]] + 1, own[on[2]]]
        self.level = np.r_[level[on[0]] + 1, level[on[1]] + 1, level[on[2]]]
        self.tried = np.r_[np.zeros(len(on[0]) + len(on[1]), np.int64), tried[on[2]] + n_try]
        self.sums = [np.r_[low[on[0]], high[on[1]], x[on[2]]] for low, high, x in zip(*sides, (c, n, s))]
        return [np.concatenate(x) for x in zip(*out)]

    def grow(self, kept: bool) -> list[np.ndarray]:
        """Grows to the end; the node table if it is ``kept``."""
        found = [self.roots]
        while len(self.node):
            table = self.step()
            if kept:
                found.append(table)
        return [np.concatenate(x) for x in zip(*found)]


def _hashed_here(kind: T.DataType) -> list[bool] | None:
    """Whether a row's fields are long (else int), where they are no other."""
    kinds = [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind]
    known = {T.LongType: True, T.IntegerType: False}
    return [known[type(k)] for k in kinds] if all(type(k) in known for k in kinds) else None


def _weights(fields: Sequence[tuple[np.ndarray, np.ndarray | None, bool]], tree: int, seed: int) -> np.ndarray:
    """``poisson_weight`` of rows by their fields (values, nulls, is long)."""
    with np.errstate(over="ignore"):
        h = _xxhash64(np.array([seed]), np.array([42], np.uint64), False)
        h = _xxhash64(np.array([tree]), h, False)
        for values, nulls, is_long in fields:
            more = _xxhash64(values, h, is_long)
            h = more if nulls is None else np.where(nulls, h, more)
    return _poisson(h.view(np.int64))


def _poisson(hashes: np.ndarray) -> np.ndarray:
    u, w = (hashes & ((1 << 52) - 1)) / float(1 << 52), np.zeros(len(hashes), np.uint8)
    for bound in _poisson_bounds():
        w += u >= bound
    return w


BLOCK_NODES = "tree int, node long, f int, b int, gain double, rows long, weight long, share double"


def _grow_blocks(specs: Mapping[str | None, tuple[int, int, int, int]], widths: Sequence[int], seed: int, longs: list[bool] | None,
                 scores_only: bool):
    """Grows the block of trees that is all of a partition: its nodes, and the
    held-out rows with their probabilities by its trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, y, fit, fields, drawn, rows = [], [], [], [], [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            model, first, n = (batch.column(c)[0].as_py() for c in ("model", "first", "n"))
            now = np.asarray(batch.column("fit"), bool)
            bins.append(batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(len(now), -1).astype(np.uint8 if max(widths) <= 128 else np.int32) * 2)
            y.append(np.asarray(batch.column("y").fill_null(0), np.int8))
            fit.append(now)
            row = batch.column("row").filter(pa.array(now))
            if longs is None:
                hashes = batch.column("h").filter(pa.array(now)).flatten().to_numpy(zero_copy_only=False)
                drawn.append(_poisson(hashes).reshape(-1, n))
            else:
                parts = row.flatten() if pa.types.is_struct(row.type) else [row]
                fields.append([(x.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(x.is_null())) for x in parts])
            rows.append(batch.select(["row", "y"]).filter(pa.array(~now)))
        if not fit:
            return
        bins, y, fit = (np.concatenate(x) for x in (bins, y, fit))
        own, held = np.flatnonzero(fit), np.flatnonzero(~fit)
        if longs is not None:
            joined = [[np.concatenate(x) for x in zip(*parts)] for parts in zip(*fields)]
            joined = [(v, nulls if nulls.any() else None, is_long) for (v, nulls), is_long in zip(joined, longs)]
            fields.clear()
        kinds = pa.schema([("model", pa.string()), *([] if scores_only else [
            ("tree", pa.int32()), ("node", pa.int64()), ("f", pa.int32()), ("b", pa.int32()), ("gain", pa.float64()),
            ("rows", pa.int64()), ("weight", pa.int64()), ("share", pa.float64())]),
            *[rows[0].schema.field(c) for c in ("row", "y")], ("said", pa.list_(pa.float64())), ("number", pa.int32())])
        spec, out = specs.get(model) or specs[None], pa.Table.from_batches(rows).combine_chunks()

        def batch_of(size: int, **cols) -> pa.RecordBatch:
            cols["model"] = pa.array([model] * size, pa.string())
            return pa.record_batch([cols.get(k.name, pa.nulls(size, k.type)) for k in kinds], schema=kinds)

        def said_by(values: np.ndarray, number: np.ndarray) -> Iterator[pa.RecordBatch]:
            """``values``: the probabilities, row by row, ``number`` of each row's trees."""
            size = (~np.isnan(values)).sum(axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(values[~np.isnan(values)]))
            if len(held):
                yield batch_of(len(held), **{c: out.column(c).combine_chunks() for c in ("row", "y")}, said=lists, number=pa.array(number, pa.int32()))

        total, number = np.zeros(len(held)), np.zeros(len(held), np.int32)
        most, together = max(1, 16 * SLICE // max(len(held), 1)), max(1, SLICE // 8 // len(fit))
        votes: list[np.ndarray] = []
        for k in range(0, n, together):
            some = range(k, min(k + together, n))
            w = [_weights(joined, first + 1 + i, seed) if longs is not None else np.concatenate([x[:, i] for x in drawn]) for i in some]
            trees = _Trees(bins, y, own, w, held, first + 1 + np.array(some), spec, np.asarray(widths), seed)
            tree, node, f, b, gain, c, weight, s = trees.grow(not scores_only)
            said = trees.said.reshape(len(some), len(held))
            if scores_only:
                known = ~np.isnan(said)
                total += np.where(known, said, 0.0).sum(axis=0)
                number += known.sum(axis=0, dtype=np.int32)
                continue
            leaf = f < 0
            yield batch_of(len(node), tree=pa.array(tree, pa.int32()), node=pa.array(node), f=pa.array(f, pa.int32(), mask=leaf),
                           b=pa.array(b, pa.int32(), mask=leaf), gain=pa.array(gain, mask=leaf), rows=pa.array(c), weight=pa.array(weight), share=pa.array(s / weight))
            votes += list(said)
            if len(votes) >= most or some[-1] == n - 1:
                by_row = np.stack(votes, axis=1)
                votes = []
                yield from said_by(by_row, (~np.isnan(by_row)).sum(axis=1))
        if scores_only:
            yield from said_by(np.where(number > 0, total, np.nan)[:, None], number)
    return run


def _grow_local(rows: DataFrame, sizes: Mapping[str, int], by_model: Mapping[str, ForestSpec], settings: Mapping[str | None, tuple],
                features: Sequence[str], thresholds: Sequence[Sequence[float]], seed: int, scores_only: bool) -> tuple[DataFrame, DataFrame]:
    """Nodes and ``said`` of the models ``sizes`` (their rows), which are of
    ``rows`` or, where those have no model, have all of them.  Blocks that
    take long come first."""
    spark = rows.sparkSession
    cost = {m: n * by_model[m].trees * min(by_model[m].depth or MAX_DEPTH, 20) for m, n in sizes.items()}
    share, blocks = max(1, sum(cost.values()) // (4 * spark.sparkContext.defaultParallelism)), []
    for m in sorted(sizes, key=lambda m: (-cost[m], m)):
        trees = by_model[m].trees
        parts = max(1, -(-trees // BLOCK), min(trees, -(-cost[m] // share)))
        most = -(-trees // parts)
        blocks += [(m, k, min(most, trees - k)) for k in range(0, trees, most)]
    blocks.sort(key=lambda x: -cost[x[0]] * x[2] // by_model[x[0]].trees)
    table = F.broadcast(spark.createDataFrame([(m, i, k, n) for i, (m, k, n) in enumerate(blocks)], "model string, block int, first int, n int"))
    dealt = rows.join(table, "model") if "model" in rows.columns else rows.crossJoin(table)
    longs = _hashed_here(rows.schema["row"].dataType)
    dealt = dealt.select("block", "model", "row", "fit", "y", "bins", "first", "n").repartitionById(len(blocks), F.col("block")).drop("block")
    if longs is None:
        dealt = dealt.withColumn("h", F.transform(F.sequence("first", F.col("first") + F.col("n") - 1), lambda t: F.xxhash64(F.lit(seed), t + 1, F.col("row"))))
    out = T.StructType([T.StructField("model", T.StringType()), *([] if scores_only else T.StructType.fromDDL(BLOCK_NODES)),
                        *[T.StructField(c, rows.schema[c].dataType) for c in ("row", "y")], T.StructField("said", T.ArrayType(T.DoubleType())),
                        T.StructField("number", T.IntegerType())])
    grown = dealt.mapInArrow(_grow_blocks(settings, [len(t) + 1 for t in thresholds], seed, longs, scores_only), out)
    grown = cut_lineage(grown, "forest-blocks", out)
    said = grown.where("number > 0").select("model", "row", "y", "said", "number")
    if scores_only:
        return None, said
    name, threshold = _named(features, thresholds)
    return grown.where("node is not null").select("model", "tree", "node", name.alias("feature"), threshold.alias("threshold"), "gain", "rows", "weight", "share"), said


def fit_forests(rows: DataFrame, specs: ForestSpec | Mapping[str, ForestSpec], features: Sequence[str],
                thresholds: Sequence[Sequence[float]], seed: int = 42, scores_only: bool = False) -> Forests:
    """Grows a forest per ``model`` of ``rows`` on the rows marked ``fit`` and
    lets all others vote.

    ``rows``: model (string), row (unique within the model), fit (boolean),
    y (0 or 1) and bins (``boosting.binned``); without model, the rows are
    those of every model of ``specs``, and should be a plain scan.  ``specs``:
    one for all models, or one per model (the models of a dict are few: it is
    broadcast).  Models without a row to fit on have no nodes and no votes.
    ``scores_only``: the nodes are not kept, and probabilities are added up."""
    spark, p, shared = rows.sparkSession, len(features), "model" not in rows.columns
    by_model = specs if isinstance(specs, Mapping) else {None: specs}
    table = [(m, s.trees, min(s.depth or MAX_DEPTH, MAX_DEPTH), s.min_split, s.min_leaf, s.tried(p)) for m, s in by_model.items()]
    settings = spark.createDataFrame(table, "model string, trees int, depth int, min_split int, min_leaf int, n_try int")
    rows = rows.select(*([] if shared else ["model"]), "row", "fit", F.col("y").cast("int").alias("y"), "bins").where("fit is not null")
    if shared:
        n = rows.count()
        sizes = dict.fromkeys(by_model, n) if n else {}
    else:
        if isinstance(specs, Mapping):
            rows = rows.join(F.broadcast(settings.select("model")), "model", "left_semi")
        rows = rows.where("model is not null").repartition(spark.sparkContext.defaultParallelism, "row")
        rows = cut_lineage(rows, "forest-rows", rows.schema)
        sizes = {r["model"]: r["n"] for r in rows.groupBy("model").agg(F.count(F.lit(1)).alias("n")).collect()}
    local, model_rows, votes = [m for m, n in sizes.items() if n <= LOCAL_ROWS], [], []
    if local:
        of = {m: by_model.get(m) or by_model[None] for m in local}
        nodes, said = _grow_local(rows, {m: sizes[m] for m in local}, of, {t[0]: t[2:] for t in table}, features, thresholds, seed, scores_only)
        if len(local) == len(sizes):
            return Forests(None if scores_only else nodes, said)
        model_rows, votes = [] if scores_only else [nodes], [said]
    if shared:
        rows = rows.crossJoin(F.broadcast(settings.select("model").where(~F.col("model").isin(local))))
        rows = rows.repartition(spark.sparkContext.defaultParallelism, "row")
    rows = rows.where(~F.col("model").isin(local)) if local else rows
    if isinstance(specs, Mapping):
        rows = rows.join(F.broadcast(settings.select("model", "trees")), "model")
    else:
        settings = dict(zip(("depth", "min_split", "min_leaf", "n_try"), table[0][2:]))
        rows = rows.withColumn("trees", F.lit(specs.trees))
    width = max((len(t) for t in thresholds), default=0) + 1
    hashes = F.transform(F.sequence(F.lit(1), F.col("trees")), lambda t: F.xxhash64(F.lit(seed), t, F.col("row")))
    state = rows.select("model", "row", "fit", "y", "bins", hashes.alias("h"))
    kinds = T.StructType([*state.drop("h").schema, T.StructField("w", T.BinaryType()), T.StructField("at", T.BinaryType())])
    state = cut_lineage(state.mapInArrow(_pack, kinds), "forest-rows", kinds)
    roots = spark.range(1, max(s.trees for s in by_model.values()) + 1).select(F.col("id").cast("int").alias("tree"))
    order = np.array([r["o"] for r in roots.select("tree", feature_order(F.lit(1).cast("long"), p, seed).alias("o")).orderBy("tree").collect()])
    level = {m: _Open(np.arange(1, s.trees + 1), np.ones(s.trees, np.int64), np.zeros(s.trees, np.int64), order[:s.trees, :s.tried(p)])
             for m, s in by_model.items() if m not in local}
    moved_kinds = T.StructType([*kinds, T.StructField("live", T.BooleanType()), T.StructField("said", T.ArrayType(T.DoubleType()))])
    at_roots = True
    while level:
        nodes = state.mapInArrow(_count(level, width), CELLS).groupBy(*KEY, "tried", "f", "b").agg(*[F.sum(x).alias(x) for x in "cns"])
        nodes = _best_cuts(nodes, settings, p, seed)
        nodes = cut_lineage(nodes, "forest-nodes", nodes.schema)
        if not scores_only:
            model_rows.append(_model_rows(nodes, features, thresholds))
        # below the roots, whose models are not known before, every open node has rows
        if (nodes.count() if at_roots else sum(len(x.node) for x in level.values())) > MAX_NODES:
            long = state.select("model", F.lit(0).alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(0).alias("tried"), "row", "fit",
                                F.lit(0).alias("w"), "y", "bins").schema
            _grow_long(state.mapInArrow(_unpack(level), long), nodes, settings, features, thresholds, seed, model_rows, votes)
            break
        cuts, level = _below(level, _sent(nodes))
        at_roots = False
        moved = cut_lineage(state.mapInArrow(_route(cuts), moved_kinds), "forest-rows", moved_kinds)
        votes.append(moved.select("model", "row", "y", "said", F.size("said").alias("number")).where("number > 0"))
        state = moved.where("live").select(*state.columns)
    said = reduce(DataFrame.unionByName, votes)
    said = cut_lineage(said, "forest-votes")
    return Forests(None if scores_only else cut_lineage(reduce(DataFrame.unionByName, model_rows), "forest-models"), said)
