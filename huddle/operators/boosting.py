"""Second-order gradient boosting of binary labels, by histograms.

Logistic loss with gradient p - y and Hessian p (1 - p); a split's gain is

    (GL^2 / (HL + lambda) + GR^2 / (HR + lambda) - G^2 / (H + lambda)) / 2 - gamma

and a leaf's weight -G / (H + lambda), times the learning rate.

Several models (grid points x folds, say) grow in step over one long table of
(model, row), so one job per level serves them all.  A level is one partial
aggregate of gradients and Hessians by (model, node, feature, bin): its size is
bounded by the models, nodes, features and bins, not by the rows, and checked
before the first job (``MAX_CELLS``); only it reaches the driver, which picks
the splits.  The trees go back as array constants of the plan, by which every
row finds its node; rows that are not fit on (validation, test) are routed the
same way, so their margins need no second pass.  Margins are written before
more than ``MOST_STEPS`` levels stand in one plan, whose code Spark could no
longer compile.

Where the caller allows it (``local_rows``) and no model has more rows, each
model grows whole in one task by the same histograms and the same choice of
splits, without a job a level; the models are spread over the tasks.

First-order boosting (``first_order_accuracies``, below) is MLlib's: log loss
of labels -1 and 1, regression trees by variance on the gradients, the first
tree with weight 1.  A model's rows are held by one task, its trees need no job.

Gradients and Hessians are summed as fixed-point integers, so the sums, and
with them the trees, do not depend on partitions or order.  Equal gains go to
the first feature, then to the lowest threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from huddle.session import cut_lineage

BINS = 32
MAX_CELLS = 8_000_000
MOST_STEPS = 8
#: Fixed-point steps of a gradient: good for 10^11 rows in 64 bits.
STEPS = float(1 << 26)


@dataclass(frozen=True)
class BoostSpec:
    rounds: int = 100
    depth: int = 3
    rate: float = 0.3
    reg_lambda: float = 1.0
    gamma: float = 0.0
    min_child_weight: float = 1.0


@dataclass
class Tree:
    """Nodes by heap number (1 is the root, 2 n and 2 n + 1 are its children).
    ``feature`` is -1 at leaves; a row goes right if its bin is above ``bin``."""
    feature: np.ndarray
    bin: np.ndarray
    weight: np.ndarray
    gain: np.ndarray
    cover: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 << depth
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))


@dataclass
class BoostedModel:
    spec: BoostSpec
    features: list[str]
    thresholds: list[list[float]]
    trees: list[Tree] = field(default_factory=list)

    def margin(self) -> Column:
        """The log-odds as an expression over the feature columns.  For models
        of moderate size: one CASE per tree, compiled with the query."""
        total = F.lit(0.0)
        for t in self.trees:
            total = total + self._node(t, 1)
        return total

    def _node(self, t: Tree, n: int) -> Column:
        f = int(t.feature[n])
        if f < 0:
            return F.lit(float(t.weight[n]))
        right = F.col(self.features[f]) > F.lit(self.thresholds[f][int(t.bin[n])])
        return F.when(right, self._node(t, 2 * n + 1)).otherwise(self._node(t, 2 * n))

    def importances(self) -> dict[str, float]:
        """Share of the total gain by feature."""
        total = np.zeros(len(self.features))
        for t in self.trees:
            for n in np.flatnonzero(t.feature >= 0):
                total[t.feature[n]] += t.gain[n]
        s = total.sum()
        return {f: float(v / s) if s else 0.0 for f, v in zip(self.features, total)}


def candidate_thresholds(df: DataFrame, features: Sequence[str], bins: int = BINS, exact: bool = False) -> list[list[float]]:
    """Up to ``bins`` thresholds a feature: its quantiles, without the largest
    value.  One aggregate; its result is bounded by features x bins.  The
    quantiles are approximate (actual values of the feature); ``exact`` ones,
    the same on every run, count all values and are for bounded tables."""
    shares = [(k + 1) / bins for k in range(bins)]

    def quantiles(x: Column) -> Column:
        return F.percentile(x, shares) if exact else F.percentile_approx(x, shares, 10_000)

    row = df.agg(*[quantiles(F.col(f).cast("double")).alias(f"q{k}") for k, f in enumerate(features)],
                 *[F.max(F.col(f).cast("double")).alias(f"m{k}") for k, f in enumerate(features)]).first()
    out = []
    for k in range(len(features)):
        top = row[f"m{k}"]
        out.append(sorted({v for v in row[f"q{k}"] or [] if v < top}))
    return out


def binned(features: Sequence[str], thresholds: Sequence[Sequence[float]]) -> Column:
    """Array of bins: how many thresholds lie below each feature's value."""
    def bin_of(x: Column, t: Sequence[float]) -> Column:
        return F.size(F.filter(F.expr(_constant(t, "double")), lambda v: v < x)) if t else F.lit(0)

    return F.array(*[bin_of(F.col(f).cast("double"), t) for f, t in zip(features, thresholds)])


def _constant(values, kind: str) -> str:
    """An array constant in SQL; one literal whatever its length."""
    text = ",".join(repr(v.item() if hasattr(v, "item") else v) for v in values)
    return f"cast(split('{text}', ',') AS array<{kind}>)"


def _step(df: DataFrame, trees: dict[int, Tree], slots: int, models: int) -> DataFrame:
    """Rows one level further down: ``node`` by the trees' splits so far."""
    feature, cut = np.full(models * slots, -1), np.zeros(models * slots, np.int64)
    for m, t in trees.items():
        feature[m * slots:m * slots + len(t.feature)] = t.feature
        cut[m * slots:m * slots + len(t.bin)] = t.bin
    kept = [f"`{c}`" for c in df.columns if c != "node"]
    df = df.selectExpr(*kept, "node", f"get({_constant(feature, 'int')}, model * {slots} + node) AS _f",
                       f"get({_constant(cut, 'int')}, model * {slots} + node) AS _cut")
    return df.selectExpr(*kept, "if(_f >= 0, 2 * node + cast(get(bins, _f) > _cut AS int), node) AS node")


def _histograms(at: DataFrame, level: int, growing: Sequence[int], shape: tuple[int, int]) -> dict:
    """Per (model, node) of a level the sums of gradients and Hessians, as two
    arrays by feature and bin.  The sums are one partial aggregate; they come
    to the driver as one short text a cell, which is faster than rows."""
    cells = at.where(f"fit AND model IN ({', '.join(map(str, growing))}) AND node >= {1 << level}").selectExpr(
        "model", "node", f"cast(round((_p - y) * {STEPS}D) AS long) AS g", f"cast(round(_p * (1 - _p) * {STEPS}D) AS long) AS h",
        "posexplode(bins) AS (f, b)").groupBy("model", "node", "f", "b").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    texts = [r[0] for r in cells.select(F.concat_ws(",", "model", "node", "f", "b", "g", "h")).collect()]
    if not texts:
        return {}
    rows = np.array(",".join(texts).split(","), dtype=np.int64).reshape(-1, 6)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    starts = np.flatnonzero(np.r_[True, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])
    out = {}
    for part in np.split(rows, starts[1:]):
        g, h = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        g[part[:, 2], part[:, 3]], h[part[:, 2], part[:, 3]] = part[:, 4], part[:, 5]
        out[int(part[0, 0]), int(part[0, 1])] = g, h
    return out


def _gains(g: np.ndarray, h: np.ndarray, spec: BoostSpec):
    """By feature and bin: gain of a cut after the bin (0 where it has none or
    a side is too light) and the sums on its left; the sums of the whole node."""
    gl, hl = np.cumsum(g, axis=1) / STEPS, np.cumsum(h, axis=1) / STEPS
    gs, hs, lam = gl[0, -1], hl[0, -1], spec.reg_lambda
    gr, hr = gs - gl, hs - hl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (gl ** 2 / (hl + lam) + gr ** 2 / (hr + lam) - gs ** 2 / (hs + lam)) / 2 - spec.gamma
    light = (hl < spec.min_child_weight) | (hr < spec.min_child_weight) | (hl <= 0) | (hr <= 0)
    return np.where(light | ~np.isfinite(gain), 0.0, gain), gl, hl, gs, hs


def _split_level(nodes: dict, trees: dict[int, Tree], models: list[BoostedModel]) -> bool:
    """Enters the best cut of every node of a level; whether there was one."""
    grown = False
    for (m, node), (g, h) in nodes.items():
        t, spec = trees[m], models[m].spec

        def weigh(n: int, gs: float, hs: float, t=t, spec=spec) -> None:
            t.cover[n] = hs
            t.weight[n] = -spec.rate * gs / (hs + spec.reg_lambda) if hs + spec.reg_lambda else 0.0

        gain, gl, hl, gs, hs = _gains(g, h, spec)
        if node == 1:
            weigh(1, gs, hs)
        if gain.max() > 1e-9:
            grown = True
            k, b = (int(v[0]) for v in np.nonzero(gain >= gain.max() - 1e-9))
            t.gain[node], t.feature[node], t.bin[node] = gain[k, b], k, b
            weigh(2 * node, gl[k, b], hl[k, b])
            weigh(2 * node + 1, gs - gl[k, b], hs - hl[k, b])
    return grown


def _fixed(x: np.ndarray) -> np.ndarray:
    """Fixed-point steps, halves away from zero as in SQL."""
    return np.copysign(np.floor(np.abs(x) * STEPS + 0.5), x)


def _boost_here(spec: BoostSpec, bins: np.ndarray, y: np.ndarray, fit: np.ndarray, shape: tuple[int, int],
                stops: Sequence[int]) -> tuple[list[Tree], list[np.ndarray]]:
    """One model on all its rows (``bins`` by feature): its trees, and the
    margins of all rows after the rounds ``stops``."""
    (p, width), model = shape, BoostedModel(spec, [], [])
    margin, margins, every = np.zeros(len(y)), [], np.arange(len(y))
    for r in range(1, max(stops) + 1):
        if r <= spec.rounds:
            tree, node = Tree.empty(spec.depth), np.ones(len(y), np.int64)
            with np.errstate(over="ignore"):
                prob = 1 / (1 + np.exp(-margin))
            g, h = _fixed(prob - y), _fixed(prob * (1 - prob))
            sums = None
            for level in range(spec.depth):
                first = 1 << level
                on = np.flatnonzero(fit & (node >= first))
                rows = np.bincount(node[on] - first, minlength=first)
                above, counted = sums, np.ones(first, bool)
                if level:
                    # of two children the smaller is counted, the other is the rest
                    counted[::2] = rows[::2] <= rows[1::2]
                    counted[1::2] = ~counted[::2]
                    on = on[counted[node[on] - first]]
                sums, at, held = np.empty((2, p, first, width), np.int64), (node[on] - first) * width, (g[on], h[on])
                for f in range(p):
                    code = at + bins[f].take(on, mode="clip")
                    for k, x in enumerate(held):
                        sums[k, f] = np.bincount(code, x, first * width).reshape(first, width)
                if level:
                    rest = np.flatnonzero(~counted)
                    sums[:, :, rest] = above[:, :, rest >> 1] - sums[:, :, rest ^ 1]
                nodes = {(0, first + k): (sums[0, :, k], sums[1, :, k]) for k in np.flatnonzero(rows).tolist()}
                if not _split_level(nodes, {0: tree}, [model]):
                    break
                f = tree.feature[node]
                node = np.where(f >= 0, 2 * node + (bins[np.maximum(f, 0), every] > tree.bin[node]), node)
            margin = margin + tree.weight[node]
            model.trees.append(tree)
        if r in stops:
            margins.append(margin)
    return model.trees, margins


def _boost_models(specs: Sequence[BoostSpec], shape: tuple[int, int], stops: Sequence[int]):
    """Grows the model whose rows are all of a partition: its rows with their
    margins by stop, and one row with its trees."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        rows = pa.Table.from_batches(batches).combine_chunks()
        m = rows.column("model")[0].as_py()
        bins = np.ascontiguousarray(rows.column("bins").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).T)
        trees, margins = _boost_here(specs[m], bins, rows.column("y").to_numpy(), np.asarray(rows.column("fit").combine_chunks(), bool), shape, stops)
        flat, ends = np.stack(margins, axis=1).ravel(), np.arange(len(rows) + 1, dtype=np.int32) * len(margins)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        for batch in rows.append_column("margins", lists).append_column("trees", pa.nulls(len(rows), pa.binary())).to_batches(max_chunksize=50_000):
            yield batch
        own = {"model": pa.array([m], rows.schema.field("model").type), "trees": pa.array([pickle.dumps(trees)], pa.binary())}
        kinds = [*rows.schema, pa.field("margins", lists.type), pa.field("trees", pa.binary())]
        yield pa.record_batch([own.get(k.name, pa.nulls(1, k.type)) for k in kinds], schema=pa.schema([k.with_nullable(True) for k in kinds]))
    return run


def _fit_whole(table: DataFrame, specs: Sequence[BoostSpec], models: list[BoostedModel], shape: tuple[int, int], at_round,
               stops: Sequence[int]) -> None:
    kinds = T.StructType([*[T.StructField(c.name, c.dataType) for c in table.schema], T.StructField("margins", T.ArrayType(T.DoubleType())),
                          T.StructField("trees", T.BinaryType())])
    done = table.repartitionById(len(specs), F.col("model")).mapInArrow(_boost_models(specs, shape, stops), kinds)
    done = cut_lineage(done, "boosting", kinds)
    found = {r["model"]: pickle.loads(r["trees"]) for r in done.where("trees is not null").select("model", "trees").collect()}
    for m, model in enumerate(models):
        # a model without rows has empty trees, as it has by levels
        model.trees += found.get(m) or [Tree.empty(model.spec.depth) for _ in range(model.spec.rounds)]
    for k, r in enumerate(stops):
        if at_round is not None:
            at_round(r, done.where("trees is null").select(*table.columns, F.get("margins", F.lit(k)).alias("margin")))


def fit_boosted(rows: DataFrame, specs: Sequence[BoostSpec], features: Sequence[str],
                thresholds: Sequence[Sequence[float]], at_round=None, stops: Sequence[int] = (),
                local_rows: int = 0) -> list[BoostedModel]:
    """Fits model k by ``specs[k]`` on the rows with ``model`` = k and ``fit``.

    ``rows``: model int, fit boolean, y double (0 or 1), bins (see ``binned``)
    and any other columns.  ``at_round(r, scored)`` is called after the rounds
    in which some model ends with all rows and their ``margin``,
    and after the rounds ``stops``: the trees of fewer rounds are the first of
    more.  ``local_rows``: rows of a model that a task may hold."""
    models = [BoostedModel(s, list(features), [list(t) for t in thresholds]) for s in specs]
    depth, last = max(s.depth for s in specs), max(s.rounds for s in specs)
    cells = len(specs) * (1 << (depth - 1)) * sum(len(t) + 1 for t in thresholds)
    if cells > MAX_CELLS:
        raise ValueError(f"{cells} histogram cells, at most {MAX_CELLS}: fewer models, bins or levels at once")
    shape = len(features), max(len(t) + 1 for t in thresholds)
    slots, stops = 2 << depth, {s.rounds for s in specs} | set(stops)
    columns = [f"`{c}`" for c in rows.columns]
    if local_rows:
        rows = cut_lineage(rows, "boosting")
        if (rows.groupBy("model").count().agg(F.max("count")).first()[0] or 0) <= local_rows:
            _fit_whole(rows, specs, models, shape, at_round, sorted(stops))
            return models
    state = cut_lineage(rows.withColumn("margin", F.lit(0.0)), "boosting")
    steps = 0
    for r in range(1, last + 1):
        active = [m for m, s in enumerate(specs) if s.rounds >= r]
        trees = {m: Tree.empty(specs[m].depth) for m in active}
        at = state.selectExpr(*columns, "margin", "1 / (1 + exp(-margin)) AS _p", "1 AS node")
        for level in range(depth):
            growing = [m for m in active if specs[m].depth > level]
            if not _split_level(_histograms(at, level, growing, shape), trees, models):
                break
            at = _step(at, trees, slots, len(specs))
        weight = np.zeros(len(specs) * slots)
        for m, t in trees.items():
            weight[m * slots:m * slots + len(t.weight)] = t.weight
            models[m].trees.append(t)
        state = at.selectExpr(*columns, f"margin + get({_constant(weight, 'double')}, model * {slots} + node) AS margin")
        steps += depth
        if steps + depth > MOST_STEPS or r in stops:
            steps = 0
            state = cut_lineage(state, "boosting", state.schema)
        if at_round is not None and r in stops:
            at_round(r, state)
    return models


def variance_splits(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Up to ``bins`` - 1 cuts of a feature, as MLlib takes them from a sample
    that is the whole: midpoints of all neighbours, or of those next to the
    multiples of an equal share of the rows."""
    values, counts = np.unique(x, return_counts=True)
    middle = (values[:-1] + values[1:]) / 2.0
    if len(middle) < bins:
        return middle
    stride, out, target = len(x) / bins, [], len(x) / bins
    before = np.cumsum(counts)
    for k in range(1, len(values)):
        if abs(before[k - 1] - target) < abs(before[k] - target):
            out.append(middle[k - 1])
            target += stride
    return np.array(out)


def _variance_tree(spec: BoostSpec, bins: np.ndarray, g: np.ndarray, n_fit: int, width: int) -> np.ndarray:
    """Every row's leaf value of one regression tree on the first ``n_fit``
    rows.  Of two children the smaller is counted, the other is the rest."""
    (p, n), size = bins.shape, 2 << spec.depth
    flat, node, value = bins.reshape(-1), np.ones(n, np.int64), np.zeros(size)
    feature, cut, slot = np.full(size, -1), np.zeros(size, np.int64), np.full(size, -1)
    places = np.arange(n)

    def counted(on: np.ndarray | slice, at: np.ndarray | int, slots: int) -> tuple[np.ndarray, np.ndarray]:
        c, s = (np.empty((slots, p, width)) for _ in range(2))
        for f in range(p):
            code = at + bins[f, on].astype(np.int64)
            c[:, f] = np.bincount(code, minlength=slots * width).reshape(slots, width)
            s[:, f] = np.bincount(code, g[on], slots * width).reshape(slots, width)
        return c, s

    heap, (c, s) = np.array([1]), counted(slice(n_fit), 0, 1)
    value[1] = s[0, 0].sum() / c[0, 0].sum()
    for level in range(spec.depth):
        cl, sl = np.cumsum(c, axis=2), np.cumsum(s, axis=2)
        whole, total = cl[:, :1, -1:], sl[:, :1, -1:]
        cr, sr = whole - cl, total - sl
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (sl ** 2 / cl + sr ** 2 / cr - total ** 2 / whole) / whole / STEPS ** 2
        gain[(cl < 1) | (cr < 1)] = 0.0
        gain = gain.reshape(len(heap), -1)
        best = gain.argmax(1)
        split = np.flatnonzero(gain[np.arange(len(heap)), best] > 1e-12)
        if not len(split):
            break
        k, (f, b) = heap[split], np.divmod(best[split], width)
        feature[k], cut[k] = f, b
        n_l, s_l, n_r, s_r = (v[split, f, b] for v in (cl, sl, cr, sr))
        value[2 * k], value[2 * k + 1] = s_l / n_l, s_r / n_r
        f_row = feature[node]
        node = np.where(f_row >= 0, 2 * node + (flat.take(np.maximum(f_row, 0) * n + places) > cut[node]), node)
        if level + 1 == spec.depth:
            break
        right = n_r < n_l
        slot[:] = -1
        slot[2 * k + right] = np.arange(len(k))
        at = slot[node[:n_fit]]
        on = np.flatnonzero(at >= 0)
        c1, s1 = counted(on, at[on] * width, len(k))
        c2, s2 = c[split] - c1, s[split] - s1
        heap, c, s = np.r_[2 * k + right, 2 * k + 1 - right], np.r_[c1, c2], np.r_[s1, s2]
    return value[node] / STEPS


def _first_order_hits(spec: BoostSpec, x: list[np.ndarray], y: np.ndarray, n_fit: int, stops: Sequence[int]) -> list[int]:
    """How many of the rows after the first ``n_fit``, on which one model
    grows, it gets right after the rounds ``stops``."""
    if any(np.isnan(v).any() for v in x):
        raise ValueError("features with null or NaN")
    bins = np.empty((len(x), len(y)), np.uint8)
    for k in range(len(x)):
        bins[k] = np.searchsorted(variance_splits(x[k][:n_fit]), x[k])
        x[k] = None
    width, sign, margin, out = int(bins.max(initial=0)) + 1, 2.0 * y - 1.0, np.zeros(len(y)), {}
    for r in range(1, max(stops) + 1):
        with np.errstate(over="ignore"):
            pull = sign if r == 1 else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))
        margin = margin + (1.0 if r == 1 else spec.rate) * _variance_tree(spec, bins, np.rint(pull * STEPS), n_fit, width)
        if r in stops:
            out[r] = int(((margin[n_fit:] > 0) == (y[n_fit:] > 0.5)).sum())
    return [out[r] for r in stops]


def first_order_accuracies(rows: DataFrame, specs: Sequence[BoostSpec], features: Sequence[str], stops: Sequence[int]) -> dict[tuple[int, int], float]:
    """Accuracy on its rows without ``fit`` of every model and number of
    rounds of ``stops``; 0 where it has no such rows.  ``rows``: model int,
    fit boolean, y double (0 or 1) and the features; a task holds a model's."""
    names = [f"_x{k}" for k in range(len(features))]
    rows = rows.select("model", "fit", "y", *[F.col(f).cast("double").alias(n) for f, n in zip(features, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        m, fit = table.column("model")[0].as_py(), table.column("fit").to_numpy()
        order = np.argsort(~fit.astype(bool), kind="stable")
        x, n_fit = [], int(fit.sum())
        y = table.column("y").to_numpy()[order]
        for n in names:
            x.append(table.column(n).to_numpy().astype(float)[order])
            table = table.drop_columns([n])
        hits = _first_order_hits(specs[m], x, y, n_fit, stops)
        yield pa.record_batch([pa.array([m] * len(stops), pa.int32()), pa.array(stops, pa.int32()), pa.array(hits, pa.int64()),
                               pa.array([len(y) - n_fit] * len(stops), pa.int64())], ["model", "rounds", "hits", "n"])

    found = rows.repartitionById(len(specs), F.col("model")).mapInArrow(run, "model int, rounds int, hits long, n long").collect()
    return {(r["model"], r["rounds"]): r["hits"] / r["n"] if r["n"] else 0.0 for r in found}
