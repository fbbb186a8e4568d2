"""Many small models: one bagged-tree classifier per player (M6).

Players are many, so fitting them one MLlib job at a time does not scale.
Every player's model is fitted on all of the player's training rows.

Players of up to ``SMALL`` rows, which are most, come to a task many at a
time and grow in step (``votes_in_step``): the same draws, cuts and votes as
one by one, with arrays over all of them instead of a call a node.  Larger ones
are fitted by one task each, with the same learner, which counts by distinct
values instead of sorting at every node.  Players of more than
``max_fit_rows`` training rows, which a task should not hold, grow over all
tasks (``forests``): Poisson weights instead of drawn rows, and cuts at up to
64 quantiles of all the player's rows.  The test rows of players one by one
are scored in groups of about ``score_rows`` rows that are cogrouped with their
player's model, so no player's test rows are collected whole into one task."""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huddle.operators.forests import ForestSpec, fit_forests
from huddle.operators.models import SMALL_FOREST, with_split
from huddle.session import cut_lineage

MODEL_DDL = "_entity long, model binary"
SCORE_DDL = "_entity long, scored long, hits long"
#: Rows of a player that grows in step with others; counts up to it have a table.
SMALL = 511
#: Rows that a task looks at together.
STEP_ROWS = 60_000
#: Training rows of a player (about 300 bytes each) that one task fits.
FIT_ROWS = 1 << 20
#: Cuts of a feature where a player grows over all tasks, one more than these.
BINS = 64


def _best_split(x: np.ndarray, y: np.ndarray, feats: np.ndarray):
    n = len(y)
    best = (None, None, 0.0)
    tot1 = y.sum()
    parent = 1.0 - (tot1 / n) ** 2 - (1 - tot1 / n) ** 2
    for f in feats:
        order = np.argsort(x[:, f], kind="mergesort")
        xs, ys = x[order, f], y[order]
        c1 = np.cumsum(ys)[:-1]
        nl = np.arange(1, n)
        valid = xs[1:] > xs[:-1]
        if not valid.any():
            continue
        pl = c1 / nl
        pr = (tot1 - c1) / (n - nl)
        gini = (nl * (1 - pl ** 2 - (1 - pl) ** 2) + (n - nl) * (1 - pr ** 2 - (1 - pr) ** 2)) / n
        gini = np.where(valid, gini, np.inf)
        i = int(np.argmin(gini))
        gain = parent - gini[i]
        if gain > best[2] + 1e-12:
            best = (int(f), (xs[i] + xs[i + 1]) / 2.0, gain)
    return best


def _grow(x, y, depth, max_depth, rng, n_feat):
    """A tree as nested tuples: ('leaf', p1) or (feature, threshold, left, right)."""
    if depth >= max_depth or len(y) < 2 or y.min() == y.max():
        return ("leaf", float(y.mean()) if len(y) else 0.5)
    feats = rng.choice(x.shape[1], size=n_feat, replace=False)
    f, thr, _ = _best_split(x, y, feats)
    if f is None:
        return ("leaf", float(y.mean()))
    m = x[:, f] <= thr
    return (f, thr, _grow(x[m], y[m], depth + 1, max_depth, rng, n_feat),
            _grow(x[~m], y[~m], depth + 1, max_depth, rng, n_feat))


class _Counted:
    """``_best_split`` and ``_grow`` by counts of distinct values: the same
    draws, cuts and shares without a sort a node."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.y, found = y.astype(np.int64), [np.unique(v, return_inverse=True) for v in x.T]
        self.values, self.codes = [v for v, _ in found], [c.reshape(-1) for _, c in found]

    def grow(self, drawn: np.ndarray, max_depth: int, rng, n_feat: int):
        w = np.bincount(drawn, minlength=len(self.y))
        return self._grow(np.flatnonzero(w), w, 0, max_depth, rng, n_feat)

    def _grow(self, at, w, depth, max_depth, rng, n_feat):
        held = w[at]
        n, s = int(held.sum()), int((held * self.y[at]).sum())
        if depth >= max_depth or n < 2 or s in (0, n):
            return ("leaf", s / n if n else 0.5)
        feats = rng.choice(len(self.values), size=n_feat, replace=False)
        # rows and positives in one number
        packed = held + (held * self.y[at]) * float(1 << 26)
        parent, best, f_best, threshold = 1.0 - (s / n) ** 2 - (1 - s / n) ** 2, 0.0, None, None
        for f in feats:
            code = self.codes[f][at]
            if len(self.values[f]) <= 4 * len(at):
                sums = np.bincount(code, packed)
                cells = np.flatnonzero(sums)
            else:
                cells, code = np.unique(code, return_inverse=True)
                sums = np.bincount(code, packed, len(cells))
            sums = np.cumsum((sums if len(sums) == len(cells) else sums[cells]).astype(np.int64))[:-1]
            values = self.values[f][cells]
            valid = values[1:] > values[:-1]
            if not valid.any():
                continue
            nl, c1 = sums & ((1 << 26) - 1), sums >> 26
            pl, pr = c1 / nl, (s - c1) / (n - nl)
            gini = (nl * (1 - pl ** 2 - (1 - pl) ** 2) + (n - nl) * (1 - pr ** 2 - (1 - pr) ** 2)) / n
            gini = np.where(valid, gini, np.inf)
            i = int(np.argmin(gini))
            if parent - gini[i] > best + 1e-12:
                best, f_best, threshold = parent - gini[i], int(f), (values[i] + values[i + 1]) / 2.0
        if f_best is None:
            return ("leaf", s / n)
        low = (self.values[f_best] <= threshold)[self.codes[f_best][at]]
        return (f_best, threshold, self._grow(at[low], w, depth + 1, max_depth, rng, n_feat),
                self._grow(at[~low], w, depth + 1, max_depth, rng, n_feat))


def _predict(tree, x):
    if tree[0] == "leaf":
        return np.full(len(x), tree[1])
    feature, threshold, low, high = tree
    out, m = np.empty(len(x)), x[:, feature] <= threshold
    out[m], out[~m] = _predict(low, x[m]), _predict(high, x[~m])
    return out


def fit_trees(x, y, n_trees=100, max_depth=5, seed=42) -> list:
    rng = np.random.default_rng(seed)
    n_feat = max(1, int(np.sqrt(x.shape[1])))
    counted = _Counted(x, y) if len(y) > SMALL and not np.isnan(y).any() else None
    trees = []
    for _ in range(n_trees):
        idx = rng.integers(0, len(y), len(y))
        trees.append(counted.grow(idx, max_depth, rng, n_feat) if counted else _grow(x[idx], y[idx], 0, max_depth, rng, n_feat))
    return trees


def vote(trees: list, x) -> np.ndarray:
    """Whether the trees' mean vote is for the positive label."""
    return sum(_predict(t, x) for t in trees) / len(trees) > 0.5


def bagged_trees_accuracy(x_tr, y_tr, x_te, y_te, n_trees=100, max_depth=5, seed=42) -> float:
    if not len(y_te):
        return float("nan")
    return float((vote(fit_trees(x_tr, y_tr, n_trees, max_depth, seed), x_te) == (y_te > 0.5)).mean())


def _preorder(depth: int, node: int = 1) -> list[int]:
    """Heap numbers of the nodes above ``depth`` in the order ``_grow`` meets them."""
    return [node, *_preorder(depth - 1, 2 * node), *_preorder(depth - 1, 2 * node + 1)] if depth else []


@lru_cache(maxsize=2)
def _stream(seed: int, n: int) -> np.ndarray:
    """The first ``n`` 32-bit numbers of ``default_rng(seed)``."""
    return np.random.PCG64(seed).random_raw(n // 2 + 1).astype("<u8").view("<u4").astype(np.uint64)


@lru_cache(maxsize=1)
def _impurity() -> np.ndarray:
    """n times the Gini impurity by n * (SMALL + 1) + positives, as ``_best_split`` has it."""
    n, c = np.arange(SMALL + 1)[:, None], np.arange(SMALL + 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = c / n
        out = n * (1 - p ** 2 - (1 - p) ** 2)
    out[0] = 0.0
    return out.ravel()


def _bounded(u: np.ndarray, n) -> tuple[np.ndarray, np.ndarray]:
    """Draws below ``n`` as the generator makes them, and whether it would
    have thrown one away and drawn again."""
    wide = u * np.asarray(n, np.uint64)
    n = np.maximum(n, 1).astype(np.uint64) if isinstance(n, np.ndarray) else np.uint64(max(n, 1))
    return (wide >> np.uint64(32)).astype(np.int64), (wide & np.uint64(0xFFFFFFFF)) < np.uint64(1 << 32) % n


def _subsets(u: np.ndarray, at: np.ndarray, size: int, n_feat: int) -> tuple[np.ndarray, int, np.ndarray]:
    """``choice(size, n_feat, replace=False)`` at the places ``at`` of the
    stream, the numbers each takes, and whether a draw was thrown away."""
    out, again, used = np.empty((len(at), n_feat), np.int64), np.zeros(len(at), bool), 0
    for k, top in enumerate(range(size - n_feat, size)):
        x = np.zeros(len(at), np.int64)
        if top:
            x, bad = _bounded(u[at + used], top + 1)
            used, again = used + 1, again | bad
        out[:, k] = np.where((out[:, :k] == x[:, None]).any(1), top, x)
    rows = np.arange(len(at))
    for k in range(n_feat - 1, 0, -1):
        x, bad = _bounded(u[at + used], k + 1)
        used, again = used + 1, again | bad
        held = out[rows, x]
        out[rows, x], out[:, k] = out[:, k], held
    return out, used, again


@lru_cache(maxsize=8)
def _draws_known(size: int, n_feat: int) -> bool:
    """Whether ``_bounded`` and ``_subsets`` draw what this numpy draws."""
    rng, u, at, same = np.random.default_rng(7), _stream(7, 4096), 0, True
    for n in (2, 3, 19, SMALL):
        same &= (rng.integers(0, n, n) == _bounded(u[at:at + n], n)[0]).all()
        at += n
        for _ in range(8):
            found, used, _ = _subsets(u, np.array([at]), size, n_feat)
            same &= (rng.choice(size, size=n_feat, replace=False) == found[0]).all()
            at += used
    return bool(same)


def votes_in_step(x: np.ndarray, y: np.ndarray, n: np.ndarray, test: np.ndarray, n_trees=100, max_depth=5,
                  seed=42) -> tuple[np.ndarray, np.ndarray]:
    """``vote(fit_trees(...))`` of many players at once, and the players whose
    draws or cuts are out of step and have to be done one by one.

    ``x``: features x players x rows, ``n`` of which (1 to ``SMALL``) count;
    ``y`` (0 or 1): players x rows; ``test``: features x players x test rows.
    A node's cell holds its rows and positives as one number."""
    (size, players, width), unit, table = x.shape, SMALL + 1, _impurity()
    n_feat, who = max(1, int(np.sqrt(size))), np.arange(players)
    nodes = _preorder(max_depth)
    u = _stream(seed, n_trees * (SMALL + len(nodes) * 2 * n_feat) + SMALL)
    real = np.arange(width) < n[:, None]
    order = np.argsort(np.where(real, x, np.inf), axis=2, kind="stable")
    xs = np.take_along_axis(x, order, 2)
    change = np.zeros(x.shape, bool)
    change[:, :, :-1] = (xs[:, :, 1:] > xs[:, :, :-1]) & real[:, 1:]
    each = np.where(real, unit + y.astype(np.int64), 0)
    at, odd = np.zeros(players, np.int64), np.zeros(players, bool)
    votes = np.zeros((players, test.shape[2]))
    for _ in range(n_trees):
        drawn, again = _bounded(u[at[:, None] + np.arange(width)], n[:, None])
        odd |= (again & real & (n > 1)[:, None]).any(1)
        taken = np.bincount((drawn + who[:, None] * width)[real], minlength=players * width).reshape(players, width)
        at += np.where(n > 1, n, 0)
        v = taken * each
        cell = np.zeros((players, 2 << max_depth), np.int64)
        cell[:, 1] = v.sum(1)
        node, node_t = np.ones((players, width), np.int16), np.ones((players, test.shape[2]), np.int16)
        for k in nodes:
            rows, hits = np.divmod(cell[:, k], unit)
            on = np.flatnonzero((rows >= 2) & (hits > 0) & (hits < rows))
            if not len(on):
                continue
            feats, used, again = _subsets(u, at[on], size, n_feat)
            odd[on] |= again
            at[on] += used
            whole, m, here = cell[on, k], rows[on], node[on] == k
            held, line = v[on] * here, np.arange(len(on))
            share = hits[on] / m
            parent = 1.0 - share ** 2 - (1 - share) ** 2
            best, cut, left, f_best = np.zeros(len(on)), np.zeros(len(on)), np.zeros(len(on), np.int64), np.full(len(on), -1)
            for f in feats.T:
                run = np.cumsum(held.take(order[f, on] + line[:, None] * width), axis=1)
                gini = (table.take(run) + table.take(whole[:, None] - run)) / m[:, None]
                gini[~change[f, on]] = np.inf
                i = gini.argmin(1)
                gain = parent - gini[line, i]
                better = np.flatnonzero(gain > best + 1e-12)
                if not len(better):
                    continue
                f_b, run = f[better], run[better]
                low = run[np.arange(len(better)), i[better]]
                a, b = (xs[f_b, on[better], p] for p in ((run >= low[:, None]).argmax(1), (run > low[:, None]).argmax(1)))
                best[better], cut[better], left[better], f_best[better] = gain[better], (a + b) / 2.0, low, f_b
                # neighbours without a number between them
                odd[on[better]] |= cut[better] >= b
            split = np.flatnonzero(f_best >= 0)
            if not len(split):
                continue
            on, f, cut, here = on[split], f_best[split], cut[split, None], here[split]
            cell[on, 2 * k], cell[on, 2 * k + 1] = left[split], whole[split] - left[split]
            node[on] = np.where(here, 2 * k + (x[f, on] > cut), node[on])
            node_t[on] = np.where(node_t[on] == k, 2 * k + (test[f, on] > cut), node_t[on])
        rows, hits = np.divmod(cell, unit)
        votes += np.where(rows > 0, hits / np.maximum(rows, 1), 0.5)[who[:, None], node_t]
    return votes / n_trees > 0.5, odd


def _in_step(feats: Sequence[str], params: dict):
    """(player, scored, hits) of partitions that hold players whole, sorted by
    player, training before test rows, in the order of the draws."""
    learner = (params["numTrees"], params["maxDepth"], params["seed"])

    def players(entity, x, y, test) -> Iterator[tuple[int, int, int]]:
        first = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])
        n = np.diff(np.r_[first, len(entity)])
        m = np.add.reduceat(test.astype(np.int64), first)
        n = n - m
        plain = np.logical_and.reduceat(np.isfinite(x).all(0), first) & _draws_known(len(x), max(1, int(np.sqrt(len(x)))))
        scored = np.flatnonzero((n > 0) & (m > 0))
        alone = scored[~plain[scored]].tolist()
        some = scored[plain[scored]]
        some = some[np.argsort(n[some], kind="stable")]
        while len(some):
            width = np.maximum.accumulate(n[some] + m[some])
            k = max(1, int(np.searchsorted(np.arange(1, len(some) + 1) * width, STEP_ROWS, "right")))
            now, some = some[:k], some[k:]
            rows = np.minimum(first[now, None] + np.arange(n[now].max()), len(y) - 1)
            tests = np.minimum(first[now, None] + n[now, None] + np.arange(m[now].max()), len(y) - 1)
            said, odd = votes_in_step(x[:, rows], y[rows], n[now], x[:, tests], *learner)
            hits = ((said == (y[tests] > 0.5)) & (np.arange(tests.shape[1]) < m[now, None])).sum(1)
            alone += now[odd].tolist()
            for e, a, b in zip(entity[first[now[~odd]]].tolist(), m[now[~odd]].tolist(), hits[~odd].tolist()):
                yield e, a, b
        for k in alone:
            a, b = slice(first[k], first[k] + n[k]), slice(first[k] + n[k], first[k] + n[k] + m[k])
            said = vote(fit_trees(x[:, a].T, y[a], *learner), x[:, b].T)
            yield int(entity[first[k]]), int(m[k]), int((said == (y[b] > 0.5)).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list[pa.RecordBatch], last: bool):
            rows = pa.Table.from_batches(held)
            entity = rows.column("_entity").to_numpy()
            # the last player may go on in the next batch
            end = len(entity) if last else int(np.flatnonzero(entity == entity[-1])[0])
            x = np.stack([rows.column(f).to_numpy().astype(float) for f in feats])[:, :end]
            y, test = rows.column("_y").to_numpy().astype(float)[:end], rows.column("_test").to_numpy().astype(bool)[:end]
            out = list(players(entity[:end], x, y, test)) if end else []
            columns = zip(*out) if out else ([], [], [])
            return rows.slice(end).to_batches(), pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["_entity", "scored", "hits"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held += [batch] if batch.num_rows else []
            if sum(b.num_rows for b in held) >= 4 * STEP_ROWS:
                held, out = done(held, False)
                yield out
        if held:
            yield done(held, True)[1]
    return run


def entity_models(spark: SparkSession, rows: DataFrame, entity: str, features: Sequence[str], label: str,
                  row_keys: Sequence[str], min_rows: int = 50, max_fit_rows: int = FIT_ROWS,
                  score_rows: int = 50_000, positive: str = "right", small: int = SMALL) -> DataFrame:
    """Accuracy of a per-entity classifier for every entity with at least
    ``min_rows`` rows.  Output: entity, n, n_test, accuracy (null where an
    entity has no test or no training rows).  ``max_fit_rows``: training rows
    of an entity that one task fits; with more it grows over all tasks, on all
    of them too.  ``small``: rows of an entity that grows in step with others
    (``SMALL`` at most; 0: none)."""
    feats = [f"_x{k}" for k in range(len(features))]
    data = with_split(rows, row_keys).select(
        F.col(entity).cast("long").alias("_entity"), *[F.col(c).cast("double").alias(f) for c, f in zip(features, feats)],
        (F.col(label) == F.lit(positive)).cast("double").alias("_y"), (F.col("split") == "test").alias("_test"),
        F.xxhash64(*row_keys).alias("_hash"))
    data = cut_lineage(data, "entity-rows")
    sizes = data.groupBy("_entity").agg(F.count(F.lit(1)).alias("n"), F.count_if("_test").alias("n_test")).filter(F.col("n") >= min_rows)
    sizes = cut_lineage(sizes.withColumn("_parts", F.ceil(F.col("n_test") / score_rows).cast("int")), "entity-sizes")
    is_small = F.col("n") <= min(small, SMALL, max_fit_rows)
    few = data.join(sizes.filter(is_small).select("_entity"), "_entity", "left_semi").repartition("_entity")
    few = few.sortWithinPartitions("_entity", "_test", "_hash", *feats, "_y").select("_entity", "_test", *feats, "_y")
    scored = few.mapInArrow(_in_step(feats, SMALL_FOREST), SCORE_DDL)
    sizes_many = sizes.filter(~is_small)
    if not sizes_many.isEmpty():
        is_large = F.col("n") - F.col("n_test") > max_fit_rows
        scored = scored.unionByName(_one_by_one(data, sizes_many.filter(~is_large), feats))
        large = sizes_many.filter(is_large & F.col("_entity").isNotNull())
        if not large.isEmpty():
            scored = scored.unionByName(_over_tasks(data.join(large.select("_entity"), "_entity", "left_semi"), feats))
    hits = scored.groupBy("_entity").agg((F.sum("hits") / F.sum("scored")).alias("accuracy"))
    return sizes.join(hits, "_entity", "left").select(F.col("_entity").alias("entity"), "n", "n_test", "accuracy")


def _one_by_one(data: DataFrame, sizes: DataFrame, feats: Sequence[str]) -> DataFrame:
    """(player, scored, hits) by parts of the test rows of the players of ``sizes``."""
    data = data.join(sizes.select("_entity"), "_entity", "left_semi")
    rank = F.row_number().over(Window.partitionBy("_entity").orderBy("_hash", *feats, "_y"))
    chosen = data.filter(~F.col("_test")).withColumn("_rank", rank)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rank")
        trees = fit_trees(pdf[feats].to_numpy(dtype=float), pdf["_y"].to_numpy(dtype=float),
                          SMALL_FOREST["numTrees"], SMALL_FOREST["maxDepth"], SMALL_FOREST["seed"])
        return pd.DataFrame({"_entity": [int(pdf["_entity"].iloc[0])], "model": [pickle.dumps(trees)]})

    def score(test: pd.DataFrame, models: pd.DataFrame) -> pd.DataFrame:
        if not len(test) or not len(models):
            return pd.DataFrame({"_entity": [], "scored": [], "hits": []})
        right = vote(pickle.loads(models["model"].iloc[0]), test[feats].to_numpy(dtype=float)) == (test["_y"].to_numpy() > 0.5)
        return pd.DataFrame({"_entity": [int(test["_entity"].iloc[0])], "scored": [len(right)], "hits": [int(right.sum())]})

    models = chosen.groupBy("_entity").applyInPandas(fit, MODEL_DDL)
    parts = sizes.filter("_parts > 0").select("_entity", "_parts")
    models = models.join(parts, "_entity").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    test = data.filter("_test").join(parts, "_entity").withColumn("_part", F.pmod("_hash", "_parts").cast("int"))
    return test.groupBy("_entity", "_part").cogroup(models.groupBy("_entity", "_part")).applyInPandas(score, SCORE_DDL)


def _over_tasks(data: DataFrame, feats: Sequence[str]) -> DataFrame:
    """(player, scored, hits) of players whose rows no task holds."""
    shares = [k / BINS for k in range(1, BINS)]
    known = data.filter(~F.col("_test")).groupBy("_entity").agg(*[
        F.array_distinct(F.percentile_approx(f, shares, 10_000)).alias(f"_cuts{f}") for f in feats], *[F.max(f).alias(f"_most{f}") for f in feats])

    def bin_of(f: str):
        return F.size(F.filter(f"_cuts{f}", lambda v: (v < F.col(f)) & (v < F.col(f"_most{f}"))))

    # rows that repeat are rows of their own
    same = ["_entity", "_hash", "_test", *feats, "_y"]
    copy = F.row_number().over(Window.partitionBy(*same).orderBy(*same))
    rows = data.withColumn("_copy", copy).join(known, "_entity").select(
        F.col("_entity").cast("string").alias("model"), F.struct("_hash", F.xxhash64(*feats, "_y").alias("_values"), "_copy").alias("row"),
        (~F.col("_test")).alias("fit"), F.coalesce(F.col("_y"), F.lit(0.0)).cast("int").alias("y"), F.array(*[bin_of(f) for f in feats]).cast("array<tinyint>").alias("bins"))
    spec = ForestSpec(SMALL_FOREST["numTrees"], SMALL_FOREST["maxDepth"], 2, 1, "sqrt")
    forests = fit_forests(rows, spec, feats, [[0.0] * BINS] * len(feats), SMALL_FOREST["seed"], True)
    return forests.predictions().groupBy(F.col("model").cast("long").alias("_entity")).agg(
        F.count(F.lit(1)).alias("scored"), F.count_if("hit").alias("hits"))
