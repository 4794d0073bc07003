"""Forests and boosted trees of large tables, all folds in the same passes (O-87, O-88, O-92).

Spark's own tree estimators pass over every row for each tree, level and fold, and boosting is a chain of some hundred jobs
for each fold.  A histogram tree only needs sums for each bin of the inputs: here every part of the table
becomes one block of cells (rows of the same bins and fold; in the worst case one row each) with the rows' targets,
and each level of all trees of all folds is one job, whose sums are added by tree (`forest`) or on the driver (`boost`).

The trees are those of Spark ML: the same candidates (midpoints of up to 32 bins of the rows that a fold is trained
on, from all of them), the same gain, leaves, rates and losses, and for a forest a Poisson draw for each row and tree; only the random
numbers of a forest are others.  The model of the whole part is an ordinary Spark ML model.  Targets are numbers or, for a classifier, 0 and 1.
"""
from __future__ import annotations

import json
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, PipelineModel
from pyspark.ml.feature import OneHotEncoderModel, StandardScalerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, scratch_path

BINS = 32
MOST_VALUES = 10_000  # an input with more distinct values (and folds) is cut at its percentiles
BLOCK_ROWS = 1_000_000
BATCH_BYTES = 96 << 20  # sums that a block sends in one job
CHECKPOINT_ROUNDS = 25
MERGED_CELLS = 200_000  # up to so many cells of all blocks together are joined into one block


@dataclass
class Plan:
    """What tasks need to know.  Fit 0 is of all rows, fit f + 1 of those outside fold f."""

    shift: np.ndarray
    scale: np.ndarray
    edges: list[np.ndarray]  # of each number: the cuts of all fits
    cuts: list[list[np.ndarray]]  # of each fit and number
    levels: list[int]  # of each text: its slots
    folds: int
    binary: bool

    def __post_init__(self):
        self.fits = 1 + self.folds
        self.features = len(self.edges) + sum(self.levels)
        self.bins = [1 + max(len(self.cuts[f][i]) for f in range(self.fits)) for i in range(len(self.edges))] + self.levels
        self.at = np.concatenate([[0], np.cumsum(self.bins)]).astype(int)
        #: bin in the fit of each code (position between the edges of all fits)
        self.lut = [[np.searchsorted(c, np.append(e, np.inf), "left").astype(np.uint8) for c, e in zip(cuts, self.edges)] for cuts in self.cuts]
        self.same = all(len(c) == len(e) for cuts in self.cuts for c, e in zip(cuts, self.edges))
        #: candidates in Spark's order: column, feature, and the last bin that goes left (0: the slot isn't set)
        self.candidates = [(c, c, b) for c in range(len(self.edges)) for b in range(self.bins[c] - 1)]
        at = len(self.edges)
        for k, n in enumerate(self.levels):
            self.candidates += [(len(self.edges) + k, at + s, s) for s in range(n)]
            at += n


@dataclass
class Block:
    """Cells ordered by fold, and the rows' targets ordered by cell."""

    slots: np.ndarray  # cells x features: code of a number, 0 or 1 of a text's slot
    codes: np.ndarray  # fits (or 1) x columns x cells: bins
    ends: np.ndarray  # where each fold's cells end
    first: np.ndarray  # first target of each cell
    y: np.ndarray
    times: np.ndarray | None  # rows with that target in that cell, if not 1

    def sums(self, weights: np.ndarray | None = None, power: int = 1) -> np.ndarray:
        w = weights if weights is not None else self.times if self.times is not None else np.ones(len(self.y))
        return np.add.reduceat(w * self.y ** power if power else w, self.first).astype(float)

    def without(self, fit: int, a: np.ndarray, axis: int = 0) -> np.ndarray:
        """Of an array over cells, those that the fit is trained on."""
        if not fit:
            return a
        lo, hi = (self.ends[fit - 2] if fit > 1 else 0), self.ends[fit - 1]
        return np.concatenate([a[:lo], a[hi:]]) if axis == 0 else np.concatenate([a[:, :lo], a[:, hi:]], axis=1)

    def kept(self, keep: np.ndarray) -> Block:
        return Block(self.slots[keep], self.codes[:, :, keep], np.searchsorted(keep, self.ends), self.first, self.y, self.times)


@dataclass
class Merged(Block):
    """The cells of all blocks; of their targets only the sums of powers 0, 1 and 2."""

    powers: np.ndarray
    places: list[np.ndarray]  # of each block of the table: its cells here

    def sums(self, weights=None, power: int = 1) -> np.ndarray:
        return self.powers[power]


@dataclass
class Cells:
    plan: Plan
    blocks: RDD
    merged: Merged | None  # if there are few
    pre: PipelineModel
    label: str
    spark: SparkSession

    def unpersist(self) -> None:
        self.blocks.unpersist()


@dataclass
class Trees:
    """Trees in heap order (root 1, children 2 i and 2 i + 1): an array of fits x trees x nodes for each property."""

    feature: np.ndarray
    cut: np.ndarray  # goes right if the code is above
    bin: np.ndarray
    split: np.ndarray
    n: np.ndarray
    sum: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(fits: int, trees: int, depth: int) -> Trees:
        shape = (fits, trees, 2 << depth)
        z = lambda kind: np.zeros(shape, kind)
        return Trees(z(np.int32), np.full(shape, 255, np.uint8), z(np.int16), z(bool), z(float), z(float), z(float))

    def grow(self, plan: Plan, tree, level: int, found: tuple) -> None:
        """Enter the splits of a level."""
        pick, gain, n, total, n_left, left = found
        at, below = slice(1 << level, 2 << level), slice(2 << level, 4 << level)
        if level == 0:
            self.n[:, tree, 1:2], self.sum[:, tree, 1:2] = n, total
        split = pick >= 0
        column, feature, last = (np.array(x)[pick] for x in zip(*plan.candidates)) if plan.candidates else (np.zeros_like(pick),) * 3
        numbers = split & (column < len(plan.edges))
        cut = np.where(split, 0, 255)
        for f, k in zip(*np.nonzero(numbers)):
            cut[f, k] = np.searchsorted(plan.edges[column[f, k]], plan.cuts[f][column[f, k]][last[f, k]])
        self.split[:, tree, at], self.feature[:, tree, at], self.cut[:, tree, at] = split, np.where(split, feature, 0), cut
        self.bin[:, tree, at], self.gain[:, tree, at] = np.where(split, last, 0), np.where(split, gain, -1.0)
        both = lambda a, b: np.stack([np.where(split, a, 0.0), np.where(split, b, 0.0)], -1).reshape(len(split), -1)
        self.n[:, tree, below], self.sum[:, tree, below] = both(n_left, n - n_left), both(left, total - left)

    def alive(self) -> np.ndarray:
        """Nodes that exist: the root, and the children of splits."""
        out = np.zeros_like(self.split)
        out[:, :, 1] = True
        out[:, :, 2:] = np.repeat(self.split[:, :, 1:out.shape[2] // 2], 2, axis=2)
        return out

    def values(self) -> np.ndarray:
        """Mean target of each node; what would be below a leaf has the leaf's."""
        v = np.divide(self.sum, self.n, out=np.zeros_like(self.sum), where=self.n > 0)
        for i in range(1, v.shape[2] // 2):
            v[:, :, 2 * i:2 * i + 2] = np.where(self.split[:, :, i:i + 1], v[:, :, 2 * i:2 * i + 2], v[:, :, i:i + 1])
        return v


# ---------------------------------------------------------------- cells
def _cuts(values: np.ndarray, n: np.ndarray, most: int = BINS - 1) -> np.ndarray:
    """Spark's candidates of one input: midpoints of its values, or those nearest to equal shares."""
    values, n = values[n > 0], n[n > 0]
    if len(values) < 2 or np.isnan(values).any():
        return np.zeros(0)
    mid = (values[:-1] + values[1:]) / 2
    if len(mid) <= most:
        return mid
    stride, out, target, now = n.sum() / (most + 1), [], n.sum() / (most + 1), n[0]
    for i in range(1, len(values)):
        before, now = now, now + n[i]
        if abs(before - target) < abs(now - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out)


def _column_cuts(rows: DataFrame, x: Column, fold: Column, folds: int, shift: float, scale: float) -> list[np.ndarray]:
    counts = rows.groupBy(x.alias("x"), fold.alias("f")).count().limit(MOST_VALUES * max(1, folds) + 1).collect()
    scaled = lambda v: (np.array(v, float) - shift) * scale
    if len(counts) <= MOST_VALUES * max(1, folds):
        value = np.array([np.nan if r["x"] is None else r["x"] for r in counts], float)
        known, at = np.unique(scaled(value), return_inverse=True)
        n = np.zeros((max(1, folds), len(known)))
        np.add.at(n, (np.array([r["f"] for r in counts], int), at), [r["count"] for r in counts])
        return [_cuts(known, n.sum(0) - (n[f - 1] if f else 0)) for f in range(1 + folds)]
    # every distinct value on the driver would be too many: a cut at each of the percentiles, of all rows
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    found = rows.agg(*[F.percentile_approx(F.when(F.lit(f == 0) | (fold != f - 1), x), at, MOST_VALUES) for f in range(1 + folds)]).first()
    return [np.unique(scaled(q)) if not np.isnan(shift) else np.zeros(0) for q in found]


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """A row of each combination, in order, and the combination of each row."""
    key, size = np.zeros(len(columns[0]), np.int64), 1
    for c, s in zip(columns, sizes):
        if size * s >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            size = len(key)
        key, size = key * s + c, size * s
    _, row, cell = np.unique(key, return_index=True, return_inverse=True)
    return row, cell


def _block(plan: Plan, numbers: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, fold: np.ndarray) -> Block:
    codes = [np.searchsorted(e, (x - a) * b, "left") for x, a, b, e in zip(numbers, plan.shift, plan.scale, plan.edges)]
    levels = [t.astype(np.int64) for t in texts]
    row, cell = _distinct([fold, *codes, *levels], [max(1, plan.folds), *(len(e) + 1 for e in plan.edges), *(k + 1 for k in plan.levels)])
    codes, levels, fold = [c[row] for c in codes], [t[row] for t in levels], fold[row]
    order = np.lexsort((y, cell))
    cell, y = cell[order], y[order]
    new = np.flatnonzero(np.append(True, (cell[1:] != cell[:-1]) | (y[1:] != y[:-1])))
    times = np.diff(np.append(new, len(y)))
    cell, y = cell[new], y[new]
    slots = [codes, *([(t == s) for s in range(k)] for t, k in zip(levels, plan.levels))]
    bins = [np.array([*(lut[c] for lut, c in zip(luts, codes)), *levels]).astype(np.uint8 if max(plan.bins, default=0) < 256 else np.int32)
            for luts in (plan.lut[:1] if plan.same else plan.lut)]
    return Block(np.array([x for s in slots for x in s], np.uint8).T.copy(), np.array(bins), np.searchsorted(fold, np.arange(max(1, plan.folds)), "right"),
                 np.searchsorted(cell, np.arange(len(row))), y, times if times.max() > 1 else None)


def cells(pre: PipelineModel, train: DataFrame, numeric, categorical, label: str, rows: int, folds: int = 0, binary: bool = False) -> Cells:
    """The training part in blocks; `pre` holds the fitted stages of `models.preprocessor`, a part with folds their number in `__fold`."""
    spark = train.sparkSession
    prepared = pre.transform(train)
    scaler = next((s for s in pre.stages if isinstance(s, StandardScalerModel)), None)
    shift, scale = np.zeros(len(numeric)), np.ones(len(numeric))
    if scaler is not None:
        shift, std = np.array(scaler.mean.toArray()), np.array(scaler.std.toArray())
        scale = np.divide(1.0, std, out=np.zeros_like(std), where=std != 0)
    levels = [s.categorySizes[0] for s in pre.stages if isinstance(s, OneHotEncoderModel)]
    fold = F.col("__fold") if folds else F.lit(0)
    xs = [F.col(c).cast("double") for c in numeric]
    from .models import _concurrently
    by_column = _concurrently(lambda i: _column_cuts(prepared, xs[i], fold, folds, shift[i], scale[i]), range(len(xs))) if xs else []
    plan = Plan(shift, scale, [np.unique(np.concatenate(c)) for c in by_column], [[c[f] for c in by_column] for f in range(1 + folds)], levels, folds, binary)
    if plan.features != prepared.schema["features"].metadata["ml_attr"]["num_attrs"]:
        raise ValueError("the inputs aren't those of the preprocessing")

    def build(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is not None and t.num_rows:
            a = [t.column(i).to_numpy() for i in range(t.num_columns)]
            k = len(numeric)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_block(plan, a[:k], a[k:-2], a[-2], a[-1]))], pa.binary())], ["block"])

    inputs = prepared.select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], *[F.col(f"{c}__idx").alias(f"c{i}") for i, c in enumerate(categorical)],
                             F.col(label).cast("double").alias("y"), fold.cast("int").alias("f"))
    blocks = inputs.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // BLOCK_ROWS))).mapInArrow(build, "block binary")
    blocks = blocks.rdd.map(lambda r: bytes(r[0])).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = blocks.mapPartitionsWithIndex(lambda part, raws: [(part, _fold_sizes(b), len(b.slots)) for b in map(pickle.loads, raws)]).collect()
    held = np.sum([n for _, n, _ in sizes], axis=0)
    for f in range(folds):
        for part, n in (("validation", held[f]), ("training", held.sum() - held[f])):
            if not n:
                blocks.unpersist()
                raise ValueError(f"the {part} data of fold {f} is empty")
    merged = None
    if sum(n for *_, n in sizes) <= MERGED_CELLS * len(sizes):
        merged = _merged(blocks)
    return Cells(plan, blocks, merged, pre, label, spark)


def _merged(blocks: RDD) -> Merged | None:
    """One block of the distinct cells, added up two blocks at a time; None if they are too many."""
    def own(part, raws):
        for b in map(pickle.loads, raws):
            fold = np.searchsorted(b.ends, np.arange(len(b.slots)), "right").astype(np.int32)
            yield fold, b.slots, b.codes, np.array([b.sums(power=p) for p in range(3)]), {part: np.arange(len(b.slots))}

    def add(a, b):
        if a is None or b is None:
            return None
        rows = [np.concatenate([x, y]) for x, y in zip(a[:2], b[:2])]
        row, cell = _distinct([rows[0], *rows[1].T], [int(rows[0].max()) + 1, *(int(c.max()) + 1 for c in rows[1].T)])
        if len(row) > MERGED_CELLS:
            return None
        powers = np.array([np.bincount(cell, w, len(row)) for w in np.concatenate([a[3], b[3]], axis=1)])
        n = len(a[0])
        return rows[0][row], rows[1][row], np.concatenate([a[2], b[2]], axis=2)[:, :, row], powers, {k: cell[v] for k, v in a[4].items()} | {k: cell[v + n] for k, v in b[4].items()}

    found = blocks.mapPartitionsWithIndex(own).treeReduce(add)
    if found is None or len(found[0]) > MERGED_CELLS:
        return None
    fold, slots, codes, powers, places = found
    ends = np.searchsorted(fold, np.arange(int(fold.max()) + 1), "right")
    return Merged(slots, codes, ends, np.zeros(0, int), np.zeros(0), None, powers, places)


def _fold_sizes(b: Block) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(b.sums(power=0))[b.ends - 1] * (b.ends > 0)]))


# ---------------------------------------------------------------- growing
def _walk(slots: np.ndarray, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray:
    """The node of each cell after so many levels."""
    flat, base, node = slots.ravel(), np.arange(len(slots)) * slots.shape[1], np.ones(len(slots), np.intp)
    for _ in range(level):
        node = 2 * node + (flat.take(base + feature.take(node)) > cut.take(node))
    return node


def _histogram(plan: Plan, b: Block, fit: int, feature, cut, alive, level: int, n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Count and target sum of each node of the level and bin of each column, over the cells that the fit is trained on."""
    codes, n, total = b.without(fit, b.codes[min(fit, len(b.codes) - 1)], 1), b.without(fit, n), b.without(fit, total)
    nodes = 1 << level
    out = np.zeros((nodes, plan.at[-1], 2))
    at = _walk(b.without(fit, b.slots), feature, cut, level) if level else np.ones(len(n), np.intp)
    if not alive[nodes:2 * nodes].all():
        live = np.flatnonzero(alive.take(at))
        codes, n, total, at = codes[:, live], n[live], total[live], at[live]
    at = at - nodes
    for c, k in enumerate(plan.bins):
        i = at * k + codes[c]
        for s, w in enumerate((n, total)):
            out[:, plan.at[c]:plan.at[c + 1], s] = np.bincount(i, w, nodes * k).reshape(nodes, k)
    return out


def _best(plan: Plan, sums: np.ndarray, chosen: np.ndarray | None) -> tuple:
    """The best candidate of each fit and node (-1: a leaf), its gain, and count and target sum of the node and of its left child."""
    fits, nodes = sums.shape[:2]
    total = sums[:, :, plan.at[0]:plan.at[1]].sum(2) if plan.bins else np.zeros((fits, nodes, 2))
    if not plan.candidates:
        zero = np.zeros((fits, nodes))
        return np.full((fits, nodes), -1), zero, total[..., 0], total[..., 1], zero, zero
    left = []
    for c in range(len(plan.bins)):
        h = sums[:, :, plan.at[c]:plan.at[c + 1]]
        left.append(np.cumsum(h, axis=2)[:, :, :-1] if c < len(plan.edges) else total[:, :, None] - h)
    left = np.concatenate(left, axis=2)
    n, t = total[..., 0], total[..., 1]
    nl, tl = left[..., 0], left[..., 1]
    nr, tr = n[..., None] - nl, t[..., None] - tl
    ok = (nl > 0.5) & (nr > 0.5)
    if chosen is not None:
        ok &= chosen
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (tl * tl / nl + tr * tr / nr - (t * t / n)[..., None]) / n[..., None], -np.inf)
        least = 1e-12 * (t / n) ** 2  # what rounding leaves of no gain
    pick = gain.argmax(2)
    best = np.take_along_axis(gain, pick[..., None], 2)[..., 0]
    first = lambda a: np.take_along_axis(a, pick[..., None], 2)[..., 0]
    pick = np.where((n > 0) & (best > least), pick, -1)
    return pick, best * (2 if plan.binary else 1), n, t, first(nl), first(tl)  # Gini's impurity of 0 and 1 is twice the variance


#: Distribution of a Poisson draw of mean 1, and the draw that the first 16 bits of a uniform number stand for
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
_FIRST = np.searchsorted(_POISSON, np.arange(1 << 16) / 65536, "right").astype(np.uint8)
_FIRST[_FIRST != np.searchsorted(_POISSON, (np.arange(1 << 16) + 1) / 65536, "left")] = 255


def _draws(b: Block, seed: int, part: int, tree: int) -> np.ndarray:
    r = np.random.Generator(np.random.SFC64([seed & 0xFFFFFFFF, part, tree]))
    if b.times is not None:
        return r.poisson(b.times)
    high = r.integers(0, 1 << 16, len(b.y), np.uint16)
    out = _FIRST.take(high)
    open_ = np.flatnonzero(out == 255)  # its 16 bits don't tell yet
    out[open_] = np.searchsorted(_POISSON, (high[open_] + r.random(len(open_))) / 65536, "right")
    return out


def _subset(strategy: str, features: int, trees: int, classes: bool) -> int:
    if strategy == "auto":
        strategy = "all" if trees == 1 else "sqrt" if classes else "onethird"
    return {"all": features, "sqrt": math.ceil(math.sqrt(features)), "onethird": math.ceil(features / 3)}[strategy]


def _added(pairs):
    out = {}
    for k, v in pairs:
        if k in out:
            out[k] += v
        else:
            out[k] = v
    return out


def forest(c: Cells, trees: int, depth: int, strategy: str, seed: int) -> tuple[Trees, np.ndarray]:
    """Bagged trees of all fits, and the sums of target powers 0, 1, 2 in the nodes of the trees of fit 0."""
    plan, blocks, sc = c.plan, c.blocks, c.blocks.ctx
    grown, some = Trees.empty(plan.fits, trees, depth), _subset(strategy, plan.features, trees, plan.binary)
    feature_of = np.array([x[1] for x in plan.candidates], int)
    parts = sc.defaultParallelism

    def chosen(t, level):
        if some == plan.features:
            return None
        r = np.random.default_rng([seed & 0xFFFFFFFF, t, level]).random((plan.fits, 1 << level, plan.features))
        return (r <= np.partition(r, some - 1, axis=-1)[..., some - 1:some])[..., feature_of]

    if c.merged is not None:
        return grown, _forest_of_few(c, grown, depth, chosen, lambda b, part, t: _draws(b, seed, part, t))
    for level in range(depth):
        alive = grown.alive()
        if not alive[:, :, 1 << level:2 << level].any():
            break
        known = sc.broadcast((grown.feature, grown.cut, alive))
        nodes = 1 << level

        def sums(batch, known=known, level=level):
            def emit(part, raws):
                feature, cut, alive = known.value
                for raw in raws:
                    b = pickle.loads(raw)
                    for t in batch:
                        w = _draws(b, seed, part, t)
                        n, total = b.sums(w, 0), b.sums(w)
                        keep = np.flatnonzero(n)
                        k = b.kept(keep)
                        n, total = n[keep], total[keep]
                        yield t, np.array([_histogram(plan, k, f, feature[f, t], cut[f, t], alive[f, t], level, n, total) for f in range(plan.fits)])
            return emit

        def splits(pairs, level=level):
            for t, h in _added(pairs).items():
                yield t, _best(plan, h, chosen(t, level))

        size = max(1, BATCH_BYTES // (plan.fits * nodes * int(plan.at[-1]) * 16))
        for at in range(0, trees, size):
            batch = range(at, min(trees, at + size))
            for t, found in blocks.mapPartitionsWithIndex(sums(batch)).partitionBy(parts, lambda k: k).mapPartitions(splits).collect():
                grown.grow(plan, t, level, found)
        known.unpersist()

    known = sc.broadcast((grown.feature[0], grown.cut[0]))

    def leaves(part, raws):
        feature, cut = known.value
        for raw in raws:
            b = pickle.loads(raw)
            for t in range(trees):
                w = _draws(b, seed, part, t)
                at = _walk(b.slots, feature[t], cut[t], depth)
                yield t, np.array([np.bincount(at, b.sums(w, p), 2 << depth) for p in range(3)])

    stats = np.zeros((trees, 3, 2 << depth))
    for t, s in blocks.mapPartitionsWithIndex(leaves).partitionBy(parts, lambda k: k).mapPartitions(lambda x: iter(_added(x).items())).collect():
        stats[t] = s
    known.unpersist()
    return grown, _upwards(stats, depth)


def _upwards(stats: np.ndarray, depth: int) -> np.ndarray:
    for i in range((1 << depth) - 1, 0, -1):
        stats[..., i] = stats[..., 2 * i] + stats[..., 2 * i + 1]
    return stats


def _forest_of_few(c: Cells, grown: Trees, depth: int, chosen, draws) -> np.ndarray:
    """A forest when there are few cells: one pass draws the rows of every tree, and a tree's sums by cell are grown in one task."""
    plan, trees = c.plan, grown.split.shape[1]
    known = c.blocks.ctx.broadcast(c.merged)

    def sums(part, raws):
        for b in map(pickle.loads, raws):
            for t in range(trees):
                w = draws(b, part, t)
                yield t, (part, b.sums(w, 0).astype(np.int32), b.sums(w), b.sums(w, 2).astype(np.float32))

    def grow(pairs):
        m, bags = known.value, {}
        for t, (part, *powers) in pairs:
            bag = bags.setdefault(t, np.zeros((3, len(m.slots))))
            for p in range(3):
                bag[p, m.places[part]] += powers[p]
        for t, bag in bags.items():
            g = Trees.empty(plan.fits, 1, depth)
            keep = np.flatnonzero(bag[0])
            k, (n, total, _) = m.kept(keep), bag[:, keep]
            for level in range(depth):
                alive = g.alive()[:, 0]
                if not alive[:, 1 << level:2 << level].any():
                    break
                h = np.array([_histogram(plan, k, f, g.feature[f, 0], g.cut[f, 0], alive[f], level, n, total) for f in range(plan.fits)])
                g.grow(plan, 0, level, _best(plan, h, chosen(t, level)))
            at = _walk(m.slots, g.feature[0, 0], g.cut[0, 0], depth)
            yield t, g, np.array([np.bincount(at, x, 2 << depth) for x in bag])

    stats = np.zeros((trees, 3, 2 << depth))
    for t, g, s in c.blocks.mapPartitionsWithIndex(sums).partitionBy(max(c.blocks.ctx.defaultParallelism, -(-trees // 16)), lambda k: k).mapPartitions(grow).collect():
        stats[t] = s
        for name in vars(g):
            getattr(grown, name)[:, t] = getattr(g, name)[:, 0]
    known.unpersist()
    return _upwards(stats, depth)


def boost(c: Cells, rounds: int, depth: int, rate: float) -> Trees:
    """Boosted trees of all fits on squared loss, or on logistic loss of 0 and 1 (as -1 and 1)."""
    plan = c.plan
    grown = Trees.empty(plan.fits, rounds, depth)
    if c.merged is not None:
        margin, raw = None, pickle.dumps(c.merged)
        for r in range(rounds):
            if r:
                margin = _step(plan, grown, r - 1, 1.0 if r == 1 else rate)(raw, margin)
            for level in range(depth):
                alive = grown.alive()[:, r]
                if not alive[:, 1 << level:2 << level].any():
                    break
                found = _boost_sums(plan, c.merged, margin, grown.feature[:, r], grown.cut[:, r], alive, level)
                grown.grow(plan, r, level, _best(plan, found, None))
        return grown
    checkpoint_dir(c.spark)
    state, old = c.blocks.map(lambda raw: (raw, None)), []
    for r in range(rounds):
        if r:
            step = _step(plan, grown, r - 1, 1.0 if r == 1 else rate)
            state = state.map(lambda s, step=step: (s[0], step(*s))).persist(StorageLevel.MEMORY_AND_DISK)
            old.append(state)
            if r % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
        for level in range(depth):
            alive = grown.alive()[:, r]
            if not alive[:, 1 << level:2 << level].any():
                break
            now = (grown.feature[:, r], grown.cut[:, r], alive)
            parts = state.map(lambda s, now=now, level=level: _boost_sums(plan, pickle.loads(s[0]), s[1], *now, level)).collect()
            grown.grow(plan, r, level, _best(plan, np.sum(parts, axis=0), None))
        while len(old) > 1:
            old.pop(0).unpersist()
    for s in old:
        s.unpersist()
    return grown


def _step(plan: Plan, grown: Trees, r: int, weight: float):
    feature, cut, value = grown.feature[:, r], grown.cut[:, r], weight * _round(grown, r).values()[:, 0]
    depth = int(math.log2(feature.shape[1])) - 1

    def step(raw, margin):
        b = pickle.loads(raw)
        margin = np.zeros((plan.fits, len(b.slots))) if margin is None else margin
        return np.array([margin[f] + value[f].take(_walk(b.slots, feature[f], cut[f], depth)) for f in range(plan.fits)])
    return step


def _round(g: Trees, r: int) -> Trees:
    return Trees(*(a[:, r:r + 1] for a in (g.feature, g.cut, g.bin, g.split, g.n, g.sum, g.gain)))


def _boost_sums(plan: Plan, b: Block, margin, feature, cut, alive, level: int) -> np.ndarray:
    n, total, out = b.sums(power=0), b.sums(), []
    for f in range(plan.fits):
        m = None if margin is None else margin[f]
        if plan.binary:
            t = 2 * total - n if m is None else 4 * total / (1 + np.exp(2 * m)) - 4 * (n - total) / (1 + np.exp(-2 * m))
        else:
            t = total if m is None else 2 * (total - n * m)
        out.append(_histogram(plan, b, f, feature[f], cut[f], alive[f], level, n, t))
    return np.array(out)


# ---------------------------------------------------------------- scores of the folds
def _fold_scores(c: Cells, predict) -> list[float]:
    """R² of each fold, or the F1 of its positive class; `predict` gives a fit's prediction of each cell of a block."""
    plan = c.plan

    def sums(raw):
        b, out = pickle.loads(raw), []
        n, y, yy = b.sums(power=0), b.sums(), b.sums(power=2)
        for f in range(plan.folds):
            i = slice(b.ends[f - 1] if f else 0, b.ends[f])
            p = predict(f + 1, b.slots[i])
            if plan.binary:
                out.append([p @ y[i], p @ (n[i] - y[i]), (1 - p) @ y[i], 0.0])
            else:
                out.append([n[i].sum(), y[i].sum(), yy[i].sum(), (yy[i] - 2 * p * y[i] + n[i] * p * p).sum()])
        return np.array(out)

    scores = []
    for a, b, d, e in np.sum(c.blocks.map(sums).collect(), axis=0):
        if plan.binary:  # hits, false alarms, misses
            scores.append(float(2 * a / (2 * a + b + d)) if a else 0.0)
        else:
            scores.append(float(1 - e / (d - b * b / a)))
    return scores


def _ensemble(plan: Plan, g: Trees, weights: np.ndarray, share: bool):
    """Prediction of a fit for cells; a forest of 0 and 1 shares its vote by the leaves' means, margins are above 0."""
    value, depth, feature, cut = (_pruned(g) if share else g).values() * weights[:, None], int(math.log2(g.cut.shape[2])) - 1, g.feature, g.cut

    def predict(fit: int, slots: np.ndarray) -> np.ndarray:
        p = np.zeros(len(slots))
        for t in range(feature.shape[1]):
            p += value[fit, t].take(_walk(slots, feature[fit, t], cut[fit, t], depth))
        return (p > (0.5 if share else 0.0)).astype(float) if plan.binary else p
    return predict


def _pruned(g: Trees) -> Trees:
    """Classes as Spark leaves them: two leaves of the same class become one."""
    split, half = g.split.copy(), g.split.shape[2] // 2
    one = 2 * g.sum > g.n
    for i in range(half - 1, 0, -1):
        a, b = 2 * i, 2 * i + 1
        inner = (split[:, :, a] | split[:, :, b]) if a < half else np.zeros_like(split[:, :, i])
        split[:, :, i] &= inner | (one[:, :, a] != one[:, :, b])
    return Trees(g.feature, g.cut, g.bin, split, g.n, g.sum, g.gain)


# ---------------------------------------------------------------- Spark's models
def _nodes(plan: Plan, g: Trees, t: int, stats: np.ndarray | None, gini: bool):
    """Rows of the saved tree, children after their parent."""
    order, rows, texts = [], [], len(plan.edges)

    def visit(i):
        me = len(order)
        order.append(i)
        rows.append(None)
        split = bool(g.split[0, t, i])
        kids = (visit(2 * i), visit(2 * i + 1)) if split else (-1, -1)
        n, s = float(g.n[0, t, i]), float(g.sum[0, t, i])
        mean = s / n if n else 0.0
        if gini:
            kept, impurity, prediction = [n - s, s], 2 * mean * (1 - mean), float(2 * s > n)
        else:
            squares = float(stats[t, 2, i]) if stats is not None else n * mean * mean
            kept, impurity, prediction = [n, s, squares], max(0.0, squares / n - mean * mean) if n else 0.0, mean
        f = int(g.feature[0, t, i])
        at = float(plan.cuts[0][f][g.bin[0, t, i]]) if split and f < texts else 0.5
        rows[me] = (t, {"id": me, "prediction": prediction, "impurity": impurity, "impurityStats": kept, "rawCount": round(n), "gain": float(g.gain[0, t, i]) if split else -1.0,
                        "leftChild": kids[0], "rightChild": kids[1],
                        "split": {"featureIndex": f if split else -1, "leftCategoriesOrThreshold": [at] if split else [], "numCategories": -1}})
        return me

    visit(1)
    return rows


_NODE = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())), ("rawCount", pa.int64()), ("gain", pa.float64()),
                   ("leftChild", pa.int32()), ("rightChild", pa.int32()),
                   ("split", pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())]))])


def _spark_model(c: Cells, est: Estimator, count: str, g: Trees, weights: np.ndarray, stats: np.ndarray | None, gini: bool):
    """The trees of fit 0 as the estimator's model: Spark reads them as it reads a saved one."""
    plan, spark = c.plan, c.spark
    tiny = spark.createDataFrame([(float(i), Vectors.dense([float(i)] * plan.features)) for i in (0, 1)], [c.label, "features"])
    model = est.copy({est.getParam(count): 1}).fit(tiny)
    like, path = scratch_path(spark, "tree"), scratch_path(spark, "trees")
    model.write().save(like)
    meta = json.loads(spark.read.text(f"{like}/metadata").first()[0])
    one = spark.read.parquet(f"{like}/treesMetadata").first()[1]
    trees = g.split.shape[1]
    meta["numTrees"] = meta["paramMap"][count] = trees
    spark.sparkContext.parallelize([json.dumps(meta)], 1).saveAsTextFile(f"{path}/metadata")
    spark.createDataFrame([(t, one, float(w)) for t, w in enumerate(weights)], "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    rows = [r for t in range(trees) for r in _nodes(plan, g, t, stats, gini)]
    table = pa.table({"treeID": pa.array([r[0] for r in rows], pa.int32()), "nodeData": pa.array([r[1] for r in rows], _NODE)})
    spark.createDataFrame(table).write.parquet(f"{path}/data")
    return type(model).load(path)


def fit(c: Cells, est: Estimator) -> tuple[PipelineModel, list[float]]:
    """(model of the whole part with its preprocessing, score of each fold) of a forest or of boosted trees."""
    if est.hasParam("numTrees"):
        g, stats = forest(c, est.getNumTrees(), est.getMaxDepth(), est.getFeatureSubsetStrategy(), est.getSeed())
        trees = est.getNumTrees()
        weights = np.ones(trees)
        scores = _fold_scores(c, _ensemble(c.plan, g, weights / trees, c.plan.binary)) if c.plan.folds else []
        model = _spark_model(c, est, "numTrees", _pruned(g) if c.plan.binary else g, weights, stats, c.plan.binary)
    else:
        g = boost(c, est.getMaxIter(), est.getMaxDepth(), est.getStepSize())
        weights = np.array([1.0, *[est.getStepSize()] * (est.getMaxIter() - 1)])
        scores = _fold_scores(c, _ensemble(c.plan, g, weights, False)) if c.plan.folds else []
        model = _spark_model(c, est, "maxIter", g, weights, None, False)
    return PipelineModel(stages=[*c.pre.stages, model]), scores
