"""Multiclass boosted trees by softmax and second-order gain, and exact contributions of features to their margins.

Features are cut into bins at their quantiles. A tree grows level by level: sums of gradients
and second derivatives by class, node, feature and bin give every split's gain. Up to
``Boosting.local`` rows one task holds all of them and grows all trees; beyond, each level is one
Spark job whose tasks sum their own rows and whose sums are added up by ``groupBy``, so that rows
stay where they are. Rows are drawn by a hash of their key and the round, so both ways draw alike.

A tree is a heap: node i has the children 2i+1 (values up to the threshold) and 2i+2. The model is
a table of one row a tree (round, class, feature, threshold, weight, cover), which tasks get as arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.writes import written

TREE = "round int, class int, feature array<int>, threshold array<double>, weight array<double>, cover array<double>"


@dataclass(frozen=True)
class Boosting:
    rounds: int = 200
    depth: int = 5
    rate: float = 0.05
    #: Shares of rows drawn for each round and of features for each tree.
    rows: float = 0.8
    columns: float = 0.8
    #: Second derivatives of a child at least.
    least: float = 5.0
    l1: float = 0.1
    l2: float = 1.0
    bins: int = 64
    seed: int = 42
    classes: int = 3
    #: Rows that one task may hold: two hundred bytes each.
    local: int = 200_000
    #: Rounds after which the rows' margins are written anew, beyond that.
    stored: int = 10


@dataclass
class Forest:
    """Trees by round and class, as heaps: arrays (rounds, classes, nodes). A leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    weight: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, trees: list[tuple]) -> Forest:
        """From rows of TREE."""
        trees = sorted(trees)
        classes = 1 + max(t[1] for t in trees)
        return cls(*(np.array([t[i] for t in trees]).reshape(-1, classes, len(trees[0][2])) for i in (2, 3, 4, 5)))

    def rows(self) -> list[tuple]:
        r, k, _ = self.feature.shape
        return [(i, j, *(a[i, j].tolist() for a in (self.feature, self.threshold, self.weight, self.cover))) for i in range(r) for j in range(k)]

    @property
    def depth(self) -> int:
        return int(self.feature.shape[2] + 1).bit_length() - 2


def _leaves(x: np.ndarray, feature: np.ndarray, threshold: np.ndarray, depth: int) -> np.ndarray:
    """The node in which each row of x ends after ``depth`` steps."""
    node, row = np.zeros(len(x), np.int64), np.arange(len(x))
    for _ in range(depth):
        f = feature[node]
        node = np.where(f >= 0, 2 * node + 1 + ~(x[row, f] <= threshold[node]), node)
    return node


def margins(x: np.ndarray, forest: Forest) -> np.ndarray:
    """Sums of the trees' weights by row and class."""
    rounds, classes, _ = forest.feature.shape
    out = np.zeros((len(x), classes))
    for r in range(rounds):
        for k in range(classes):
            out[:, k] += forest.weight[r, k][_leaves(x, forest.feature[r, k], forest.threshold[r, k], forest.depth)]
    return out


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _uniform(key: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) by key and salt alone (a finaliser of 64-bit words)."""
    with np.errstate(over="ignore"):
        z = key.astype(np.uint64) + np.uint64(salt + 1) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53)


# Growing -----------------------------------------------------------------------------------


@dataclass
class _Round:
    """The trees of a round while they grow: splits by bin, weights and covers."""

    feature: np.ndarray
    bin: np.ndarray
    weight: np.ndarray
    cover: np.ndarray

    @classmethod
    def empty(cls, how: Boosting) -> _Round:
        shape = (how.classes, 2 ** (how.depth + 1) - 1)
        return cls(np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape))


def histograms(bins: np.ndarray, y: np.ndarray, key: np.ndarray, margin: np.ndarray, trees: _Round, level: int, number: int, how: Boosting) -> np.ndarray:
    """Sums of gradients and second derivatives by class, node of the level, feature and bin, over the rows drawn for the round."""
    some = _uniform(key, how.seed * 1_000_003 + number) < how.rows
    bins, y, p = bins[some], y[some], softmax(margin[some])
    n, features = bins.shape
    nodes, first = 2**level, 2**level - 1
    out = np.zeros((how.classes, nodes * features * how.bins, 2))
    for k in range(how.classes):
        at = _leaves(bins, trees.feature[k], trees.bin[k], level) - first
        here = at >= 0
        g = p[here, k] - (y[here] == k)
        h = np.maximum(2 * p[here, k] * (1 - p[here, k]), 1e-16)
        slot = ((at[here, None] * features + np.arange(features)) * how.bins + bins[here]).ravel()
        for c, v in enumerate((g, h)):
            out[k, :, c] = np.bincount(slot, np.repeat(v, features), minlength=out.shape[1])
    return out.reshape(how.classes, nodes, features, how.bins, 2)


def _shrunk(g, how: Boosting):
    return np.sign(g) * np.maximum(np.abs(g) - how.l1, 0)


def _score(g, h, how: Boosting):
    return _shrunk(g, how) ** 2 / (h + how.l2)


def split(sums: np.ndarray, trees: _Round, level: int, number: int, how: Boosting) -> bool:
    """Sets the level's weights, covers and splits from its sums; whether any node was split."""
    split_any = False
    features = sums.shape[2]
    for k in range(how.classes):
        drawn = np.sort(np.random.default_rng([how.seed, number, k]).permutation(features)[: max(1, round(how.columns * features))])
        for node in range(2**level):
            at = 2**level - 1 + node
            if level and trees.feature[k, (at - 1) // 2] < 0:
                continue
            g, h = sums[k, node, 0].sum(axis=0)
            trees.weight[k, at], trees.cover[k, at] = -how.rate * _shrunk(g, how) / (h + how.l2), h
            if level == how.depth:
                continue
            left = np.cumsum(sums[k, node, drawn], axis=1)[:, :-1]
            gl, hl = left[:, :, 0], left[:, :, 1]
            gain = _score(gl, hl, how) + _score(g - gl, h - hl, how) - _score(g, h, how)
            gain = np.where((hl >= how.least) & (h - hl >= how.least), gain, -np.inf)
            best = np.unravel_index(np.argmax(gain), gain.shape)
            if gain[best] > 1e-9:
                trees.feature[k, at], trees.bin[k, at] = drawn[best[0]], best[1]
                split_any = True
    return split_any


def grown(sums_of, number: int, how: Boosting) -> _Round:
    """A round's trees; ``sums_of`` gives a level's sums."""
    trees = _Round.empty(how)
    for level in range(how.depth + 1):
        if not split(sums_of(trees, level, number), trees, level, number, how):
            break
    return trees


def added(bins: np.ndarray, margin: np.ndarray, rounds: list[_Round], how: Boosting) -> np.ndarray:
    out = margin.copy()
    for trees in rounds:
        for k in range(how.classes):
            out[:, k] += trees.weight[k][_leaves(bins, trees.feature[k], trees.bin[k], how.depth)]
    return out


def _forest(rounds: list[_Round], edges: np.ndarray) -> Forest:
    feature = np.array([t.feature for t in rounds])
    split_bin = np.array([t.bin for t in rounds])
    threshold = np.where(feature >= 0, edges[np.maximum(feature, 0), np.minimum(split_bin, edges.shape[1] - 1)], 0.0)
    weight = np.array([t.weight for t in rounds])
    return Forest(feature, threshold, np.where(feature >= 0, 0.0, weight), np.array([t.cover for t in rounds]))


def edges_of(df: DataFrame, features: str, how: Boosting) -> np.ndarray:
    """Upper edges of the bins of each feature, by quantiles in one pass; repeated ones are infinite, at the end."""
    first = df.select(F.size(features)).first()
    shares = F.array(*[F.lit(i / how.bins) for i in range(1, how.bins)])
    q = df.agg(*[F.percentile_approx(F.col(features)[i], shares, F.lit(100 * how.bins)).alias(f"q{i}") for i in range(first[0])]).first()
    out = np.full((len(q), how.bins - 1), np.inf)
    for row, qs in zip(out, q, strict=True):
        distinct = np.unique(qs)
        row[: len(distinct)] = distinct
    return out


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Of each value the first bin whose upper edge is not below it; the last bin for what is not a number."""
    return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)


def fitted(df: DataFrame, features: str, target: str, key: Column, how: Boosting = Boosting()) -> Forest:
    """Trees for the rows of df: an array of features, a target from 0 to classes - 1, and a key that draws rows (equal keys are drawn together)."""
    rows = df.select(F.xxhash64(key).alias("key"), F.col(target).cast("int").alias("y"), F.col(features).alias("x"))
    n = rows.count()
    if n < 200:
        raise ValueError("200 rows or more are needed")
    edges = edges_of(rows, "x", how)

    def arrays(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.array(b.column(2).to_pylist(), float).reshape(b.num_rows, -1)
        return b.column(0).to_numpy(), b.column(1).to_numpy(), binned(x, edges)

    if n <= how.local:

        def all_here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batches = list(batches)
            if not batches:
                return
            key, y, bins = arrays(pa.Table.from_batches(batches).combine_chunks())
            margin, rounds = np.zeros((len(y), how.classes)), []
            for number in range(how.rounds):
                rounds.append(grown(lambda t, level, i: histograms(bins, y, key, margin, t, level, i, how), number, how))
                margin = added(bins, margin, rounds[-1:], how)
            trees = list(zip(*_forest(rounds, edges).rows(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(trees, (pa.int32(), pa.int32(), pa.list_(pa.int32()), *[pa.list_(pa.float64())] * 3), strict=True)], ["round", "class", "feature", "threshold", "weight", "cover"])

        # ordered, so that sums are added in one order
        return Forest.of([tuple(r) for r in rows.repartition(1).sortWithinPartitions("key", "y", "x").mapInArrow(all_here, TREE).collect()])

    def stored(at: DataFrame, rounds: list[_Round]) -> DataFrame:
        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                bins = np.array(b.column(2).to_pylist(), np.int64).reshape(b.num_rows, -1)
                z = added(bins, np.array(b.column(3).to_pylist(), float).reshape(-1, how.classes), rounds, how)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(z), pa.list_(pa.float64()))], names)

        return written(at.mapInArrow(put, "key long, y int, bins array<smallint>, margin array<double>"), "margins")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bins = arrays(b)[2].astype(np.int16)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(bins), pa.list_(pa.int16())), pa.array([[0.0] * how.classes] * b.num_rows)], names)

    names = ["key", "y", "bins", "margin"]
    at = written(rows.mapInArrow(start, "key long, y int, bins array<smallint>, margin array<double>"), "margins")
    rounds: list[_Round] = []
    pending: list[_Round] = []

    def sums_of(trees: _Round, level: int, number: int) -> np.ndarray:
        def part(batches: Iterator[pa.RecordBatch], late: list[_Round]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    bins = np.array(b.column(2).to_pylist(), np.int64).reshape(b.num_rows, -1)
                    z = added(bins, np.array(b.column(3).to_pylist(), float).reshape(-1, how.classes), late, how)
                    one = histograms(bins, b.column(1).to_numpy(), b.column(0).to_numpy(), z, trees, level, number, how)
                    total = one if total is None else total + one
            if total is not None:
                flat = total.reshape(-1, 2)
                slot = np.flatnonzero(flat.any(axis=1))
                yield pa.RecordBatch.from_pydict({"slot": slot, "g": flat[slot, 0], "h": flat[slot, 1]})

        late = list(pending)
        sums = at.mapInArrow(partial(part, late=late), "slot long, g double, h double").groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
        out = np.zeros((how.classes * 2**level * len(edges) * how.bins, 2))
        out[sums["slot"].to_numpy(int)] = sums[["g", "h"]].to_numpy(float)
        return out.reshape(how.classes, 2**level, len(edges), how.bins, 2)

    for number in range(how.rounds):
        trees = grown(sums_of, number, how)
        rounds.append(trees)
        pending.append(trees)
        if len(pending) == how.stored:
            at, pending = stored(at, list(pending)), []
    return _forest(rounds, edges)


def probabilities(features: Column | str, forest: Forest) -> Column:
    """An array of the classes' probabilities."""

    @F.pandas_udf("array<double>")
    def told(x: pd.Series) -> pd.Series:
        return pd.Series(list(softmax(margins(np.array(x.tolist(), float).reshape(len(x), -1), forest))))

    return told(features)


# Contributions -----------------------------------------------------------------------------


@dataclass(frozen=True)
class _Path:
    """A leaf: its value, and for each feature on its path the share of rows that follow it there and its bounds (above, up to)."""

    value: float
    share: float
    features: tuple[int, ...]
    zeros: tuple[float, ...]
    bounds: tuple[tuple[float, float], ...]


def paths(feature: np.ndarray, threshold: np.ndarray, weight: np.ndarray, cover: np.ndarray) -> list[_Path]:
    out: list[_Path] = []

    def walk(i: int, share: float, at: dict[int, tuple[float, float, float]]) -> None:
        f = int(feature[i])
        if f < 0:
            out.append(_Path(float(weight[i]), share, tuple(at), tuple(z for z, _, _ in at.values()), tuple((lo, hi) for _, lo, hi in at.values())))
            return
        z, lo, hi = at.get(f, (1.0, -np.inf, np.inf))
        for child, bounds in ((2 * i + 1, (lo, min(hi, threshold[i]))), (2 * i + 2, (max(lo, threshold[i]), hi))):
            ratio = float(cover[child] / cover[i])
            walk(child, share * ratio, at | {f: (z * ratio, *bounds)})

    walk(0, 1.0, {})
    return out


def contributions(x: np.ndarray, trees: list[list[_Path]]) -> tuple[np.ndarray, float]:
    """Exact Shapley values of every row's features, where a feature that is not known follows both branches by their covers, and the base value.

    Of a leaf with d features a row's value is v times the product over its features of 1 or 0 (known)
    or the share (not known). The sum over subsets of other features, weighted by their size, needs the
    coefficients of the polynomial prod(share + known * t), so d^3 steps and no subsets.
    """
    out, base = np.zeros(x.shape), 0.0
    for leaf in (p for tree in trees for p in tree):
        base += leaf.value * leaf.share
        d = len(leaf.features)
        if not d or not leaf.value:
            continue
        known = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, (lo, hi) in zip(leaf.features, leaf.bounds, strict=True)]
        for i, f in enumerate(leaf.features):
            c = np.zeros((len(x), d))
            c[:, 0] = 1.0
            for j in range(d):
                if j != i:
                    up = c[:, :-1] * known[j][:, None]
                    c *= leaf.zeros[j]
                    c[:, 1:] += up
            total = sum(c[:, k] * (factorial(k) * factorial(d - 1 - k) / factorial(d)) for k in range(d))
            out[:, f] += leaf.value * (known[i] - leaf.zeros[i]) * total
    return out, base


def explained(features: Column | str, forest: Forest, of_class: int = 0) -> Column:
    """A struct of ``base``, ``margin`` and ``effects``, one a feature: base plus all effects is the class's margin."""
    trees = [paths(*(a[r, of_class] for a in (forest.feature, forest.threshold, forest.weight, forest.cover))) for r in range(len(forest.feature))]
    own = Forest(*(a[:, of_class : of_class + 1] for a in (forest.feature, forest.threshold, forest.weight, forest.cover)))

    @F.pandas_udf("base double, margin double, effects array<double>")
    def told(x: pd.Series) -> pd.DataFrame:
        m = np.array(x.tolist(), float).reshape(len(x), -1)
        effects, base = contributions(m, trees)
        return pd.DataFrame({"base": base, "margin": margins(m, own)[:, 0], "effects": list(effects)})

    return told(features)
