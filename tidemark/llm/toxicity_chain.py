"""Toxicity by a classifier chain: linear models predict one category after another, each fed the probabilities of those before it.

A text is the set of its lower-cased words, hashed. For each category the words that tell
about it are chosen in the training rows: those in three rows or more whose log likelihood
ratio is at least the logarithm of the number of such words, so that chance lets few words
in however many there are; of them the best ``Chain.telling``. They are scaled by their
naive-Bayes log ratios, and a logistic regression is fitted on top. The probabilities that later models are trained with are out of fold:
every training row's come from models that have not seen it. The last category's threshold
is the one with the best F1 over such probabilities, of those with half of the flagged rows
right; if there is none, nothing is flagged, so few labels never reject clean documents.

Training uses labelled rows only, at most about ``Chain.rows`` of them, by a hash of their
id; this is the one bound. They are few and sparse, so one task fits the whole chain, folds
included, by L-BFGS on arrays: one job, where a fit of each model would take one an iteration. Every row is scored, on its whole text. Null and empty texts
have no words and get the base rates; null ids are scored like others but never train.
Repeated rows get equal results; where labels repeat, the largest counts. Without labelled
rows every probability is 0. An empty table gives an empty result. Other columns are kept
by ``clean`` and ignored by ``scored``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, written


@dataclass(frozen=True)
class Chain:
    """categories: name and SQL condition on the labels, in chain order; the last one decides."""

    categories: tuple[tuple[str, str], ...] = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
    rows: int = 40_000
    folds: int = 2
    features: int = 1 << 17
    telling: int = 4096
    penalty: float = 3e-3
    iterations: int = 15


def bagged(docs: DataFrame, chain: Chain) -> DataFrame:
    """docs with the hashed words of text in _bag."""
    words = F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+")
    df = docs.withColumn("_words", F.filter(words, lambda w: w != ""))
    return HashingTF(numFeatures=chain.features, inputCol="_words", outputCol="_bag", binary=True).transform(df).drop("_words")


@dataclass
class Bags:
    """Rows as sets of word numbers: ``words`` one after another, ``row`` of each, and the number of rows."""

    words: np.ndarray
    row: np.ndarray
    n: int

    @classmethod
    def of(cls, sets: list) -> Bags:
        sizes = np.array([len(s) for s in sets], np.int64)
        words = np.concatenate([np.zeros(0, np.int64), *[np.asarray(s, np.int64) for s in sets]])
        return cls(words, np.repeat(np.arange(len(sets)), sizes), len(sets))

    def some(self, rows: np.ndarray) -> Bags:
        at = np.full(self.n, -1)
        at[rows] = np.arange(len(rows))
        new = at[self.row]
        return Bags(self.words[new >= 0], new[new >= 0], len(rows))


@dataclass
class Model:
    """A linear model over some words and the probabilities of the categories before."""

    words: np.ndarray
    weights: np.ndarray
    before: np.ndarray
    bias: float

    def told(self, bags: Bags, before: list[np.ndarray], features: int) -> np.ndarray:
        dense = np.zeros(features)
        dense[self.words] = self.weights
        z = np.bincount(bags.row, dense[bags.words], bags.n) + self.bias
        for w, p in zip(self.before, before, strict=True):
            z = z + w * p
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def telling(bags: Bags, y: np.ndarray, chain: Chain) -> tuple[np.ndarray, np.ndarray]:
    """The most telling words (one at least), and the log ratios of their smoothed rates in the two classes."""
    hit = y[bags.row] == 1
    pos, neg = (np.bincount(bags.words[at], minlength=chain.features).astype(float) for at in (hit, ~hit))
    p, q = float((y == 1).sum()), float((y == 0).sum())
    rate = (pos + neg) / max(p + q, 1)

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9))

    gain = part(pos, p * rate) + part(neg, q * rate) + part(p - pos, p * (1 - rate)) + part(q - neg, q * (1 - rate))
    often = pos + neg >= 3
    gain = np.where(often, gain, -1.0)
    many = int((gain >= np.log(max(often.sum(), 1))).sum())
    best = np.sort(np.lexsort((np.arange(len(gain)), -gain))[: max(1, min(many, chain.telling))])
    ratio = np.log((pos + 1) / (p + 2)) - np.log((neg + 1) / (q + 2))
    return best, np.where(often, ratio, 0.0)[best]


def least(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int, memory: int = 10, close: float = 1e-6) -> np.ndarray:
    """Where f (value, gradient) is least, by L-BFGS with halved steps, after ``steps`` steps at most."""
    value, grad = f(x)
    moves: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, kept = grad.copy(), []
        for s, g in reversed(moves):
            a = (s @ q) / (g @ s)
            kept.append(a)
            q -= a * g
        if moves:
            s, g = moves[-1]
            q *= (s @ g) / (g @ g)
        for (s, g), a in zip(moves, reversed(kept), strict=True):
            q += (a - (g @ q) / (g @ s)) * s
        step, slope = (1.0 if moves else min(1.0, 1 / max(np.abs(grad).sum(), 1e-12))), -(grad @ q)
        for _ in range(40):
            there, there_grad = f(x - step * q)
            if there <= value + 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, g = -step * q, there_grad - grad
        if s @ g > 1e-12 * np.sqrt((s @ s) * (g @ g)):
            moves = [*moves[-(memory - 1) :], (s, g)]
        x, gone, value, grad = x + s, value - there, there, there_grad
        if gone <= close * 1e-3 * max(abs(value), 1e-12) or np.abs(grad).max() <= close * 1e-2:
            break
    return x


def fitted(bags: Bags, y: np.ndarray, before: list[np.ndarray], chain: Chain) -> Model | None:
    """Logistic regression with a penalty on all weights but the bias. None without rows; with one class only, its bias is infinite."""
    if not bags.n:
        return None
    best, ratio = telling(bags, y, chain)
    rate = y.mean()
    if rate in (0, 1):
        return Model(best, np.zeros(len(best)), np.zeros(len(before)), np.inf if rate else -np.inf)
    at = np.full(chain.features, -1)
    at[best] = np.arange(len(best))
    column = at[bags.words]
    row, column = bags.row[column >= 0], column[column >= 0]
    value, extra, k = ratio[column], np.array(before).reshape(len(before), bags.n), len(best)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.bincount(row, value * w[column], bags.n) + w[k:-1] @ extra + w[-1]
        d = (_sigmoid(z) - y) / bags.n
        grad = np.r_[np.bincount(column, value * d[row], k), extra @ d, d.sum()]
        grad[:-1] += chain.penalty * w[:-1]
        return float(np.mean(np.logaddexp(0, z) - y * z) + chain.penalty / 2 * (w[:-1] @ w[:-1])), grad

    w = least(loss, np.r_[np.zeros(k + len(before)), np.log(rate / (1 - rate))], chain.iterations)
    return Model(best, ratio * w[:k], w[k:-1], float(w[-1]))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Where F1 is best among the places with half of the flagged rows right, in steps of 0.001; halfway to the next lower probability. Above 1 if there is none."""
    step, at = np.unique(np.floor(p * 1000).astype(int), return_inverse=True)
    yes, every = np.bincount(at, y, len(step)), np.bincount(at, minlength=len(step))
    total, hits, taken, best = yes.sum(), 0.0, 0, (0.0, 1.01)
    for i in range(len(step) - 1, -1, -1):
        hits, taken = hits + yes[i], taken + every[i]
        low = step[i - 1] if i else 0
        if hits > 0 and hits >= taken / 2:
            best = max(best, (2 * hits / (taken + total), (step[i] + low) / 2000))
    return max(best[1], 0.01)


def chained(bags: Bags, fold: np.ndarray, targets: np.ndarray, chain: Chain) -> tuple[list[Model | None], float]:
    """One model for each category, and the last one's threshold. targets: a row a category, not a number where it is not known."""
    models, held = [], []
    for y in targets:
        known = ~np.isnan(y)

        def learned(rows: np.ndarray, y: np.ndarray = y, held: tuple = tuple(held)) -> Model | None:
            return fitted(bags.some(rows), y[rows], [p[rows] for p in held], chain)

        models.append(learned(np.flatnonzero(known)))
        out = np.zeros(bags.n)
        for k in range(chain.folds):
            part, m = np.flatnonzero(fold == k), learned(np.flatnonzero(known & (fold != k)))
            if m is not None and len(part):
                out[part] = m.told(bags.some(part), [p[part] for p in held], chain.features)
        held.append(out)
    return models, best_threshold(held[-1][known], targets[-1][known])


_MODEL = "category int, words array<int>, weights array<double>, before array<double>, bias double, threshold double"


def trained(docs: DataFrame, labels: DataFrame, chain: Chain) -> tuple[list[Model | None], float]:
    """One model for each category, and the last one's threshold."""
    is_ = {f"_is_{name}": F.max(F.expr(when).cast("double")) for name, when in chain.categories}
    labels = labels.where("doc_id is not null").groupBy("doc_id").agg(*[v.alias(k) for k, v in is_.items()])
    n = labels.count()
    h = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))
    labels = labels.where(h < int((1 << 30) * min(1.0, chain.rows / max(n, 1))))
    rows = docs.select("doc_id", "text").join(small(labels, min(n, chain.rows)), "doc_id")
    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(chain.folds)).cast("int")  # copies share a fold
    words = F.unwrap_udt("_bag")["indices"].alias("_words")
    rows = written(bagged(rows, chain).select(words, F.coalesce(fold, F.lit(0)).alias("_fold"), *is_), "train")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches, schema)
        targets = np.array([t.column(2 + i).to_numpy() for i in range(many)], float)
        models, threshold = chained(Bags.of(t.column(0).to_pylist()), t.column(1).to_numpy(), targets, chain)
        for i, m in enumerate(models):
            if m is not None:
                one = {"category": [i], "words": [m.words.astype(np.int32)], "weights": [m.weights], "before": [m.before], "bias": [m.bias], "threshold": [threshold]}
                yield pa.RecordBatch.from_pydict(one, pa.schema([("category", pa.int32()), ("words", pa.list_(pa.int32())), *[(c, pa.list_(pa.float64())) for c in ("weights", "before")], *[(c, pa.float64()) for c in ("bias", "threshold")]]))

    many, schema = len(is_), pa.schema([("_words", pa.list_(pa.int32())), ("_fold", pa.int32()), *[(c, pa.float64()) for c in is_]])
    models: list[Model | None] = [None] * len(chain.categories)
    threshold = 1.01
    for r in rows.coalesce(1).sortWithinPartitions(F.xxhash64("_words"), *is_).mapInArrow(fit, _MODEL).collect():
        models[r["category"]] = Model(np.array(r["words"], np.int64), np.array(r["weights"]), np.array(r["before"]), r["bias"])
        threshold = r["threshold"]
    return models, threshold


def scored(docs: DataFrame, labels: DataFrame, chain: Chain = Chain()) -> DataFrame:
    """doc_id, p_<category> for each category, and the last category's verdict under its name, for every row of docs."""
    return _scored(docs.select("doc_id", "text"), docs, labels, chain, ["doc_id"])


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, chain: Chain, keep: list[str]) -> DataFrame:
    models, threshold = trained(docs, labels, chain)
    names = [name for name, _ in chain.categories]
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("array<double>")
    def told(words: pd.Series) -> pd.Series:
        bags, out = Bags.of(list(words)), []
        for m in shared.value:
            out.append(m.told(bags, out, chain.features) if m else np.zeros(bags.n))
        return pd.Series(list(np.array(out).T))

    out = bagged(rows, chain).select(*keep, told(F.unwrap_udt("_bag")["indices"]).alias("_p"))
    out = out.select(*keep, *[F.col("_p")[i].alias(f"p_{name}") for i, name in enumerate(names)])
    return out.withColumn(names[-1], F.col(f"p_{names[-1]}") >= threshold)


def clean(docs: DataFrame, labels: DataFrame, chain: Chain = Chain()) -> DataFrame:
    """The rows of docs that the chain does not reject."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return _scored(rows, docs, labels, chain, ["_row"]).where(~F.col(chain.categories[-1][0])).select("_row.*")
