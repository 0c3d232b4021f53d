from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees as T


def data(spark, n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5)).round(3)
    y = np.where(x[:, 0] + x[:, 1] * x[:, 2] > 0.6, 0, np.where(x[:, 3] < -0.3, 1, 2))
    return x, y, spark.createDataFrame([(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")


@pytest.fixture(scope="module")
def model(spark):
    x, y, df = data(spark)
    return x, y, df, T.fitted(df, "x", "y", F.col("id"), T.Boosting(rounds=30, depth=3, rate=0.2, least=1.0))


def test_learns_and_probabilities_add_up(model):
    x, y, df, forest = model
    p = np.array([r["p"] for r in df.select(T.probabilities("x", forest).alias("p")).collect()])
    assert np.abs(p.sum(1) - 1).max() < 1e-12
    assert (p.argmax(1) == y).mean() > 0.93
    assert np.abs(p - T.softmax(T.margins(x, forest))).max() < 1e-12


def test_unseen_rows(spark, model):
    x, y, _ = data(spark, seed=8)
    assert (T.margins(x, model[3]).argmax(1) == y).mean() > 0.8


def test_a_job_for_each_level_grows_the_same_trees(spark):
    _, _, df = data(spark, 400)
    how = T.Boosting(rounds=4, depth=3, rate=0.3, least=1.0, stored=2)
    one = T.fitted(df, "x", "y", F.col("id"), how)
    many = T.fitted(df.repartition(5), "x", "y", F.col("id"), T.Boosting(rounds=4, depth=3, rate=0.3, least=1.0, stored=2, local=0))
    assert (one.feature == many.feature).all() and np.abs(one.threshold - many.threshold).max() < 1e-12
    assert np.abs(one.weight - many.weight).max() < 1e-9 and np.abs(one.cover - many.cover).max() < 1e-9


def test_first_split_has_the_greatest_gain(spark):
    """Against all cuts between values, without sampling."""
    x, y, df = data(spark, 300)
    how = T.Boosting(rounds=1, depth=1, rows=1.0, columns=1.0, bins=512, least=1.0)
    forest = T.fitted(df, "x", "y", F.col("id"), how)
    score = lambda g, h: max(abs(g) - how.l1, 0) ** 2 / (h + how.l2)
    for k in range(3):
        g, h = 1 / 3 - (y == k), np.full(len(y), 2 * 1 / 3 * 2 / 3)
        gains = {(f, c): score(g[m].sum(), h[m].sum()) + score(g[~m].sum(), h[~m].sum()) for f in range(5) for c in np.unique(x[:, f])[:-1] for m in [x[:, f] <= c] if min(h[m].sum(), h[~m].sum()) >= how.least}
        f, c = forest.feature[0, k, 0], forest.threshold[0, k, 0]
        here = x[:, f] <= c
        got = score(g[here].sum(), h[here].sum()) + score(g[~here].sum(), h[~here].sum())
        assert abs(got - max(gains.values())) < 1e-9


def shapley(x, feature, threshold, weight, cover):
    """By all subsets: what is not known follows both branches by their covers."""
    n = len(x)

    def value(i, known):
        f = feature[i]
        if f < 0:
            return weight[i]
        if f in known:
            return value(2 * i + 1 if x[f] <= threshold[i] else 2 * i + 2, known)
        return sum(cover[c] / cover[i] * value(c, known) for c in (2 * i + 1, 2 * i + 2))

    out = np.zeros(n)
    for i in range(n):
        rest = [j for j in range(n) if j != i]
        for k in range(n):
            for s in combinations(rest, k):
                out[i] += factorial(k) * factorial(n - 1 - k) / factorial(n) * (value(0, {*s, i}) - value(0, set(s)))
    return out, value(0, set())


def test_contributions_equal_brute_force(model):
    x, _, _, forest = model
    for r in (0, 7, 29):
        tree = [a[r, 0] for a in (forest.feature, forest.threshold, forest.weight, forest.cover)]
        got, base = T.contributions(x[:20], [T.paths(*tree)])
        for row, effects in zip(x[:20], got, strict=True):
            want, at = shapley(row, *tree)
            assert np.abs(effects - want).max() < 1e-9 and abs(base - at) < 1e-9


@pytest.mark.parametrize("k", [0, 1, 2])
def test_contributions_add_up_to_the_margin(model, k):
    _, _, df, forest = model
    for r in df.select(T.explained("x", forest, k).alias("e")).select("e.*").limit(200).collect():
        assert abs(r["base"] + sum(r["effects"]) - r["margin"]) < 1e-9


def test_model_as_rows(model):
    again = T.Forest.of(model[3].rows())
    assert all((getattr(again, n) == getattr(model[3], n)).all() for n in ("feature", "threshold", "weight", "cover"))


def test_too_few_rows(spark):
    with pytest.raises(ValueError, match="200"):
        T.fitted(data(spark, 50)[2], "x", "y", F.col("id"))
