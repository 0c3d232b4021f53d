import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import toxicity_chain as T

from .helpers import rows

SCHEMA = "doc_id long, text string, toxic string, _row int, p_toxic int"
CHAIN = dataclasses.replace(T.Chain(), features=1 << 14)


@pytest.mark.parametrize("sf, least, caught", [("sf0.01", 90, 0.4), ("sf0.1", 900, 0.85)])
def test_held_out_accuracy(spark, sf, least, caught):
    """With 300 labelled rows, 36 of them toxic, many toxic words were seen in one or two rows or in none: half is found, and little else."""
    sf = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = T.scored(docs, labels.where(~held)).join(labels.where(held).select("doc_id", F.col("toxic").alias("y")), "doc_id").collect()
    print(len(got), sum(r.toxic and not r.y for r in got), sum(r.toxic and r.y for r in got), sum(r.y for r in got))
    assert len(got) > least
    assert sum(r.toxic and not r.y for r in got) <= 0.015 * len(got)
    assert sum(r.toxic and r.y for r in got) >= caught * sum(r.y for r in got)


def logistic(x, y, penalty):
    """Newton's steps to the optimum of the mean loss and half the penalty on the squared weights, the intercept free."""
    x = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve(x.T * (p * (1 - p)) @ x / len(x) + ridge + 1e-12 * np.eye(len(w)), x.T @ (p - y) / len(x) + ridge @ w)
    return w


def test_chain_matches_plain_arrays(spark):
    """Choice of words, scaling, out-of-fold probabilities, fits and threshold again, in NumPy with an exact optimum."""
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in "klmnopqr"]
    data, marks = [], []
    for i in range(240):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        text = [rng.choice(vocabulary) for _ in range(12)] + ["junk"] * (bad and rng.random() < 0.8) + ["vile"] * (toxic and rng.random() < 0.8)
        data.append((i, " ".join(text), "x", 1, 2))
        if i < 200:
            marks.append((i, 0 if bad else 1, int(toxic)))
    docs = spark.createDataFrame(data, SCHEMA).repartition(3)
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    chain = dataclasses.replace(T.Chain(), features=1 << 10, iterations=400)
    got = {r["doc_id"]: r for r in rows(T.scored(docs, labels, chain))}

    fold = F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(2)).cast("int").alias("fold")
    bags = T.bagged(docs, chain).select("doc_id", fold, "_bag").orderBy("doc_id").collect()
    x = np.array([r["_bag"].toArray() for r in bags])
    fold, n = np.array([r["fold"] for r in bags]), len(marks)
    targets = {"low_quality": np.array([1.0 - q for _, q, _ in marks]), "toxic": np.array([float(t) for _, _, t in marks])}

    def fit(at, y, before):
        """A function that gives the probabilities of rows, learned from rows ``at``."""
        some, truth = x[at], y[at]
        pos, neg, p, q = some[truth == 1].sum(0), some[truth == 0].sum(0), (truth == 1).sum(), (truth == 0).sum()
        gain = np.zeros(x.shape[1])
        for j in range(x.shape[1]):
            for seen, cls in ((pos[j], p), (neg[j], q)):
                for part in (seen, cls - seen):
                    whole = pos[j] + neg[j] if part is seen else p + q - pos[j] - neg[j]
                    if part:
                        gain[j] += part * np.log(part / (cls * whole / (p + q)))
        often = pos + neg >= 3
        best = sorted((j for j in range(x.shape[1]) if often[j] and gain[j] >= np.log(often.sum())), key=lambda j: -gain[j])[: chain.telling]
        ratio = np.where(often, np.log((pos + 1) / (p + 2)) - np.log((neg + 1) / (q + 2)), 0.0)[best]

        def features(rows_, extra):
            return np.hstack([x[rows_][:, best] * ratio, *[e[rows_][:, None] for e in extra]])

        w = logistic(features(at, before), truth, chain.penalty)
        return lambda rows_, extra: 1 / (1 + np.exp(-(features(rows_, extra) @ w[:-1] + w[-1])))

    every, train = np.arange(len(data)), np.arange(n)
    held, full = [], []  # out-of-fold probabilities of training rows; the whole models' of all rows
    for name, y in targets.items():
        whole = fit(train, y, held)
        out = np.zeros(n)
        for k in (0, 1):
            out[fold[:n] == k] = fit(train[fold[:n] != k], y, held)(train[fold[:n] == k], held)
        full.append(whole(every, full))
        held.append(out)
        assert [got[i][f"p_{name}"] for i in range(len(data))] == pytest.approx(full[-1], abs=2e-3)
    steps = np.floor(held[-1] * 1000)
    f1 = {s: 2 * ((steps >= s) & (targets["toxic"] == 1)).sum() / ((steps >= s).sum() + targets["toxic"].sum()) for s in set(steps)}
    flagged = [got[i]["toxic"] for i in range(len(data))]
    sure = [full[-1][i] * 1000 >= max(s for s in f1 if f1[s] > max(f1.values()) - 0.02) for i in range(len(data))]
    assert sum(a != b for a, b in zip(flagged, sure, strict=True)) <= 0.03 * len(data)


def test_corner_cases(spark):
    ok = [(i, f"fine words number {'abcdefgh'[i % 8]} here and there", "x", 1, 2) for i in range(40)]
    bad = [(100 + i, f"you idiot moron {'abcdefgh'[i % 8]} here and there", "x", 1, 2) for i in range(40)]
    more = [(500, None, None, None, None), (501, "", "x", 1, 2), (None, "idiot moron", "x", 1, 2), (502, "fine words " * 30_000, "x", 1, 2), (100, bad[0][1], "x", 1, 2)]
    docs = spark.createDataFrame(ok + bad + more, SCHEMA).repartition(3)
    labels = spark.createDataFrame([(r[0], 1, 0) for r in ok] + [(r[0], 1, 1) for r in bad] + [(100, 1, None), (None, 0, 1), (9999, 0, 1)], "doc_id long, quality int, toxic int")
    got = rows(T.scored(docs, labels, CHAIN))
    assert len(got) == 85
    flag = {r["doc_id"]: r["toxic"] for r in got}
    assert all(flag[r[0]] for r in bad) and flag[None]
    assert not any(flag[r[0]] for r in ok) and not flag[502]
    kept = T.clean(docs, labels, CHAIN)
    assert kept.columns == docs.columns
    assert kept.where("doc_id between 100 and 140").count() == 0
    assert kept.where("doc_id < 100").count() == 40


def test_labels_that_tell_nothing_reject_nothing(spark):
    docs = spark.createDataFrame([(i, f"words {'abcdefgh'[i % 8]} here", "x", 1, 2) for i in range(60)], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(i % 11 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    assert T.clean(docs, labels, CHAIN).count() == 60


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 1, 2)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["toxic"] for r in rows(T.scored(docs, labels, CHAIN))] == [False]
    assert T.scored(docs.limit(0), labels, CHAIN).count() == 0
    assert T.clean(docs.limit(0), labels, CHAIN).count() == 0
