import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import rows
from tidemark.llm import queries
from tidemark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>"


def brute(df):
    """Ids, exact deviations and whitened rows from a plain singular value decomposition."""
    kept = [(r["vec_id"], r["embedding"]) for r in rows(df) if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]
    x = np.floor(1024 * np.array([v for _, v in kept], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    _, sigma, vt = np.linalg.svd(c, full_matrices=False)
    e = sigma**2 / n
    exact = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s, strict=True)) for row in x]
    return [i for i, _ in kept], [v if v < 1 << 63 else None for v in exact], c @ vt[:8].T / np.sqrt(e[:8]), e[:8] / (c**2).sum() * n



def against(got, df, close=1e-9):
    ids, deviation, z, share = brute(df)
    exact = [r["deviation"] for r in got.where("component = 1").orderBy("vec_id").collect()]
    got = got.toPandas().sort_values(["vec_id", "component"])
    k = int(got.component.max())
    assert len(got) == k * len(ids) and set(got.n) == {len(ids)}
    order = np.argsort(ids, kind="stable")
    table = got.whitened.to_numpy().reshape(-1, k)
    signs = np.sign((table * z[order][:, :k]).sum(0))
    assert np.abs(table * signs - z[order][:, :k]).max() < close
    assert exact == [deviation[i] for i in order]
    assert np.abs(got.explained.to_numpy()[:k] / share[:k] - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    return k


def test_query_equals_a_plain_decomposition(spark, sf):
    assert against(queries.op13_choleskyqr_whitening(spark, sf), spark.read.parquet(f"{sf}/embeddings.parquet")) == 8


def frame(spark, a):
    return spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(a)], SCHEMA)


def test_nearly_singular_columns_keep_their_digits(spark):
    """Variances from 1e12 down to 1e-4 in rotated axes: the covariance in doubles loses the last ones."""
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.normal(size=(9, 9)))
    df = frame(spark, rng.normal(size=(900, 9)) * np.logspace(6, -2, 9) @ q)
    assert against(W.components(df), df, 1e-7) == 8


def test_equal_and_constant_columns(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(300, 6))
    a[:, 2], a[:, 4] = a[:, 1], 3.0
    assert against(W.components(frame(spark, a)), frame(spark, a)) == 4


def test_bad_rows_go_and_repeats_stay(spark):
    rng = np.random.default_rng(2)
    good = [(i, [float(c) for c in r]) for i, r in enumerate(rng.normal(size=(60, 3)))]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    df = spark.createDataFrame(good + good[:5] + bad, SCHEMA)
    out = W.components(df.withColumns({"n": F.lit("x"), "x": F.lit(1), "whitened": F.lit(2)}))
    assert {r["vec_id"] for r in out.collect()} == set(range(60)) and out.count() == 65 * 3
    assert set(r["n"] for r in out.collect()) == {65}


@pytest.mark.parametrize("a", [np.zeros((0, 3)), np.ones((1, 3)), np.ones((40, 3)), np.array([[1, 2], [3, 5]])])
def test_without_variance(spark, a):
    assert W.components(frame(spark, a)).count() == (2 if len(a) == 2 else 0)


def test_null_ids_floats_and_huge_entries(spark):
    df = spark.createDataFrame([(None, [1e300, 1.0]), (2, [-1e300, 2.0]), (None, [0.5, 3.0])], SCHEMA)
    out = rows(W.components(df))
    assert len(out) in (3, 6) and all(r["deviation"] is None or r["deviation"] > 0 for r in out)
