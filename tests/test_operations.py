import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import text as X
from tidemark.operators import learning as L
from tidemark.operators import operations as Q
from tidemark.plans import operations as queries
from tidemark.sources import files


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def walked(events, chain):
    """Requests of one service, one after another."""
    out, used, recent = {}, {}, {n: [] for n, *_ in chain}
    for at, i, ok in sorted(events):
        won, tried = None, []
        for name, per_day, per_minute in chain:
            recent[name] = [t for t in recent[name] if t > at - dt.timedelta(seconds=60)]
            if used.get((name, at.date()), 0) >= per_day or len(recent[name]) >= per_minute:
                tried.append(f"{name}: rate limited")
                continue
            used[name, at.date()] = used.get((name, at.date()), 0) + 1
            recent[name].append(at)
            if name in ok:
                won = name
                break
            tried.append(f"{name}: failed")
        out[i] = (won, "; ".join(tried))
    return out


def test_fallback_keeps_to_limits(spark):
    rng = random.Random(1)
    chain = [("a", 9, 2), ("b", 5, 1), ("c", 2, 3)]
    rows = []
    for i in range(300):
        at = dt.datetime(2024, 1, 1, 23, 50) + dt.timedelta(seconds=rng.randrange(1500))
        rows.append((i % 3, at, i, [n for n in "abc" if rng.random() < 0.7]))
    df = spark.createDataFrame(rows, "k long, ts timestamp_ntz, id long, works array<string>").repartition(4)
    got = {r.id: (r.provider, r.attempts) for r in Q.with_fallback(df, chain, "k", "ts", "id", "works").collect()}
    want = {}
    for k in range(3):
        want |= walked([r[1:] for r in rows if r[0] == k], chain)
    assert got == want and {p for p, _ in got.values()} == {"a", "b", "c", None}


def test_registered_fallback_is_the_walk(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.event_id: (r.provider, r.attempts) for r in queries.rate_limited_fallback(spark, sf).collect()}
    want = {}
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_type", "ts", "event_id").collect()
    for kind in {r.event_type for r in rows}:
        want |= walked([(r.ts, r.event_id, [n for i, (n, *_) in enumerate(queries.CHAIN) if r.event_id % (5 + i)]) for r in rows if r.event_type == kind], queries.CHAIN)
    assert got == want


def test_weighted_f1(spark):
    truth, pred = [0, 0, 0, 1, 1, 2, 2, 2, 2, 1], [0, 0, 1, 1, 1, 2, 2, 0, 2, 2]
    df = spark.createDataFrame([(float(y), *(1.0 if p == k else 0.0 for k in range(3))) for y, p in zip(truth, pred, strict=True)], "y double, ml_up double, ml_down double, ml_flat double")
    want = 0.0
    for k in range(3):
        tp = sum(a == b == k for a, b in zip(truth, pred, strict=True))
        want += truth.count(k) / 10 * 2 * tp / (truth.count(k) + pred.count(k))
    r = L.metrics(df, "y").first()
    assert r.accuracy == 0.7 and r.weighted_f1 == pytest.approx(want, abs=1e-6) and r.recall_up == pytest.approx(2 / 3, abs=1e-6)
    assert L.metrics(df.where("y = 2"), "y").first().recall_down is None


def test_parts_follow_in_time(spark):
    df = spark.createDataFrame([("a", i) for i in range(100)], "k string, t int")
    n = {r.part: (r.lo, r.hi) for r in L.staged(df, "k", "t").groupBy("part").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert n == {"train": (0, 63), "calibrate": (64, 79), "test": (80, 99)}


def test_models_are_trained_once(spark, tmp_path):
    rng = random.Random(2)
    df = spark.createDataFrame([([rng.random(), rng.random()], float(i % 3), i) for i in range(240)], "x array<double>, y double, k int")
    calls = []

    def train():
        calls.append(1)
        return L.trained(df, "x", "y", "k", L.Boosting(rounds=1, depth=1))

    a, b = (L.kept(f"{tmp_path}/m", spark, train) for _ in range(2))
    assert len(calls) == 1 and (a.weight == b.weight).all()
    assert sorted(map(str, L.predicted(df, a, "x").collect())) == sorted(map(str, L.predicted(df, b, "x").collect()))


def test_checks_stop_bad_rows(spark):
    df = spark.createDataFrame([(0.5, 3), (1.0, 1)], "p double, n int")
    assert Q.checked(df, ["p"], ["n"]).count() == 2
    bad = spark.createDataFrame([(1.5, 3), (None, 1), (float("nan"), 0)], "p double, n int")
    assert [r.v for r in bad.select(Q.violations(["p"], ["n"]).alias("v")).collect()] == ["p", "p", "p,n"]
    with pytest.raises(Exception, match="outside the valid range: p"):
        Q.checked(bad, ["p"], ["n"]).collect()


def test_pages(spark):
    df = spark.range(45)
    order = [F.col("id")]
    assert [(r.id, r.has_more) for r in Q.page(df, order, 40, 3).collect()] == [(40, True), (41, True), (42, True)]
    assert [(r.id, r.has_more) for r in Q.page(df, order, 40, 5).collect()][-1] == (44, False)
    for offset, limit in ((0, 0), (0, 101), (-1, 5)):
        with pytest.raises(ValueError):
            Q.page(df, order, offset, limit)


def test_documents(spark):
    r = one(spark, D.canonical(F.lit('{"b":-0,"a":[-0.0,{"d":null,"c":"-0"}]}')).alias("a"), D.canonical(F.lit("{")).alias("b"), D.half_even(F.lit(0.125), 2).alias("c"), D.half_even(F.lit(-2.5)).alias("d"), D.lenient_vector(F.lit("[1, 2.5]")).alias("e"), D.lenient_vector(F.lit("nan")).alias("f"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ('{"a":[0,{"c":"-0","d":null}],"b":0}', None, 0.12, -2.0, [1.0, 2.5], [])


@pytest.mark.parametrize("hidden", ["/etc/app/secret.conf", r"C:\data\app\x.txt", "10.0.0.1", "172.16.5.4:80", "172.31.0.9", "192.168.1.1", "127.0.0.1", "localhost:8080", "DROP TABLE users", "insert into t values (1)", "update t set a = 1", "    at run (main.js:3:1)"])
def test_messages_hide(spark, hidden):
    got = one(spark, X.redacted(F.lit(f"it broke\n{hidden}")).alias("x")).x
    assert "[redacted]" in got and hidden.strip() not in got


@pytest.mark.parametrize("plain", ["rate 1/2 of all", "172.32.0.1 and 8.8.8.8", "please select one", "the update came", "look at it", "version 1.2.3"])
def test_messages_keep(spark, plain):
    assert one(spark, X.redacted(F.lit(plain)).alias("x")).x == plain


def test_positional_calendar(spark, tmp_path):
    lines = ["timestamp,name,impact,actual,estimate,previous,currency", "2024-01-02 09:00:00,CPI report,high,1.5,1.0,0.9,EUR", "2024-01-02T12:00:00Z,retail sales,,x,,2", "2024-01-09 09:00:00,GDP,high,1,1,1,USD", "2024-01-02 10:00:00,short,low"]
    (tmp_path / "c.csv").write_text("\r\n".join(lines))
    got = sorted(files.read_positional_calendar(spark, str(tmp_path / "c.csv"), "2024-01-02 00:00:00").collect())
    assert [(r.event_date, r.name, r.actual, r.estimate, r.previous, r.currency, r.impact) for r in got] == [(dt.datetime(2024, 1, 2, 9), "CPI report", 1.5, 1.0, 0.9, "EUR", "high"), (dt.datetime(2024, 1, 2, 12), "retail sales", None, None, 2.0, "USD", "medium")]


def test_archive_and_empty_accuracy(spark):
    old = spark.createDataFrame([("a", "b", "r1")], "fingerprint_id string, match_id string, batch_id string")
    new = spark.createDataFrame([("a", "b", "r2"), ("a", "c", "r2")], old.schema)
    assert sorted(tuple(r) for r in Q.archived(old, new).collect()) == [("a", "b", "r1"), ("a", "c", "r2")]
    f = spark.createDataFrame([("x", 1, "UP"), ("y", 1, "UP")], "k string, t int, direction string")
    got = {r.k: (r.evaluated, r.correct, r.accuracy) for r in Q.direction_accuracy(f, f.where("k = 'x'"), "k", "t").collect()}
    assert got == {"x": (1, 1, 100.0), "y": (0, 0, None)}
