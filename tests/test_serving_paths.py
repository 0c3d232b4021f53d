"""Sources, replies, pages, traces, experiments, boundaries, and the index of states."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import fingerprint as P
from tidemark.operators import index as I
from tidemark.operators import operations as Q
from tidemark.operators import research as R
from tidemark.operators import similarity as M
from tidemark.operators.tracing import Trace
from tidemark.sources import responses as W

T0 = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "high,close,vol,trend",
    [(1.0030, 1.0, "NORMAL", "RANGING"), (1.0070, 1.0, "NORMAL", "RANGING"), (1.00701, 1.0, "HIGH", "RANGING"), (1.00299, 1.0, "LOW", "RANGING"), (1.0100, 1.0030, "HIGH", "RANGING"), (1.0100, 1.00301, "HIGH", "BULLISH"), (1.0, 1.0, "LOW", "RANGING")],
)
def test_boundaries_of_regimes_are_those_of_rounded_pips(spark, high, close, vol, trend):
    df = spark.createDataFrame([("a", T0, 1.0, high, 1.0, close)], "asset string, ts timestamp_ntz, open double, high double, low double, close double")
    r = P.fingerprints(df, 0.0001).first()
    assert (r.vol_regime, r.trend_regime) == (vol, trend)
    assert r.market_state_version == P.VERSIONS["market_state_version"]


def test_pips_at_thirty_never_fall_below(spark):
    """Lows from 1.0 to 1.5 and thirty pips more: binary fractions are off on both sides."""
    rows = [("a", T0, low, low + 0.003, low, low) for low in (round(1 + i / 10_000, 4) for i in range(0, 5000, 7))]
    df = spark.createDataFrame(rows, "asset string, ts timestamp_ntz, open double, high double, low double, close double")
    assert {r.vol_regime for r in P.fingerprints(df, 0.0001).select("vol_regime").collect()} == {"NORMAL"}


def test_market_state_is_of_the_snapshot_alone(spark):
    df = spark.createDataFrame([("a", T0, 1.0, 1.01, 0.99, 1.0), ("a", T0 + dt.timedelta(hours=4), 1.0, 1.01, 0.99, 1.0)], "asset string, ts timestamp_ntz, open double, high double, low double, close double")
    snap = spark.createDataFrame([(T0, 100.0, 25.0, 5500.0, 2.0, None)], "ts timestamp_ntz, dxy double, vix double, spx double, us10y double, gold double")
    macro = spark.createDataFrame([(T0, 3, *[0.1] * 8)], f"ts timestamp_ntz, events int, {', '.join(f'{c} double' for c in P.MACRO_PARTS)}")
    mood = spark.createDataFrame([("a", T0, 3, *[0.2] * 6)], f"asset string, ts timestamp_ntz, articles int, {', '.join(f'{c} double' for c in P.MOOD_PARTS)}")
    a, b = P.with_context(P.fingerprints(df, 0.0001), macro, mood, snap).orderBy("ts").collect()
    assert a.macro_source == a.sentiment_source == "engine"
    assert a.macro_state == pytest.approx((0.5 + 0.5 + 1 + 0.25 + 0.5) / 5) and a.sentiment_score == pytest.approx((0.5 + 0.5 + 0.25 + 0) / 4)
    assert (b.macro_state, b.sentiment_score, b.macro_source) == (0.5, 0.5, "neutral")


@pytest.mark.parametrize(
    "reply,n,want",
    [
        ("[-0.3, 0.7, 0.0, -0.5]", 4, [-0.3, 0.7, 0, -0.5]),
        ("```json\n[0.1, 2]\n```", 2, [0.1, 1]),
        ("```\n[0.1]\n```", 2, [0.1, 0]),
        ('Sure: ["0.5", null, true, "-3x"] and [9]', 4, [0.5, 0, 0, -1]),
        ("1.5 -0.25 .", 2, [1, -0.25]),
        ("only 0.5", 2, [0, 0]),
        ("[0.1, oops] 0.2 0.3", 2, [0.1, 0.2]),
        ("['0.1']", 1, [0.1]),
        ("", 2, [0, 0]),
        (None, 2, [0, 0]),
        ("[]", 1, [0]),
        ("[1]", 0, []),
    ],
)
def test_replies(spark, reply, n, want):
    r = spark.createDataFrame([(reply, n)], "reply string, n int").select(X.scores_of_reply(F.col("reply"), F.col("n")).alias("s")).first()
    assert r.s == pytest.approx(want)


def test_pages_follow_their_keys(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "a int, b int")
    order, after, got = [("a", True), ("b", False)], None, []
    while page := Q.page_after(df, order, after, 8).collect():
        got += [(r.a, r.b) for r in page]
        after = page[-1].asDict()
    assert got == sorted(((i % 7, i) for i in range(50)), key=lambda x: (-x[0], x[1]))


def test_answers_of_three_shapes(spark):
    t = [T0 + dt.timedelta(hours=4 * i) for i in range(6)]
    body = {
        "primary": [(t[0], '{"values": [{"open": "1.1", "high": "1.2", "low": "1.0", "close": "1.15"}], "status": "ok"}'), (t[1], '{"status": "error", "message": "x", "values": [{"open": "9"}]}'), (t[2], "no json"), (t[3], '{"values": [{"open": "1", "high": "x", "low": "1", "close": "1"}]}')],
        "fallback": [(t[1], '{"candles": [{"open": 2, "high": 3, "low": 1, "close": 2.5, "volume": 7}]}'), (t[2], '{"candles": []}')],
        "emergency": [(t[i], '{"chart": {"result": [{"indicators": {"quote": [{"open": [0, 5], "high": [0, 6], "low": [0, 4], "close": [0, %s], "volume": [1]}]}}]}}' % c) for i, c in ((1, "5.5"), (2, "5.5"), (4, "null"))] + [(t[5], '{"chart": {"result": null}}')],
    }
    answers = {p: spark.createDataFrame([("A", *r) for r in rows], "asset string, ts timestamp_ntz, body string") for p, rows in body.items()}
    got = {r.ts: (r.close, r.volume, r.source_rank, r.sources) for r in W.fetched(answers).collect()}
    assert got == {t[0]: (1.15, None, 0, 1), t[1]: (2.5, 7.0, 1, 2), t[2]: (5.5, None, 2, 1)}
    assert {r.ts: r.error for r in W.candles(answers["emergency"], "emergency").collect()} == {t[1]: None, t[2]: None, t[4]: "incomplete", t[5]: "no data"}


def test_a_failing_version_keeps_the_others(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0)], "fingerprint_id string, x int")
    same = lambda d: d.withColumn("result", F.col("x").cast("string"))
    broken = lambda d: d.withColumn("result", (1 / F.col("x")).cast("string"))
    rows, errors = R.experiment_apart(df, {"1": same, "2": broken, "3": lambda d: d.nothing})
    assert {(r.fingerprint_id, r.results) for r in rows.collect()} == {("a", "1=1"), ("b", "1=0")} and set(errors) == {"2", "3"}
    with pytest.raises(ValueError, match="all versions failed"):
        R.experiment_apart(df, {"1": broken, "2": broken})


def test_traces_do_not_depend_on_order(spark):
    df = spark.range(1000).withColumn("t", F.concat(F.lit("x"), F.col("id")))
    trace = Trace(spark)
    for name, make in (("one", lambda: df.repartition(7)), ("two", lambda: df.orderBy(F.desc("id"))), ("three", lambda: df.where("id > 0"))):
        trace.stage(name, make)
    with pytest.raises(Exception, match="(?i)divi"):
        trace.stage("four", lambda: df.select((1 / (F.col("id") - F.col("id"))).alias("z")))
    one, two, three, four = trace.table().orderBy("position").collect()
    assert one.rows == two.rows == 1000 and one.digest == two.digest != three.digest
    assert four.rows is None and four.error


def states(spark, n):
    """States of one asset with context layers that move slowly."""
    u = lambda s: F.rand(s)
    df = spark.range(n).select(F.lit("a").alias("asset"), (F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") * 4).cast("int"))).alias("ts"), (1 + u(1)).alias("open"), F.randn(2).alias("c"), u(3).alias("h"), u(4).alias("l"))
    df = df.withColumn("close", F.col("open") + 0.003 * F.col("c"))
    df = df.withColumns({"high": F.greatest("open", "close") + 0.002 * F.col("h"), "low": F.least("open", "close") - 0.002 * F.col("l")}).drop("c", "h", "l")
    wave = lambda k, m: F.array(*[(0.5 + 0.3 * F.sin(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600.0 / (20 + 7 * i * m))) + 0.15 * F.rand(100 + k * 10 + i) for i in range(k)])
    return P.fingerprints(df, 0.0001).withColumns({"l4": wave(8, 1), "l5": wave(6, 2)})


def test_index_finds_nine_in_ten(spark):
    from tidemark.operators.writes import written

    st = written(states(spark, 4000), "test-states")
    exact = written(M.engine_search(st, 20), "test-exact")
    r = I.recall(I.engine_search(st, 20, I.Index(reach=120)), exact).first()
    assert r.pairs == exact.count() and r.recall >= 0.9
    whole = I.engine_search(st, 20, I.Index(reach=10**6))
    key = ["fingerprint_id", "match_id", "rank", "score"]
    assert whole.select(*key).exceptAll(exact.select(*key)).count() == 0 == exact.select(*key).exceptAll(whole.select(*key)).count()


def test_index_of_equal_states(spark):
    """All in one list, cut into spans."""
    st = states(spark, 1).drop("ts", "fingerprint_id").crossJoin(spark.range(300).select((F.lit("2000-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("id") * 4).cast("int"))).alias("ts"), F.format_string("f%03d", "id").alias("fingerprint_id")))
    got = I.search(st, ["asset"], 5, how=I.Index(reach=20))
    assert got.count() == sum(min(i, 5) for i in range(300))
    assert math.isclose(got.agg(F.min("score")).first()[0], got.agg(F.max("score")).first()[0])
