"""Worked examples and invariants of single operators."""

import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import vectors as V
from tidemark.functions.numeric import rounded
from tidemark.functions.stamps import parse_stamp
from tidemark.operators import candles as C
from tidemark.operators import fingerprint as P
from tidemark.operators import joins as J
from tidemark.operators import learning as L
from tidemark.operators import outcomes as O
from tidemark.operators import research as R
from tidemark.operators import scoring as S
from tidemark.operators import similarity as M
from tidemark.operators import topology as T
from tidemark.sources import files

T0 = dt.datetime(2024, 6, 14, 8)
GOLD = {
    (1.0850, 1.0920, 1.0835, 1.0910): ".529412 .705882 .117647 .176471 1 .705882 .705882 .176471 .882353 .176471 .941176 .768525 .85 .691176 .705882 .208333",
    (1.0910, 1.0925, 1.0840, 1.0850): ".470588 .705882 .176471 .117647 0 .705882 .705882 .176471 .117647 .823529 .941176 .231475 .85 .308824 0 .208333",
    (1.0875, 1.0890, 1.0860, 1.08755): ".508333 .016667 .483333 .5 1 .016667 .016667 .5 .516667 .5 .983333 .5025 .3 .508333 .016667 1",
}


def bars(spark, rows, asset="A", start=T0):
    data = [(asset, start + dt.timedelta(hours=4 * i), *map(float, r), 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "asset string, ts timestamp_ntz, open double, high double, low double, close double, volume long")


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.mark.parametrize("candle,want", GOLD.items())
def test_structure_goldens(spark, candle, want):
    r = P.fingerprints(bars(spark, [candle]), 0.0001).first()
    assert r.l1 == pytest.approx([float(x) for x in want.split()], abs=2e-6)


def test_other_layers_goldens(spark):
    r = P.fingerprints(bars(spark, [next(iter(GOLD))]), 0.0001).first()
    assert r.l2 == pytest.approx([0.85, 0.705882, 0.117647, 0.176471, 1, 0, 0.705882, 1, 1, 1, 0.8, 0.294118], abs=2e-6)
    assert r.l3[:4] + r.l3[-1:] == pytest.approx([0.444118, 0.496749, 0.549381, 0.602012, 0.555882], abs=2e-6)
    assert (r.net_pips, r.range_pips, r.vol_regime, r.trend_regime) == (60, 85, "HIGH", "BULLISH")


def test_id_hashes_the_canonical_time(spark):
    df = bars(spark, [(1, 1, 1, 1)], "EURUSD", dt.datetime(2024, 6, 15, 8))
    assert P.with_id(df).first().fingerprint_id == "f9c493f1aefc1d3f6b2ac2a01043e824d1698d2b4479a120a695420c001d3769"


def test_flat_bars_divide_by_nothing(spark):
    r = P.extended(P.fingerprints(bars(spark, [(1, 1, 1, 1)] * 3), 1.0)).collect()
    assert all(0 <= x <= 1 for row in r for c in ("l1", "l2", "l3") for x in row[c])
    assert r[0].trend_regime == "RANGING" and r[2].vol_regime_score == 0.5 and r[2].rolling_trend == 0.5


def test_distribution_of_ten(spark):
    df = spark.createDataFrame([("k", float(x)) for x in (5, -3, 1, 8, -6, 0, 4, -1, 10, -5)], "k string, x double")
    r = O.distribution(df, ["k"], "x").first()
    assert (r.sample_size, r.mean_return, r.median_return, r.up_probability, r.down_probability, r.flat_probability, r.max_abs_return) == (10, 1.3, 0.5, 0.4, 0.3, 0.3, 10)
    assert (r.std_dev, r.p10, r.p90) == (5.1, -5.1, 8.2) and r.sharpness == pytest.approx(0.203125)


def test_flat_boundary(spark):
    df = spark.createDataFrame([("k", x) for x in (2.0, -2.0, 2.0001, -2.0001)], "k string, x double")
    r = O.distribution(df, ["k"], "x").first()
    assert (r.up_probability, r.down_probability, r.flat_probability) == (0.25, 0.25, 0.5)


def test_sessions_and_grid(spark):
    hours = spark.range(24).select("id", (F.lit(dt.datetime(2024, 1, 15)) + F.make_dt_interval(hours=F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"))
    got = {r.id: (r.s, r.g.hour) for r in hours.select("id", F.expr(P.SESSION).alias("s"), C.grid_start(F.col("ts")).alias("g")).collect()}
    for h, (s, g) in got.items():
        assert s == ("LONDON" if 4 <= h < 12 else "NY" if 12 <= h < 20 else "ASIA") and g == h // 4 * 4


def test_sunday_becomes_monday(spark):
    df = bars(spark, [(1, 5, 0, 2), (2, 3, 1, 3)], start=dt.datetime(2024, 1, 14, 20))
    r = C.sunday_merged(df).collect()
    assert len(r) == 1 and (r[0].ts, r[0].open, r[0].high, r[0].low, r[0].close, r[0].volume) == (dt.datetime(2024, 1, 15), 1, 5, 0, 3, 2)


def test_gaps_on_weekends(spark):
    df = bars(spark, [(1, 1, 1, 1)] * 30, start=dt.datetime(2024, 1, 18))
    some = df.where("ts != timestamp_ntz'2024-01-19 08:00:00' and ts != timestamp_ntz'2024-01-20 08:00:00'")
    assert C.gaps(some, weekends=True).count() == 2
    assert [r.ts for r in C.gaps(some, weekends=False).collect()] == [dt.datetime(2024, 1, 19, 8)]


def test_stamps(spark):
    for s in ("2020-06-01T08:00:00.000Z", "2020-06-01T08:00:00Z", "2020-06-01 08:00", "2020-06-01 08:00:00", "01.06.2020 08:00:00.000"):
        assert one(spark, parse_stamp(F.lit(s)).cast("timestamp_ntz").alias("t")).t == dt.datetime(2020, 6, 1, 8)
    assert one(spark, parse_stamp(F.lit("June 2020")).alias("t")).t is None


def test_bar_files(spark, tmp_path):
    (tmp_path / "b.csv").write_text("Time,Open,High,Low,Close,Volume\r\n01.06.2020 08:00:00.000,1,2,0.5,1.5,10\r\n\r\n01.06.2020 12:00:00.000,1,2\r\n01.06.2020 16:00:00.000,1,x,1,1,1\r\n")
    r = sorted(files.read_bars(spark, str(tmp_path / "b.csv")).collect(), key=lambda r: r.ts_text)
    assert [x.error for x in r] == [None, "too few fields", "not a number"]
    assert (r[0].open, r[0].volume) == (1, 10)


def test_calendar_file(spark, tmp_path):
    (tmp_path / "c.csv").write_text("name,timestamp,actual,estimate,previous,currency\nCPI,2024-01-15,1.5,-,1,\nGDP,2024-01-15T13:30:00,,2,x,EUR\n,2024-01-15,1,1,1,USD\nX,,1,1,1,USD\n")
    r = sorted(files.read_calendar(spark, str(tmp_path / "c.csv")).collect(), key=lambda r: r.name)
    assert [(x.name, x.event_date, x.currency, x.actual, x.estimate, x.previous) for x in r] == [("CPI", dt.datetime(2024, 1, 15, 9), "USD", 1.5, None, 1.0), ("GDP", dt.datetime(2024, 1, 15, 13, 30), "EUR", None, 2.0, None)]


def test_imports_keep_keys_unique(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    b = spark.createDataFrame([(2, "x"), (3, "c")], "k long, v string")
    assert files.import_new(spark, path, a, ["k"]) == (2, 0)
    assert files.import_new(spark, path, b, ["k"]) == (1, 1)
    files.overwrite_keys(spark, path, str(tmp_path / "s"), b, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "x"), (3, "c")]


def test_forecast_adds_up(spark):
    rows = [(1 / 3, 1 / 3, 1 / 3, 0.0), (0.125, 0.125, 0.75, 1.005), (0.005, 0.0, 0.995, -2.5)]
    df = spark.createDataFrame(rows, "up_probability double, down_probability double, flat_probability double, mean_return double")
    for r in S.forecast(df).collect():
        assert r.up + r.down + r.flat == pytest.approx(1)
    assert S.forecast(df).first().up == 0.34


def test_tradeability(spark):
    rows = [(0.9, 1.0, "LONDON", 0.9, False), (0.9, 1.0, "LONDON", 0.9, True), (0.6, 1.0, "NY", 0.9, False), (None, 1.0, "NY", 0.9, False), (0.9, 6.0, "ASIA", 0.3, False)]
    df = spark.createDataFrame(rows, "c double, s double, e string, l double, n boolean")
    got = [(r.tradeability_score, r.label, r.unavailable) for r in S.tradeability(df, "c", "s", "e", "l", "n").collect()]
    assert got == [(0.9, "GO", ""), (0.0, "NO_GO", ""), (0.48, "CONDITIONAL", ""), (0.0, "NO_GO", "c"), (0.07, "NO_GO", "")]


def test_drift_needs_full_windows(spark):
    rows = [("a", i, int(i < 12 or i >= 30)) for i in range(30)] + [("b", i, 1) for i in range(29)] + [("c", i, 1) for i in range(70)] + [("c", i, 0) for i in range(70, 100)]
    got = {r.k: r for r in R.drift(spark.createDataFrame(rows, "k string, t int, direction_accuracy int"), "k", ["t"]).collect()}
    assert set(got) == {"a", "c"} and got["a"].rolling_accuracy == 0.4 and not got["a"].drifted
    assert got["c"].rolling_accuracy == 0.0 and got["c"].baseline_mean > 0.5


def test_text(spark):
    def asset(s):
        return one(spark, X.asset_of(F.lit(s)).alias("x")).x

    assert [asset(s) for s in ("EUR and USD", "usdjpy", "GBP alone", "the fed", "nothing", "AUD CAD")] == ["eurusd", "usdjpy", "forex", "eurusd", "forex", "forex"]
    msg = "at run (/app/x.js:1) failed: SELECT a FROM b on 10.1.2.3 or localhost:80 /var/log/app.log"
    assert one(spark, X.redacted(F.lit(msg)).alias("x")).x.count("[redacted]") >= 2


def test_joins(spark):
    p = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), h) for h in range(0, 24, 3)], "at timestamp_ntz, v int")
    m = spark.createDataFrame([(dt.datetime(2024, 1, 1, 6),), (dt.datetime(2024, 1, 1, 13),)], "m timestamp_ntz")
    got = sorted((r.m.hour, r.v) for r in J.interval_join(p, m, [], "at", "m", 6 * 3600, 3 * 3600).collect())
    assert got == sorted((h, v) for h in (6, 13) for v in range(0, 24, 3) if h - 6 <= v <= h + 3)


def test_search_sees_only_the_past(spark):
    rng = np.random.default_rng(1)
    rows = [(o, o + 2, o - 2, o + d) for o, d in zip(rng.uniform(90, 110, 40), rng.uniform(-2, 2, 40), strict=True)]
    s = P.fingerprints(bars(spark, rows), 0.05)
    at = {r.fingerprint_id: r.ts for r in s.collect()}
    got = M.batch_search(s, 5).collect()
    assert got and all(at[r.match_id] < at[r.fingerprint_id] for r in got)
    assert max(r["rank"] for r in got) == 5 and all(0 <= r.score <= 1 for r in got)


def greedy(prices, width):
    out = []
    for p in sorted(prices):
        if out and p - out[-1][0] <= width:
            out[-1].append(p)
        else:
            out.append([p])
    return out


@given(st.lists(st.floats(1, 2, allow_nan=False), max_size=40))
@settings(max_examples=60, deadline=None)
def test_clusters_are_anchored(prices):
    p = np.sort(np.array(prices, float))
    assert [list(x) for x in np.split(p, T.clustered(p, 0.05))[1:]] == greedy(prices, 0.05)


@given(st.integers(0, 10_000))
@settings(max_examples=40, deadline=None)
def test_topology_invariants(seed):
    rng = np.random.default_rng(seed)
    c = 1.1 + np.cumsum(rng.normal(0, 0.002, 60))
    o = np.concatenate([[1.1], c[:-1]])
    h, lo = np.maximum(o, c) + 0.001, np.minimum(o, c) - 0.001
    rows = T.levels(o, h, lo, c, 0.0001)
    assert len(rows) <= 20 and sum(r[8] for r in rows) == pytest.approx(1, abs=1e-5)
    assert all(r[2] >= 1 and r[3] <= r[2] and r[1] in ("support", "resistance", "flip_zone") for r in rows)
    v = T.vector(rows, 60)
    assert len(v) == 40 and all(0 <= x <= 1 for x in v)


def test_topology_vector_of_few_levels():
    assert T.vector([], 50) == [0.0] * 40
    level = lambda price, kind, away: (price, kind, 2, 1, 1, 0.5, 10, away, 0.5)
    one = T.vector([level(1.1, "support", 3.0)], 50)
    assert one[32:36] == [1, 0, 0, 0] and one[39] == 0
    two = T.vector([level(1.1, "support", 3.0), level(1.2, "resistance", 30.0)], 50)
    assert two[32:36] == [0.5, 0, 0, 0.5] and two[38] == 0.5 and two[39] == 1
    assert T.vector([level(1.1, "support", 0.0), level(1.2, "flip_zone", 4.0)], 50)[39] == 0.5


def test_blocks_give_the_windows_of_a_whole_asset(spark, monkeypatch):
    rng = np.random.default_rng(5)
    c = 100 + np.cumsum(rng.normal(0, 1, 500))
    o = np.concatenate([[100], c[:-1]])
    rows = [(float(a), float(max(a, b) + 0.5), float(min(a, b) - 0.5), float(b)) for a, b in zip(o, c, strict=True)]
    df = P.with_pip(bars(spark, rows), 0.1)
    for current in (True, False):
        whole = sorted(map(str, T.topology(df, current).collect()))
        with monkeypatch.context() as m:
            m.setattr(T, "BLOCK", 120)
            assert sorted(map(str, T.topology(df, current).collect())) == whole
    assert len(whole) == 470


def test_search_in_blocks_equals_one_block(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(o, o + 2, o - 2, o + d) for o, d in zip(rng.uniform(90, 110, 130), rng.uniform(-2, 2, 130), strict=True)]
    s = P.fingerprints(bars(spark, rows), 0.05)
    s = s.withColumn("topology", F.when(F.hour("ts") != 4, F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.col("l3")[i % 20] * 0.5)))
    for search in (lambda: M.batch_search(s, 7, 0.1), lambda: M.engine_search(s, 7)):
        whole = sorted(map(str, search().collect()))
        with monkeypatch.context() as m:
            m.setattr(M, "BLOCK", 16)
            m.setattr(M, "SPAN", 24)
            m.setattr(M, "SLICE", 10)
            assert sorted(map(str, search().collect())) == whole


@given(st.floats(-1e6, 1e6, allow_nan=False))
@settings(max_examples=20, deadline=None)
def test_rounding_is_half_up(spark, x):
    assert one(spark, F.expr(rounded(f"cast('{x!r}' as double)", 2)).alias("y")).y == math.floor(x * 100 + 0.5) / 100


def test_vectors(spark):
    a = lambda *x: F.array(*map(F.lit, map(float, x)))
    r = one(spark, V.cosine(a(1, 0), a(1, 1)).alias("c"), V.cosine(a(0, 0), a(1, 1)).alias("z"), V.cosine(a(1), a(1, 1)).alias("n"), V.closeness(a(0, 3), a(4, 0)).alias("d"))
    assert r.c == pytest.approx(2**-0.5) and r.z == 0 and r.n == 0 and r.d == pytest.approx(1 / 6)


def test_too_little_to_train(spark):
    df = spark.createDataFrame([([0.5] * 30, 1.0)] * 10, "x array<double>, y double")
    with pytest.raises(ValueError):
        L.trained(df, "x", "y", "y")


def test_streamed_bars_equal_batch_bars(spark, sf, tmp_path):
    from tidemark.streaming import bars as B

    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = str(tmp_path / "in")
    events.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = B.write_bars(B.bars(stream, "event_type", "ts", "value", "event_id", "60 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination()
    got = sorted(tuple(r) for r in B.latest(spark.read.parquet(str(tmp_path / "out"))).collect())
    want = sorted(tuple(r) for r in C.bars(events, "event_type", "ts", "value", "event_id").collect())
    assert got == want


def test_registry_and_tiers(spark):
    from tidemark.operators import serving as G

    with pytest.raises(ValueError):
        G.registry(spark, G.ASSETS + G.ASSETS[:1])
    m = F.create_map(*[F.lit(x) for i in range(7) for x in (f"k{i}", float(i) / 2)])
    assert one(spark, G.first_markets(m).alias("m")).m == {"k0": 0.0, "k1": 0.5, "k2": 1.0, "k3": 1.0, "k4": 1.0}
    df = spark.createDataFrame([(1, "a"), (2, None)], "b int, a string")
    assert len({r.trace for r in G.traced(df).collect()}) == 2
