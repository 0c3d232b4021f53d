import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context as K
from tidemark.operators import operations as Q
from tidemark.streaming import context as SC
from tidemark.streaming import maturity as SM
from tidemark.streaming import quotas as SQ

CHAIN = [("alpha", 12, 2), ("beta", 6, 1), ("gamma", 4, 1)]
T0 = dt.datetime(2024, 1, 1)


@pytest.fixture
def stores(spark):
    """The state store that timers and several states need."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def replay(spark, batches, schema, folder):
    """A stream that reads the batches in their order, one at a time."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def drained(df, folder):
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{folder}/ck").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{folder}/out")


def test_quotas_as_state_equal_the_fold(spark, sf, tmp_path, stores):
    """All events in four batches, each out of order, and a last one that moves the watermark on."""
    events = [(r.event_type, r.ts, r.event_id) for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts").collect()]
    rows = [(k, ts, n, [x for i, (x, *_) in enumerate(CHAIN) if n % (5 + i)]) for k, ts, n in events]
    step = -(-len(rows) // 4)
    batches = [sorted(rows[i : i + step], key=lambda r: -r[2]) for i in range(0, len(rows), step)]
    last = max(r[1] for r in rows) + dt.timedelta(days=2)
    schema = "service string, ts timestamp, n long, works array<string>"
    stream = replay(spark, [*batches, [(k, last, -i, []) for i, k in enumerate({r[0] for r in rows})], [("none", last + dt.timedelta(days=1), -99, [])]], schema, tmp_path / "in")
    got = drained(SQ.with_fallback(stream, CHAIN, "service", "ts", "n", "works", "1 day"), tmp_path)
    want = Q.with_fallback(spark.createDataFrame(rows, schema), CHAIN, "service", "ts", "n", "works")
    assert sorted(map(tuple, got.where("n >= 0").collect())) == sorted(map(tuple, want.collect())) != []


def test_counters_forget(spark):
    q = Q.Quotas(CHAIN)
    for i in range(50):
        q.ask(i * 90_000_000, ["alpha"])
    assert len(q.kept()) <= sum(m for *_, m in CHAIN) and sum(q.used) <= 22


def test_forecasts_close_once(spark, tmp_path, stores):
    """Outcomes in time, late, never, and before their forecast; as the batch query has them once all is over."""
    at = lambda h: T0 + dt.timedelta(hours=h)
    forecasts = [(f"f{i}", at(i), at(i + 4)) for i in range(40)]
    outcomes = [(f"f{i}", at(i + 4 + (i % 3)), float(i)) for i in range(40) if i % 5]
    fs, os_ = "fingerprint_id string, ts timestamp, expiry timestamp", "fingerprint_id string, ts timestamp, net_return_pips double"
    f = replay(spark, [forecasts[i : i + 10] for i in range(0, 40, 10)] + [[("end", at(200), at(400))], [("end2", at(201), at(400))]], fs, tmp_path / "f")
    o = replay(spark, [outcomes[i : i + 8] for i in range(0, 32, 8)] + [[("nobody", at(200), 1.0)], [("nobody", at(201), 1.0)]], os_, tmp_path / "o")
    got = {(r.fingerprint_id, r.status, r.net_return_pips) for r in drained(SM.matured(f, o, "12 hours"), tmp_path).collect()}
    from tidemark.operators import research as R

    batch = spark.createDataFrame(forecasts, fs).join(spark.createDataFrame(outcomes, os_).drop("ts"), "fingerprint_id", "left")
    want = {(r.fingerprint_id, r.status, r.net_return_pips) for r in R.maturity(batch.withColumn("expiry", F.col("expiry").cast("timestamp_ntz")), "2025-01-01").collect()}
    assert got == want and len(got) == 40


def test_news_joined_on_streams_equal_the_batch(spark, tmp_path):
    at = lambda h: T0 + dt.timedelta(hours=h)
    news = [(at(i * 0.7), ((i * 37) % 21 - 10) / 10, ((i * 13) % 11) / 10) for i in range(200)]
    times = [(at(4 * i),) for i in range(40)]
    ns, ts = "published_at timestamp, hint double, relevance double", "ts timestamp"
    n = replay(spark, [news[i : i + 50] for i in range(0, 200, 50)] + [[(at(500), 0.0, 0.0)], [(at(501), 0.0, 0.0)]], ns, tmp_path / "n")
    t = replay(spark, [times[i : i + 10] for i in range(0, 40, 10)] + [[(at(500.5),)], [(at(502),)]], ts, tmp_path / "t")
    sums = drained(SC.sums(t, n, "2 days"), tmp_path).where(F.col("ts") < F.lit(at(400)))
    bars = spark.createDataFrame([(a, x) for a in "ab" for (x,) in times], "asset string, ts timestamp")
    got = {(r.asset, r.ts): [round(v, 6) for v in r[3:]] for r in K.sentiment_of(bars, sums).collect()}
    want = {(r.asset, r.ts): [round(v, 6) for v in r[3:]] for r in K.sentiment(bars, spark.createDataFrame(news, ns)).collect()}
    assert got == want and len(got) == 80
