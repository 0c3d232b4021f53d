import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import changes as H
from tidemark.operators import fingerprint as P
from tidemark.operators import outcomes as O
from tidemark.operators import topology as T

T0 = dt.datetime(2024, 1, 1)


def ticks(spark, sf):
    """Ticks of three months: those of the table and two copies, a month apart."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type", "value")
    more = [e.withColumns({"ts": F.col("ts") + F.expr(f"interval {30 * i} days"), "event_id": F.col("event_id") + 10**6 * i, "value": F.col("value") + 3 * i}) for i in (1, 2)]
    return e.unionByName(more[0]).unionByName(more[1])


def rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect())


def test_only_what_hangs_on_a_change_is_made_anew(spark, sf):
    old = ticks(spark, sf)
    late = spark.createDataFrame([(-1, T0 + dt.timedelta(days=40, hours=5), "view", 900.0), (-2, T0 + dt.timedelta(days=41), "view", -50.0), (-3, T0 + dt.timedelta(days=87, hours=2), "click", 77.0)], old.schema)
    names = ("event_type", "ts", "value", "event_id")
    before = P.with_pip(C.bars(old, *names), 2.0).cache()
    after = P.with_pip(C.bars(old.unionByName(late), *names), 2.0).cache()
    fresh = P.with_pip(H.rebuilt(old.unionByName(late), late, *names), 2.0).cache()
    assert fresh.count() == 3
    bars = H.replaced(before, fresh).cache()
    assert rows(bars) == rows(after)

    extended = lambda b: P.extended(P.with_regime(b)).drop("pip")
    outcomes = lambda b: O.forward(b, digits=True).select("asset", "ts", "next_ts", "net_return_pips", "mfe_pips", "mae_pips")
    shapes = lambda b: T.topology(b, include_current=False).select("asset", "ts", "vector")
    for make, back, ahead in ((extended, 50, 0), (outcomes, 0, 1)):
        assert rows(H.refreshed(make(before), bars, fresh, make, back, ahead)) == rows(make(after))
    new, keys = H.recomputed(bars, fresh, shapes, H.BACK, 0)
    text = lambda df: sorted((r.asset, str(r.ts), str([round(x, 6) for x in r.vector])) for r in df.collect())
    full = shapes(after)
    assert text(new) == text(full.join(keys, H.KEY, "left_semi"))
    assert text(full.join(keys, H.KEY, "left_anti")) == text(shapes(before).join(keys, H.KEY, "left_anti"))


def test_work_grows_with_the_change(spark, sf):
    bars = P.with_pip(C.bars(ticks(spark, sf), "event_type", "ts", "value", "event_id"), 2.0)
    one = bars.where("asset = 'view'").orderBy("ts").limit(1)
    _, keys = H.recomputed(bars, one, lambda b: b, 50, 1)
    assert keys.count() <= 1 + 50 + 1 < bars.count() / 10
