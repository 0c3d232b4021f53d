"""Late or corrected ticks: which bars they touch, which derived rows hang on those, and only these made anew.

A bar's own state hangs on the bar; its features of preceding bars (trend, percentile, session
statistics, topology) hang on up to ``BACK`` bars before it; its outcome hangs on the bar after it.
So a touched bar reaches the bar before it and ``BACK`` bars after it, and these need, as inputs, the
``BACK`` bars before them and one after. Everything else keeps its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .candles import bars
from .joins import numbered

#: Bars that the longest window looks back on.
BACK = 120

KEY = ["asset", "ts"]


def touched(ticks: DataFrame, asset: str, ts: str) -> DataFrame:
    """asset, ts of the bars that ticks fall into."""
    return ticks.select(F.col(asset).alias("asset"), F.window(ts, "4 hours").start.alias("ts")).distinct()


def rebuilt(all_ticks: DataFrame, late: DataFrame, asset: str, ts: str, price: str, tie: str) -> DataFrame:
    """The bars that the late ticks touch, from all ticks of those bars only; all_ticks holds the late ones, too."""
    slots = touched(late, asset, ts).select(F.col("asset").alias("_asset"), F.col("ts").alias("_ts"))
    some = all_ticks.withColumn("_ts", F.window(ts, "4 hours").start).withColumn("_asset", F.col(asset)).join(slots, ["_asset", "_ts"], "left_semi").drop("_asset", "_ts")
    return bars(some, asset, ts, price, tie)


def replaced(table: DataFrame, rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """table with rows in place of those of the same key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows.select(table.columns))


def around(table: DataFrame, changed: DataFrame, back: int, ahead: int) -> DataFrame:
    """asset, ts of the rows of table that are at most ``back`` rows before or ``ahead`` rows after a changed one, in the asset's order of time."""
    df = numbered(table.select(*KEY), ["asset"], "ts")
    at = df.join(changed.select(*KEY).distinct(), KEY, "left_semi").select("asset", F.explode(F.sequence(F.col("_n") - back, F.col("_n") + ahead)).alias("_n")).distinct()
    return df.join(at, ["asset", "_n"], "left_semi").select(*KEY)


def recomputed(table: DataFrame, changed: DataFrame, make: Callable[[DataFrame], DataFrame], back: int = BACK, ahead: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows that hang on the changed bars, made anew by ``make`` from the bars that they need; and the keys of all those rows.

    ``back``: bars that make looks back on; ``ahead``: bars that it looks ahead. The first
    result can lack keys of the second, where make gives no row (the last bar has no outcome).
    """
    keys = around(table, changed, ahead, back)
    inputs = table.join(around(table, keys, back, ahead), KEY, "left_semi")
    return make(inputs).join(keys, KEY, "left_semi"), keys


def refreshed(derived: DataFrame, table: DataFrame, changed: DataFrame, make: Callable[[DataFrame], DataFrame], back: int = BACK, ahead: int = 1) -> DataFrame:
    """A derived table after a change of bars: rows that do not hang on it as they were, the others made anew."""
    new, keys = recomputed(table, changed, make, back, ahead)
    return derived.join(keys, KEY, "left_anti").unionByName(new.select(derived.columns))
