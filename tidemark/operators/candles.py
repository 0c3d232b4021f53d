"""Four-hour bars from ticks: resampling, checks, gaps, the Sunday merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS = 4


def bars(ticks: DataFrame, asset: str, ts: str, price: str, tie: str) -> DataFrame:
    """asset, ts, open, high, low, close, volume (ticks) on the 4 h grid in UTC."""
    first = F.struct(F.col(ts), F.col(tie))
    return (
        ticks.groupBy(F.col(asset).alias("asset"), F.window(ts, f"{HOURS} hours").start.alias("ts"))
        .agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.count(F.lit(1)).alias("volume"))
    )


def grid_start(ts: Column) -> Column:
    return F.date_trunc("day", ts) + F.make_dt_interval(hours=F.floor(F.hour(ts) / HOURS).cast("int") * HOURS)


def trades(ts: Column) -> Column:
    """Whether a 24x5 market is open: not on Saturdays, from Sunday 21:00 to Friday 21:00."""
    day, hour = F.dayofweek(ts), F.hour(ts)
    return ~((day == 7) | ((day == 1) & (hour < 21)) | ((day == 6) & (hour >= 21)))


def expected(candles: DataFrame, weekends: bool = False) -> DataFrame:
    """asset, ts: every grid slot from an asset's first bar to its last."""
    ends = candles.groupBy("asset").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    grid = ends.select("asset", F.explode(F.sequence("a", "b", F.expr(f"interval {HOURS} hours"))).alias("ts"))
    return grid if weekends else grid.where(trades(F.col("ts")))


def gaps(candles: DataFrame, weekends: bool = True) -> DataFrame:
    """asset, ts of expected slots without a bar, with the slot before."""
    grid = expected(candles, weekends).withColumn("previous_ts", F.lag("ts").over(Window.partitionBy("asset").orderBy("ts")))
    return grid.join(candles.select("asset", "ts"), ["asset", "ts"], "left_anti")


def violations(candles: DataFrame) -> DataFrame:
    """asset, ts, row (from 1, by time), reason of bars whose high or low does not bound the others."""
    w = Window.partitionBy("asset").orderBy("ts")
    high = F.col("high") < F.greatest("open", "close", "low")
    low = F.col("low") > F.least("open", "close", "high")
    return candles.withColumn("row", F.row_number().over(w)).where(high | low).select("asset", "ts", "row", F.when(high, "high").otherwise("low").alias("reason"))


def sunday_merged(candles: DataFrame) -> DataFrame:
    """Bars of a Sunday become part of Monday's first."""
    to = F.when(F.dayofweek("ts") == 1, F.date_trunc("day", "ts") + F.expr("interval 1 day")).otherwise(F.col("ts"))
    return (
        candles.withColumn("slot", to)
        .groupBy("asset", "slot")
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
        .withColumnRenamed("slot", "ts")
    )


def seconds_to_next(ts: Column) -> Column:
    """Seconds to the next grid boundary, in (0, 14400]."""
    step = HOURS * 3600
    return step - F.unix_seconds(ts.cast("timestamp")) % step
