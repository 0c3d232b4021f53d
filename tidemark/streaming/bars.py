"""Four-hour bars from a stream of ticks: late ticks count up to a watermark, and changed bars are written batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def bars(ticks: DataFrame, asset: str, ts: str, price: str, tie: str, late: str = "72 hours") -> DataFrame:
    """The bars of ``operators.candles.bars`` over a stream whose column ``ts`` is a timestamp. Replayed ticks are counted once."""
    ticks = ticks.withWatermark(ts, late).dropDuplicatesWithinWatermark([tie])
    first = F.struct(F.col(ts), F.col(tie))
    w = F.window(ts, "4 hours")
    g = ticks.groupBy(F.col(asset).alias("asset"), w.alias("w"))
    out = g.agg(F.min_by(price, first).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, first).alias("close"), F.count(F.lit(1)).alias("volume"))
    return out.select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def write_bars(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch's changed bars with the batch's number; ``latest`` reads the newest state of every bar."""

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n:09d}")

    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(df: DataFrame) -> DataFrame:
    """Of every bar the row of its last batch."""
    return df.groupBy("asset", "ts").agg(F.max_by(F.struct("open", "high", "low", "close", "volume"), "batch").alias("r")).select("asset", "ts", "r.*")


def compacted(df: DataFrame, to: str) -> None:
    """The newest state of every bar of a written stream as one folder, named as the last batch it holds."""
    n = df.agg(F.max("batch")).first()[0]
    if n is not None:
        latest(df).write.mode("overwrite").parquet(f"{to}/batch={int(n):09d}")
