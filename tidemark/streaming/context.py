"""News around bar times from two streams: an interval join with watermarks on both sides, and sums of each time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.context import HOUR, SUMS, sentiment_sums


def sums(times: DataFrame, articles: DataFrame, late: str = "2 hours") -> DataFrame:
    """ts and the sums of ``operators.context.sentiment_sums`` over the articles (published_at, hint, relevance) of the 24 hours up to each time (ts); both streams of timestamps.

    Times are dealt into the hours that they look back on and meet the articles by hour, so the
    join has an equality; its bounds in time let Spark drop articles a day past the watermark.
    A time's sums come out when the watermark has passed it; times without articles have none.
    """
    hour = lambda c: F.floor(F.unix_seconds(c) / HOUR)
    t = times.withWatermark("ts", late).select("ts", F.explode(F.sequence(hour(F.col("ts")) - 24, hour(F.col("ts")))).alias("_hour"))
    a = articles.withWatermark("published_at", late).withColumn("_at", hour(F.col("published_at")))
    near = t.join(a, F.expr("_hour = _at and published_at >= ts - interval 24 hours and published_at <= ts"))
    return sentiment_sums(near).select("ts", *SUMS)
