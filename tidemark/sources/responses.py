"""Candles from recorded answers of three providers, each with a shape of its own: one row an answer, parsed by column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import first_available

#: In the order in which they are asked.
PROVIDERS = ("primary", "fallback", "emergency")
FIELDS = ("open", "high", "low", "close", "volume")

_TEXTS = ", ".join(f"{f}: string" for f in FIELDS)
_NUMBERS = ", ".join(f"{f}: double" for f in FIELDS)
_SERIES = ", ".join(f"{f}: array<double>" for f in FIELDS)
#: The shapes of the answers.
SHAPES = {
    "primary": f"status string, message string, values array<struct<{_TEXTS}>>",
    "fallback": f"candles array<struct<{_NUMBERS}>>",
    "emergency": f"chart struct<result: array<struct<indicators: struct<quote: array<struct<{_SERIES}>>>>>>",
}


def _candle(provider: str, body: Column) -> Column:
    """The candle of an answer, all as doubles; null if it has none."""
    doc = F.from_json(body, SHAPES[provider])
    if provider == "primary":
        first = F.get(doc["values"], F.lit(0))
        return F.when(first.isNotNull() & ~F.coalesce(doc["status"] == "error", F.lit(False)), F.struct(*[first[f].try_cast("double").alias(f) for f in FIELDS]))
    if provider == "fallback":
        first = F.get(doc["candles"], F.lit(0))
        return F.when(first.isNotNull(), first)
    quote = F.get(F.get(doc["chart"]["result"], F.lit(0))["indicators"]["quote"], F.lit(0))
    last = F.size(quote["open"]) - 1
    return F.when(quote.isNotNull() & (last >= 0), F.struct(*[F.get(quote[f], last).alias(f) for f in FIELDS]))


def candles(answers: DataFrame, provider: str) -> DataFrame:
    """asset, ts, open, high, low, close, volume, error of a provider's answers (asset, ts, body). The time is that of the boundary that was asked for.

    An answer without a candle, or whose candle lacks a price, has an error and no prices; a volume may be missing.
    """
    df = answers.select("asset", "ts", _candle(provider, F.col("body")).alias("_c"))
    gap = F.lit(False)
    for f in FIELDS[:4]:
        gap = gap | F.col(f"_c.{f}").isNull()
    error = F.when(F.col("_c").isNull(), "no data").when(gap, "incomplete")
    return df.withColumn("error", error).select("asset", "ts", *[F.when(F.col("error").isNull(), F.col(f"_c.{f}")).alias(f) for f in FIELDS], "error")


def fetched(answers: dict[str, DataFrame]) -> DataFrame:
    """For each asset and boundary the candle of the first provider that has one, with its rank and how many have one."""
    return first_available([candles(answers[p], p).where("error is null").drop("error") for p in PROVIDERS if p in answers], ["asset", "ts"])
