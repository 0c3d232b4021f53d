"""What followed a bar, and the distribution of what followed similar ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import rounded

FLAT_PIPS = 2.0


def r6(c: Column, digits: int = 6) -> Column:
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def forward(candles: DataFrame, digits: bool = False) -> DataFrame:
    """Return, best and worst excursion and range of the next bar in pips; the last bar of an asset has none. digits: rounded to 2, 2, 2, 4."""
    w = Window.partitionBy("asset").orderBy("ts")
    nxt = {c: F.lead(c).over(w).alias(f"n_{c}") for c in ("ts", "high", "low", "close")}
    df = candles.select("*", *nxt.values()).where("n_ts is not null")
    out = {"net_return_pips": "(n_close - close) / pip", "mfe_pips": "(n_high - close) / pip", "mae_pips": "(close - n_low) / pip", "realised_volatility": "((n_high - n_low) / pip) / 10000e0"}
    for name, x in out.items():
        df = df.withColumn(name, F.expr(rounded(x, 4 if name == "realised_volatility" else 2) if digits else x))
    return df.withColumnRenamed("n_ts", "next_ts").drop("n_high", "n_low", "n_close")


def distribution(df: DataFrame, keys: list[str], value: str, flat: Column | float = FLAT_PIPS, weight: str | None = None) -> DataFrame:
    """Statistics of ``value`` by keys. ``weight``: whole numbers of copies that each value counts for."""
    flat = flat if isinstance(flat, Column) else F.lit(float(flat))
    x, n = F.col(value), (F.col(weight) if weight else F.lit(1)).cast("long")
    ps = F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)), n)
    df = df.withColumns({"_x": x, "_n": n, "_flat": flat})
    g = df.groupBy(*keys).agg(
        F.sum("_n").alias("sample_size"),
        F.sum(F.col("_x") * F.col("_n")).alias("_s"),
        F.sum(F.col("_x") * F.col("_x") * F.col("_n")).alias("_ss"),
        ps.alias("_p"),
        F.sum(F.when(F.abs("_x") <= F.col("_flat"), 0).when(F.col("_x") > 0, F.col("_n")).otherwise(0)).alias("_up"),
        F.sum(F.when(F.abs("_x") <= F.col("_flat"), 0).when(F.col("_x") < 0, F.col("_n")).otherwise(0)).alias("_down"),
        F.max(F.abs("_x")).alias("max_abs_return"),
    )
    mean = F.col("_s") / F.col("sample_size")
    sd = F.sqrt(F.greatest(F.col("_ss") / F.col("sample_size") - mean * mean, F.lit(0.0)))
    up, down = F.col("_up") / F.col("sample_size"), F.col("_down") / F.col("sample_size")
    cv = F.when(mean == 0, sd).otherwise(sd / F.when(mean == 0, 1.0).otherwise(F.abs(mean)))
    flat_p = (F.col("sample_size") - F.col("_up") - F.col("_down")) / F.col("sample_size")
    return g.select(
        *keys,
        "sample_size",
        r6(mean).alias("mean_return"),
        r6(F.col("_p")[1]).alias("median_return"),
        r6(up).alias("up_probability"),
        r6(down).alias("down_probability"),
        r6(flat_p).alias("flat_probability"),
        r6(sd).alias("std_dev"),
        r6(F.col("max_abs_return")).alias("max_abs_return"),
        r6(F.col("_p")[0]).alias("p10"),
        r6(F.col("_p")[2]).alias("p90"),
        r6(F.greatest(up, down, flat_p)).alias("max_probability"),
        r6(1 / (1 + cv)).alias("sharpness"),
    )


def regime_copies(query_vol: Column, query_session: Column, vol: Column, session: Column) -> Column:
    """How often a matched outcome counts: 15 for the same volatility and session, 12 for the same volatility, 7 for another, 10 if unknown."""
    return F.when(vol.isNull() | query_vol.isNull(), 10).when((vol == query_vol) & (session == query_session), 15).when(vol == query_vol, 12).otherwise(7)


def dynamic_flat(df: DataFrame) -> DataFrame:
    """flat_threshold: a quarter of the mean range of the asset's last 14 bars in pips, at least 1; the fixed one below five bars."""
    w = Window.partitionBy("asset").orderBy("ts").rowsBetween(-13, 0)
    r = F.expr("(high - low) / pip")
    return df.withColumn("flat_threshold", F.when(F.count(r).over(w) >= 5, F.greatest(0.25 * F.avg(r).over(w), F.lit(1.0))).otherwise(FLAT_PIPS))
