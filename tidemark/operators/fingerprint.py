"""State vectors of bars: five layers of features in [0, 1], the regime, and features of the preceding bars.

Formulas are SQL text (``tidemark.functions.numeric``) over open, high, low, close, and ``pip``,
the size of a pip. The first two layers and the regimes take net and range in pips as rounded to two
digits (``net_pips``, ``range_pips`` of ``with_regime``), so that no binary fraction decides at a
boundary; the statistics of preceding bars take them unrounded. Windows run over an asset's bars in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import feature, ratio, rounded, sigmoid, unit

VERSIONS = {"market_state_version": "1.1.0", "schema_version": "v1_0", "normalisation": "fixed", "timeframe": "4H"}

NET, RANGE = "((close - open) / pip)", "((high - low) / pip)"
_R = "(case when high = low then 1e0 else high - low end)"
_BODY, _UP, _LOW = "abs(close - open)", "(high - greatest(open, close))", "(least(open, close) - low)"
_POS = f"(((open + close) / 2e0 - low) / {_R})"
_DIR = "(case when close > open then 1e0 when close < open then 0e0 else 5e-1 end)"
_TREND = "(case when range_pips = 0 then 0e0 else abs(net_pips) / range_pips end)"

#: Sixteen components of market structure.
STRUCTURE = [
    _POS,
    f"{_BODY} / {_R}",
    f"{_UP} / {_R}",
    f"{_LOW} / {_R}",
    _DIR,
    _TREND,
    f"{_BODY} / {_R}",
    f"greatest({_UP}, {_LOW}) / {_R}",
    f"(close - low) / {_R}",
    f"(open - low) / {_R}",
    f"1e0 - abs({_POS} - 5e-1) * 2e0",
    sigmoid("net_pips / 50e0"),
    "range_pips / 100e0",
    f"(close - (high + low) / 2e0) / {_R} * 5e-1 + 5e-1",
    f"{_DIR} * {unit(_TREND)}",
    f"(case when close = open then 5e-1 else ({_UP} + {_LOW}) / {_BODY} / 2e0 end)",
]

_EXPANSION = unit("range_pips / 50e0")
#: Twelve components of volatility.
VOLATILITY = [
    "range_pips / 100e0",
    f"{_BODY} / {_R}",
    f"{_UP} / {_R}",
    f"{_LOW} / {_R}",
    _EXPANSION,
    f"1e0 - {_EXPANSION}",
    _TREND,
    f"({_BODY} / pip) / 50e0",
    "range_pips / 30e0",
    "(range_pips - 30e0) / 40e0",
    ratio(f"{_UP} + {_LOW} - abs({_UP} - {_LOW})", f"{_UP} + {_LOW}", "5e-1"),
    f"1e0 - {_BODY} / {_R}",
]


def liquidity(i: int) -> str:
    """Density at the i-th of twenty price steps from low to high."""
    p = f"(low + {i}e0 / 19e0 * (high - low))"
    near = lambda x: f"(1e0 - abs({p} - {x}) / {_R})"
    return rounded(unit(f"3e-1 * {near('open')} + 4e-1 * {near('close')} + 3e-1 * {near('((high + low) / 2e0)')}"))


LIQUIDITY = [liquidity(i) for i in range(20)]


def _snapshot(x: str, low: str, width: str) -> str:
    return f"(case when {x} is null then 5e-1 else {unit(f'({x} - {low}) / {width}')} end)"  # greatest and least pass over nulls


_DXY, _VIX, _SPX = _snapshot("dxy", "90e0", "20e0"), _snapshot("vix", "10e0", "30e0"), _snapshot("spx", "3000e0", "2500e0")
_BOND, _GOLD = _snapshot("us10y", "1e0", "4e0"), _snapshot("gold", "1500e0", "1000e0")
#: Eight components of macro context from market snapshots.
MACRO = [_DXY, _VIX, _SPX, _BOND, _GOLD, f"1e0 - {_DXY}", f"({_SPX} + 1e0 - {_VIX}) / 2e0", f"abs({_BOND} - {_GOLD})"]

_FEAR = f"((({_VIX}) + ({_GOLD})) / 2e0)"
#: Six components of sentiment from market snapshots: fear, risk aversion, dollar, equity appetite, bond stress, their mean.
MOOD = [_VIX, _FEAR, _DXY, _SPX, _BOND, f"({_VIX} + {_FEAR} + {_DXY} + {_SPX} + {_BOND}) / 5e0"]
#: The market's state and its aversion to risk, each of the norms alone; neutral where there is no snapshot.
MACRO_STATE, RISK_OFF = f"({_DXY} + {_VIX} + {_SPX} + {_BOND} + {_GOLD}) / 5e0", f"({_VIX} + {_GOLD} + {_BOND} + 1e0 - {_SPX}) / 4e0"
#: Components of the engines' vectors, in the order of the layers.
MACRO_PARTS = ("event_proximity_pressure", "aggregate_surprise_factor", "rate_differential", "high_impact_event_count", "medium_impact_event_count", "event_density", "upcoming_event_intensity", "composite_macro_state")
MOOD_PARTS = ("aggregate_sentiment", "bullish_pressure", "bearish_pressure", "article_volume", "sentiment_dispersion", "momentum")

VOL_REGIME = "case when range_pips < 30 then 'LOW' when range_pips > 70 then 'HIGH' else 'NORMAL' end"
TREND_REGIME = "case when range_pips = 0 then 'RANGING' when net_pips / range_pips > 3e-1 then 'BULLISH' when net_pips / range_pips < -3e-1 then 'BEARISH' else 'RANGING' end"
SESSION = "case when hour(ts) >= 4 and hour(ts) < 12 then 'LONDON' when hour(ts) >= 12 and hour(ts) < 20 then 'NY' else 'ASIA' end"
API_SESSION = "case when hour(ts) >= 12 and hour(ts) < 21 then 'NY' when hour(ts) >= 7 and hour(ts) < 12 then 'LONDON' else 'ASIA' end"


def with_pip(candles: DataFrame, pip: float) -> DataFrame:
    return candles.withColumn("pip", F.lit(float(pip)))


def with_id(df: DataFrame) -> DataFrame:
    """fingerprint_id: SHA-256 of asset and canonical time."""
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return df.withColumn("fingerprint_id", F.sha2(F.concat_ws(":", "asset", stamp), 256))


def with_regime(df: DataFrame) -> DataFrame:
    """net and range in pips, vol_regime, trend_regime, session."""
    df = df.withColumns({"net_pips": F.expr(rounded(NET, 2)), "range_pips": F.expr(rounded(RANGE, 2))})
    return df.withColumns({"vol_regime": F.expr(VOL_REGIME), "trend_regime": F.expr(TREND_REGIME), "session": F.expr(SESSION)})


def layer(parts: list[str]):
    return F.array(*[F.expr(feature(x)) for x in parts])


def fingerprints(candles: DataFrame, pip: float | None = None) -> DataFrame:
    """One row for each bar: id, versions, regime, and the layers l1 to l5 (l4 and l5 neutral until ``with_context``). Without ``pip``, bars have it as a column."""
    df = with_regime(with_id(candles if pip is None else with_pip(candles, pip)))
    df = df.withColumns({name: F.lit(v) for name, v in VERSIONS.items()})
    half = lambda n: F.array(*[F.lit(0.5)] * n)
    return df.withColumns({"l1": layer(STRUCTURE), "l2": layer(VOLATILITY), "l3": F.array(*[F.expr(x) for x in LIQUIDITY]), "l4": half(8), "l5": half(6)})


def with_context(states: DataFrame, macro: DataFrame, sentiment: DataFrame, snapshots: DataFrame) -> DataFrame:
    """states with l4 and l5 from the context, and macro_source and sentiment_source.

    macro: by ts, events and MACRO_PARTS; sentiment: by asset and ts, articles and MOOD_PARTS;
    snapshots: by ts, dxy, vix, spx, us10y and gold. A layer is the engine's vector if it saw
    an event or article, else made of the snapshot, else neutral. macro_state and
    sentiment_score are of the snapshot, whatever the layers are made of.
    """
    m = macro.where("events > 0").select("ts", F.array(*MACRO_PARTS).alias("_l4"))
    s = sentiment.where("articles > 0").select("asset", "ts", F.array(*MOOD_PARTS).alias("_l5"))
    p = snapshots.select("ts", layer(MACRO).alias("_p4"), layer(MOOD).alias("_p5"), F.expr(feature(MACRO_STATE)).alias("macro_state"), F.expr(feature(RISK_OFF)).alias("sentiment_score"))
    df = states.join(m, "ts", "left").join(s, ["asset", "ts"], "left").join(p, "ts", "left")
    df = df.withColumns({c: F.coalesce(c, F.lit(0.5)) for c in ("macro_state", "sentiment_score")})
    for name, own, other, to in (("macro", "_l4", "_p4", "l4"), ("sentiment", "_l5", "_p5", "l5")):
        source = F.when(F.col(own).isNotNull(), "engine").when(F.col(other).isNotNull(), "snapshot").otherwise("neutral")
        df = df.withColumns({f"{name}_source": source, to: F.coalesce(own, other, to)}).drop(own, other)
    return df


def last(n: int, upto: int = 0):
    return Window.partitionBy("asset").orderBy("ts").rowsBetween(-(n - 1), upto)


def rolling_trend(df: DataFrame) -> DataFrame:
    """Sigmoid of the least-squares slope of the last 50 closes, in pips a bar over 2.5; a lone bar uses its own move over 25."""
    w = last(50)
    t = F.row_number().over(Window.partitionBy("asset").orderBy("ts")).cast("double")
    df = df.withColumn("_t", t)
    df = df.withColumns({"_n": F.count("close").over(w).cast("double"), "_x": F.sum("_t").over(w), "_y": F.sum("close").over(w), "_xy": F.sum(F.col("_t") * F.col("close")).over(w), "_xx": F.sum(F.col("_t") * F.col("_t")).over(w)})
    slope = "((_n * _xy - _x * _y) / (_n * _xx - _x * _x))"
    out = f"case when _n = 1 then {sigmoid(f'{NET} / 25e0')} else {sigmoid(f'{slope} / pip / 25e-1')} end"
    return df.withColumn("rolling_trend", F.expr(rounded(out))).drop("_t", "_n", "_x", "_y", "_xy", "_xx")


def atr_percentile(df: DataFrame) -> DataFrame:
    """Share of the last 50 ranges below this one."""
    df = df.withColumn("_w", F.collect_list(F.expr("high - low")).over(last(50)))
    below = F.size(F.filter("_w", lambda r: r < F.expr("high - low")))
    return df.withColumn("atr_percentile", F.when(F.size("_w") <= 1, 0.5).otherwise(below / (F.size("_w") - 1))).withColumn("atr_percentile", F.expr(rounded("atr_percentile"))).drop("_w")


def volatility_score(df: DataFrame) -> DataFrame:
    df = df.withColumn("_avg", F.avg(F.expr("high - low")).over(last(50)))
    return df.withColumn("vol_regime_score", F.expr(rounded(f"case when _avg = 0 then 5e-1 else {sigmoid('((high - low) / _avg - 1e0) * 2e0')} end"))).drop("_avg")


def session_statistics(df: DataFrame) -> DataFrame:
    """Count and mean range in pips of each session among the last 50 bars, by bar time."""
    w = last(50)
    df = df.withColumn("_range", F.expr(RANGE))
    for s in ("asia", "london", "ny"):
        on = F.when(F.col("session") == s.upper(), F.col("_range"))
        df = df.withColumns({f"{s}_count": F.count(on).over(w), "_sum": F.sum(on).over(w)})
        # the sum is rounded first, so that its order does not show in the mean's last digit
        df = df.withColumn(f"{s}_range", F.expr(rounded(f"case when {s}_count = 0 then 5e-1 else {rounded('_sum')} / {s}_count end")))
    return df.drop("_range", "_sum")


def extended(df: DataFrame) -> DataFrame:
    return session_statistics(volatility_score(atr_percentile(rolling_trend(df))))


def ml_vector(df: DataFrame) -> DataFrame:
    """Thirty features: statistics of l1 and l2, l4, l5, one-hot session and volatility, three extended features."""

    def stats(c: str) -> list:
        n, v = F.size(c), F.col(c)
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / n
        var = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
        return [mean, F.sqrt(var), F.array_min(v), F.array_max(v)]

    hot = [(F.col("session") == s).cast("double") for s in ("LONDON", "NY", "ASIA")] + [(F.col("vol_regime") == r).cast("double") for r in ("HIGH", "LOW")]
    more = [F.coalesce(F.col(c), F.lit(0.5)) for c in ("rolling_trend", "atr_percentile", "vol_regime_score")]
    flat = F.concat(F.array(*stats("l1"), *stats("l2")), "l4", "l5", F.array(*hot, *more))
    return df.withColumn("ml_features", F.transform(flat, lambda x: F.floor(x * 1e6 + 0.5) / 1e6))

