"""Forecasts from outcome distributions, their confidence and tradeability, and the nine regime rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .outcomes import r6


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def forecast(d: DataFrame) -> DataFrame:
    """up, down, flat rounded to 2 digits, what is missing to 1 added to the largest (up before down before flat); expected move and direction."""
    u, v, f = (r6(F.col(f"{x}_probability"), 2) for x in ("up", "down", "flat"))
    d = d.withColumns({"_u": u, "_v": v, "_f": f})
    rest = r6(1 - (F.col("_u") + F.col("_v") + F.col("_f")), 2)
    d = d.withColumn("_rest", rest)
    is_u = (F.col("_u") >= F.col("_v")) & (F.col("_u") >= F.col("_f"))
    is_v = ~is_u & (F.col("_v") >= F.col("_f"))
    return d.withColumns(
        {
            "up": r6(F.col("_u") + F.when(is_u, F.col("_rest")).otherwise(0.0), 2),
            "down": r6(F.col("_v") + F.when(is_v, F.col("_rest")).otherwise(0.0), 2),
            "flat": r6(F.col("_f") + F.when(~is_u & ~is_v, F.col("_rest")).otherwise(0.0), 2),
            "expected_move_pips": r6(F.col("mean_return"), 2),
            "direction": F.when(is_u, "UP").when(is_v, "DOWN").otherwise("FLAT"),
        }
    ).drop("_u", "_v", "_f", "_rest")


def ensemble(d: DataFrame, ml_up: str, ml_down: str, ml_flat: str, alpha: float = 0.5) -> DataFrame:
    """up, down, flat blended with a model's where it has any; up and down are shares, flat is the rest."""
    mix = lambda a, b: r6(alpha * F.col(a) + (1 - alpha) * F.col(b), 2)
    d = d.withColumns({"_u": mix("up", ml_up), "_v": mix("down", ml_down), "_f": mix("flat", ml_flat)})
    total = F.col("_u") + F.col("_v") + F.col("_f")
    ok = F.col(ml_up).isNotNull() & (total > 0)
    safe = F.when(total > 0, total).otherwise(1.0)
    d = d.withColumns({"ens_up": F.when(ok, r6(F.col("_u") / safe, 2)).otherwise(F.col("up")), "ens_down": F.when(ok, r6(F.col("_v") / safe, 2)).otherwise(F.col("down"))})
    return d.withColumn("ens_flat", F.when(ok, r6(1 - F.col("ens_up") - F.col("ens_down"), 2)).otherwise(F.col("flat"))).drop("_u", "_v", "_f")


def confidence_v1(d: DataFrame) -> DataFrame:
    """Columns up, down, flat, mean_similarity, top_match_density, similarity_spread, variance, skew, kurtosis, sample_size, regime_match_ratio, regime_diversity give confidence_raw, sample_weight, regime_stability, confidence_v1."""
    c = F.col
    decisive = (F.greatest("up", "down", "flat") - 1 / 3) / (2 / 3)
    quality = 0.5 * c("mean_similarity") + 0.3 * c("top_match_density") + 0.2 * (1 - c("similarity_spread"))
    shape = ((1 - c("variance")) + (1 - F.abs("skew")) + (1 - c("kurtosis"))) / 3
    raw = clamp(0.4 * decisive + 0.35 * quality + 0.25 * shape)
    sample = F.when(c("sample_size") < 30, F.least(c("sample_size") / 30, F.lit(0.5))).otherwise(1.0)
    stable = clamp(0.7 * c("regime_match_ratio") + 0.3 * (1 - c("regime_diversity")))
    return d.withColumns({"confidence_raw": r6(raw), "sample_weight": r6(sample), "regime_stability": r6(stable), "confidence_v1": r6(clamp(raw * sample * stable))})


def bucket(p: Column) -> Column:
    """0.0-0.1 ... 0.9-1.0; exactly 1 is in the last."""
    lo = F.least(F.floor(p * 10), F.lit(9))
    return F.concat(F.format_string("%.1f", lo / 10), F.lit("-"), F.format_string("%.1f", (lo + 1) / 10))


def confidence_v2(d: DataFrame, bucket_rate: Column, regime_rate: Column, density: Column, base: float = 0.5) -> DataFrame:
    """Bucket success rate times regime accuracy times density factor, each with its fallback (base, 1, 1); the density only counts below 30 samples."""
    factor = F.when(F.col("sample_size") >= 30, 1.0).otherwise(F.coalesce(density, F.lit(1.0)))
    value = F.coalesce(bucket_rate, F.lit(base)) * F.coalesce(regime_rate, F.lit(1.0)) * factor
    return d.withColumns({"confidence_v2": r6(clamp(value)), "using_fallback": bucket_rate.isNull() | regime_rate.isNull()})


#: Spread in pips and liquidity by session.
SESSION_DEFAULTS = {"NY": (1.0, 0.85), "LONDON": (1.2, 0.85), "ASIA": (1.5, 0.70)}


def session_default(session: Column, i: int) -> Column:
    out = F.lit(None).cast("double")
    for s, v in SESSION_DEFAULTS.items():
        out = F.when(session == s, v[i]).otherwise(out)
    return out


def tradeability(d: DataFrame, confidence: str, spread: str, session: str, liquidity: str, news: str) -> DataFrame:
    """Confidence times factors of spread, session, liquidity and news: tradeability_score, label, unavailable (missing inputs, which mean 0 and NO_GO)."""
    c = F.col
    f_spread = F.when(c(spread) <= 2, 1.0).when(c(spread) <= 5, 0.7).otherwise(0.3)
    f_session = F.when(c(session) == "LONDON", 1.0).when(c(session) == "NY", 0.8).otherwise(0.5)
    f_liquid = F.when(c(liquidity) >= 0.7, 1.0).when(c(liquidity) >= 0.4, 0.75).otherwise(0.5)
    score = r6(clamp(c(confidence)) * f_spread * f_session * f_liquid * F.when(c(news), 0.0).otherwise(1.0), 2)
    names = F.array_join(F.array_compact(F.array(*[F.when(c(x).isNull(), F.lit(x)) for x in (confidence, spread, session, liquidity, news)])), ",")
    d = d.withColumn("unavailable", names)
    d = d.withColumn("tradeability_score", F.when(c("unavailable") != "", 0.0).otherwise(score))
    label = F.when(c("tradeability_score") > 0.75, "GO").when(c("tradeability_score") >= 0.45, "CONDITIONAL").otherwise("NO_GO")
    return d.withColumn("label", label)


# Each rule: name, and (points, condition) over the named features. rt is null where the rolling trend is neutral or missing.
RULES = {
    "accumulation": ((0.4, "contraction > 0.5e0"), (0.4, "close_pos > 0.55e0"), (0.2, "strength < 0.4e0")),
    "breakout": ((0.35, "impulse > 0.6e0"), (0.35, "speed > 0.6e0"), (0.3, "expansion > 0.55e0")),
    "contraction": ((0.5, "contraction > 0.65e0"), (0.3, "atr < 0.35e0"), (0.2, "pct < 0.3e0")),
    "distribution": ((0.4, "contraction > 0.5e0"), (0.4, "close_pos < 0.45e0"), (0.2, "strength < 0.4e0")),
    "expansion": ((0.5, "expansion > 0.65e0"), (0.3, "atr > 0.6e0"), (0.2, "pct > 0.7e0")),
    "macro_driven": ((0.6, "abs(macro - 0.5e0) > 0.3e0"), (0.3, "abs(sentiment - 0.5e0) > 0.3e0"), (0.1, "strength < 0.4e0")),
    "ranging": ((0.5, "strength < 0.35e0"), (0.3, "expansion < 0.4e0"), (0.2, "abs(rt - 0.5e0) < 0.15e0")),
    "reversal": ((0.5, "rejection > 0.5e0"), (0.3, "abs(direction - close_pos) > 0.3e0"), (0.2, "abs(rt - direction) > 0.3e0")),
    "trend": ((0.5, "strength > 0.55e0"), (0.3, "impulse > 0.5e0"), (0.2, "abs(rt - 0.5e0) > 0.2e0")),
}
#: Features of the rules in terms of the layers and extended features.
FEATURES = {
    "direction": "l1[4]", "strength": "l1[5]", "impulse": "l1[6]", "rejection": "l1[7]", "close_pos": "l1[8]",
    "atr": "l2[0]", "expansion": "l2[4]", "contraction": "l2[5]", "speed": "l2[6]",
    **{n: f"case when abs({x} - 0.5e0) >= 1e-9 then {x} end" for n, x in (("rt", "rolling_trend"), ("pct", "atr_percentile"), ("macro", "macro_state"), ("sentiment", "sentiment_score"))},
}


def rule_score(parts) -> str:
    """Points of the conditions that hold, to 6 digits; conditions on missing features do not."""
    return "(floor((" + " + ".join(f"(case when {c} then {p}e0 else 0e0 end)" for p, c in parts) + ") * 1e6 + 0.5) / 1e6)"


def regimes(df: DataFrame) -> DataFrame:
    """primary regime, up to two secondary ones with their relevance, and all nine scores, from layers and extended features."""
    df = df.withColumns({f"{k}": F.expr(v) for k, v in FEATURES.items()})
    df = df.withColumns({f"rule_{name}": F.expr(rule_score(parts)) for name, parts in RULES.items()})
    every = F.array(*[F.struct((-F.col(f"rule_{n}")).alias("s"), F.lit(n).alias("name")) for n in RULES])
    df = df.withColumn("_r", F.array_sort(every))
    df = df.withColumn("primary", F.col("_r")[0]["name"]).withColumn("primary_score", -F.col("_r")[0]["s"])
    second = F.slice(F.filter(F.slice("_r", 2, 8), lambda r: r["s"] < 0), 1, 2)
    rel = F.transform(second, lambda r: F.concat(r["name"], F.lit(":"), F.format_string("%.4f", F.when(F.col("primary_score") > 0, -r["s"] / F.col("primary_score")).otherwise(0.0))))
    return df.withColumn("secondary", F.array_join(rel, ",")).drop("_r", *FEATURES)
