"""News and calendar context of every bar: windows of articles and events joined to bar times by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import interval_join
from .outcomes import r6

HOUR = 3600


def hours(a: str, b: str) -> Column:
    return (F.unix_seconds(F.col(a).cast("timestamp")) - F.unix_seconds(F.col(b).cast("timestamp"))) / float(HOUR)


#: Sums of a time's articles that its sentiment is made of.
SUMS = ("n", "sw", "w", "bull", "bear", "m", "mm")


def sentiment_sums(near: DataFrame, half_life: float = 8.0) -> DataFrame:
    """ts and SUMS of pairs of times (ts) and articles (published_at, hint, relevance)."""
    hint = F.coalesce("hint", F.lit(0.0))
    w = F.col("relevance") * F.pow(F.lit(0.5), hours("ts", "published_at") / half_life)
    return near.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(hint * w).alias("sw"),
        F.sum(w).alias("w"),
        F.avg((hint > 0.2).cast("double")).alias("bull"),
        F.avg((hint < -0.2).cast("double")).alias("bear"),
        F.avg((hint + 1) / 2).alias("m"),
        F.avg((hint + 1) / 2 * ((hint + 1) / 2)).alias("mm"),
    )


def sentiment(bars: DataFrame, articles: DataFrame, half_life: float = 8.0) -> DataFrame:
    """asset, ts, articles, and six components of sentiment over the articles (published_at, hint, relevance) of the 24 hours up to each bar, both ends included.

    Weights halve every ``half_life`` hours; fewer than three articles are mixed with 0.5. Momentum is against the asset's bar before.
    """
    near = interval_join(articles, bars.select("ts").distinct(), [], "published_at", "ts", 24 * HOUR, 0)
    return sentiment_of(bars, sentiment_sums(near, half_life))


def sentiment_of(bars: DataFrame, g: DataFrame) -> DataFrame:
    """``sentiment`` from the sums of every time."""
    df = bars.select("asset", "ts").join(g, "ts", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    agg = F.when(F.coalesce(F.col("w"), F.lit(0.0)) == 0, 0.5).otherwise((F.col("sw") / F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")) + 1) / 2)
    df = df.withColumn("agg", agg)
    before = F.coalesce(F.lag("agg").over(Window.partitionBy("asset").orderBy("ts")), F.lit(0.5))
    df = df.withColumn("momentum", (F.col("agg") - before + 1) / 2)
    known = F.least(F.col("n") / 3, F.lit(1.0))
    mixed = lambda c: F.when(F.col("n") == 0, 0.5).otherwise(r6(c * known + 0.5 * (1 - known)))
    var = F.greatest(F.col("mm") - F.col("m") * F.col("m"), F.lit(0.0))
    return df.select(
        "asset", "ts", F.col("n").alias("articles"), mixed(F.col("agg")).alias("aggregate_sentiment"), mixed(F.col("bull")).alias("bullish_pressure"), mixed(F.col("bear")).alias("bearish_pressure"),
        mixed(F.least(F.col("n") / 50, F.lit(1.0))).alias("article_volume"), mixed(F.least(var / 0.25, F.lit(1.0))).alias("sentiment_dispersion"), mixed(F.col("momentum")).alias("momentum"),
    )


def surprise(actual: Column, estimate: Column) -> Column:
    d = F.when(estimate == 0, actual - estimate).otherwise((actual - estimate) / F.abs(F.when(estimate == 0, 1.0).otherwise(estimate)))
    return (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d)) + 1) / 2


def macro(times: DataFrame, events: DataFrame) -> DataFrame:
    """ts, events, and eight components of macro context over the events (event_date, impact, is_rate, actual, estimate, previous) from 72 hours before to 24 hours after each time."""
    e = interval_join(events, times, [], "event_date", "ts", 72 * HOUR, 24 * HOUR)
    high, ahead = F.col("impact") == "high", hours("event_date", "ts")
    w = F.when(high, 3.0).when(F.col("impact") == "medium", 2.0).otherwise(1.0)
    known = F.col("actual").isNotNull() & F.col("estimate").isNotNull()
    diff = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("actual") - F.col("previous")))
    rate = F.col("is_rate") & F.col("actual").isNotNull() & F.col("previous").isNotNull()
    g = e.groupBy("ts").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(high & (ahead > 0), ahead)).alias("next"),
        F.sum(F.when(known, surprise(F.col("actual"), F.col("estimate")) * w)).alias("sw"),
        F.sum(F.when(known, w)).alias("w"),
        F.max(F.when(rate, F.struct("event_date", diff.alias("d"))))["d"].alias("rate"),
        F.sum(high.cast("int")).alias("nh"),
        F.sum((F.col("impact") == "medium").cast("int")).alias("nm"),
        F.sum(F.when(ahead > 0, w).otherwise(0.0)).alias("soon"),
    )
    one = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = {
        "event_proximity_pressure": (0.25, F.when(F.col("next").isNull(), 0.0).otherwise(one(1 - F.col("next") / 24))),
        "aggregate_surprise_factor": (0.20, F.coalesce(F.col("sw") / F.col("w"), F.lit(0.5))),
        "rate_differential": (0.15, F.coalesce((F.col("rate") + 1) / 2, F.lit(0.5))),
        "high_impact_event_count": (0.15, one(F.col("nh") / 5)),
        "medium_impact_event_count": (0.05, one(F.col("nm") / 10)),
        "event_density": (0.05, one(F.col("n") / 20)),
        "upcoming_event_intensity": (0.15, one(F.col("soon") / 15)),
    }
    df = times.join(g, "ts", "left").withColumns({k: c for k, (_, c) in parts.items()})
    total = None
    for k, (w_, _) in parts.items():
        total = F.lit(w_) * F.col(k) if total is None else total + F.lit(w_) * F.col(k)
    df = df.withColumn("composite_macro_state", total)
    none = F.col("n").isNull()
    return df.select("ts", F.coalesce("n", F.lit(0)).alias("events"), *[F.when(none, 0.5).otherwise(r6(F.col(k))).alias(k) for k in [*parts, "composite_macro_state"]])


def events_of(bars: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """Pairs of bars (asset, ts, currencies) and events (currency, event_date and more) of one of their currencies, or of none, within the seconds before and after."""
    by = bars.withColumn("currency", F.explode(F.array_distinct("currencies"))).drop("currencies")
    own = interval_join(events.where("currency is not null"), by, ["currency"], "event_date", "ts", before, after)
    free = interval_join(events.where("currency is null"), bars.drop("currencies"), [], "event_date", "ts", before, after)
    return own.unionByName(free)


def asset_events(bars: DataFrame, events: DataFrame) -> DataFrame:
    """asset, ts, events (from 72 hours before to 24 after), and of the high-impact ones up to 8 hours ahead the nearest: next_event, hours_to_event."""
    n = events_of(bars, events, 72 * HOUR, 24 * HOUR).groupBy("asset", "ts").agg(F.count(F.lit(1)).alias("events"))
    soon = events_of(bars, events.where("impact = 'high'"), 0, 8 * HOUR).where("event_date > ts")
    soon = soon.groupBy("asset", "ts").agg(F.min(F.struct("event_date", "name")).alias("_e")).withColumn("event_date", F.col("_e.event_date"))
    soon = soon.select("asset", "ts", F.col("_e.name").alias("next_event"), hours("event_date", "ts").alias("hours_to_event"))
    df = bars.select("asset", "ts").join(n, ["asset", "ts"], "left").join(soon, ["asset", "ts"], "left")
    return df.withColumn("events", F.coalesce("events", F.lit(0)))


def news_risk(bars: DataFrame, events: DataFrame) -> DataFrame:
    """asset, ts, at_risk, hours_to_event, names: high-impact events of one of the asset's currencies after each bar's time, up to 8 hours ahead.

    bars: asset, ts, currencies; events: name, event_date, impact, currency. Assets without
    currencies are at no risk. Bars with only a ts are held against all events.
    """
    high = events.where("impact = 'high'")
    if "currencies" in bars.columns:
        keys = ["asset", "ts"]
        by = bars.select(*keys, F.explode(F.array_distinct("currencies")).alias("currency"))
        e = interval_join(high.where("currency is not null"), by, ["currency"], "event_date", "ts", 0, 8 * HOUR)
    else:
        keys = ["ts"]
        e = interval_join(high, bars, [], "event_date", "ts", 0, 8 * HOUR)
    e = e.where("event_date > ts").select(*keys, "event_date", "name").distinct()
    names = F.transform(F.array_sort(F.collect_list(F.struct("event_date", "name"))), lambda x: x["name"])
    g = e.groupBy(*keys).agg(F.min(hours("event_date", "ts")).alias("hours_to_event"), F.array_join(names, ",").alias("names"))
    return bars.select(*keys).join(g, keys, "left").withColumn("at_risk", F.col("hours_to_event").isNotNull()).withColumn("names", F.coalesce("names", F.lit("")))


def upcoming(bars: DataFrame, events: DataFrame, within: int = 8 * HOUR) -> DataFrame:
    """asset, ts, name of the nearest high-impact event of one of the asset's currencies, from each bar's time on."""
    by = bars.select("asset", "ts", F.explode(F.array_distinct("currencies")).alias("currency"))
    e = interval_join(events.where("impact = 'high' and currency is not null"), by, ["currency"], "event_date", "ts", 0, within)
    return e.groupBy("asset", "ts").agg(F.min(F.struct("event_date", "name"))["name"].alias("name"))


def event_impact(bars: DataFrame, events: DataFrame, outcomes: DataFrame) -> DataFrame:
    """For each asset and bar with an event ahead, what the asset did at the events of that name before: asset, ts, name, events, outcomes, median_abs, up_share, amplification.

    bars: asset, ts, currencies; events: name, event_date, impact, currency; outcomes: asset, ts,
    net_return_pips. An event's outcome is the asset's latest within four hours on either
    side. Bars with fewer than three events or three outcomes have no row. Outcomes are
    matched once for each asset and event; a bar then takes those before it, as many as the calendar has of the name.
    """
    past = events.select("name", "event_date").distinct()
    net = interval_join(outcomes.select("asset", "ts", "net_return_pips"), past, [], "ts", "event_date", 4 * HOUR, 4 * HOUR)
    net = net.groupBy("name", "event_date", "asset").agg(F.max_by("net_return_pips", "ts").alias("net"))
    ahead = upcoming(bars, events)
    seen = ahead.join(past, "name").where("event_date < ts").groupBy("asset", "ts", "name").agg(F.count(F.lit(1)).alias("events"))
    near = ahead.join(net, ["asset", "name"]).where("event_date < ts")
    g = near.groupBy("asset", "ts", "name").agg(F.count(F.lit(1)).alias("outcomes"), F.median(F.abs("net")).alias("med"), F.avg(F.abs("net")).alias("mean"), F.avg((F.col("net") > 0).cast("double")).alias("up"))
    g = g.join(seen, ["asset", "ts", "name"]).where("outcomes >= 3 and events >= 3")
    ratio = F.when(F.col("med") == 0, 1.0).otherwise(F.col("mean") / F.when(F.col("med") == 0, 1.0).otherwise(F.col("med")))
    return g.select("asset", "ts", "name", "events", "outcomes", r6(F.col("med")).alias("median_abs"), r6(F.col("up")).alias("up_share"), r6(ratio).alias("amplification"))
