"""What runs around the forecasts: limits and fallbacks of providers, dashboard figures, archives, diagnostics, checks of inputs, optional filters, pages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import insert_new, top_per_key
from .outcomes import r6


def mean_hint(hint: Column) -> Column:
    """Mean of the hints that are neither null nor 0; 0 if there are none (an aggregate)."""
    return F.coalesce(F.avg(F.when(hint != 0, hint)), F.lit(0.0))


def price_direction(pips: Column) -> Column:
    """By half a pip."""
    return F.when(pips > 0.5, "UP").when(pips < -0.5, "DOWN").otherwise("FLAT")


def direction_accuracy(forecasts: DataFrame, actual: DataFrame, key: str, order: str) -> DataFrame:
    """key, evaluated, correct, accuracy (percent, null without pairs): the n-th forecast (direction) of a key against its n-th actual direction."""
    w = Window.partitionBy(key).orderBy(order)
    a = forecasts.select(key, "direction", F.row_number().over(w).alias("_n"))
    b = actual.select(key, F.col("direction").alias("_is"), F.row_number().over(w).alias("_n"))
    g = a.join(b, [key, "_n"]).groupBy(key).agg(F.count(F.lit(1)).alias("evaluated"), F.count_if(F.col("direction") == F.col("_is")).alias("correct"))
    g = a.select(key).distinct().join(g, key, "left")
    return g.select(key, F.coalesce("evaluated", F.lit(0)).alias("evaluated"), F.coalesce("correct", F.lit(0)).alias("correct"), r6(100 * F.col("correct") / F.nullif("evaluated", F.lit(0)), 2).alias("accuracy"))


DAY, LAST_MINUTE = 86_400_000_000, 60_000_000


class Quotas:
    """The counters of one service: requests of the UTC day by provider, and the times (microseconds) of those in the last minute."""

    def __init__(self, chain: list[tuple[str, int, int]], day: int | None = None, used: list[int] | None = None, recent: list[tuple[int, int]] | None = None):
        self.chain, self.day = chain, day
        self.used = list(used or [0] * len(chain))
        self.recent: list[deque[int]] = [deque(at for p, at in sorted(recent or []) if p == i) for i in range(len(chain))]

    def ask(self, at: int, works) -> tuple[str | None, list[str]]:
        """The provider that serves a request, null if all fail, and what was asked or skipped before it. Times do not fall from call to call."""
        if at // DAY != self.day:
            self.day, self.used = at // DAY, [0] * len(self.chain)
        tried = []
        for i, (name, per_day, per_minute) in enumerate(self.chain):
            recent = self.recent[i]
            while recent and recent[0] <= at - LAST_MINUTE:
                recent.popleft()
            if self.used[i] >= per_day or len(recent) >= per_minute:
                tried.append(f"{name}: rate limited")
                continue
            self.used[i] += 1
            recent.append(at)
            if name in works:
                return name, tried
            tried.append(f"{name}: failed")
        return None, tried

    def kept(self) -> list[tuple[int, int]]:
        return [(i, at) for i, times in enumerate(self.recent) for at in times]


def with_fallback(requests: DataFrame, chain: list[tuple[str, int, int]], key: str, ts: str, tie: str, works: str) -> DataFrame:
    """key, tie, provider (null if all failed), attempts: providers asked or skipped before it, in the order of the chain (name, requests a day, requests a minute).

    A provider at its limit is skipped; one that fails (its name is not in the array column
    ``works``) still uses up a request. Days are UTC days, a minute is the last 60 seconds.
    The requests of a key are an ordered fold: rows are sorted by key and time within
    partitions by key and pass through Arrow batch by batch, so a task holds a batch and
    the counters of one key, not the key's rows. ``streaming.quotas`` keeps them as state.
    """
    kinds = dict(requests.dtypes)
    rows = requests.select(F.col(key).alias("_key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(tie).alias("_tie"), F.col(works).alias("_works"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, quotas = None, None
        for b in batches:
            won, tried = [], []
            for k, at, ok in zip(*(b.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if quotas is None or k != of:
                    of, quotas = k, Quotas(chain)
                a, t = quotas.ask(at, ok or [])
                won.append(a)
                tried.append("; ".join(t))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(won, pa.string()), pa.array(tried, pa.string())], [key, tie, "provider", "attempts"])

    return rows.repartition("_key").sortWithinPartitions("_key", "_at", "_tie").mapInArrow(run, f"{key} {kinds[key]}, {tie} {kinds[tie]}, provider string, attempts string")


def daily_quota(requests: DataFrame, key: str, ts: str, tie: str, limit: int) -> DataFrame:
    """requests with used (of the UTC day, this one in it), remaining and allowed."""
    w = Window.partitionBy(key, F.date_trunc("day", ts)).orderBy(ts, tie)
    used = F.row_number().over(w)
    return requests.withColumns({"used": used, "remaining": F.greatest(F.lit(0), limit - used), "allowed": used <= limit})


def archived(archive: DataFrame, matches: DataFrame) -> DataFrame:
    """The archive (fingerprint_id, match_id, batch_id and more) with those matches that it lacks; known ones are left as they are."""
    return insert_new(archive, matches, ["fingerprint_id", "match_id"])


def bonus_counts(states: DataFrame, newest: DataFrame) -> DataFrame:
    """asset, candidates, session_bonus_count, regime_bonus_count: earlier states of the asset that share the newest one's session, or its volatility."""
    n = newest.select("asset", F.col("ts").alias("_t"), F.col("session").alias("_s"), F.col("vol_regime").alias("_v"))
    p = states.join(n, "asset").where("ts < _t")
    return p.groupBy("asset").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(F.col("session") == F.col("_s")).alias("session_bonus_count"), F.count_if(F.col("vol_regime") == F.col("_v")).alias("regime_bonus_count"))


def document(df: DataFrame, key: str, parts: list[str], to: str = "diagnostics") -> DataFrame:
    """One JSON document for each key."""
    return df.select(key, F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}).alias(to))


def filtered(df: DataFrame, start=None, end=None, ts: str = "ts", **equal) -> DataFrame:
    """df where columns equal the values that are given (None: any) and start <= ts < end."""
    for c, v in equal.items():
        df = df if v is None else df.where(F.col(c) == v)
    df = df if start is None else df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    return df if end is None else df.where(F.col(ts) < F.lit(end).cast("timestamp_ntz"))


def violations(units: list[str], positive: list[str] = ()) -> Column:
    """Names of the columns that are null, NaN or outside [0, 1], or (positive) not above 0, comma-joined."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double"))
    found = [F.when(bad(c) | (F.col(c) < 0) | (F.col(c) > 1), F.lit(c)) for c in units] + [F.when(bad(c) | (F.col(c) <= 0), F.lit(c)) for c in positive]
    return F.array_join(F.array_compact(F.array(*found)), ",")


def checked(df: DataFrame, units: list[str], positive: list[str] = ()) -> DataFrame:
    """df; a row with a violation stops the query."""
    v = violations(units, positive)
    return df.where(F.assert_true(v == "", F.concat(F.lit("outside the valid range: "), v)).isNull())


def page_after(df: DataFrame, order: list[tuple[str, bool]], after: dict | None, size: int) -> DataFrame:
    """The next ``size`` rows in order (column, whether it falls; the last one unique) behind the row with the values ``after``; the first ones without it.

    Rows before it are left out by a predicate, not counted, so a late page costs what an early one does.
    """
    if after is not None:
        behind = F.lit(False)
        for i, (c, falls) in enumerate(order):
            here = F.col(c) < after[c] if falls else F.col(c) > after[c]
            for b, _ in order[:i]:
                here = here & (F.col(b) == after[b])
            behind = behind | here
        df = df.where(behind)
    return df.orderBy(*[F.col(c).desc() if falls else F.col(c).asc() for c, falls in order]).limit(size)


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """The rows of one page and has_more, whether rows follow it."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("a page has 1 to 100 rows from an offset of 0 or more")
    some = df.orderBy(*order).offset(offset).limit(limit + 1)
    w = Window.orderBy(*order)  # limit + 1 rows at most
    some = some.withColumns({"_n": F.row_number().over(w), "_all": F.count(F.lit(1)).over(Window.partitionBy())})
    return some.where(F.col("_n") <= limit).withColumn("has_more", F.col("_all") > limit).drop("_n", "_all")


def capped(df: DataFrame, source: str, newest: list[Column], most: int) -> DataFrame:
    """The newest rows of each source, at most so many: the cap of the feed."""
    return top_per_key(df, [source], newest, most, "_r").drop("_r")


def calendar_summary(at_risk: Column, hours: Column) -> dict[str, Column]:
    """Whether a high-impact event is near and hours to it; false and 24 without data, never below 0."""
    known = at_risk.isNotNull()
    return {"high_impact_event": F.when(known, at_risk).otherwise(False), "hours_to_next_event": r6(F.when(known, F.greatest(F.lit(0.0), F.coalesce(hours, F.lit(24.0)))).otherwise(24.0))}


#: The extended features that can be switched on, and the columns of each.
EXTENDED = {
    "rolling_trend": ["rolling_trend"],
    "atr_percentile": ["atr_percentile"],
    "volatility_regime_score": ["vol_regime_score"],
    "session_statistics": [f"{s}_{x}" for x in ("count", "range") for s in ("asia", "london", "ny")],
    "correlated_markets": ["correlated"],
    "economic_calendar_summary": ["high_impact_event", "hours_to_next_event"],
    "macro_state": ["macro_state"],
    "sentiment_summary": ["sentiment_summary"],
}


def enabled(df: DataFrame, flags: dict[str, bool], columns: dict[str, list[str]]) -> DataFrame:
    """df with the columns of features that are switched off made null."""
    off = [c for name, on in flags.items() if not on for c in columns[name]]
    types = dict(df.dtypes)
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in off}) if off else df


def alerts(drift: DataFrame, key: str) -> DataFrame:
    """A row for each drifted key, with what it asks for."""
    cols = {"baseline": F.col("baseline_mean"), "current": F.col("rolling_accuracy"), "sigmas": F.col("deviation"), "action": F.lit("retrain"), "status": F.lit("open")}
    return drift.where("drifted").select(key, *[c.alias(n) for n, c in cols.items()])


def running_guard(batches: DataFrame, key: str, batch: str, status: str, running: str) -> DataFrame:
    """key, is_overlapping, running_batch: the smallest running batch of each key, if any."""
    one = F.min(F.when(F.col(status) == running, F.col(batch)))
    return batches.groupBy(key).agg(one.alias("running_batch")).withColumn("is_overlapping", F.col("running_batch").isNotNull())


def picked(df: DataFrame, tier: Column, fields: dict[str, list[str] | None], key: str) -> DataFrame:
    """key, tier, fields: what a tier may see of a row as a JSON object; None: everything."""
    out = F.lit(None).cast("string")
    for t, names in fields.items():
        cols = df.columns if names is None else [c for c in df.columns if c in names]
        out = F.when(tier == t, F.to_json(F.struct(*cols))).otherwise(out)
    return df.select(key, tier.alias("tier"), F.coalesce(out, F.lit("{}")).alias("fields"))
