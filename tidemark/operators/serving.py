"""Registry, versions, reports and entitlements as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .joins import top_per_key

# The assets of the registry.
ASSETS = (
    ("eurusd", "EURUSD", "FOREX", "ACTIVE", 1, 0.0001, 5, "24x5"),
    ("gbpusd", "GBPUSD", "FOREX", "ACTIVE", 2, 0.0001, 5, "24x5"),
)
REGISTRY = "id string, symbol string, asset_class string, status string, priority int, pip_size double, price_precision int, market_hours string"
#: Requests and period of each plan.
PLANS = {"free": (100, "day"), "starter": (5000, "month"), "professional": (25000, "month"), "enterprise": (25000, "month")}
#: Tiers, lowest first, and the least one of each path.
TIERS = ("retail", "developer", "research", "internal")
PATHS = {"/v1/forecast": "retail", "/v1/state": "developer", "/v1/similarity": "developer", "/v1/metrics": "internal"}


def registry(spark: SparkSession, rows=ASSETS) -> DataFrame:
    """The assets; ids and symbols must be unique."""
    for i in (0, 1):
        if len({r[i] for r in rows}) < len(rows):
            raise ValueError("an id or symbol of the registry repeats")
    values = ", ".join("(" + ", ".join(repr(v) for v in r) + ")" for r in rows)
    names = [c.split()[0] for c in REGISTRY.split(", ")]
    return spark.sql(f"select * from values {values} as t({', '.join(names)})").withColumn("pip_size", F.col("pip_size").cast("double"))


def processable(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("status").isin("ACTIVE", "BETA")).orderBy("priority", "id")


def currencies(symbol: Column) -> Column:
    """Both codes of a symbol of six letters or more, else the symbol itself."""
    return F.when(F.length(symbol) >= 6, F.array(F.substring(symbol, 1, 3), F.substring(symbol, 4, 3))).otherwise(F.array(symbol))


def api_currencies(symbol: Column) -> Column:
    """Both codes of a symbol of exactly six capital letters, else none."""
    return F.when(symbol.rlike("^[A-Z]{6}$"), currencies(symbol)).otherwise(F.array().cast("array<string>"))


def snapshot(versions: DataFrame) -> DataFrame:
    """One map from engine name to its active version."""
    return versions.where("is_active").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("engine", "version")))).alias("versions"))


def bumped(versions: DataFrame, new: DataFrame) -> DataFrame:
    """new (engine, version, created_at) on top: only the newest version of an engine is active."""
    both = versions.select("engine", "version", "created_at").unionByName(new.select("engine", "version", "created_at"))
    newest = F.row_number().over(Window.partitionBy("engine").orderBy(F.col("created_at").desc(), F.col("version").desc())) == 1
    return both.withColumn("is_active", newest)


def report(df: DataFrame, keys: list[str], counts: dict[str, str]) -> DataFrame:
    """keys, status (partial if any count named errors is over 0), and the counts as a JSON document."""
    g = df.groupBy(*keys).agg(*[F.count_if(F.expr(x)).alias(n) for n, x in counts.items()])
    return g.select(*keys, F.when(F.col("errors") > 0, "partial").otherwise("complete").alias("status"), F.to_json(F.struct(*sorted(counts))).alias("report"))


def served(latest: DataFrame, cached: DataFrame, as_of: str) -> DataFrame:
    """The newest bar of each asset with the seconds that its entry may live, where it lives a minute or more."""
    end = F.unix_seconds((F.col("ts") + F.expr("interval 4 hours")).cast("timestamp"))
    ttl = end - F.unix_seconds(F.lit(as_of).cast("timestamp"))
    return top_per_key(latest.join(cached, "asset"), ["asset"], [F.col("ts").desc()], 1, "_r").drop("_r").withColumn("ttl", ttl).where("ttl >= 60")


def limit_of(plan: Column, override: Column) -> Column:
    """Requests that a plan allows; enterprise may override."""
    out = F.lit(None).cast("int")
    for p, (n, _) in PLANS.items():
        out = F.when(plan == p, F.when((F.lit(p) == "enterprise") & (override > 0), override).otherwise(n)).otherwise(out)
    return out


def period_of(plan: Column) -> Column:
    return F.when(plan == "free", "day").otherwise("month")


def needs_reset(last: Column, period: Column, now: Column) -> Column:
    return last < F.when(period == "day", F.date_trunc("day", now)).otherwise(F.date_trunc("month", now))


def retry_after(period: Column, now: Column) -> Column:
    """Seconds to the next period, one at least."""
    nxt = F.when(period == "day", F.date_trunc("day", now) + F.expr("interval 1 day")).otherwise(F.date_trunc("month", now) + F.expr("interval 1 month"))
    return F.greatest(F.lit(1), F.unix_seconds(nxt.cast("timestamp")) - F.unix_seconds(now.cast("timestamp")))


def rank_of(tier: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, TIERS)), tier)


def allowed(requests: DataFrame) -> DataFrame:
    """Requests (path, tier) with the longest known path that theirs begins with, and whether the tier reaches its least one."""
    known, need = F.lit(None).cast("string"), F.lit(None).cast("string")
    for p, t in sorted(PATHS.items(), key=lambda x: len(x[0])):
        known, need = F.when(F.col("path").startswith(p), p).otherwise(known), F.when(F.col("path").startswith(p), t).otherwise(need)
    return requests.withColumn("endpoint", known).withColumn("allowed", F.coalesce(rank_of(F.col("tier")) >= rank_of(need), F.lit(False)))


def traced(df: DataFrame) -> DataFrame:
    """df with the SHA-256 of each row's JSON, columns in order of name."""
    return df.withColumn("trace", F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256))


def strict(df: DataFrame, col: str, fields: dict[str, str]) -> DataFrame:
    """Violations of a JSON document: unknown and missing fields, and those that are no numbers or strings as declared."""
    keys = F.coalesce(F.json_object_keys(col), F.array().cast("array<string>"))
    names = F.array(*[F.lit(f) for f in fields])
    wrong = [F.when(F.get_json_object(col, f"$.{f}").isNotNull() & F.get_json_object(col, f"$.{f}").try_cast("double").isNull(), F.lit(f)) for f, t in fields.items() if t == "number"]
    join = lambda a: F.array_join(F.array_sort(a), ",")
    return df.withColumns({"unknown": join(F.array_except(keys, names)), "missing": join(F.array_except(names, keys)), "mistyped": join(F.array_compact(F.array(*wrong)))})


def first_markets(values: Column, n: int = 5) -> Column:
    """The first n keys of a map in order, their values in [0, 1], 0.5 for NaN."""
    e = F.slice(F.array_sort(F.map_entries(values)), 1, n)
    unit = lambda v: F.when(v.isNull() | F.isnan(v), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)))
    return F.map_from_entries(F.transform(e, lambda x: F.struct(x["key"], unit(x["value"]))))
