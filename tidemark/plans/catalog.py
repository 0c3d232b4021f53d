"""All queries by name. Market concepts are mapped to the test tables here: ticks are events, news are documents, the calendar is made of orders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import text as X
from tidemark.functions.numeric import feature
from tidemark.functions.stamps import parse_stamp
from tidemark.operators import candles as C
from tidemark.operators import context as K
from tidemark.operators import fingerprint as P
from tidemark.operators import index as I
from tidemark.operators import joins as J
from tidemark.operators import learning as L
from tidemark.operators import operations as Q
from tidemark.operators import outcomes as O
from tidemark.operators import research as R
from tidemark.operators import scoring as S
from tidemark.operators import serving as G
from tidemark.operators import similarity as M
from tidemark.operators import topology as T
from tidemark.operators.outcomes import r6
from tidemark.operators.trees import Forest
from tidemark.operators.writes import once
from tidemark.session import shared_dir
from tidemark.sources import responses as W
from tidemark.sources.files import bar_line, bar_lines

from .oracle import ORACLE_SQL as ORACLE_SQL

#: The test assets as registered markets.
MARKETS = (
    ("click", "EURUSD", "FOREX", "ACTIVE", 1, 2.0, 2, "24x7"),
    ("view", "GBPUSD", "FOREX", "ACTIVE", 2, 2.0, 2, "24x7"),
    ("purchase", "USDJPY", "FOREX", "BETA", 3, 2.0, 2, "24x7"),
    ("signup", "XAU", "METAL", "BETA", 4, 2.0, 2, "24x7"),
    ("error", "eurgbp", "FOREX", "PLANNED", 5, 2.0, 2, "24x7"),
)
CURRENCIES = ("USD", "EUR", "GBP", "JPY")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars of all ticks: ticks are read once, what is built on bars reads the written table."""
    pips = G.registry(spark, MARKETS).select(F.col("id").alias("asset"), F.col("pip_size").alias("pip"))
    return once(spark, sf, "bars", lambda: C.bars(read(spark, sf, "events"), "event_type", "ts", "value", "event_id").join(F.broadcast(pips), "asset"))


def states(spark: SparkSession, sf: str) -> DataFrame:
    """States with the context of calendar, news and snapshots, written once as bars are."""

    def made() -> DataFrame:
        b = bars(spark, sf)
        return P.with_context(P.fingerprints(b), K.macro(b.select("ts").distinct(), calendar(spark, sf)), K.sentiment(b, articles(spark, sf)), snapshots(spark, sf))

    return once(spark, sf, "states", made)


def shaped(spark: SparkSession, sf: str) -> DataFrame:
    """States with the topology vector of the bars before them, null where those are too few; written once."""

    def made() -> DataFrame:
        t = T.topology(bars(spark, sf), include_current=False).select("asset", "ts", F.col("vector").alias("topology"))
        return states(spark, sf).join(t, ["asset", "ts"], "left")

    return once(spark, sf, "shaped", made)


def regime_bars(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_regime(P.with_id(bars(spark, sf)))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return O.forward(regime_bars(spark, sf), digits=True)


def split(df: DataFrame, col: str, parts: list[str], keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.expr(x).alias(f"{col}_{i}") for i, x in enumerate(parts)])


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as news, an hour apart from the first of January 2024 on, over thirty days."""
    d = read(spark, sf, "documents")
    return d.select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("doc_id") % 720).cast("int"))).alias("published_at"),
        (((F.col("doc_id") * 37) % 21 - 10) / 10).alias("hint"),
        (((F.col("doc_id") * 13) % 11) / 10).alias("relevance"),
    )


CLERK_NAMES = ("CPI report", "rate decision", "PMI survey", "GDP release", "retail sales", "speech")


def calendar(spark: SparkSession, sf: str, *keep: str) -> DataFrame:
    """Orders as calendar events, dealt over five years that begin with the ticks' thirty days."""
    o = read(spark, sf, "orders")
    i = (F.col("o_orderkey") / 61).cast("long") % 6
    name = F.get(F.array(*map(F.lit, CLERK_NAMES)), i.cast("int"))
    return o.select(
        (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=((F.col("o_orderkey") * 7) % 43_920).cast("int"), mins=F.lit(30))).alias("event_date"),
        name.alias("name"),
        X.impact(name).alias("impact"),
        X.is_rate_decision(name).alias("is_rate"),
        F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_orderkey") % 50) / 10).alias("actual"),
        F.when(F.col("o_orderkey") % 11 != 0, (F.col("o_orderkey") % 40) / 10).alias("estimate"),
        ((F.col("o_orderkey") % 45) / 10).alias("previous"),
        *keep,
    )


@query
def candle_resample_4h(spark, sf):
    return C.bars(read(spark, sf, "events"), "event_type", "ts", "value", "event_id")


@query
def ohlc_validate(spark, sf):
    """Every seventh bar is given a high below its close first."""
    w = Window.partitionBy("asset").orderBy("ts")
    bad = bars(spark, sf).withColumn("rn", F.row_number().over(w)).withColumn("high", F.when(F.col("rn") % 7 == 0, F.least("open", "close") - 1).otherwise(F.col("high")))
    return C.violations(bad)


@query
def grid_expected(spark, sf):
    return C.expected(bars(spark, sf))


@query
def gap_detect(spark, sf):
    """Every fifth bar is taken away first."""
    w = Window.partitionBy("asset").orderBy("ts")
    some = bars(spark, sf).withColumn("rn", F.row_number().over(w)).where("rn % 5 != 3")
    return C.gaps(some)


@query
def sunday_merge(spark, sf):
    return C.sunday_merged(bars(spark, sf))


@query
def fingerprint_id(spark, sf):
    return P.with_id(bars(spark, sf)).select("asset", "ts", "fingerprint_id")


@query
def return_profile(spark, sf):
    return regime_bars(spark, sf).select("asset", "ts", "net_pips", "range_pips")


@query
def regime_classify(spark, sf):
    return regime_bars(spark, sf).select("asset", "ts", "vol_regime", "trend_regime", "session", F.expr(P.API_SESSION).alias("api_session"))


@query
def l1_structure(spark, sf):
    return split(regime_bars(spark, sf), "l1", [feature(x) for x in P.STRUCTURE], ["asset", "ts"])


@query
def l2_volatility(spark, sf):
    return split(regime_bars(spark, sf), "l2", [feature(x) for x in P.VOLATILITY], ["asset", "ts"])


@query
def l3_liquidity(spark, sf):
    return split(bars(spark, sf), "l3", P.LIQUIDITY, ["asset", "ts"])


@query
def l4_macro_snapshot(spark, sf):
    return split(snapshots(spark, sf), "l4", [feature(x) for x in P.MACRO], ["ts"])


@query
def l5_sentiment_snapshot(spark, sf):
    """As above; every seventh hour block lacks the volatility index."""
    snap = snapshots(spark, sf).withColumn("vix", F.when(F.dayofmonth("ts") % 7 != 0, F.col("vix")))
    return split(snap, "l5", [feature(x) for x in P.MOOD], ["ts"])


@query
def state_layers(spark, sf):
    """Where layers four and five come from and what they are: news and calendar of the first ten days only, snapshots of the first twenty, so that each source is used."""
    df = ten_days(spark, sf)
    return split(df, "l4", [f"l4[{i}]" for i in range(8)], ["asset", "ts", "macro_source", "sentiment_source", "l5"]).select("*", *[F.col("l5")[i].alias(f"l5_{i}") for i in range(6)]).drop("l5")


def ten_days(spark: SparkSession, sf: str) -> DataFrame:
    """States with news and calendar of the first ten days and snapshots of the first twenty."""
    b = bars(spark, sf)
    ten, twenty = (F.lit(f"2024-01-{d}").cast("timestamp_ntz") for d in (11, 21))
    m = K.macro(b.select("ts").distinct(), calendar(spark, sf).where(F.col("event_date") < ten))
    s = K.sentiment(b, articles(spark, sf).where(F.col("published_at") < ten))
    return P.with_context(P.fingerprints(b), m, s, snapshots(spark, sf).where(F.col("ts") < twenty))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Closes of the five assets stand for the five snapshot symbols, brought into their ranges."""
    wide = bars(spark, sf).groupBy("ts").agg(*[F.max(F.when(F.col("asset") == a, F.col("close"))).alias(f"x{i}") for i, a in enumerate(ASSETS)])
    return wide.select("ts", *[F.expr(e).alias(n) for n, e in SNAPSHOT.items()])


ASSETS = ("click", "view", "purchase", "signup", "error")
SNAPSHOT = {"dxy": "90e0 + x0 / 10e0", "vix": "10e0 + x1 / 5e0", "spx": "3000e0 + x2 * 10e0", "us10y": "1e0 + x3 / 50e0", "gold": "1500e0 + x4 * 4e0"}


@query
def forward_outcomes(spark, sf):
    cols = ["asset", "ts", "next_ts", "net_return_pips", "mfe_pips", "mae_pips", "realised_volatility"]
    return O.forward(bars(spark, sf), digits=True).select(*cols)


@query
def rolling_trend(spark, sf):
    return P.rolling_trend(bars(spark, sf)).select("asset", "ts", "rolling_trend")


@query
def atr_percentile(spark, sf):
    return P.atr_percentile(bars(spark, sf)).select("asset", "ts", "atr_percentile")


@query
def vol_regime_score(spark, sf):
    return P.volatility_score(bars(spark, sf)).select("asset", "ts", "vol_regime_score")


@query
def session_stats(spark, sf):
    return P.session_statistics(regime_bars(spark, sf)).select("asset", "ts", *[f"{s}_{x}" for s in ("asia", "london", "ny") for x in ("count", "range")])


@query
def extended_all(spark, sf):
    """All eight extended features of every state, two of them switched off."""
    df = P.extended(states(spark, sf)).withColumnRenamed("sentiment_score", "sentiment_summary")
    markets = bars(spark, sf).groupBy("ts").agg(F.map_from_entries(F.collect_list(F.struct("asset", F.col("close") / 200))).alias("_m"))
    told = F.transform(F.map_entries(G.first_markets(F.col("_m"))), lambda e: F.format_string("%s:%.6f", e["key"], e["value"]))
    risk = K.news_risk(bars(spark, sf).select("ts").distinct(), calendar(spark, sf)).select("ts", *[c.alias(n) for n, c in Q.calendar_summary(F.col("at_risk"), F.col("hours_to_event")).items()])
    df = df.join(markets.select("ts", F.array_join(told, ",").alias("correlated")), "ts").join(risk, "ts")
    flags = dict.fromkeys(Q.EXTENDED, True) | {"atr_percentile": False, "sentiment_summary": False}
    return Q.enabled(df, flags, Q.EXTENDED).select("asset", "ts", *[c for cols in Q.EXTENDED.values() for c in cols])


@query
def ml_features(spark, sf):
    df = P.ml_vector(P.extended(states(spark, sf)))
    return df.select("asset", "ts", *[F.col("ml_features")[i].alias(f"f{i}") for i in range(30)])


@query
def walk_forward_split(spark, sf):
    return L.walk_forward(labelled(spark, sf), "asset", "ts").groupBy("asset").agg(F.sum(F.col("is_train").cast("int")).alias("train"), F.count(F.lit(1)).alias("n"))


@query
def outcome_distribution(spark, sf):
    return O.distribution(labelled(spark, sf), ["asset", "vol_regime"], "net_return_pips")


@query
def outcome_weighted(spark, sf):
    """Every asset's outcomes as seen from a NORMAL bar in London."""
    d = labelled(spark, sf).withColumn("copies", O.regime_copies(F.lit("NORMAL"), F.lit("LONDON"), F.col("vol_regime"), F.col("session")))
    return O.distribution(d, ["asset"], "net_return_pips", weight="copies")


@query
def dynamic_flat(spark, sf):
    return O.dynamic_flat(bars(spark, sf)).select("asset", "ts", r6(F.col("flat_threshold")).alias("flat_threshold"))


@query
def cosine_pairs(spark, sf):
    """For every vector whose id is divisible by 20, the ten nearest of its label by cosine."""
    return M.nearest(vectors(spark, sf), F.expr("vec_id % 20 = 0"), 10, F.col("label")).select(F.col("q_vec_id").alias("a_vec_id"), F.col("vec_id").alias("b_vec_id"), F.col("score").alias("similarity"))


@query
def l2_similarity(spark, sf):
    """As above, by distance."""
    return M.nearest(vectors(spark, sf), F.expr("vec_id % 20 = 0"), 10, F.col("label"), euclid=True).select(F.col("q_vec_id").alias("a_vec_id"), F.col("vec_id").alias("b_vec_id"), F.col("score").alias("similarity"))


@query
def topk_similarity(spark, sf):
    """For every vector whose id is divisible by 20, the ten nearest of all by cosine."""
    return M.nearest(vectors(spark, sf), F.expr("vec_id % 20 = 0"), 10, F.lit(0))


@query
def similarity_batch(spark, sf):
    """All earlier states of the asset, blended with the topology."""
    return M.batch_search(shaped(spark, sf), topology_weight=M.TOPOLOGY_WEIGHT).select("asset", "fingerprint_id", "match_id", "rank", "score")


@query
def similarity_engine(spark, sf):
    return M.engine_search(states(spark, sf)).select("asset", "fingerprint_id", "match_id", "rank", "score")


@query
def match_explanation(spark, sf):
    m = M.explained(M.engine_search(states(spark, sf), 3), 0.95)
    return m.select("fingerprint_id", "match_id", "matched", "mismatched", "reason")


@query
def match_explanation_brief(spark, sf):
    """Of the three best matches of the blended search, by the fixed thresholds."""
    m = M.explained_briefly(M.batch_search(shaped(spark, sf), 3, M.TOPOLOGY_WEIGHT))
    return m.select("fingerprint_id", "match_id", "matched", "mismatched", "reason")


@query
def ann_layers(spark, sf):
    """The search within regimes through the index of layers."""
    return I.engine_search(states(spark, sf)).select("asset", "fingerprint_id", "match_id", "rank", "score")


@query
def ann_recall(spark, sf):
    """How many of the fifty best earlier states of its asset a state finds through the index, regimes together, so that groups exceed what a query reads."""
    st = states(spark, sf)
    found = I.search(st, ["asset"], 50, bonus=True, how=I.Index(reach=80))
    return I.recall(found, M.batch_search(st, 50))


@query
def blended_score(spark, sf):
    """The topology's part in the five best matches; the first bars have no topology."""
    m = M.batch_search(shaped(spark, sf), 5, M.TOPOLOGY_WEIGHT)
    return m.select("fingerprint_id", "match_id", "topology_score", F.col("score").alias("blended"))


@query
def layer_merge(spark, sf):
    """Three searches by different regimes, merged by id."""
    b = labelled(spark, sf).select(F.col("fingerprint_id").alias("id"), "vol_regime", "trend_regime", "session", F.abs("net_return_pips").alias("score"))
    return M.merged_layers([b.where("vol_regime = 'HIGH'"), b.where("trend_regime = 'BULLISH'"), b.where("session = 'NY'")])


def forecasts(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """For every bar the distribution of what followed its most similar earlier bars, as a forecast, with confidence inputs."""
    m = M.engine_search(states(spark, sf), k)
    out = labelled(spark, sf)
    known = m.join(out.select(F.col("fingerprint_id").alias("match_id"), "net_return_pips"), "match_id")
    d = O.distribution(known, ["asset", "fingerprint_id"], "net_return_pips")
    q = known.groupBy("fingerprint_id").agg(F.avg("score").alias("mean_similarity"), (F.max("score") - F.min("score")).alias("similarity_spread"), F.avg((F.col("score") >= 0.8).cast("double")).alias("top_match_density"), F.avg((F.col("session") == F.col("match_session")).cast("double")).alias("regime_match_ratio"))
    d = S.forecast(d).join(q, "fingerprint_id")
    d = d.withColumns({"variance": F.least(F.col("std_dev") / 50, F.lit(1.0)), "skew": F.lit(0.0), "kurtosis": F.lit(0.0), "regime_diversity": 1 - F.col("regime_match_ratio")})
    return S.confidence_v1(d)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return forecasts(spark, sf).select("asset", "fingerprint_id", "sample_size", "up", "down", "flat", "expected_move_pips", "direction", "confidence_v1")


@query
def forecast_flagship(spark, sf):
    return flagship(spark, sf)


def regime_forecasts(spark: SparkSession, sf: str) -> DataFrame:
    """Every bar's forecast from all outcomes of its asset and regime: cheap, with evaluations for all bars."""
    o = labelled(spark, sf)
    d = S.forecast(O.distribution(o, ["asset", "vol_regime", "trend_regime"], "net_return_pips"))
    cols = ["asset", "vol_regime", "trend_regime", "up", "down", "flat", "expected_move_pips", "sample_size", "std_dev", "max_probability"]
    keep = o.select("asset", "ts", "fingerprint_id", "vol_regime", "trend_regime", "session", "net_return_pips")
    return keep.join(d.select(*cols), ["asset", "vol_regime", "trend_regime"]).withColumn("confidence", F.col("max_probability"))


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    return R.evaluated(regime_forecasts(spark, sf)).withColumn("regime", F.concat_ws("_", "vol_regime", "trend_regime"))


@query
def forecast_normalise(spark, sf):
    return S.forecast(O.distribution(labelled(spark, sf), ["asset", "vol_regime", "session"], "net_return_pips")).select("asset", "vol_regime", "session", "up", "down", "flat", "expected_move_pips", "direction")


@query
def ensemble_blend(spark, sf):
    """The asset's own distribution stands for the model's; sign-ups have none."""
    o = labelled(spark, sf)
    d = S.forecast(O.distribution(o, ["asset", "vol_regime"], "net_return_pips"))
    m = S.forecast(O.distribution(o.where("asset != 'signup'"), ["asset"], "net_return_pips")).select("asset", *[F.col(x).alias(f"ml_{x}") for x in ("up", "down", "flat")])
    return S.ensemble(d.join(m, "asset", "left"), "ml_up", "ml_down", "ml_flat").select("asset", "vol_regime", "ens_up", "ens_down", "ens_flat")


@query
def confidence_v1(spark, sf):
    f = regime_forecasts(spark, sf).select("asset", "vol_regime", "trend_regime", "up", "down", "flat", "sample_size", "std_dev").distinct()
    f = f.withColumns({"variance": F.least(F.col("std_dev") / 50, F.lit(1.0)), "skew": F.lit(0.1), "kurtosis": F.lit(0.2), "mean_similarity": F.lit(0.8), "similarity_spread": F.lit(0.2), "top_match_density": F.lit(0.7), "regime_match_ratio": F.lit(0.6), "regime_diversity": F.lit(0.3)})
    return S.confidence_v1(f).select("asset", "vol_regime", "trend_regime", "confidence_raw", "sample_weight", "regime_stability", "confidence_v1")


@query
def confidence_v2(spark, sf):
    """Bucket and regime rates come from the evaluations themselves; the density curve is n / 30."""
    e = evaluations(spark, sf)
    b = e.groupBy("bucket").agg(r6(F.avg("direction_accuracy")).alias("bucket_rate"))
    r = e.groupBy("regime").agg(r6(F.avg("direction_accuracy")).alias("regime_rate"), F.count(F.lit(1)).alias("rn")).where("rn >= 30")
    f = e.select("asset", "regime", "bucket", "sample_size").distinct().join(b, "bucket").join(r, "regime", "left")
    return S.confidence_v2(f, F.col("bucket_rate"), F.col("regime_rate"), F.col("sample_size") / 30).select("asset", "regime", "bucket", "sample_size", "confidence_v2", "using_fallback")


@query
def tradeability(spark, sf):
    f = regime_forecasts(spark, sf).withColumns({"spread": S.session_default(F.col("session"), 0), "liquidity": S.session_default(F.col("session"), 1), "news": F.hour("ts") == 12, "conf": F.when(F.col("sample_size") > 5, F.col("confidence"))})
    return S.tradeability(f, "conf", "spread", "session", "liquidity", "news").select("asset", "ts", "tradeability_score", "label", "unavailable")


@query
def sentiment_vector(spark, sf):
    return K.sentiment(bars(spark, sf), articles(spark, sf))


@query
def macro_vector(spark, sf):
    return K.macro(bars(spark, sf).select("ts").distinct(), calendar(spark, sf))


def priced_calendar(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar with a currency for four in five events."""
    c = calendar(spark, sf, F.get(F.array(*map(F.lit, CURRENCIES)), (F.col("o_orderkey") % 5).cast("int")).alias("currency"))
    return c.select("event_date", "name", "impact", "currency")


def dealt(spark: SparkSession, sf: str) -> DataFrame:
    """asset, ts and the currencies of the asset as registered."""
    own = G.registry(spark, MARKETS).select(F.col("id").alias("asset"), G.currencies(F.upper("symbol")).alias("currencies"))
    return bars(spark, sf).select("asset", "ts").join(F.broadcast(own), "asset")


@query
def news_risk(spark, sf):
    return K.news_risk(dealt(spark, sf), priced_calendar(spark, sf))


@query
def event_context(spark, sf):
    """What each asset did at earlier events of the name that is ahead of it."""
    return K.event_impact(dealt(spark, sf), priced_calendar(spark, sf), O.forward(bars(spark, sf), digits=True))


@query
def regime_v2(spark, sf):
    return S.regimes(P.extended(states(spark, sf))).select("asset", "ts", "primary", "primary_score", "secondary", *[f"rule_{n}" for n in S.RULES])


@query
def evaluation_metrics(spark, sf):
    return evaluations(spark, sf).select("fingerprint_id", "direction_predicted", "direction_actual", "direction_accuracy", "error", "abs_error", "squared_error", "brier", "calibration_error", "bucket", "tradeability_success")


@query
def forecast_maturity(spark, sf):
    f = labelled(spark, sf).withColumns({"expiry": F.col("ts") + F.expr("interval 4 hours"), "net_return_pips": F.when(F.col("session") != "NY", F.col("net_return_pips"))})
    return R.maturity(f, "2024-01-20 00:00:00").select("fingerprint_id", "status")


@query
def unevaluated_antijoin(spark, sf):
    f = regime_bars(spark, sf).select("asset", "ts", "fingerprint_id")
    return f.join(evaluations(spark, sf).where("session != 'ASIA'").select("fingerprint_id"), "fingerprint_id", "left_anti")


@query
def calibration_report(spark, sf):
    return R.calibration(evaluations(spark, sf))


@query
def regime_accuracy(spark, sf):
    """Against the run before the fifteenth."""
    e = evaluations(spark, sf)
    return R.regime_accuracy(e, R.regime_accuracy(e.where("ts < timestamp_ntz'2024-01-15'")))


@query
def regime_accuracy_rollup(spark, sf):
    return evaluations(spark, sf).rollup("regime", "asset").agg(F.count(F.lit(1)).alias("n"), r6(100 * F.avg("direction_accuracy"), 2).alias("accuracy"))


@query
def stage_contribution(spark, sf):
    """News and calendar of the first ten days only, so that states with and without data are compared."""
    st = ten_days(spark, sf)
    flags = st.select("fingerprint_id", *[(F.col(f"{x}_source") == "engine").alias(f"has_{x}") for x in ("macro", "sentiment")])
    return R.contributions(evaluations(spark, sf).join(flags, "fingerprint_id"), M.engine_search(st, 5))


@query
def marginal_delta(spark, sf):
    return R.marginal(evaluations(spark, sf), F.col("session") == "LONDON")


@query
def pearson(spark, sf):
    return R.correlation(labelled(spark, sf).withColumn("zero", F.lit(1.0)), ["asset"], "range_pips", "mfe_pips")


@query
def drift_check(spark, sf):
    return R.drift(evaluations(spark, sf), "asset", ["ts"])


@query
def experiment_ab(spark, sf):
    by_pips = lambda n: lambda d: d.withColumn("result", R.realised(F.col("net_return_pips"), n))
    return R.experiment(labelled(spark, sf), {"1.0": by_pips(2.0), "1.1": by_pips(20.0)})


def rekeyed(customers: DataFrame, times: int, balance: float) -> DataFrame:
    """All customers as writes to ``times`` their key: some keys are known, some new."""
    return customers.withColumns({"c_custkey": F.col("c_custkey") * times, "c_acctbal": F.lit(balance)})


@query
def upsert_ignore(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return J.insert_new(c, rekeyed(c, 2, 0.0), ["c_custkey"])


@query
def upsert_overwrite(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return J.upsert(c, rekeyed(c, 2, 0.0), ["c_custkey"])


@query
def update_column(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return J.updated(c, rekeyed(c, 5, 1.0), ["c_custkey"], "c_acctbal")


@query
def dedup_first(spark, sf):
    return J.first_of_each(read(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query
def provider_fallback(spark, sf):
    b = bars(spark, sf).select("asset", "ts", "close")
    return J.first_available([b.where("hour(ts) < 8"), b.where("hour(ts) < 16").withColumn("close", F.col("close") + 1), b.withColumn("close", F.col("close") + 2)], ["asset", "ts"])


@query
def asof_next(spark, sf):
    return J.asof_next(bars(spark, sf).select("asset", "ts", "close"), "asset", "ts", ["ts", "close"])


@query
def asof_tolerance(spark, sf):
    """For each high-impact event and asset the latest bar within four hours on either side."""
    e = calendar(spark, sf).where("impact = 'high'").select("name", "event_date").distinct()
    m = J.interval_join(bars(spark, sf).select("asset", "ts", "close"), e, [], "ts", "event_date", 4 * 3600, 4 * 3600)
    return m.groupBy("asset", "name", "event_date").agg(F.max("ts").alias("ts"), F.max_by("close", "ts").alias("close"))


@query
def range_join_window(spark, sf):
    m = J.interval_join(articles(spark, sf), bars(spark, sf).select("ts").distinct(), [], "published_at", "ts", 24 * 3600, 0)
    return m.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("hint")).alias("mean_hint"))


@query
def serving_latest(spark, sf):
    """Each asset's newest bar."""
    s = F.struct("ts", "close", "vol_regime", "trend_regime", "session")
    return regime_bars(spark, sf).groupBy("asset").agg(F.max(s).alias("s")).select("asset", "s.*")


@query
def paginate(spark, sf):
    """The third page of twenty customers by balance, and whether more follow."""
    return Q.page(read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), [F.col("c_acctbal").desc(), F.col("c_custkey")], 40, 20)


@query
def paginate_keyset(spark, sf):
    """The third page again, from the last row of the second one on."""
    c, order = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), [("c_acctbal", True), ("c_custkey", False)]
    after = None
    for _ in range(2):
        after = Q.page_after(c, order, after, 20).collect()[-1].asDict()
    return Q.page_after(c, order, after, 20)


@query
def tier_projection(spark, sf):
    """Customers with nation and region, as a tier may see them: balances only where they are high."""
    c, n, r = (read(spark, sf, t) for t in ("customer", "nation", "region"))
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select("c_custkey", "n_name", "r_name", F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")).alias("c_acctbal"))


NEWS = ("EUR/USD rallies as ECB holds", "USDJPY slips, yen strong", "Fed signals GDP growth", "GBP weak against CHF and CAD", "Markets quiet", "Eurozone inflation in decline", "AUD gains", "nfp surge lifts dollar")


def headlines(spark: SparkSession, sf: str) -> DataFrame:
    d = read(spark, sf, "documents")
    pick = F.get(F.array(*map(F.lit, NEWS)), (F.col("doc_id") % len(NEWS)).cast("int"))
    return d.select("doc_id", F.concat_ws(" ", pick, "text").alias("headline"))


@query
def reply_scores(spark, sf):
    """Replies to batches of ten documents, in five shapes by turns, parsed and dealt back by position."""
    score = ((F.col("doc_id") * 37) % 21 - 10) / 10
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("batch"), score.alias("s"))
    b = d.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("doc_id", "s"))).alias("_d"))
    listed = lambda f: F.array_join(F.transform("_d", lambda x: f(x["s"]).cast("string")), ", ")
    fence = F.lit("```")
    shapes = [
        F.concat(F.lit("["), listed(lambda s: s), F.lit("]")),
        F.concat(fence, F.lit("json\n["), listed(lambda s: s), F.lit("]\n"), fence),
        F.concat(F.lit("Scores: "), listed(lambda s: s)),
        F.lit("I cannot score these."),
        F.concat(F.lit("Here: ["), listed(lambda s: 3 * s), F.lit(', null, "0.5"] and [9]')),
    ]
    reply = F.get(F.array(*shapes), F.pmod("batch", F.lit(5)).cast("int"))
    b = b.select(F.transform("_d", lambda x: x["doc_id"]).alias("ids"), X.scores_of_reply(reply, F.size("_d")).alias("scores"))
    return b.select(F.explode(F.arrays_zip("ids", "scores")).alias("z")).select(F.col("z.ids").alias("doc_id"), F.col("z.scores").alias("score"))


@query
def candle_sources(spark, sf):
    """Bars as answers of three providers, some of them errors or incomplete, and the first candle of each boundary."""
    b = bars(spark, sf).withColumn("h", F.hour("ts"))
    text = F.to_json(F.struct(F.array(F.struct(*[F.col(f).cast("string").alias(f) for f in W.FIELDS])).alias("values"), F.lit("ok").alias("status")))
    plain = F.to_json(F.struct(F.array(F.struct(F.col("open"), F.col("high"), F.col("low"), (F.col("close") + 1).alias("close"), F.col("volume"))).alias("candles")))
    quote = F.struct(*[F.array(F.lit(0.0), F.when(F.lit(f != "high") | (F.dayofmonth("ts") % 5 != 0), F.col(f)).cast("double")).alias(f) for f in W.FIELDS])
    chart = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.array(quote).alias("quote")).alias("indicators"))).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    body = {
        "primary": F.when(F.col("h") < 8, text).otherwise('{"status": "error", "message": "limit"}'),
        "fallback": F.when(F.col("h") < 16, plain).otherwise('{"candles": []}'),
        "emergency": chart,
    }
    return W.fetched({p: b.select("asset", "ts", c.alias("body")) for p, c in body.items()})


@query
def detect_asset(spark, sf):
    return headlines(spark, sf).select("doc_id", X.asset_of(F.col("headline")).alias("asset_id"))


@query
def relevance_score(spark, sf):
    return headlines(spark, sf).select("doc_id", X.relevance(F.col("headline")).alias("relevance"))


@query
def event_impact(spark, sf):
    h = headlines(spark, sf)
    return h.select("doc_id", X.impact(F.col("headline")).alias("impact"), X.impact(F.col("headline"), "news").alias("news_impact"), X.is_rate_decision(F.col("headline")).alias("is_rate"))


@query
def sentiment_bias(spark, sf):
    p, n = X.bias_hits(F.col("headline"))
    g = headlines(spark, sf).groupBy((F.col("doc_id") % 10).alias("batch")).agg(F.sum(p).alias("p"), F.sum(n).alias("n"))
    return g.select("batch", r6(F.when(F.col("p") + F.col("n") == 0, 0.0).otherwise((F.col("p") - F.col("n")) / F.greatest(F.col("p") + F.col("n"), F.lit(1)))).alias("bias"))


@query
def csv_round_trip(spark, sf):
    """Bars written as lines and parsed again."""
    lines = bars(spark, sf).select(bar_line(F.col("ts"), "open", "high", "low", "close", "volume").alias("value"))
    return bar_lines(lines).where("error is null").select(parse_stamp(F.col("ts_text")).cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "volume")


@query
def json_vector_parse(spark, sf):
    """Vectors as text: arrays of numbers, one with a null, nothing, and no array at all."""
    e = read(spark, sf, "events")
    i = F.col("event_id") % 4
    text = F.when(i == 0, F.concat(F.lit("["), F.col("event_id"), F.lit(", 0.5, -1e-1]"))).when(i == 1, "oops").when(i == 2, F.lit("[]"))
    v = D.lenient_vector(text)
    return e.select("event_id", F.size(v).alias("n"), F.get(v, F.lit(0)).alias("first"), F.get(v, F.lit(2)).alias("third"))


@query
def cache_ttl(spark, sf):
    return read(spark, sf, "events").select("event_id", C.seconds_to_next(F.col("ts")).cast("long").alias("ttl"), (C.seconds_to_next(F.col("ts")) >= 60).alias("cached"))


@query
def rate_window(spark, sf):
    """Events of a user in the hour up to each event, and whether they exceed five."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(s).rangeBetween(-3600, 0)
    n = F.count(F.lit(1)).over(w)
    return read(spark, sf, "events").select("event_id", n.alias("n"), (n > 5).alias("limited"))


@query
def time_ago(spark, sf):
    m = F.floor((F.lit(1706745600) - F.unix_seconds(F.col("ts").cast("timestamp"))) / 60)
    return read(spark, sf, "events").select("event_id", X.time_ago(m).alias("ago"))


@query
def sparkline(spark, sf):
    """The last 24 closes of each asset, in time order."""
    last = J.top_per_key(bars(spark, sf).select("asset", "ts", "close"), ["asset"], [F.col("ts").desc()], 24)
    g = last.groupBy("asset").agg(F.array_sort(F.collect_list(F.struct("ts", "close"))).alias("s"))
    return g.select("asset", F.size("s").alias("n"), F.array_join(F.transform("s", lambda x: F.format_string("%.2f", x["close"])), ",").alias("closes"))


@query
def topology_levels(spark, sf):
    t = T.topology(bars(spark, sf))
    return t.select("asset", "ts", F.inline("levels"))


@query
def level_strengths(spark, sf):
    """The five greatest strengths of each bar's levels."""
    t = T.topology(bars(spark, sf))
    top = F.slice(F.sort_array(F.transform("levels", lambda x: x["strength"]), asc=False), 1, 5)
    return t.select("asset", "ts", F.array_join(F.transform(top, lambda x: F.format_string("%.6f", x)), ",").alias("strengths"))


@query
def topology_vector(spark, sf):
    t = T.topology(bars(spark, sf), include_current=False)
    return t.select("asset", "ts", *[F.col("vector")[i].alias(f"t{i}") for i in range(40)])


def _ml(spark: SparkSession, sf: str) -> tuple[DataFrame, Forest]:
    """Labelled states by part, and the model learned from the first part: stored in the shared folder, trained once."""
    df = P.ml_vector(P.extended(O.forward(states(spark, sf), digits=True))).withColumn("target", L.label(F.col("net_return_pips")))
    df = L.staged(df, "asset", "ts")
    path = f"{shared_dir(spark)}/tidemark/models/{sf.strip('/').replace('/', '-')}"
    return df, L.kept(path, spark, lambda: L.trained(df.where("part = 'train'"), "ml_features", "target", "fingerprint_id"))


def _ml_predictions(spark: SparkSession, sf: str) -> DataFrame:
    df, model = _ml(spark, sf)
    return L.predicted(df, model, "ml_features").select("fingerprint_id", "part", "target", "ml_up", "ml_down", "ml_flat")


@query
def classifier_train(spark, sf):
    """Scores on the newest fifth of each asset's rows."""
    return L.metrics(_ml_predictions(spark, sf).where("part = 'test'"), "target")


@query
def isotonic_calibrate(spark, sf):
    """Calibrated on rows that the classifier has not seen, between its training rows and the newest fifth, which is told."""
    p = _ml_predictions(spark, sf)
    return L.calibrated(p.where("part = 'test'"), L.calibrators(p.where("part = 'calibrate'"), "target")).select("fingerprint_id", *[r6(F.col(f"cal_{n}")).alias(f"cal_{n}") for n in L.CLASSES])


@query
def ensemble_model(spark, sf):
    """Every state's forecast from its most similar earlier states, blended with the stored model's probabilities."""
    f = flagship(spark, sf).select("asset", "fingerprint_id", "up", "down", "flat")
    p = _ml_predictions(spark, sf).select("fingerprint_id", "ml_up", "ml_down", "ml_flat")
    return S.ensemble(f.join(p, "fingerprint_id", "left"), "ml_up", "ml_down", "ml_flat").select("asset", "fingerprint_id", "up", "ens_up", "ens_down", "ens_flat")


@query
def shap_approx(spark, sf):
    df, model = _ml(spark, sf)
    return L.occlusion(df.where("part = 'test'").select("fingerprint_id", "ml_features"), model, "ml_features", "fingerprint_id")


@query
def tree_shap(spark, sf):
    """The five greatest exact contributions to the margin of up, of every state."""
    df, model = _ml(spark, sf)
    return L.contributions(df.select("fingerprint_id", "ml_features"), model, "ml_features", "fingerprint_id")


@query
def registry(spark, sf):
    """Markets that are processed, with the bars that they have."""
    n = bars(spark, sf).groupBy(F.col("asset").alias("id")).agg(F.count(F.lit(1)).alias("bars"))
    a = G.processable(G.registry(spark, MARKETS)).join(n, "id", "left")
    return a.select("id", "symbol", "priority", "pip_size", F.array_join(G.currencies(F.upper("symbol")), "/").alias("pair"), F.concat("symbol", F.lit("=X")).alias("chart_symbol"), "bars")


def versions(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as engines, with three versions each."""
    n = read(spark, sf, "nation").select(F.col("n_name").alias("engine"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    return n.select("engine", F.concat(F.lit("1."), F.col("i")).alias("version"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=F.col("i"))).alias("created_at"), (F.col("i") == 3).alias("is_active"))


@query
def version_bump(spark, sf):
    new = read(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("engine"), F.lit("2.0").alias("version"), F.lit("2024-02-01").cast("timestamp_ntz").alias("created_at"))
    return G.bumped(versions(spark, sf), new)


@query
def config_snapshot(spark, sf):
    return G.snapshot(versions(spark, sf)).select(F.explode("versions").alias("engine", "version"))


@query
def integrity_report(spark, sf):
    """Counts of each asset's bars, with those of odd volume for errors."""
    counts = {"bars": "true", "wide": "high - low > 120", "errors": "volume % 10 = 0"}
    r = G.report(bars(spark, sf), ["asset"], counts)
    return r.select("asset", "status", *[F.get_json_object("report", f"$.{c}").cast("long").alias(c) for c in counts])


@query
def cache_write(spark, sf):
    last = bars(spark, sf).select("asset", "ts", "close")
    return G.served(last, last.select("asset").distinct(), "2024-01-30 21:00:00")


@query
def plan_limits(spark, sf):
    """Customers by plan, as of a fixed time."""
    names = F.array(*[F.lit(p) for p in G.PLANS])
    c = read(spark, sf, "customer").select("c_custkey", F.get(names, (F.col("c_custkey") % 4).cast("int")).alias("plan"), F.when(F.col("c_custkey") % 8 == 3, F.lit(99)).alias("override"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 40).cast("int"))).alias("last"))
    now = F.lit("2024-03-15 10:30:00").cast("timestamp_ntz")
    return c.select("c_custkey", "plan", G.limit_of(F.col("plan"), F.col("override")).alias("max_requests"), G.needs_reset(F.col("last"), G.period_of(F.col("plan")), now).alias("reset"), G.retry_after(G.period_of(F.col("plan")), now).alias("retry_after"))


@query
def tier_allowed(spark, sf):
    tiers, paths = F.array(*map(F.lit, G.TIERS)), F.array(*[F.lit(f"{p}/x") for p in G.PATHS], F.lit("/v2"))
    r = read(spark, sf, "customer").select("c_custkey", F.get(tiers, (F.col("c_custkey") % 4).cast("int")).alias("tier"), F.get(paths, (F.col("c_custkey") % 5).cast("int")).alias("path"))
    return G.allowed(r)


@query
def strict_json(spark, sf):
    """Every third document lacks its field, every fifth has one too many."""
    e = read(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.lit("{}")).when(F.col("event_id") % 5 == 0, F.lit('{"k": "x", "z": 1}')).otherwise(F.col("props")).alias("doc"))
    return G.strict(e, "doc", {"k": "number"}).select("event_id", "unknown", "missing", "mistyped")


@query
def macro_snapshot(spark, sf):
    """The last value of each symbol up to a time."""
    e = read(spark, sf, "events").where("ts <= timestamp_ntz'2024-01-20'")
    return e.groupBy("event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
