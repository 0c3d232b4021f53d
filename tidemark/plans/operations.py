"""Queries of what runs around the forecasts, on the same mapping of tables as the catalogue, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import documents as D
from tidemark.functions import text as X
from tidemark.operators import context as K
from tidemark.operators import fingerprint as P
from tidemark.operators import joins as J
from tidemark.operators import operations as Q
from tidemark.operators import outcomes as O
from tidemark.operators import research as R
from tidemark.operators import scoring as S
from tidemark.operators import serving as G
from tidemark.operators import similarity as M
from tidemark.operators.outcomes import r6
from tidemark.operators.tracing import Trace

from . import oracle as A
from .catalog import MARKETS, Query, articles, bars, calendar, dealt, evaluations, labelled, priced_calendar, read, regime_bars, regime_forecasts, rekeyed, shaped, states

QUERIES: dict[str, Query] = {}

CHAIN = [("alpha", 12, 2), ("beta", 6, 1), ("gamma", 4, 1)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


@query
def currency_derivation(spark, sf):
    a = bars(spark, sf).select("asset").distinct().join(F.broadcast(G.registry(spark, MARKETS).select(F.col("id").alias("asset"), "symbol")), "asset")
    text = lambda c: F.array_join(c, ",")
    return a.select("asset", "symbol", text(G.currencies(F.col("symbol"))).alias("codes"), text(G.api_currencies(F.col("symbol"))).alias("api_codes"), F.concat(F.lower("symbol"), F.lit("=x")).alias("chart"), F.regexp_replace("symbol", "^(.{3})(.{3})$", "$1/$2").alias("slashed"))


@query
def asset_events(spark, sf):
    """Events of each asset's currencies around every bar."""
    return K.asset_events(dealt(spark, sf), priced_calendar(spark, sf))


@query
def aggregate_sentiment(spark, sf):
    """Of each day's articles; those of even hint tenths have none."""
    a = articles(spark, sf).withColumn("hint", F.when(F.col("relevance") != 0.3, F.col("hint")))
    return a.groupBy(F.date_trunc("day", "published_at").alias("day")).agg(r6(Q.mean_hint(F.col("hint"))).alias("sentiment"))


@query
def direction_accuracy_pct(spark, sf):
    """Forecasts of each asset against what its following bars did from open to close."""
    f = regime_forecasts(spark, sf).withColumn("direction", R.predicted("up", "down", "flat"))
    nxt = J.asof_next(bars(spark, sf).select("asset", "ts", "open", "close", "pip"), "asset", "ts", ["open", "close"]).where("next_open is not null")
    actual = nxt.withColumn("direction", Q.price_direction((F.col("next_close") - F.col("next_open")) / F.col("pip")))
    return Q.direction_accuracy(f, actual, "asset", "ts")


@query
def daily_quota(spark, sf):
    """Events as requests of users, three a day."""
    return Q.daily_quota(read(spark, sf, "events").select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 3).select("event_id", "used", "remaining", "allowed")


@query
def rate_limited_fallback(spark, sf):
    """Events as requests of five services to three providers, of which some fail."""
    works = F.array_compact(F.array(*[F.when(F.col("event_id") % (5 + i) != 0, F.lit(n)) for i, (n, *_) in enumerate(CHAIN)]))
    return Q.with_fallback(read(spark, sf, "events").withColumn("works", works), CHAIN, "event_type", "ts", "event_id", "works").drop("event_type")


@query
def similarity_archive(spark, sf):
    """Three matches a state, then five by a second run: only the new ones are taken in."""
    m = M.engine_search(states(spark, sf), 5).select("fingerprint_id", "match_id", "rank", "score", F.to_json(F.struct("s1", "s2", "s3", "s4", "s5")).alias("layers"))
    first, second = (d.withColumn("batch_id", F.lit(n)) for d, n in ((m.where("rank <= 3"), "run-1"), (m, "run-2")))
    return Q.archived(first, second).select("fingerprint_id", "match_id", "rank", "score", "batch_id", F.get_json_object("layers", "$.s3").cast("double").alias("s3"))


@query
def diagnostics_document(spark, sf):
    """Of each asset's newest bar."""
    s = regime_bars(spark, sf)
    newest = J.top_per_key(s, ["asset"], [F.col("ts").desc()], 1)
    d = Q.document(Q.bonus_counts(s, newest).withColumn("forecast", F.lit(None).cast("string")), "asset", ["candidates", "session_bonus_count", "regime_bonus_count", "forecast"])
    return d.select("asset", F.json_object_keys("diagnostics").cast("string").alias("parts"), *[F.get_json_object("diagnostics", f"$.{c}").cast("long").alias(c) for c in ("candidates", "session_bonus_count", "regime_bonus_count")])


@query
def canonical_json(spark, sf):
    e = read(spark, sf, "events")
    doc = F.concat(F.lit('{ "z": -0.0, "k": '), F.col("event_id"), F.lit(', "a": [true, null, {"y": "t u", "x": -0}],\n "Z": {} }'))
    bad = F.when(F.col("event_id") % 10 == 0, F.lit("{oops")).when(F.col("event_id") % 10 != 1, doc)
    return e.select("event_id", D.canonical(bad).alias("canonical"), F.sha2(D.canonical(bad), 256).alias("trace"))


@query
def half_even(spark, sf):
    """Quarters to one digit: halves go both ways."""
    x = (F.col("event_id") % 1000 - 500) / 4
    return read(spark, sf, "events").select("event_id", D.half_even(x, 1).alias("even"), r6(x, 1).alias("up"))


@query
def filtered_calibration(spark, sf):
    """The report of one regime over a fortnight, and its overall score."""
    e = Q.filtered(evaluations(spark, sf), "2024-01-05", "2024-01-19", asset=None, vol_regime="HIGH")
    return R.overall(R.calibration(e))


@query
def input_violations(spark, sf):
    f = regime_forecasts(spark, sf).withColumns({"up": F.when(F.hour("ts") == 4, F.col("up") + 1).otherwise(F.col("up")), "down": F.when(F.hour("ts") != 8, F.col("down")), "flat": F.when(F.hour("ts") == 12, F.lit(float("nan"))).otherwise(F.col("flat")), "sample_size": F.when(F.hour("ts") == 16, 0).otherwise(F.col("sample_size"))})
    return f.select("fingerprint_id", Q.violations(["up", "down", "flat"], ["sample_size"]).alias("violations"))


@query
def news_capped(spark, sf):
    """The fifty newest documents of each source."""
    return Q.capped(read(spark, sf, "documents").select("doc_id", "source"), "source", [F.col("doc_id").desc()], 50)


@query
def calendar_summary(spark, sf):
    """Of bars, without data on Sundays."""
    b = bars(spark, sf).select("ts").distinct()
    r = K.news_risk(b, calendar(spark, sf).select("name", "event_date", "impact").distinct()).where(F.dayofweek("ts") != 1)
    d = b.join(r, "ts", "left")
    return d.select("ts", *[c.alias(n) for n, c in Q.calendar_summary(F.col("at_risk"), F.col("hours_to_event")).items()])


@query
def extended_flags(spark, sf):
    """Two of three features switched on."""
    df = P.volatility_score(P.atr_percentile(P.rolling_trend(bars(spark, sf))))
    names = ("rolling_trend", "atr_percentile", "vol_regime_score")
    return Q.enabled(df, dict(zip(names, (True, False, True), strict=True)), {n: [n] for n in names}).select("asset", "ts", *names)


@query
def drift_alerts(spark, sf):
    """Accuracy by asset and session; a key counts as drifted from half a deviation on."""
    e = evaluations(spark, sf).withColumn("key", F.concat_ws("/", "asset", "session"))
    return Q.alerts(R.drift(e, "key", ["ts"], sigmas=0.5), "key")


@query
def running_guard(spark, sf):
    """Orders as batches of customers; open ones are running."""
    return Q.running_guard(read(spark, sf, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", "O")


@query
def field_whitelist(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"))
    tier = F.get(F.array(*map(F.lit, G.TIERS)), (F.col("c_custkey") % 5).cast("int"))
    return Q.picked(c, tier, {"retail": ["c_custkey"], "developer": ["c_custkey", "c_name"], "research": ["c_nationkey", "c_name"], "internal": None}, "c_custkey")


@query
def message_redaction(spark, sf):
    """Messages with a stack line, a path, a statement, a private address, or nothing to hide."""
    parts = ["fetch failed\n    at load (/srv/app/main.js:10:5)", "cannot open /var/lib/app/data.db today", "error in SELECT a, b FROM users WHERE id = 1; retry", "connect to 10.1.2.3:5432 and 8.8.8.8 refused", "plain message 1.2"]
    text = F.get(F.array(*map(F.lit, parts)), (F.col("event_id") % 5).cast("int"))
    return read(spark, sf, "events").select("event_id", X.redacted(text).alias("message"))


@query
def sentiment_labels(spark, sf):
    a = articles(spark, sf).select("published_at", "hint", X.sentiment_label(F.col("hint")).alias("label"))
    return a.select("published_at", "hint", "label", X.hint_of(F.col("label")).alias("score")).distinct()


@query
def states_without_outcome(spark, sf):
    """States that nothing followed (anti join), and of the others those with a match (semi join)."""
    s, out = regime_bars(spark, sf).select("asset", "ts", "fingerprint_id"), labelled(spark, sf).select("fingerprint_id")
    m = M.engine_search(states(spark, sf), 1).select("fingerprint_id")
    without = s.join(out, "fingerprint_id", "left_anti").withColumn("kind", F.lit("no outcome"))
    return without.union(s.join(out, "fingerprint_id", "left_semi").join(m, "fingerprint_id", "left_semi").withColumn("kind", F.lit("matched")))


@query
def unknown_or_null(spark, sf):
    """Orders of a status, or without a known priority."""
    o = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority"))
    return o.where((F.col("o_orderstatus") == "F") | F.col("priority").isNull()).select("o_orderkey")


@query
def upsert_versions(spark, sf):
    """An outcome store: known rows stay, missing ones come in, by the key of asset and time."""
    o = labelled(spark, sf).select("asset", "ts", "net_return_pips")
    return J.insert_new(o.where(F.hour("ts") < 12), o.withColumn("net_return_pips", F.lit(0.0)), ["asset", "ts"])


@query
def forecast_pipeline(spark, sf):
    """From state to tradeability for every bar: blended search, outcomes weighted by regime with the bar's own flat threshold, forecast, confidence from evaluated buckets and regimes, and the factors of the session and the news."""
    return pipeline(spark, sf).select("asset", "fingerprint_id", "sample_size", "up", "down", "flat", "expected_move_pips", "direction", "confidence_v2", "tradeability_score", "label")


@query
def forecast_trace(spark, sf):
    """Rows and hashes of the stages that lead to tradeability."""
    trace = Trace(spark)
    pipeline(spark, sf, trace=trace)
    return trace.table().select("position", "stage", "rows", "digest")


def pipeline(spark: SparkSession, sf: str, k: int = 20, trace: Trace | None = None) -> DataFrame:
    """The forecasts with all that they are made of. With a trace, each stage is written and recorded."""
    stage = trace.stage if trace else lambda name, make: make()
    m = stage("similarity", lambda: M.batch_search(shaped(spark, sf), k, M.TOPOLOGY_WEIGHT))
    out = labelled(spark, sf).select(F.col("fingerprint_id").alias("match_id"), "net_return_pips")
    own = O.dynamic_flat(regime_bars(spark, sf)).select("fingerprint_id", "ts", "trend_regime", r6(F.col("flat_threshold")).alias("flat_threshold"))
    copies = O.regime_copies(F.col("vol_regime"), F.col("session"), F.col("match_vol_regime"), F.col("match_session"))
    known = stage("outcomes", lambda: m.join(out, "match_id").join(own, "fingerprint_id").withColumn("copies", copies))
    d = stage("forecast", lambda: S.forecast(O.distribution(known, ["asset", "fingerprint_id", "ts", "vol_regime", "trend_regime", "session"], "net_return_pips", flat=F.col("flat_threshold"), weight="copies")))
    n = known.groupBy("fingerprint_id").agg(F.count(F.lit(1)).alias("matches"))
    e = stage("evaluations", lambda: evaluations(spark, sf))
    rate = lambda key, least: e.groupBy(key).agg(r6(F.avg("direction_accuracy")).alias(f"{key}_rate"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).drop("_n")
    d = d.withColumns({"bucket": S.bucket(F.col("max_probability")), "regime": F.concat_ws("_", "vol_regime", "trend_regime")})
    d = d.join(rate("bucket", 1), "bucket", "left").join(rate("regime", 30), "regime", "left").join(n, "fingerprint_id").withColumn("sample_size", F.col("matches"))
    d = S.confidence_v2(d, F.col("bucket_rate"), F.col("regime_rate"), F.col("sample_size") / 30)
    risk = stage("news_risk", lambda: K.news_risk(dealt(spark, sf), priced_calendar(spark, sf)).select("asset", "ts", "at_risk"))
    d = d.join(risk, ["asset", "ts"]).withColumns({"spread": S.session_default(F.col("session"), 0), "liquidity": S.session_default(F.col("session"), 1)})
    return stage("tradeability", lambda: S.tradeability(d, "confidence_v2", "spread", "session", "liquidity", "at_risk"))


_SYMBOL, _CODES, _CUR = A.SYMBOL, A.CODES, A.PCAL
_NOT = "' '"

ORACLE_SQL: dict[str, str] = {
    "currency_derivation": f"with a as (select distinct event_type as asset from events), s as (select asset, {_SYMBOL} as symbol from a) select asset, symbol, case when length(symbol) >= 6 then symbol[1:3] || ',' || symbol[4:6] else symbol end as codes, case when regexp_matches(symbol, '^[A-Z]{{6}}$') then symbol[1:3] || ',' || symbol[4:6] else '' end as api_codes, lower(symbol) || '=x' as chart, case when length(symbol) = 6 then symbol[1:3] || '/' || symbol[4:6] else symbol end as slashed from s",
    "asset_events": f"with {A.BARS}, {A.CAL}, {_CUR}, b as (select asset, ts, {_CODES} as codes from c), n as (select asset, ts, count(*) as events from b join pcal on event_date between ts - interval '72 hours' and ts + interval '24 hours' and (currency is null or list_contains(codes, currency)) group by all), s as (select asset, ts, min({{'d': event_date, 'n': name}}) as e from b join pcal on event_date > ts and event_date <= ts + interval '8 hours' and impact = 'high' and (currency is null or list_contains(codes, currency)) group by all) select asset, ts, coalesce(events, 0) as events, e.n as next_event, (epoch(e.d) - epoch(ts)) / 3600.0::double as hours_to_event from b left join n using (asset, ts) left join s using (asset, ts)",
    "aggregate_sentiment": f"with {A.NEWS} select date_trunc('day', published_at)::timestamp as day, {A.r6('coalesce(avg(case when relevance != 0.3::double and hint != 0 then hint end), 0)')} as sentiment from news group by 1",
    "direction_accuracy_pct": f"with {A.RF}, f as (select asset, case when up >= down and up >= flat then 'UP' when down >= flat then 'DOWN' else 'FLAT' end as d, row_number() over (partition by asset order by ts) as n from rf), m as (select asset, ts, lead((close - open) / pip) over (partition by asset order by ts) as p from c), a as (select asset, case when p > 0.5::double then 'UP' when p < -0.5::double then 'DOWN' else 'FLAT' end as d, row_number() over (partition by asset order by ts) as n from m where p is not null) select asset, count(*) as evaluated, count_if(f.d = a.d)::bigint as correct, {A.r6('100 * count_if(f.d = a.d) / count(*)', 2)} as accuracy from f join a using (asset, n) group by asset",
    "daily_quota": "with q as (select event_id, row_number() over (partition by user_id, date_trunc('day', ts) order by ts, event_id)::int as used from events) select event_id, used, greatest(0, 3 - used)::int as remaining, used <= 3 as allowed from q",
    "similarity_archive": f"with {A.ENGINE}, {A.ranked('sc', 5)} select fingerprint_id, match_id, rank, score, case when rank <= 3 then 'run-1' else 'run-2' end as batch_id, {A.r6('s3')} as s3 from rk",
    "diagnostics_document": f"with {A.REG}, l as (select asset as a, ts as t, session as s, vol_regime as v from g qualify row_number() over (partition by asset order by ts desc) = 1) select asset, '[candidates, session_bonus_count, regime_bonus_count, forecast]' as parts, count(*) as candidates, count_if(session = s)::bigint as session_bonus_count, count_if(vol_regime = v)::bigint as regime_bonus_count from g join l on asset = a and ts < t group by asset",
    "canonical_json": "with d as (select event_id, case when event_id % 10 > 1 then '{\"Z\":{},\"a\":[true,null,{\"x\":0,\"y\":\"t u\"}],\"k\":' || event_id || ',\"z\":0}' end as canonical from events) select *, sha256(canonical) as trace from d",
    "half_even": f"with e as (select event_id, (event_id % 1000 - 500) as q from events) select event_id, (case when abs(q * 10) % 4 = 2 then 2 * round(q * 10 / 8.0) else round(q * 10 / 4.0) end / 10)::double as even, {A.r6('q / 4', 1)} as up from e",
    "filtered_calibration": f"with {A.EV}, k as (select bucket, count(*) as n, avg(direction_accuracy) as rate from ev where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-19' and vol_regime = 'HIGH' group by bucket), a as (select printf('%.1f-%.1f', i / 10, (i + 1) / 10) as bucket, i / 10 + 0.05::double as mid from range(10) t(i)), r as (select {A.r6('abs(mid - rate)')} as deviation, coalesce(n, 0) >= 10 as enough from a left join k using (bucket)) select {A.r6('avg(case when enough then deviation end)')} as overall, count_if(enough)::bigint as buckets from r",
    "input_violations": f"with {A.RF} select fingerprint_id, array_to_string(list_filter([case when hour(ts) = 4 and up > 0 then 'up' end, case when hour(ts) = 8 then 'down' end, case when hour(ts) = 12 then 'flat' end, case when hour(ts) = 16 then 'sample_size' end], lambda x: x is not null), ',') as violations from rf",
    "news_capped": "select doc_id, source from documents qualify row_number() over (partition by source order by doc_id desc) <= 50",
    "calendar_summary": f"with {A.BARS}, {A.TIMES}, {A.CAL}, s as (select t.ts, min((epoch(event_date) - epoch(t.ts)) / 3600.0::double) as h from times t join cal on impact = 'high' and event_date > t.ts and event_date <= t.ts + interval '8 hours' group by t.ts) select ts, h is not null and dayofweek(ts) != 0 as high_impact_event, case when dayofweek(ts) = 0 then 24e0 else {A.r6('greatest(0e0, coalesce(h, 24e0))')} end as hours_to_next_event from times left join s using (ts)",
    "extended_flags": f"with {A.EXT} select asset, ts, rolling_trend, null::double as atr_percentile, vol_regime_score from e",
    "running_guard": "select o_custkey, min(case when o_orderstatus = 'O' then o_orderkey end) as running_batch, count_if(o_orderstatus = 'O') > 0 as is_overlapping from orders group by o_custkey",
    "field_whitelist": "select c_custkey, ['retail', 'developer', 'research', 'internal', null][(c_custkey % 5 + 1)::int] as tier, case c_custkey % 5 when 0 then '{\"c_custkey\":' || c_custkey || '}' when 1 then '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\"}' when 2 then '{\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' when 3 then '{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"c_nationkey\":' || c_nationkey || '}' else '{}' end as fields from customer",
    "message_redaction": "select event_id, ['fetch failed' || chr(10) || '[redacted]', 'cannot open [redacted] today', 'error in [redacted] retry', 'connect to [redacted] and 8.8.8.8 refused', 'plain message 1.2'][(event_id % 5 + 1)::int] as message from events",
    "sentiment_labels": f"with {A.NEWS}, l as (select distinct published_at, hint, case when hint > 0.2::double then 'positive' when hint < -0.2::double then 'negative' else 'neutral' end as label from news) select *, case label when 'positive' then 0.7::double when 'negative' then -0.7::double else 0e0 end as score from l",
    "states_without_outcome": f"with {A.ENGINE}, nx as (select asset, ts, fingerprint_id, lead(ts) over (partition by asset order by ts) as n from g) select asset, ts, fingerprint_id, 'no outcome' as kind from nx where n is null union all select asset, ts, fingerprint_id, 'matched' from nx where n is not null and fingerprint_id in (select fingerprint_id from sc)",
    "unknown_or_null": "select o_orderkey from orders where o_orderstatus = 'F' or o_orderkey % 3 = 0 or o_orderpriority is null",
    "upsert_versions": f"with {A.FWD} select asset, ts, case when hour(ts) < 12 then net_return_pips else 0 end as net_return_pips from o",
    "drift_alerts": f"with {A.EV}, e2 as (select *, asset || '/' || session as key from ev), r as (select *, row_number() over (partition by key order by ts desc) as rn from e2), n as (select * from r where rn <= 100), w as (select key, rn, avg(direction_accuracy) over w as acc, count(*) over w as k from n window w as (partition by key order by rn desc rows between 29 preceding and current row)), gg as (select key, count(*) as n, max(case when rn = 1 and k = 30 then acc end) as rolling, avg(case when k = 30 then acc end) as mean, avg(case when k = 30 then acc * acc end) as sq from w group by key), h as (select *, {A.r6('sqrt(greatest(sq - mean * mean, 0))')} as sd from gg where n >= 30) select key, {A.r6('mean')} as baseline, {A.r6('rolling')} as current, {A.r6('(mean - rolling) / sd', 2)} as sigmas, 'retrain' as action, 'open' as status from h where sd > 0 and rolling < mean - 0.5::double * sd",
    "forecast_pipeline": f"""with recursive {A.BATCH}, {A.ranked('b4', 20)}, {A.EVALS},
fl as (select fingerprint_id, ts, trend_regime, {A.r6('case when count(*) over w >= 5 then greatest(0.25 * avg((high - low) / pip) over w, 1e0) else 2e0 end')} as flat from g window w as (partition by asset order by ts rows between 13 preceding and current row)),
kn as (select rk.asset, rk.fingerprint_id, fl.ts, rk.vol_regime, fl.trend_regime, rk.session, o.net_return_pips, flat, case when match_vol_regime = rk.vol_regime and match_session = rk.session then 15 when match_vol_regime = rk.vol_regime then 12 else 7 end as copies from rk join o on o.fingerprint_id = rk.match_id join fl on fl.fingerprint_id = rk.fingerprint_id),
{A.distribution('kn', 'asset, fingerprint_id, ts, vol_regime, trend_regime, session', 'copies', 'flat').replace('dist', 'pdist')}, {A.forecast('pdist', 'pf')},
n as (select fingerprint_id, count(*) as matches from kn group by 1), br as (select bucket, {A.r6('avg(direction_accuracy)')} as b from ev group by 1), rr as (select regime, {A.r6('avg(direction_accuracy)')} as r from ev group by 1 having count(*) >= 30),
{_CUR}, b0 as (select asset, ts, {_CODES} as codes from c), ns as (select distinct asset, ts from b0 join pcal on impact = 'high' and event_date > ts and event_date <= ts + interval '8 hours' and list_contains(codes, currency)),
f as (select pf.*, matches, {A.r6('greatest(0, least(1, coalesce(b, 5e-1) * coalesce(r, 1e0) * case when matches >= 30 then 1e0 else matches / 30 end))')} as conf, ns.ts is not null as news from pf join n using (fingerprint_id) left join br on br.bucket = {A.BUCKET.replace('confidence', 'max_probability')} left join rr on rr.regime = vol_regime || '_' || trend_regime left join ns on ns.ts = pf.ts and ns.asset = pf.asset),
t as (select *, {A.r6("conf * case session when 'LONDON' then 1e0 when 'NY' then 8e-1 else 5e-1 end * case when news then 0e0 else 1e0 end", 2)} as score from f)
select asset, fingerprint_id, matches as sample_size, up, down, flat, expected_move_pips, direction, conf as confidence_v2, score as tradeability_score, case when score > 0.75 then 'GO' when score >= 0.45 then 'CONDITIONAL' else 'NO_GO' end as label from t""",
}
