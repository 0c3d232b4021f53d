"""DuckDB SQL for the catalogue's queries, from the same tables. Formulas, rules, weights and word lists are written out here, apart from the library's own."""

from __future__ import annotations


def r6(x: str, d: int = 6) -> str:
    """Half up towards positive infinity."""
    return f"(floor(({x}) * 1e{d} + 0.5) / 1e{d})"


def unit(x: str) -> str:
    return f"greatest(0e0, least(1e0, {x}))"


def part(x: str) -> str:
    return unit(r6(x))


def logistic(x: str) -> str:
    return f"(1e0 / (1e0 + exp(-({x}))))"


def cols(name: str, parts: list[str]) -> str:
    return ", ".join(f"{x} as {name}_{i}" for i, x in enumerate(parts))


def norm(x: str, low: str, width: str) -> str:
    return f"(case when {x} is null then 5e-1 else {unit(f'({x} - {low}) / {width}')} end)"


# Components of the layers over the columns of geo: net and range in rounded pips, and the bar's shape.
_TOP_WICK, _LOW_WICK, _BODY = "((high - top) / safe)", "((bottom - low) / safe)", "((top - bottom) / safe)"
_PLACE = "(((top + bottom) / 2e0 - low) / safe)"
L1 = [
    _PLACE, _BODY, _TOP_WICK, _LOW_WICK, "heading", "drive", _BODY, f"greatest({_TOP_WICK}, {_LOW_WICK})", "(close - low) / safe", "(open - low) / safe",
    f"1e0 - abs({_PLACE} - 5e-1) * 2e0", logistic("net_pips / 50e0"), "range_pips / 100e0", "(close - (high + low) / 2e0) / safe * 5e-1 + 5e-1", "heading * drive",
    f"case when top = bottom then 5e-1 else (high - top + bottom - low) / (top - bottom) / 2e0 end",
]
L2 = [
    "range_pips / 100e0", _BODY, _TOP_WICK, _LOW_WICK, "least(1e0, range_pips / 50e0)", "1e0 - least(1e0, range_pips / 50e0)", "drive", "(top - bottom) / pip / 50e0", "range_pips / 30e0",
    "case when range_pips < 30 then 0e0 when range_pips > 70 then 1e0 else (range_pips - 30e0) / 40e0 end",
    "case when high - top + bottom - low = 0 then 5e-1 else 1e0 - abs((high - top) - (bottom - low)) / (high - top + bottom - low) end", f"1e0 - {_BODY}",
]
L3 = [r6(unit(" + ".join(f"{w} * (1e0 - abs(low + {i}e0 / 19e0 * (high - low) - {at}) / safe)" for w, at in (("3e-1", "open"), ("4e-1", "close"), ("3e-1", "((high + low) / 2e0)")))) ) for i in range(20)]
_DXY, _VIX, _SPX, _BOND, _GOLD = norm("dxy", "90e0", "20e0"), norm("vix", "10e0", "30e0"), norm("spx", "3000e0", "2500e0"), norm("us10y", "1e0", "4e0"), norm("gold", "1500e0", "1000e0")
L4 = [_DXY, _VIX, _SPX, _BOND, _GOLD, f"1e0 - {_DXY}", f"({_SPX} + (1e0 - {_VIX})) / 2e0", f"abs({_BOND} - {_GOLD})"]
L5 = [_VIX, f"({_VIX} + {_GOLD}) / 2e0", _DXY, _SPX, _BOND, f"({_VIX} + ({_VIX} + {_GOLD}) / 2e0 + {_DXY} + {_SPX} + {_BOND}) / 5e0"]
MACRO_STATE = f"({_DXY} + {_VIX} + {_SPX} + {_BOND} + {_GOLD}) / 5e0"
RISK_OFF = f"({_VIX} + {_GOLD} + {_BOND} + (1e0 - {_SPX})) / 4e0"

#: Points and conditions of the nine regimes over strength, impulse, expansion and the like; neutral extended features are null.
RULES = {
    "accumulation": "0.4 * (squeeze > 0.5), 0.4 * (at_close > 0.55), 0.2 * (strength < 0.4)",
    "breakout": "0.35 * (impulse > 0.6), 0.35 * (pace > 0.6), 0.3 * (growth > 0.55)",
    "contraction": "0.5 * (squeeze > 0.65), 0.3 * (atr < 0.35), 0.2 * (pct < 0.3)",
    "distribution": "0.4 * (squeeze > 0.5), 0.4 * (at_close < 0.45), 0.2 * (strength < 0.4)",
    "expansion": "0.5 * (growth > 0.65), 0.3 * (atr > 0.6), 0.2 * (pct > 0.7)",
    "macro_driven": "0.6 * (abs(macro - 0.5) > 0.3), 0.3 * (abs(mood - 0.5) > 0.3), 0.1 * (strength < 0.4)",
    "ranging": "0.5 * (strength < 0.35), 0.3 * (growth < 0.4), 0.2 * (abs(roll - 0.5) < 0.15)",
    "reversal": "0.5 * (rejection > 0.5), 0.3 * (abs(heading - at_close) > 0.3), 0.2 * (abs(roll - heading) > 0.3)",
    "trend": "0.5 * (strength > 0.55), 0.3 * (impulse > 0.5), 0.2 * (abs(roll - 0.5) > 0.2)",
}

#: Weights of the layers by volatility, and word lists.
WEIGHTS = {"LOW": (0.40, 0.15, 0.30, 0.10, 0.05), "NORMAL": (0.20, 0.15, 0.15, 0.30, 0.20), "HIGH": (0.25, 0.25, 0.15, 0.20, 0.15)}
LAYERS = ("structure", "volatility", "liquidity", "macro", "sentiment")
CURRENCIES = ("USD", "EUR", "GBP", "JPY", "AUD", "NZD", "CAD", "CHF")
PAIRS = ("EURUSD", "GBPUSD", "USDJPY", "AUDUSD", "NZDUSD", "USDCAD", "USDCHF", "EURGBP", "EURJPY", "GBPJPY")
EURO_WORDS = ("ecb", "eurozone", "euro area", "european central bank", "lagarde", "euro")
DOLLAR_WORDS = ("fed", "federal reserve", "powell", "fomc", "us economy", "dollar", "treasury")
STRONG_WORDS = ("ecb", "fed", "eurozone", "fomc", "nonfarm", "nfp", "cpi", "gdp", "rate decision", "inflation")
POSITIVE = ("bullish", "rally", "growth", "strong", "gain", "surge", "optimism", "recovery")
NEGATIVE = ("bearish", "crash", "recession", "weak", "loss", "plunge", "fear", "risk-off", "decline")
IMPACT = {
    "calendar": (("nfp", "non-farm", "cpi", "gdp", "rate decision"), ("pmi", "retail sales")),
    "news": (("nonfarm", "nfp", "cpi", "gdp", "interest rate", "fomc", "fed funds", "ecb rate", "employment change"), ("pmi", "retail sales", "trade balance", "unemployment", "consumer confidence", "housing")),
}


# Common table expressions, each building on those before it.
BARS = """candles as (
  select event_type as asset, time_bucket(interval '4 hours', ts) as ts, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, count(*) as volume
  from events group by 1, 2),
c as (select *, 2.0::double as pip from candles)"""
REG = f"""{BARS},
pips as (select *, {r6("(close - open) / pip", 2)} as net_pips, {r6("(high - low) / pip", 2)} as range_pips from c),
g as (select *, case when range_pips < 30 then 'LOW' when range_pips <= 70 then 'NORMAL' else 'HIGH' end as vol_regime,
  case when range_pips > 0 and abs(net_pips) / range_pips > 0.3::double then case when net_pips > 0 then 'BULLISH' else 'BEARISH' end else 'RANGING' end as trend_regime,
  case hour(ts) // 4 when 1 then 'LONDON' when 2 then 'LONDON' when 3 then 'NY' when 4 then 'NY' else 'ASIA' end as session,
  sha256(asset || ':' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000Z') as fingerprint_id from pips),
geo as (select *, case when high = low then 1e0 else high - low end as safe, greatest(open, close) as top, least(open, close) as bottom, case when range_pips = 0 then 0e0 else least(1e0, abs(net_pips) / range_pips) end as drive, case when close > open then 1e0 when close < open then 0e0 else 5e-1 end as heading from g)"""
FWD = f"""{REG},
nx as (select *, lead(ts) over w as next_ts, lead(high) over w as nh, lead(low) over w as nl, lead(close) over w as nc from g window w as (partition by asset order by ts)),
o as (select *, {r6("(nc - close) / pip", 2)} as net_return_pips, {r6("(nh - close) / pip", 2)} as mfe_pips, {r6("(close - nl) / pip", 2)} as mae_pips, {r6("((nh - nl) / pip) / 10000e0", 4)} as realised_volatility from nx where next_ts is not null)"""


def contains(text: str, terms) -> str:
    return "(" + " or ".join(f"contains({text}, '{t}')" for t in terms) + ")"


def count_of(text: str, terms) -> str:
    return "(" + " + ".join(f"contains({text}, '{t}')::int" for t in terms) + ")"


def impact(name: str, terms: str = "calendar") -> str:
    high, medium = IMPACT[terms]
    return f"case when {contains(f'lower({name})', high)} then 'high' when {contains(f'lower({name})', medium)} then 'medium' else 'low' end"


_NAMES = "['CPI report', 'rate decision', 'PMI survey', 'GDP release', 'retail sales', 'speech']"
CAL = f"""cal0 as (select o_orderkey as k, {_NAMES}[((o_orderkey // 61) % 6 + 1)::int] as name, timestamp '2024-01-01' + to_hours(((o_orderkey * 7) % 43920)::int) + interval '30 minutes' as event_date from orders),
cal as (select k, name, event_date, {impact("name")} as impact, {contains("lower(name)", ("rate decision", "interest rate"))} as is_rate, case when k % 7 != 0 then ((k % 50) / 10)::double end as actual, case when k % 11 != 0 then ((k % 40) / 10)::double end as estimate, ((k % 45) / 10)::double as previous from cal0)"""
TIMES = "times as (select distinct ts from candles)"
NEWS = """news as (select timestamp '2024-01-01' + to_hours((doc_id % 720)::int) as published_at, (((doc_id * 37) % 21 - 10) / 10)::double as hint, (((doc_id * 13) % 11) / 10)::double as relevance from documents)"""


_MACRO_PARTS = {"event_proximity_pressure": 0.25, "aggregate_surprise_factor": 0.20, "rate_differential": 0.15, "high_impact_event_count": 0.15, "medium_impact_event_count": 0.05, "event_density": 0.05, "upcoming_event_intensity": 0.15}
_SNAP = {"dxy": "90e0 + x0 / 10e0", "vix": "10e0 + x1 / 5e0", "spx": "3000e0 + x2 * 10e0", "us10y": "1e0 + x3 / 50e0", "gold": "1500e0 + x4 * 4e0"}
_ASSETS = ("click", "view", "purchase", "signup", "error")
_KNOWN = f"case when n = 0 then 5e-1 else {r6('({}) * least(n / 3, 1e0) + 5e-1 * (1 - least(n / 3, 1e0))')} end"
SNAPS = f"""wide as (select ts, {', '.join(f"max(case when asset = '{a}' then close end) as x{i}" for i, a in enumerate(_ASSETS))} from c group by ts),
snaps as (select ts, {', '.join(f'{v} as {k}' for k, v in _SNAP.items())} from wide)"""


def macro_cte(cal: str = "cal") -> str:
    """mac: the macro vector of every time."""
    return f"""mj as (select t.ts, k.*, case impact when 'high' then 3e0 when 'medium' then 2e0 else 1e0 end as w, (epoch(event_date) - epoch(t.ts)) / 3600.0::double as ahead, case when estimate = 0 then actual - estimate else (actual - estimate) / abs(estimate) end as d from times t join {cal} k on event_date between t.ts - interval '72 hours' and t.ts + interval '24 hours'),
ms as (select ts, count(*) as n, min(case when impact = 'high' and ahead > 0 then ahead end) as nxt, sum(case when actual is not null and estimate is not null then (greatest(-1e0, least(1e0, d)) + 1) / 2 * w end) as sw, sum(case when actual is not null and estimate is not null then w end) as w,
  max(case when is_rate and actual is not null then {{'t': event_date, 'd': greatest(-1e0, least(1e0, actual - previous))}} end).d as rate, sum((impact = 'high')::int) as nh, sum((impact = 'medium')::int) as nm, sum(case when ahead > 0 then w else 0 end) as soon from mj group by ts),
mp as (select ts, n, case when nxt is null then 0e0 else greatest(0e0, least(1e0, 1 - nxt / 24)) end as event_proximity_pressure, coalesce(sw / w, 5e-1) as aggregate_surprise_factor, coalesce((rate + 1) / 2, 5e-1) as rate_differential, least(1e0, nh / 5) as high_impact_event_count, least(1e0, nm / 10) as medium_impact_event_count, least(1e0, n / 20) as event_density, least(1e0, soon / 15) as upcoming_event_intensity from times left join ms using (ts)),
mq as (select *, {' + '.join(f'{w}::double * {k}' for k, w in _MACRO_PARTS.items())} as composite_macro_state from mp),
mac as (select ts, coalesce(n, 0) as events, {', '.join(f'case when n is null then 5e-1 else {r6(k)} end as {k}' for k in [*_MACRO_PARTS, 'composite_macro_state'])} from mq)"""


def sentiment_cte(news: str = "news") -> str:
    """sen: the sentiment vector of every bar."""
    return f"""sj as (select t.ts, hint, hint > 0.2::double as up, hint < -0.2::double as down, relevance * pow(5e-1, (epoch(t.ts) - epoch(published_at)) / 3600.0::double / 8e0) as w from times t join {news} k on published_at between t.ts - interval '24 hours' and t.ts),
ss as (select ts, count(*) as n, sum(hint * w) as sw, sum(w) as w, avg(up::int) as bull, avg(down::int) as bear, avg((hint + 1) / 2) as m, avg((hint + 1) / 2 * ((hint + 1) / 2)) as mm from sj group by ts),
sa as (select asset, ts, coalesce(n, 0) as n, case when coalesce(w, 0) = 0 then 5e-1 else (sw / w + 1) / 2 end as agg, bull, bear, greatest(mm - m * m, 0) as var from c left join ss using (ts)),
sb as (select *, (agg - coalesce(lag(agg) over (partition by asset order by ts), 5e-1) + 1) / 2 as mo from sa),
sen as (select asset, ts, n as articles, {_KNOWN.format('agg')} as aggregate_sentiment, {_KNOWN.format('bull')} as bullish_pressure, {_KNOWN.format('bear')} as bearish_pressure, {_KNOWN.format('least(n / 50, 1e0)')} as article_volume, {_KNOWN.format('least(var / 25e-2, 1e0)')} as sentiment_dispersion, {_KNOWN.format('mo')} as momentum from sb)"""


_MOOD_PARTS = ("aggregate_sentiment", "bullish_pressure", "bearish_pressure", "article_volume", "sentiment_dispersion", "momentum")
CONTEXT = f"{TIMES}, {NEWS}, {CAL}, {macro_cte()}, {sentiment_cte()}, {SNAPS}"


def state_cte(snaps: str = "snaps") -> str:
    """v: states with their layers and the sources of the last two."""
    none = lambda n: f"list_resize([0.5::double], {n}, 0.5::double)"
    return f"""v as (select g.*, [{", ".join(map(part, L1))}] as l1, [{", ".join(map(part, L2))}] as l2, [{", ".join(L3)}] as l3,
  case when mac.events > 0 then [{", ".join([*_MACRO_PARTS, "composite_macro_state"])}] when sn.ts is not null then [{", ".join(map(part, L4))}] else {none(8)} end as l4,
  case when sen.articles > 0 then [{", ".join(_MOOD_PARTS)}] when sn.ts is not null then [{", ".join(map(part, L5))}] else {none(6)} end as l5,
  case when mac.events > 0 then 'engine' when sn.ts is not null then 'snapshot' else 'neutral' end as macro_source,
  case when sen.articles > 0 then 'engine' when sn.ts is not null then 'snapshot' else 'neutral' end as sentiment_source,
  {r6(MACRO_STATE)} as macro_state, {r6(RISK_OFF)} as sentiment_score
  from geo g left join mac on g.ts = mac.ts left join sen on g.asset = sen.asset and g.ts = sen.ts left join {snaps} sn on g.ts = sn.ts)"""


TEN = f"{REG}, {TIMES}, {NEWS}, {CAL}, news10 as (select * from news where published_at < timestamp '2024-01-11'), cal10 as (select * from cal where event_date < timestamp '2024-01-11'), {macro_cte('cal10')}, {sentiment_cte('news10')}, {SNAPS}, snaps20 as (select * from snaps where ts < timestamp '2024-01-21'), {state_cte('snaps20')}"
STATES = f"{REG}, {CONTEXT}, {state_cte()}"
EXT = f"""{STATES},
x as (
  select *, row_number() over (partition by asset order by ts)::double as t, list(high - low) over w as wr, avg(high - low) over w as wavg, count(*) over w as wn,
    {", ".join(f"count(case when session = '{s.upper()}' then 1 end) over w as {s}_count, sum(case when session = '{s.upper()}' then (high - low) / pip end) over w as {s}_sum" for s in ("asia", "london", "ny"))}
  from v window w as (partition by asset order by ts rows between 49 preceding and current row)),
y as (select *, count(*) over w as n, sum(t) over w as sx, sum(close) over w as sy, sum(t * close) over w as sxy, sum(t * t) over w as sxx from x window w as (partition by asset order by ts rows between 49 preceding and current row)),
e as (
  select *, {r6(f"case when n = 1 then {logistic('(close - open) / pip / 25e0')} else {logistic('((n * sxy - sx * sy) / (n * sxx - sx * sx)) / pip / 25e-1')} end")} as rolling_trend,
    {r6("case when wn <= 1 then 5e-1 else len(list_filter(wr, lambda r: r < high - low))::double / (wn - 1) end")} as atr_percentile,
    {r6(f"case when wavg = 0 then 5e-1 else {logistic('((high - low) / wavg - 1e0) * 2e0')} end")} as vol_regime_score,
    {", ".join(f"{r6(f'case when {s}_count = 0 then 5e-1 else {r6(f"{s}_sum")} / {s}_count end')} as {s}_range" for s in ("asia", "london", "ny"))}
  from y)"""


def distribution(src: str, keys: str, n: str = "1", flat: str = "2") -> str:
    """Statistics of net_return_pips by keys; n: copies of each row; flat: pips up to which a row is flat."""
    return f"""dist_rows as (select {keys}, net_return_pips as x, {flat} as fl from {src}, lateral (select unnest(range({n})))),
dist_sums as (
  select {keys}, count(*) as sample_size, sum(x) / count(*) as mean, sqrt(greatest(sum(x * x) / count(*) - (sum(x) / count(*)) * (sum(x) / count(*)), 0)) as sd, quantile_cont(x, 0.5) as med, quantile_cont(x, 0.1) as q1, quantile_cont(x, 0.9) as q9, max(abs(x)) as mx,
    sum(case when abs(x) > fl and x > 0 then 1 else 0 end)::double / count(*) as up, sum(case when abs(x) > fl and x < 0 then 1 else 0 end)::double / count(*) as down,
    sum(case when abs(x) <= fl then 1 else 0 end)::double / count(*) as flat
  from dist_rows group by {keys}),
dist as (
  select {keys}, sample_size, {r6("mean")} as mean_return, {r6("med")} as median_return, {r6("up")} as up_probability, {r6("down")} as down_probability, {r6("flat")} as flat_probability, {r6("sd")} as std_dev, {r6("mx")} as max_abs_return, {r6("q1")} as p10, {r6("q9")} as p90, {r6("greatest(up, down, flat)")} as max_probability,
    {r6("1 / (1 + case when mean = 0 then sd else sd / abs(mean) end)")} as sharpness
  from dist_sums)"""


def forecast(src: str, name: str, keep: str = "*") -> str:
    """The normalised forecast of a distribution."""
    return f"""{name}_r as (select *, {r6("up_probability", 2)} as ru, {r6("down_probability", 2)} as rd, {r6("flat_probability", 2)} as rf from {src}),
{name}_s as (select *, {r6("1 - (ru + rd + rf)", 2)} as rest, case when ru >= rd and ru >= rf then 'UP' when rd >= rf then 'DOWN' else 'FLAT' end as direction from {name}_r),
{name} as (select *, {r6("ru + case when direction = 'UP' then rest else 0 end", 2)} as up, {r6("rd + case when direction = 'DOWN' then rest else 0 end", 2)} as down, {r6("rf + case when direction = 'FLAT' then rest else 0 end", 2)} as flat, {r6("mean_return", 2)} as expected_move_pips from {name}_s)"""


RF = f"""{FWD}, {distribution("o", "asset, vol_regime, trend_regime")}, {forecast("dist", "fc")},
rf as (select o.asset, o.ts, o.fingerprint_id, o.vol_regime, o.trend_regime, o.session, o.net_return_pips, up, down, flat, expected_move_pips, sample_size, std_dev, max_probability, max_probability as confidence from o join fc using (asset, vol_regime, trend_regime))"""
BUCKET = "printf('%.1f-%.1f', least(floor(confidence * 10), 9) / 10, (least(floor(confidence * 10), 9) + 1) / 10)"
EV = f"""{RF},
ev0 as (select *, case when up >= down and up >= flat then 'UP' when down >= flat then 'DOWN' else 'FLAT' end as direction_predicted, case when net_return_pips > 2 then 'UP' when net_return_pips < -2 then 'DOWN' else 'FLAT' end as direction_actual, expected_move_pips - net_return_pips as err from rf),
ev1 as (select *, (direction_predicted = direction_actual)::int as direction_accuracy, up - case when direction_actual = 'UP' then 1e0 else 0e0 end as bu, down - case when direction_actual = 'DOWN' then 1e0 else 0e0 end as bd, flat - case when direction_actual = 'FLAT' then 1e0 else 0e0 end as bf from ev0),
ev as (select *, {r6("err", 2)} as error, {r6("abs(err)", 2)} as abs_error, {r6("err * err", 4)} as squared_error, {r6("(bu * bu + bd * bd + bf * bf) / 3")} as brier, {r6("confidence - direction_accuracy")} as calibration_error, {BUCKET} as bucket,
  direction_accuracy = 1 and abs(err) <= 0.5 * abs(net_return_pips) as tradeability_success, vol_regime || '_' || trend_regime as regime from ev1)"""

EVALS = EV.removeprefix(f"{REG},\n")


HEAD = f"""head as (select doc_id, {list(("EUR/USD rallies as ECB holds", "USDJPY slips, yen strong", "Fed signals GDP growth", "GBP weak against CHF and CAD", "Markets quiet", "Eurozone inflation in decline", "AUD gains", "nfp surge lifts dollar"))}[(doc_id % 8 + 1)::int] || coalesce(' ' || text, '') as headline from documents)"""


def weight(i: int) -> str:
    return "case q.vol_regime " + " ".join(f"when '{n}' then {w[i]}::double" for n, w in WEIGHTS.items()) + " else 0.2::double end"


def _cos(i: int) -> str:
    return f"greatest(0, least(1, list_dot_product(q.l{i}, k.l{i}) / (sqrt(list_dot_product(q.l{i}, q.l{i})) * sqrt(list_dot_product(k.l{i}, k.l{i})))))"


def search(euclid: tuple[int, ...], prefilter: bool) -> str:
    s = {i: f"greatest(0, least(1, 1 / (1 + list_distance(q.l{i}, k.l{i}))))" if i in euclid else _cos(i) for i in range(1, 6)}
    same = " and q.vol_regime = k.vol_regime and q.trend_regime = k.trend_regime" if prefilter else ""
    total = " + ".join(f"s{i} * w{i}" for i in range(1, 6))
    return f"""sp as (select q.asset, q.fingerprint_id, k.fingerprint_id as match_id, q.vol_regime, q.session, k.vol_regime as match_vol_regime, k.session as match_session, {", ".join(f"{x} as s{i}" for i, x in s.items())}, {", ".join(f"{weight(i - 1)} as w{i}" for i in range(1, 6))}
  from v q join v k on q.asset = k.asset and k.ts < q.ts{same}),
sc as (select *, {r6(f"greatest(0, least(1, {total}))")} as score from sp)"""


def ranked(src: str, k: int) -> str:
    return f"rk as (select *, row_number() over (partition by asset, fingerprint_id order by score desc, match_id) as rank from {src} qualify rank <= {k})"


def topology_cte(current: bool) -> str:
    """tl: the levels of every bar, rk from 1; tv: its vector t, for bars with 30 bars or more in their window. Needs ``with recursive``."""
    frame = "119 preceding and current row" if current else "120 preceding and 1 preceding"
    scale = {"strength": "1e0", "distance_pips": "500e0", "age": "any_value(n)", "touches": "any_value(n)", "rejections": "any_value(n)", "breakouts": "any_value(n)", "importance": "1e0"}
    parts = ["count(*) / 20e0", *[f"count_if(kind = '{k}') / count(*)" for k in ("support", "resistance", "flip_zone")]]
    parts += [f"{e} / {d}" for x, d in scale.items() for e in (f"min({x})", f"max({x})", f"{r6(f'sum({x})', 9)} / count(*)", f"stddev_pop({x})")]
    parts += [f"count_if(quarter = {k}) / count(*)" for k in range(4)]
    up, down = (f"count_if(kind = '{k}' and distance_pips > 0)" for k in ("resistance", "support"))
    parts += [f"{r6("list_sum(list_sort(list(strength), 'desc')[1:5])", 9)} / least(5, count(*))", parts[3], "count_if(distance_pips <= 20) / count(*)", f"case when {up} + {down} = 0 then 5e-1 else 1 - abs({up} - {down})::double / ({up} + {down}) end"]
    return f"""tw0 as (select asset, ts, pip, count(*) over w as n, list(open) over w as o, list(high) over w as h, list(low) over w as l, list(close) over w as k from c window w as (partition by asset order by ts rows between {frame})),
tw as (select *, k[n] as price_now from tw0 where n >= 30),
tb as (select asset, ts, pip, n, i, o[i] as o, h[i] as h, l[i] as l, k[i] as k, h[i - 1] as h0, h[i + 1] as h2, l[i - 1] as l0, l[i + 1] as l2 from (select *, unnest(range(1, n + 1)) as i from tw)),
tc as (select asset, ts, pip, i, h as price, 0 as sup from tb where i > 1 and i < n and h > h0 and h > h2
  union all select asset, ts, pip, i, l, 1 from tb where i > 1 and i < n and l < l0 and l < l2
  union all select asset, ts, pip, i, least(o, k), 1 from tb where h > l and abs(k - o) > 0.6::double * (h - l)
  union all select asset, ts, pip, i, greatest(o, k), 0 from tb where h > l and abs(k - o) > 0.6::double * (h - l)),
ta as (select asset, ts, pip, min(price) as a from tc group by all
  union all select ta.asset, ta.ts, ta.pip, min(tc.price) from ta join tc on tc.asset = ta.asset and tc.ts = ta.ts and tc.price - ta.a > 5e0 * ta.pip group by all),
tm as (select tc.asset, tc.ts, tc.pip, a, {r6(r6('sum(price)', 8) + ' / count(*)', 5)} as price, min(i) as first, sum(sup) / count(*) as share from tc asof join ta on tc.asset = ta.asset and tc.ts = ta.ts and tc.price >= ta.a group by all),
tt as (select tm.asset, tm.ts, tm.pip, tm.price, first, share, count_if(l <= price + 3e0 * tb.pip and h >= price - 3e0 * tb.pip) as met, count_if(l <= price + 3e0 * tb.pip and h >= price - 3e0 * tb.pip and abs(k - price) <= 3e0 * tb.pip) as back from tm join tb on tm.asset = tb.asset and tm.ts = tb.ts group by all),
tr as (select asset, ts, price, n, case when share > 0.65::double then 'support' when share < 0.35::double then 'resistance' else 'flip_zone' end as kind, greatest(1, met) as touches, back as rejections, met - back as breakouts, back / greatest(1, met) as strength, n - first + 1 as age, {r6('abs(price - price_now) / tt.pip', 2)} as distance_pips,
  row_number() over (partition by asset, ts order by 2 * back + greatest(1, met) - (met - back) desc, price) as rk from tt join tw using (asset, ts) qualify rk <= 20),
ti as (select *, strength / greatest(distance_pips, 1) as raw, sum(strength / greatest(distance_pips, 1)) over p as total, count(*) over p as many from tr window p as (partition by asset, ts)),
tj as (select *, {r6('case when total > 0 then raw / total else 1 / many end')} as part from ti),
tq as (select *, sum(part) over (partition by asset, ts) as whole, row_number() over (partition by asset, ts order by part desc, rk) as nth from tj),
tl as (select *, {r6('part + case when nth = 1 then 1 - whole else 0e0 end')} as importance from tq),
tx as (select *, case when max(price) over p > min(price) over p then least(floor((price - min(price) over p) / (max(price) over p - min(price) over p) * 4), 3) else 0 end as quarter from tl window p as (partition by asset, ts)),
ty as (select asset, ts, any_value(n) as n, [{', '.join(f'greatest(0, least(1, {r6(x)}))' for x in parts)}] as t from tx group by asset, ts),
tv as (select asset, ts, coalesce(t, list_resize([0e0], 40, 0e0)) as t from tw left join ty using (asset, ts))"""


TOPO = topology_cte(False)
ENGINE = f"{STATES}, {search((4, 5), True)}"
BATCH = f"""{STATES}, {TOPO}, {search((), False)},
b1 as (select * replace (case when session = match_session then least(1, score * 1.05::double) else score end as score) from sc),
b2 as (select * replace ({r6("case when vol_regime = match_vol_regime then least(1, score * 1.03::double) else score end")} as score) from b1),
vt as (select fingerprint_id, t, sqrt(list_dot_product(t, t)) as m from v join tv using (asset, ts)),
b3 as (select b2.*, case when a.m * b.m > 0 then greatest(0, least(1, list_dot_product(a.t, b.t) / (a.m * b.m))) when a.m is not null and b.m is not null then 0e0 end as cosine from b2 left join vt a on b2.fingerprint_id = a.fingerprint_id left join vt b on b2.match_id = b.fingerprint_id),
b4 as (select * replace (case when cosine is null then score else {r6("0.9::double * score + 0.1::double * cosine")} end as score), {r6("cosine")} as topology_score from b3)"""
TRADES = "not (dayofweek(ts) = 6 or (dayofweek(ts) = 0 and hour(ts) < 21) or (dayofweek(ts) = 5 and hour(ts) >= 21))"
V1 = f"""cf as (select *, {r6("greatest(0, least(1, rawc))")} as confidence_raw, greatest(0, least(1, rawc)) as raw1, case when sample_size < 30 then least(sample_size / 30, 0.5::double) else 1.0::double end as sw, greatest(0, least(1, 0.7::double * mr + 0.3::double * (1 - dv))) as st from cf0)"""


def confidence_raw(sim: str, density: str, spread: str, skew: str, kurt: str) -> str:
    return f"0.4::double * ((greatest(up, down, flat) - 1e0 / 3) / (2e0 / 3)) + 0.35::double * (0.5::double * {sim} + 0.3::double * {density} + 0.2::double * (1 - {spread})) + 0.25::double * (((1 - least(std_dev / 50, 1e0)) + (1 - abs({skew})) + (1 - {kurt})) / 3)"


def _rule(text: str) -> str:
    """Points of the conditions that hold; what is not known does not."""
    return r6(" + ".join(f"case when {cond[:-1]} then {points}::double else 0e0 end" for points, cond in (x.split(" * (", 1) for x in text.split(", "))))


def _regimes() -> str:
    return f"""{EXT},
f1 as (select * exclude (heading), l1[5] as heading, l1[6] as strength, l1[7] as impulse, l1[8] as rejection, l1[9] as at_close, l2[1] as atr, l2[5] as growth, l2[6] as squeeze, l2[7] as pace,
  {", ".join(f"case when abs({x} - 5e-1) >= 1e-9 then {x} end as {n}" for x, n in (("rolling_trend", "roll"), ("atr_percentile", "pct"), ("macro_state", "macro"), ("sentiment_score", "mood")))} from e),
f2 as (select *, {", ".join(f"{_rule(v)} as rule_{k}" for k, v in RULES.items())} from f1),
f3 as (select *, list_sort([{", ".join(f"{{'s': -rule_{n}, 'name': '{n}'}}" for n in RULES)}]) as r from f2),
f4 as (select *, r[1].name as "primary", -r[1].s as primary_score, list_filter(r[2:9], lambda p: p.s < 0)[1:2] as sec from f3)
select asset, ts, "primary", primary_score, array_to_string(list_transform(sec, lambda p: p.name || ':' || printf('%.4f', case when primary_score > 0 then -p.s / primary_score else 0 end)), ',') as secondary, {", ".join(f"rule_{n}" for n in RULES)} from f4"""


def stats(c: str) -> list[str]:
    mean = f"list_avg({c})"
    return [mean, f"sqrt(list_avg(list_transform({c}, lambda z: (z - {mean}) * (z - {mean}))))", f"list_min({c})", f"list_max({c})"]


_ML = [*stats("l1"), *stats("l2"), *[f"l4[{i}]" for i in range(1, 9)], *[f"l5[{i}]" for i in range(1, 7)], *[f"(session = '{s}')::int::double" for s in ("LONDON", "NY", "ASIA")], *[f"(vol_regime = '{r}')::int::double" for r in ("HIGH", "LOW")], "rolling_trend", "atr_percentile", "vol_regime_score"]
_PAIR = "from e a join e b on a.label = b.label and a.vec_id != b.vec_id where a.vec_id % 20 = 0"
_EMB = "e as (select vec_id, label, list_transform(embedding, lambda z: z::double) as v from embeddings)"


def corr() -> str:
    vx, vy = "(n * sxx - sx * sx)", "(n * syy - sy * sy)"
    return r6(f"case when n >= 2 and {vx} > 1e-9 and {vy} > 1e-9 then greatest(-1, least(1, (n * sxy - sx * sy) / sqrt({vx} * {vy}))) else 0 end")


def sums(x: str, y: str) -> str:
    return f"count(*) as n, sum({x}) as sx, sum({y}) as sy, sum({x} * {y}) as sxy, sum({x} * {x}) as sxx, sum({y} * {y}) as syy"


#: Fixed mapping of the test assets to symbols, of their currencies, and of calendar events to currencies.
SYMBOLS = {"click": "EURUSD", "view": "GBPUSD", "purchase": "USDJPY", "signup": "XAU", "error": "eurgbp"}
SYMBOL = "case asset " + " ".join(f"when '{a}' then '{s}'" for a, s in SYMBOLS.items()) + " end"
CODES = f"case when length({SYMBOL}) >= 6 then [upper({SYMBOL})[1:3], upper({SYMBOL})[4:6]] else [{SYMBOL}] end"
PCAL = "pcal as (select cal.*, ['USD', 'EUR', 'GBP', 'JPY'][(k % 5 + 1)::int] as currency from cal)"


ORACLE_SQL: dict[str, str] = {
    "candle_resample_4h": f"with {BARS} select * from candles",
    "ohlc_validate": f"with {BARS}, n as (select *, row_number() over (partition by asset order by ts) as row from c), b as (select * replace (case when row % 7 = 0 then least(open, close) - 1 else high end as high) from n) select asset, ts, row, case when high < greatest(open, close, low) then 'high' else 'low' end as reason from b where high < greatest(open, close, low) or low > least(open, close, high)",
    "grid_expected": f"with {BARS}, r as (select asset, min(ts) as a, max(ts) as b from c group by asset), s as (select asset, unnest(generate_series(a, b, interval '4 hours')) as ts from r) select * from s where {TRADES}",
    "gap_detect": f"with {BARS}, k as (select asset, ts, row_number() over (partition by asset order by ts) as rn from c), k2 as (select asset, ts from k where rn % 5 != 3), r as (select asset, min(ts) as a, max(ts) as b from k2 group by asset), s as (select asset, unnest(generate_series(a, b, interval '4 hours')) as ts from r), l as (select *, lag(ts) over (partition by asset order by ts) as previous_ts from s) select * from l where not exists (select 1 from k2 where k2.asset = l.asset and k2.ts = l.ts)",
    "sunday_merge": f"with {BARS}, s as (select *, case when dayofweek(ts) = 0 then date_trunc('day', ts) + interval '1 day' else ts end as slot from c) select asset, slot as ts, first(open order by ts) as open, max(high) as high, min(low) as low, last(close order by ts) as close, sum(volume)::bigint as volume from s group by asset, slot",
    "fingerprint_id": f"with {REG} select asset, ts, fingerprint_id from g",
    "return_profile": f"with {REG} select asset, ts, net_pips, range_pips from g",
    "regime_classify": f"with {REG} select asset, ts, vol_regime, trend_regime, session, case when hour(ts) between 12 and 20 then 'NY' when hour(ts) between 7 and 11 then 'LONDON' else 'ASIA' end as api_session from g",
    "l1_structure": f"with {REG} select asset, ts, {cols('l1', [*map(part, L1)])} from geo",
    "l2_volatility": f"with {REG} select asset, ts, {cols('l2', [*map(part, L2)])} from geo",
    "l3_liquidity": f"with {REG} select asset, ts, {cols('l3', L3)} from geo",
    "l4_macro_snapshot": f"with {BARS}, {SNAPS} select ts, {cols('l4', [*map(part, L4)])} from snaps",
    "l5_sentiment_snapshot": f"with {BARS}, {SNAPS}, sn as (select * replace (case when day(ts) % 7 != 0 then vix end as vix) from snaps), n as (select ts, {', '.join(f'case when {x} is null then 5e-1 else greatest(0e0, least(1e0, ({x} - {lo}) / {w})) end as {x}' for x, lo, w in (('vix', '10e0', '30e0'), ('gold', '1500e0', '1000e0'), ('dxy', '90e0', '20e0'), ('spx', '3000e0', '2500e0'), ('us10y', '1e0', '4e0')))} from sn) select ts, {r6('vix')} as l5_0, {r6('(vix + gold) / 2')} as l5_1, {r6('dxy')} as l5_2, {r6('spx')} as l5_3, {r6('us10y')} as l5_4, {r6('(vix + (vix + gold) / 2 + dxy + spx + us10y) / 5')} as l5_5 from n",
    "state_layers": f"with {TEN} select asset, ts, macro_source, sentiment_source, {', '.join(f'l4[{i + 1}] as l4_{i}' for i in range(8))}, {', '.join(f'l5[{i + 1}] as l5_{i}' for i in range(6))} from v",
    "forward_outcomes": f"with {FWD} select asset, ts, next_ts, net_return_pips, mfe_pips, mae_pips, realised_volatility from o",
    "rolling_trend": f"with {EXT} select asset, ts, rolling_trend from e",
    "atr_percentile": f"with {EXT} select asset, ts, atr_percentile from e",
    "vol_regime_score": f"with {EXT} select asset, ts, vol_regime_score from e",
    "session_stats": f"with {EXT} select asset, ts, asia_count, asia_range, london_count, london_range, ny_count, ny_range from e",
    "ml_features": f"with {EXT} select asset, ts, {', '.join(f'{r6(x)} as f{i}' for i, x in enumerate(_ML))} from e",
    "walk_forward_split": f"with {FWD}, s as (select asset, row_number() over (partition by asset order by ts) <= floor(0.8 * count(*) over (partition by asset)) as t from o) select asset, sum(t::int)::bigint as train, count(*) as n from s group by asset",
    "outcome_distribution": f"with {FWD}, {distribution('o', 'asset, vol_regime')} select * from dist",
    "outcome_weighted": f"with {FWD}, w as (select *, case when vol_regime = 'NORMAL' and session = 'LONDON' then 15 when vol_regime = 'NORMAL' then 12 else 7 end as copies from o), {distribution('w', 'asset', 'copies')} select * from dist",
    "dynamic_flat": f"with {BARS}, d as (select asset, ts, count(*) over w as n, avg((high - low) / pip) over w as a from c window w as (partition by asset order by ts rows between 13 preceding and current row)) select asset, ts, {r6('case when n >= 5 then greatest(0.25 * a, 1e0) else 2e0 end')} as flat_threshold from d",
    "cosine_pairs": f"with {_EMB}, p as (select a.vec_id as a_vec_id, b.vec_id as b_vec_id, {r6('list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))')} as similarity {_PAIR}) select * from p qualify row_number() over (partition by a_vec_id order by similarity desc, b_vec_id) <= 10",
    "l2_similarity": f"with {_EMB}, p as (select a.vec_id as a_vec_id, b.vec_id as b_vec_id, {r6('1 / (1 + list_distance(a.v, b.v))')} as similarity {_PAIR}) select * from p qualify row_number() over (partition by a_vec_id order by similarity desc, b_vec_id) <= 10",
    "topk_similarity": f"with {_EMB}, p as (select a.vec_id as q_vec_id, b.vec_id, {r6('list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))')} as score from e a join e b on a.vec_id != b.vec_id where a.vec_id % 20 = 0) select *, row_number() over (partition by q_vec_id order by score desc, vec_id) as rank from p qualify rank <= 10",
    "similarity_batch": f"with recursive {BATCH}, {ranked('b4', 50)} select asset, fingerprint_id, match_id, rank, score from rk",
    "similarity_engine": f"with {ENGINE}, {ranked('sc', 50)} select asset, fingerprint_id, match_id, rank, score from rk",
    "blended_score": f"with recursive {BATCH}, {ranked('b4', 5)} select fingerprint_id, match_id, topology_score, score as blended from rk",
    "match_explanation": f"with {ENGINE}, {ranked('sc', 3)}, p as (select *, [{', '.join(f'''{{'name': '{n}', 's': {r6(f's{i}')}, 'c': {r6(f'{r6(f's{i}')} * w{i}', 9)}, 'o': {-i}}}''' for i, n in enumerate(LAYERS, 1))}] as p from rk) select fingerprint_id, match_id, array_to_string(list_transform(list_filter(p, lambda z: z.s >= 0.95::double), lambda z: z.name), ',') as matched, array_to_string(list_transform(list_filter(p, lambda z: z.s < 0.95::double), lambda z: z.name), ',') as mismatched, coalesce(list_sort(list_transform(list_filter(p, lambda z: z.s >= 0.95::double), lambda z: {{'c': z.c, 'o': z.o, 'name': z.name}}), 'desc')[1].name, 'none') as reason from p",
    "match_explanation_brief": f"with recursive {BATCH}, {ranked('b4', 3)} select fingerprint_id, match_id, array_to_string(list_filter([{', '.join(f"case when {r6(f's{i}')} > 0.8::double then '{n}' end" for i, n in ((1, 'structure'), (2, 'volatility'), (3, 'liquidity')))}], lambda z: z is not null), ',') as matched, array_to_string(list_filter([{', '.join(f"case when {r6(f's{i}')} < 0.5::double then '{n}' end" for i, n in ((4, 'macro'), (5, 'sentiment')))}], lambda z: z is not null), ',') as mismatched, 'weighted_vector_similarity' as reason from rk",
    "ann_layers": f"with {ENGINE}, {ranked('sc', 50)} select asset, fingerprint_id, match_id, rank, score from rk",
    "extended_all": f"""with {EXT}, mk as (select ts, string_agg(asset || ':' || printf('%.6f', greatest(0, least(1, close / 200))), ',' order by asset) as correlated from c group by ts), ah as (select t.ts, min((epoch(event_date) - epoch(t.ts)) / 3600.0::double) as h from times t join cal on impact = 'high' and event_date > t.ts and event_date <= t.ts + interval '8 hours' group by t.ts)
select e.asset, e.ts, rolling_trend, null::double as atr_percentile, vol_regime_score, asia_count, london_count, ny_count, asia_range, london_range, ny_range, correlated, h is not null as high_impact_event, {r6('greatest(0e0, coalesce(h, 24e0))')} as hours_to_next_event, macro_state, null::double as sentiment_summary from e join mk using (ts) left join ah using (ts)""",
    "paginate_keyset": "select c_custkey, c_name, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20 offset 40",
    "reply_scores": "with d as (select doc_id, (doc_id // 10) % 5 as shape, (((doc_id * 37) % 21 - 10) / 10)::double as s from documents) select doc_id, case when shape in (0, 1, 2) then s when shape = 3 then 0e0 else greatest(-1e0, least(1e0, 3 * s)) end as score from d",
    "candle_sources": f"with {BARS}, s as (select *, case when hour(ts) < 8 then 0 when hour(ts) < 16 then 1 when day(ts) % 5 != 0 then 2 end as source_rank, ((hour(ts) < 8)::int + (hour(ts) < 16)::int + (day(ts) % 5 != 0)::int)::bigint as sources from c) select asset, ts, open, high, low, case when source_rank = 1 then close + 1 else close end as close, volume::double as volume, source_rank, sources from s where source_rank is not null",
    "level_strengths": f"with recursive {BARS}, {topology_cte(True)} select asset, ts, array_to_string(list_transform(list_sort(list(strength), 'desc')[1:5], lambda z: printf('%.6f', z)), ',') as strengths from tl group by asset, ts",
    "layer_merge": f"with {FWD}, s as (select fingerprint_id as id, abs(net_return_pips) as score, vol_regime = 'HIGH' as a, trend_regime = 'BULLISH' as b, session = 'NY' as d from o) select id, case when a then score else 0 end as s1, case when b then score else 0 end as s2, case when d then score else 0 end as s3 from s where a or b or d",
    "forecast_normalise": f"with {FWD}, {distribution('o', 'asset, vol_regime, session')}, {forecast('dist', 'fc')} select asset, vol_regime, session, up, down, flat, expected_move_pips, direction from fc",
    "tradeability": f"with {RF}, t as (select *, case when sample_size > 5 then confidence end as conf, case session when 'NY' then 1.0 when 'LONDON' then 1.2 else 1.5 end as spread, case session when 'ASIA' then 0.7 else 0.85 end as liquidity, hour(ts) = 12 as news from rf), u as (select asset, ts, case when conf is null then 0e0 else {r6('greatest(0, least(1, conf)) * (case when spread <= 2 then 1e0 else 7e-1 end) * (case session when ' + chr(39) + 'LONDON' + chr(39) + ' then 1e0 when ' + chr(39) + 'NY' + chr(39) + ' then 8e-1 else 5e-1 end) * 1e0 * (case when news then 0e0 else 1e0 end)', 2)} end as tradeability_score, case when conf is null then 'conf' else '' end as unavailable from t) select *, case when tradeability_score > 0.75 then 'GO' when tradeability_score >= 0.45 then 'CONDITIONAL' else 'NO_GO' end as label from u",
    "confidence_v1": f"with {RF}, cf00 as (select distinct asset, vol_regime, trend_regime, up, down, flat, sample_size, std_dev from rf), cf0 as (select *, {confidence_raw('0.8::double', '0.7::double', '0.2::double', '0.1::double', '0.2::double')} as rawc, 0.6::double as mr, 0.3::double as dv from cf00), {V1} select asset, vol_regime, trend_regime, confidence_raw, {r6('sw')} as sample_weight, {r6('st')} as regime_stability, {r6('greatest(0, least(1, raw1 * sw * st))')} as confidence_v1 from cf",
    "confidence_v2": f"with {EV}, b as (select bucket, {r6('avg(direction_accuracy)')} as br from ev group by bucket), r as (select regime, {r6('avg(direction_accuracy)')} as rr from ev group by regime having count(*) >= 30), f as (select distinct asset, regime, bucket, sample_size from ev) select asset, f.regime, f.bucket, sample_size, {r6('greatest(0, least(1, coalesce(br, 5e-1) * coalesce(rr, 1e0) * case when sample_size >= 30 then 1e0 else sample_size / 30 end))')} as confidence_v2, br is null or rr is null as using_fallback from f join b using (bucket) left join r using (regime)",
    "ensemble_blend": f"""with {FWD}, {distribution('o', 'asset, vol_regime')}, {forecast('dist', 'fc')}, o2 as (select * from o where asset != 'signup'), {distribution('o2', 'asset').replace('dist', 'mdist')}, {forecast('mdist', 'mf')},
m as (select fc.asset, fc.vol_regime, fc.up, fc.down, fc.flat, mf.up as mu, {r6('0.5 * fc.up + 0.5 * mf.up', 2)} as u, {r6('0.5 * fc.down + 0.5 * mf.down', 2)} as d, {r6('0.5 * fc.flat + 0.5 * mf.flat', 2)} as f from fc left join mf using (asset)),
n as (select *, case when mu is null then up else {r6('u / (u + d + f)', 2)} end as ens_up, case when mu is null then down else {r6('d / (u + d + f)', 2)} end as ens_down from m)
select asset, vol_regime, ens_up, ens_down, case when mu is null then flat else {r6('1 - ens_up - ens_down', 2)} end as ens_flat from n""",
    "sentiment_vector": f"with {BARS}, {TIMES}, {NEWS}, {sentiment_cte()} select * from sen",
    "macro_vector": f"with {BARS}, {TIMES}, {CAL}, {macro_cte()} select * from mac",
    "news_risk": f"with {BARS}, {CAL}, {PCAL}, b as (select asset, ts, {CODES} as codes from c), h as (select distinct asset, ts, name, event_date from b join pcal on impact = 'high' and list_contains(codes, currency) and event_date > ts and event_date <= ts + interval '8 hours'), s as (select asset, ts, min((epoch(event_date) - epoch(ts)) / 3600.0::double) as hours_to_event, string_agg(name, ',' order by event_date, name) as names from h group by asset, ts) select asset, ts, hours_to_event, coalesce(names, '') as names, hours_to_event is not null as at_risk from b left join s using (asset, ts)",
    "event_context": f"""with {FWD}, {CAL}, {PCAL}, b as (select asset, ts, {CODES} as codes from c),
up as (select asset, ts, min({{'d': event_date, 'n': name}}).n as name from b join pcal on event_date >= ts and event_date <= ts + interval '8 hours' and impact = 'high' and list_contains(codes, currency) group by asset, ts),
inst as (select distinct name, event_date from cal),
net as (select asset, name, event_date, max({{'ts': ts, 'net': net_return_pips}}).net as net from inst join o on o.ts between event_date - interval '4 hours' and event_date + interval '4 hours' group by asset, name, event_date),
past as (select asset, ts, name, count(*) as events from up join inst using (name) where event_date < ts group by asset, ts, name),
gg as (select up.asset, up.ts, up.name, count(*) as outcomes, median(abs(net)) as med, avg(abs(net)) as mean, avg((net > 0)::int) as share from up join net on net.asset = up.asset and net.name = up.name and net.event_date < up.ts group by up.asset, up.ts, up.name)
select asset, ts, name, events, outcomes, {r6('med')} as median_abs, {r6('share')} as up_share, {r6('case when med = 0 then 1e0 else mean / med end')} as amplification from gg join past using (asset, ts, name) where outcomes >= 3 and events >= 3""",
    "regime_v2": f"with {_regimes()}",
    "evaluation_metrics": f"with {EV} select fingerprint_id, direction_predicted, direction_actual, direction_accuracy, error, abs_error, squared_error, brier, calibration_error, bucket, tradeability_success from ev",
    "forecast_maturity": f"with {FWD} select fingerprint_id, case when session != 'NY' then 'evaluated' when ts + interval '12 hours' <= timestamp '2024-01-20' then 'outcome_unavailable' else 'waiting' end as status from o",
    "unevaluated_antijoin": f"with {FWD} select asset, ts, fingerprint_id from g where fingerprint_id not in (select fingerprint_id from o where session != 'ASIA')",
    "calibration_report": f"with {EV}, k as (select bucket, count(*) as n, avg(direction_accuracy) as rate from ev group by bucket), a as (select printf('%.1f-%.1f', i / 10, (i + 1) / 10) as bucket, i / 10 + 0.05::double as mid from range(10) t(i)) select bucket, coalesce(n, 0) as n, {r6('rate')} as observed_rate, {r6('abs(mid - rate)')} as deviation, coalesce(n, 0) < 10 as insufficient from a left join k using (bucket)",
    "regime_accuracy": f"with {EV}, a as (select regime, asset, direction_predicted, {r6('100 * avg(direction_accuracy)', 2)} as accuracy, count(*) as n from ev group by all), b as (select regime, asset, direction_predicted, {r6('100 * avg(direction_accuracy)', 2)} as old from ev where ts < timestamp '2024-01-15' group by all) select regime, asset, direction_predicted, accuracy, n, n >= 30 as significant, accuracy < 40 as underperforming, {r6('accuracy - old', 2)} as delta from a left join b using (regime, asset, direction_predicted)",
    "regime_accuracy_rollup": f"with {EV} select regime, asset, count(*) as n, {r6('100 * avg(direction_accuracy)', 2)} as accuracy from ev group by rollup (regime, asset)",
    "stage_contribution": f"""with {TEN}, {search((4, 5), True)}, {ranked('sc', 5)}, {EVALS},
mt as (select fingerprint_id, avg(score) as similarity, max(case when rank = 1 then 'L' || (list_position([{', '.join(r6(f's{i}') for i in range(1, 6))}], list_max([{', '.join(r6(f's{i}') for i in range(1, 6))}]))) end) as dominant from rk group by fingerprint_id),
f as (select ev.fingerprint_id, ev.direction_accuracy::double as hit, ev.confidence, v.macro_source = 'engine' as has_macro, v.sentiment_source = 'engine' as has_sentiment, mt.similarity, dominant, count(*) over (partition by ev.asset, ev.regime) < 10 as low from ev join v using (fingerprint_id) left join mt using (fingerprint_id)),
l as (select fingerprint_id, hit, low, dominant, stage, value from (select *, unnest([{', '.join(f"{{'stage': '{s}', 'value': {x}::double}}" for s, x in (('similarity', 'similarity'), ('regime', 'confidence'), ('macro', 'has_macro::int'), ('sentiment', 'has_sentiment::int'), ('confidence', 'confidence'), ('outcome', 'confidence')))}], recursive := true) from f)),
s as (select stage, {sums('value', 'hit')} from l where value is not null group by stage), k as (select stage, {corr()} as score from s),
d as ({' union all '.join(f"select '{x}' as stage, {r6(f'avg(case when has_{x} then hit end) - avg(case when not has_{x} then hit end)')} as delta from f" for x in ('macro', 'sentiment'))})
select fingerprint_id, stage, coalesce(score, 0) as contribution_score, case when stage = 'similarity' then dominant end as layer_dominant, delta as marginal_accuracy_delta, low as is_low_confidence from l left join k using (stage) left join d using (stage)""",
    "marginal_delta": f"with {EV}, d as (select avg(case when session = 'LONDON' then direction_accuracy end) as a, avg(case when session != 'LONDON' then direction_accuracy end) as b from ev) select {r6('a')} as with_rate, {r6('b')} as without_rate, {r6('a - b')} as delta from d",
    "pearson": f"with {FWD}, s as (select asset, {sums('range_pips', 'mfe_pips')} from o group by asset) select asset, n, {corr()} as correlation from s",
    "drift_check": f"with {EV}, r as (select *, row_number() over (partition by asset order by ts desc) as rn from ev), n as (select * from r where rn <= 100), w as (select asset, rn, avg(direction_accuracy) over w as acc, count(*) over w as k from n window w as (partition by asset order by rn desc rows between 29 preceding and current row)), gg as (select asset, count(*) as n, max(case when rn = 1 and k = 30 then acc end) as rolling, avg(case when k = 30 then acc end) as mean, avg(case when k = 30 then acc * acc end) as sq from w group by asset), h as (select *, {r6('sqrt(greatest(sq - mean * mean, 0))')} as sd from gg where n >= 30) select asset, n, {r6('rolling')} as rolling_accuracy, {r6('mean')} as baseline_mean, sd as baseline_std, sd > 0 and rolling < mean - 2 * sd as drifted, case when sd > 0 then {r6('(mean - rolling) / sd', 2)} else 0 end as deviation from h",
    "experiment_ab": f"with {FWD}, r as (select fingerprint_id, case when net_return_pips > 2 then 'UP' when net_return_pips < -2 then 'DOWN' else 'FLAT' end as a, case when net_return_pips > 20 then 'UP' when net_return_pips < -20 then 'DOWN' else 'FLAT' end as b from o) select fingerprint_id, '1.0=' || a || ',1.1=' || b as results, a = b as agree from r",
    "upsert_ignore": "select c_custkey, c_name, c_acctbal from customer union all select c_custkey * 2, c_name, 0::double from customer where c_custkey * 2 not in (select c_custkey from customer)",
    "upsert_overwrite": "select c_custkey * 2 as c_custkey, c_name, 0::double as c_acctbal from customer union all select c_custkey, c_name, c_acctbal from customer where c_custkey not in (select c_custkey * 2 from customer)",
    "update_column": "select c_custkey, case when c_custkey in (select c_custkey * 5 from customer) then 1 else c_acctbal end as c_acctbal from customer",
    "dedup_first": "select o_custkey, o_orderdate, o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) = 1",
    "provider_fallback": f"with {BARS} select asset, ts, case when hour(ts) < 8 then close when hour(ts) < 16 then close + 1 else close + 2 end as close, case when hour(ts) < 8 then 0 when hour(ts) < 16 then 1 else 2 end as source_rank, case when hour(ts) < 8 then 3 when hour(ts) < 16 then 2 else 1 end::bigint as sources from c",
    "asof_next": f"with {BARS} select asset, ts, close, lead(ts) over w as next_ts, lead(close) over w as next_close from c window w as (partition by asset order by ts)",
    "asof_tolerance": f"with {BARS}, {CAL}, h as (select distinct name, event_date from cal where impact = 'high') select asset, name, event_date, max(ts) as ts, arg_max(close, ts) as close from h join c on c.ts between event_date - interval '4 hours' and event_date + interval '4 hours' group by all",
    "range_join_window": f"with {BARS}, {TIMES}, {NEWS} select t.ts, count(*) as n, {r6('avg(hint)')} as mean_hint from times t join news on published_at between t.ts - interval '24 hours' and t.ts group by t.ts",
    "serving_latest": f"with {REG} select asset, ts, close, vol_regime, trend_regime, session from g qualify row_number() over (partition by asset order by ts desc) = 1",
    "paginate": "select c_custkey, c_name, c_acctbal, count(*) over () > 60 as has_more from customer order by c_acctbal desc, c_custkey limit 20 offset 40",
    "tier_projection": "select c_custkey, n_name, r_name, case when c_acctbal > 5000 then c_acctbal end as c_acctbal from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
    "detect_asset": f"with {HEAD}, h as (select doc_id, upper(headline) as u, lower(headline) as l, {count_of('upper(headline)', CURRENCIES)} as n from head) select doc_id, case {' '.join(f'''when n >= 2 and contains(u, '{p[:3]}') and contains(u, '{p[3:]}') then '{p.lower()}' ''' for p in PAIRS)} when n = 1 then 'forex' when {contains('l', EURO_WORDS + DOLLAR_WORDS)} then 'eurusd' else 'forex' end as asset_id from h",
    "relevance_score": f"with {HEAD}, h as (select doc_id, upper(headline) as u, lower(headline) as l, {count_of('upper(headline)', CURRENCIES)} as n from head) select doc_id, (case when {contains('u', [x for p in PAIRS for x in (p, f'{p[:3]}/{p[3:]}')])} then 0.9 when n >= 2 then 0.8 when {contains('l', STRONG_WORDS)} then case when n >= 1 then 0.8 else 0.7 end when n = 1 then 0.5 else 0.3 end)::double as relevance from h",
    "event_impact": f"with {HEAD} select doc_id, {impact('headline')} as impact, {impact('headline', 'news')} as news_impact, {contains('lower(headline)', ('rate decision', 'interest rate'))} as is_rate from head",
    "sentiment_bias": f"with {HEAD}, h as (select doc_id % 10 as batch, sum({count_of('lower(headline)', POSITIVE)}) as p, sum({count_of('lower(headline)', NEGATIVE)}) as n from head group by 1) select batch, {r6('case when p + n = 0 then 0 else (p - n)::double / (p + n) end')} as bias from h",
    "csv_round_trip": f"with {BARS} select ts, open, high, low, close, volume::double as volume from c",
    "json_vector_parse": "select event_id, case event_id % 4 when 0 then 3 else 0 end as n, case event_id % 4 when 0 then event_id::double end as first, case event_id % 4 when 0 then -0.1::double end as third from events",
    "cache_ttl": "select event_id, (14400 - floor(epoch(ts))::bigint % 14400) as ttl, 14400 - floor(epoch(ts))::bigint % 14400 >= 60 as cached from events",
    "rate_window": "with e as (select event_id, user_id, floor(epoch(ts))::bigint as s from events), n as (select event_id, count(*) over (partition by user_id order by s range between 3600 preceding and current row) as n from e) select event_id, n, n > 5 as limited from n",
    "time_ago": "with m as (select event_id, floor((1706745600 - floor(epoch(ts))) / 60)::bigint as m from events) select event_id, case when m < 60 then m || 'm ago' when m < 1440 then (m // 60) || 'h ago' else (m // 1440) || 'd ago' end as ago from m",
    "sparkline": f"with {BARS}, l as (select asset, ts, close from c qualify row_number() over (partition by asset order by ts desc) <= 24) select asset, count(*)::int as n, array_to_string(list(printf('%.2f', close) order by ts), ',') as closes from l group by asset",
    "topology_levels": f"with recursive {BARS}, {topology_cte(True)} select asset, ts, price, kind, touches, rejections, breakouts, strength, age, distance_pips, importance from tl",
    "topology_vector": f"with recursive {BARS}, {TOPO} select asset, ts, {', '.join(f't[{i + 1}] as t{i}' for i in range(40))} from tv",
    "registry": f"with {BARS}, m as (select * from (values ('click', 'EURUSD', 1, 'EUR/USD'), ('view', 'GBPUSD', 2, 'GBP/USD'), ('purchase', 'USDJPY', 3, 'USD/JPY'), ('signup', 'XAU', 4, 'XAU')) t(id, symbol, priority, pair)), n as (select asset, count(*) as bars from c group by 1) select id, symbol, priority::int as priority, 2.0::double as pip_size, pair, symbol || '=X' as chart_symbol, bars from m left join n on asset = id",
    "version_bump": "with v as (select n_name as engine, '1.' || i as version, timestamp '2024-01-01' + to_days(i::int) as created_at from nation, range(1, 4) t(i) union all select n_name, '2.0', timestamp '2024-02-01' from nation where n_nationkey % 2 = 0) select *, created_at = max(created_at) over (partition by engine) as is_active from v",
    "config_snapshot": "select n_name as engine, '1.3' as version from nation",
    "integrity_report": f"with {BARS} select asset, case when count_if(volume % 10 = 0) > 0 then 'partial' else 'complete' end as status, count(*) as bars, count_if(high - low > 120)::bigint as wide, count_if(volume % 10 = 0)::bigint as errors from c group by asset",
    "cache_write": f"with {BARS}, l as (select asset, ts, close from c qualify row_number() over (partition by asset order by ts desc) = 1) select *, (epoch(ts + interval '4 hours') - epoch(timestamp '2024-01-30 21:00:00'))::bigint as ttl from l where epoch(ts + interval '4 hours') - epoch(timestamp '2024-01-30 21:00:00') >= 60",
    "plan_limits": "with c as (select c_custkey, ['free', 'starter', 'professional', 'enterprise'][(c_custkey % 4 + 1)::int] as plan, timestamp '2024-03-01' + to_days((c_custkey % 40)::int) as last from customer) select c_custkey, plan, case when plan = 'enterprise' and c_custkey % 8 = 3 then 99 else case plan when 'free' then 100 when 'starter' then 5000 else 25000 end end as max_requests, last < case when plan = 'free' then timestamp '2024-03-15' else timestamp '2024-03-01' end as reset, (epoch(case when plan = 'free' then timestamp '2024-03-16' else timestamp '2024-04-01' end) - epoch(timestamp '2024-03-15 10:30:00'))::bigint as retry_after from c",
    "tier_allowed": "with r as (select c_custkey, ['retail', 'developer', 'research', 'internal'][(c_custkey % 4 + 1)::int] as tier, ['/v1/forecast/x', '/v1/state/x', '/v1/similarity/x', '/v1/metrics/x', '/v2'][(c_custkey % 5 + 1)::int] as path from customer) select *, case when path = '/v2' then null else left(path, length(path) - 2) end as endpoint, case c_custkey % 5 when 0 then true when 1 then tier != 'retail' when 2 then tier != 'retail' when 3 then tier = 'internal' else false end as allowed from r",
    "strict_json": "select event_id, case when event_id % 3 != 0 and event_id % 5 = 0 then 'z' else '' end as unknown, case when event_id % 3 = 0 then 'k' else '' end as missing, case when event_id % 3 != 0 and event_id % 5 = 0 then 'k' else '' end as mistyped from events",
    "macro_snapshot": "select event_type, last(value order by ts, event_id) as value from events where ts <= timestamp '2024-01-20' group by event_type",
}
_FLAG = f"""with {ENGINE}, {ranked('sc', 20)}, nx as (select *, lead(close) over (partition by asset order by ts) as nc from v), o as (select *, {r6("(nc - close) / pip", 2)} as net from nx where nc is not null),
k as (select rk.*, o.net as net_return_pips from rk join o on o.fingerprint_id = rk.match_id), {distribution('k', 'asset, fingerprint_id')}, {forecast('dist', 'fc')},
q as (select fingerprint_id, avg(score) as ms, max(score) - min(score) as sp, avg((score >= 0.8::double)::int) as dn, avg((session = match_session)::int) as mr from k group by fingerprint_id),
cf0 as (select *, {confidence_raw('ms', 'dn', 'sp', '0e0', '0e0')} as rawc, 1 - mr as dv from fc join q using (fingerprint_id)), {V1}
select asset, fingerprint_id, sample_size, up, down, flat, expected_move_pips, direction, {r6('greatest(0, least(1, raw1 * sw * st))')} as confidence_v1 from cf"""
ORACLE_SQL["forecast_flagship"] = _FLAG
