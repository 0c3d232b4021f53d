"""Support and resistance levels of the last 120 bars, and their 40 summary components.

Candidates are swing highs and lows and the edges of large bodies. They are clustered by
price, each cluster anchored at its lowest price, which depends on the order; that fold
and what follows from it run in NumPy. An asset's bars are dealt into blocks, each with the
120 bars before it, so that tasks hold a block, every bar is sent once or twice, and the
window slides inside the block.

Levels are ranked by 2 * rejections + touches - breakouts, then by price; at most 20 stay.
Without a level all components are 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .joins import blocked

WINDOW, LEAST, MOST_LEVELS = 120, 30, 20
CLUSTER_PIPS, TOUCH_PIPS, BODY = 5.0, 3.0, 0.6
#: Bars of a block.
BLOCK = 512
NAMES = ("price", "kind", "touches", "rejections", "breakouts", "strength", "age", "distance_pips", "importance")
LEVEL = "array<struct<price:double,kind:string,touches:int,rejections:int,breakouts:int,strength:double,age:int,distance_pips:double,importance:double>>"


def js_round(x, digits: int):
    return np.floor(np.asarray(x, float) * 10**digits + 0.5) / 10**digits


def mean(x) -> float:
    return float(js_round(np.sum(x), 9)) / len(x)


def clustered(prices: np.ndarray, width: float) -> np.ndarray:
    """Where clusters of ascending prices begin: a new one beyond ``width`` from the first price of the last."""
    starts, at = [], 0
    while at < len(prices):
        starts.append(at)
        at += int(np.searchsorted(prices[at:] - prices[at], width, side="right"))
    return np.array(starts, np.int64)


def levels(o, h, lo, c, pip: float) -> list[tuple]:
    """The levels of one window, best first."""
    n, inner = len(c), np.arange(1, len(c) - 1)
    tops = inner[(h[1:-1] > h[:-2]) & (h[1:-1] > h[2:])]
    bottoms = inner[(lo[1:-1] < lo[:-2]) & (lo[1:-1] < lo[2:])]
    body = np.flatnonzero((h > lo) & (np.abs(c - o) > BODY * (h - lo)))
    price = np.concatenate([h[tops], lo[bottoms], np.minimum(o, c)[body], np.maximum(o, c)[body]])
    if not len(price):
        return []
    at = np.concatenate([tops, bottoms, body, body])
    support = np.repeat([0, 1, 1, 0], [len(tops), len(bottoms), len(body), len(body)])
    order = np.argsort(price, kind="stable")
    price, at, support = price[order], at[order], support[order]
    starts = clustered(price, CLUSTER_PIPS * pip)
    size = np.diff(np.append(starts, len(price)))
    middle = js_round(js_round(np.add.reduceat(price, starts), 8) / size, 5)  # no trace of the order of the sum in the last digit
    first, share = np.minimum.reduceat(at, starts), np.add.reduceat(support, starts) / size
    near = TOUCH_PIPS * pip
    touch = (lo <= middle[:, None] + near) & (h >= middle[:, None] - near)
    met, back = touch.sum(1), (touch & (np.abs(c - middle[:, None]) <= near)).sum(1)
    touches, out = np.maximum(1, met), met - back
    best = np.lexsort((middle, -(2 * back + touches - out)))[:MOST_LEVELS]
    strength, distance = back / touches, js_round(np.abs(middle - c[-1]) / pip, 2)
    raw = strength[best] / np.maximum(distance[best], 1.0)
    weight = js_round(raw / raw.sum() if raw.sum() > 0 else np.full(len(best), 1 / len(best)), 6)
    weight[int(np.argmax(weight))] += 1 - weight.sum()
    weight = js_round(weight, 6)
    kind = np.where(share > 0.65, "support", np.where(share < 0.35, "resistance", "flip_zone"))
    return [(float(middle[k]), str(kind[k]), int(touches[k]), int(back[k]), int(out[k]), float(strength[k]), int(n - first[k]), float(distance[k]), float(w)) for k, w in zip(best, weight, strict=True)]


def vector(rows: list[tuple], n: int) -> list[float]:
    """Forty components in [0, 1] of the levels of a window of n bars.

    Number over 20; shares of supports, resistances, flip zones; minimum, maximum, mean and
    deviation of strength, distance / 500, age / n, touches / n, rejections / n, breakouts / n
    and importance; shares of the levels by quarter of the span from the lowest level's price
    to the highest one's (all in the first if there is no span); mean of the five largest
    strengths; share of flip zones; share of levels within 20 pips; and 1 - |resistances -
    supports| / (both), counted away from the price, 0.5 if there are none.
    """
    if not rows:
        return [0.0] * 40
    price, kind, touches, back, broke, strength, age, distance, weight = (np.array(x) for x in zip(*rows, strict=True))
    out = [len(rows) / MOST_LEVELS, *[(kind == k).mean() for k in ("support", "resistance", "flip_zone")]]
    for x, scale in ((strength, 1), (distance, 500), (age, n), (touches, n), (back, n), (broke, n), (weight, 1)):
        out += [v / scale for v in (x.min(), x.max(), mean(x), x.std())]
    low, high = price.min(), price.max()
    quarter = np.minimum(np.floor((price - low) / (high - low) * 4), 3) if high > low else np.zeros(len(rows))
    out += [(quarter == k).mean() for k in range(4)]
    up, down = (int(((kind == k) & (distance > 0)).sum()) for k in ("resistance", "support"))
    balance = 1 - abs(up - down) / (up + down) if up + down else 0.5
    out += [mean(np.sort(strength)[::-1][:5]), out[3], (distance <= 20).mean(), balance]
    return [float(x) for x in np.clip(js_round(out, 6), 0, 1)]


def topology(candles: DataFrame, include_current: bool = True) -> DataFrame:
    """asset, ts, levels, vector for bars with 30 bars or more in their window of at most 120, the bar itself in it or not."""
    columns = ["ts", "open", "high", "low", "close", "pip"]

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("_n", ignore_index=True)
        o, h, lo, c = (b[x].to_numpy(float) for x in ("open", "high", "low", "close"))
        out = []
        for k in np.flatnonzero(b["_own"].to_numpy()):
            stop = k + 1 if include_current else k
            w = slice(max(0, stop - WINDOW), stop)
            if w.stop - w.start < LEAST:
                continue
            rows = levels(o[w], h[w], lo[w], c[w], float(b["pip"][k]))
            out.append((b["asset"][k], b["ts"][k], [dict(zip(NAMES, r, strict=True)) for r in rows], vector(rows, w.stop - w.start)))
        return pd.DataFrame(out, columns=["asset", "ts", "levels", "vector"])

    dealt = blocked(candles.select("asset", *columns), ["asset"], "ts", BLOCK, WINDOW)
    return dealt.groupBy("asset", "_block").applyInPandas(run, f"asset string, ts timestamp_ntz, levels {LEVEL}, vector array<double>")
