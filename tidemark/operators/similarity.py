"""The most similar earlier states of every state, within its asset (or within asset and regime).

States are numbered in time. Blocks of queries meet spans of earlier states, each pair of
them in a group of its own, in which NumPy computes similarities as products of matrices,
slice by slice, and keeps the best k of each query; what is left, k rows for each query and
span, is ranked again. A state travels as one run of doubles. So a task holds a block and a span, however long an asset's history
is, and no pair of states ever becomes a row. Scores are rounded to six
digits before they are ranked; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import numbered, top_per_key
from .outcomes import r6

#: Queries of a block, earlier states of a span, and of a slice.
BLOCK, SPAN, SLICE = 1024, 8192, 1024
LAYERS = ("structure", "volatility", "liquidity", "macro", "sentiment")
#: Weights of the layers by volatility; others weigh the same.
WEIGHTS = {"LOW": (0.40, 0.15, 0.30, 0.10, 0.05), "NORMAL": (0.20, 0.15, 0.15, 0.30, 0.20), "HIGH": (0.25, 0.25, 0.15, 0.20, 0.15)}
TOP, TOPOLOGY_WEIGHT, MATCHED = 50, 0.10, 0.6
#: Components of the layers, and of the topology.
WIDTHS, TOPOLOGY = (16, 12, 20, 8, 6), 40
LAYER_COLUMNS = [f"l{i}" for i in range(1, 6)]


def weight(vol: Column, i: int) -> Column:
    out = F.lit(0.2)
    for name, w in WEIGHTS.items():
        out = F.when(vol == name, w[i]).otherwise(out)
    return out


def blended(score: Column, topology: Column, w: float = TOPOLOGY_WEIGHT) -> Column:
    """The score with the topology's similarity mixed in, where there is one."""
    return F.when(topology.isNull() | F.lit(w == 0), score).otherwise(r6((1 - w) * score + w * topology))


def rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e6 + 0.5) / 1e6


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All cosines of rows; 0 where a norm is."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    both = na[:, None] * nb
    return np.where(both > 0, (a @ b.T) / np.where(both > 0, both, 1.0), 0.0)


def closenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 / (1 + distance) of all rows."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):  # differences, not squares of norms, so that equal rows are at distance 0
        out += (a[:, j, None] - b[:, j]) ** 2
    return 1 / (1 + np.sqrt(out))


def of_pairs(a: np.ndarray, b: np.ndarray, euclid: bool) -> np.ndarray:
    """The similarity of each row of a with the same row of b."""
    if euclid:
        return 1 / (1 + np.sqrt(((a - b) ** 2).sum(1)))
    both = np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1))
    return np.where(both > 0, (a * b).sum(1) / np.where(both > 0, both, 1.0), 0.0)


def matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(-1, width)


REGIME = ["vol_regime", "trend_regime", "session"]
FOUND = "asset string, fingerprint_id string, match_id string, score double, s1 double, s2 double, s3 double, s4 double, s5 double, topology_score double, vol_regime string, session string, match_vol_regime string, match_session string"


def scorer(k: int, euclid: tuple[int, ...] = (), bonus: bool = False, topology_weight: float = 0.0):
    """A function of a group of queries and earlier states (told by the column ``query``) to the k best of each query, by FOUND."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        q, c = (b[b["query"] == on].sort_values("_n", ignore_index=True) for on in (True, False))
        x, y = (unpacked(side["v"], topology_weight) for side in (q, c))
        sides = list(zip(x[:5], y[:5], strict=True))
        w = np.array([WEIGHTS.get(v, (0.2,) * 5) for v in q["vol_regime"]]).reshape(len(q), 5)
        shapes = [x[5], y[5]] if topology_weight else None  # rows without a topology are told by their first component
        when_q, when_c, order = q["_n"].to_numpy(), c["_n"].to_numpy(), np.argsort(np.argsort(c["fingerprint_id"].to_numpy().astype(str)))
        rows, cols, scores = [], [], []
        for at in range(0, len(c), SLICE):
            part = slice(at, at + SLICE)
            total = np.zeros((len(q), len(c[part])))
            for i, (x, y) in enumerate(sides):
                total += np.clip((closenesses if i + 1 in euclid else cosines)(x, y[part]), 0, 1) * w[:, i, None]
            total = rounded(np.clip(total, 0, 1))
            if bonus:
                for name, more in (("session", 1.05), ("vol_regime", 1.03)):
                    same = q[name].to_numpy()[:, None] == c[name].to_numpy()[part]
                    total = np.where(same, np.minimum(1.0, total * more), total)
                total = rounded(total)
            if shapes:
                has = ~np.isnan(shapes[0][:, :1]) & ~np.isnan(shapes[1][part, 0])
                t = np.clip(cosines(*(np.nan_to_num(x) for x in (shapes[0], shapes[1][part]))), 0, 1)
                total = np.where(has, rounded((1 - topology_weight) * total + topology_weight * t), total)
            total[when_c[part] >= when_q[:, None]] = -1.0
            least = np.partition(total, -k, axis=1)[:, -k] if total.shape[1] > k else np.zeros(len(q))
            r, m = np.nonzero(total >= np.maximum(least, 0.0)[:, None])
            rows.append(r)
            cols.append(m + at)
            scores.append(total[r, m])
        r, m, score = (np.concatenate([*x, np.zeros(0)]) for x in (rows, cols, scores))
        r, m = r.astype(int), m.astype(int)
        best = np.lexsort((order[m], -score, r)) if len(r) else np.zeros(0, int)
        r, m, score = r[best], m[best], score[best]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, m, score = r[top], m[top], score[top]
        out = {"asset": q["asset"].to_numpy()[r], "fingerprint_id": q["fingerprint_id"].to_numpy()[r], "match_id": c["fingerprint_id"].to_numpy()[m], "score": score}
        out |= {f"s{i}": rounded(np.clip(of_pairs(x[r], y[m], i in euclid), 0, 1)) for i, (x, y) in enumerate(sides, 1)}
        shape = np.full(len(r), np.nan)
        if shapes and len(r):
            x, y = shapes[0][r], shapes[1][m]
            shape = np.where(np.isnan(x[:, 0]) | np.isnan(y[:, 0]), np.nan, rounded(np.clip(of_pairs(np.nan_to_num(x), np.nan_to_num(y), False), 0, 1)))
        out |= {"topology_score": shape, "vol_regime": q["vol_regime"].to_numpy()[r], "session": q["session"].to_numpy()[r], "match_vol_regime": c["vol_regime"].to_numpy()[m], "match_session": c["session"].to_numpy()[m]}
        return pd.DataFrame(out)

    return run


def packed(states: DataFrame, keys: list[str], topology_weight: float) -> DataFrame:
    """What a search takes of a state: ts, keys, ids, regime, and ``v``, the components of its layers (and topology) as one run of doubles, once a state."""
    arrays = [*LAYER_COLUMNS, *(["topology"] if topology_weight else [])]
    cols = [*dict.fromkeys(["ts", *keys, "asset", "fingerprint_id", *REGIME])]

    @F.pandas_udf("binary")
    def pack(l1: pd.Series, l2: pd.Series, l3: pd.Series, l4: pd.Series, l5: pd.Series) -> pd.Series:
        return pd.Series([m.tobytes() for m in np.hstack([matrix(v, w) for v, w in zip((l1, l2, l3, l4, l5), WIDTHS, strict=True)])])

    @F.pandas_udf("binary")
    def pack_shape(l1: pd.Series, l2: pd.Series, l3: pd.Series, l4: pd.Series, l5: pd.Series, topology: pd.Series) -> pd.Series:
        shape = topology.map(lambda v: [np.nan] * TOPOLOGY if v is None else v)
        return pd.Series([m.tobytes() for m in np.hstack([matrix(v, w) for v, w in zip((l1, l2, l3, l4, l5, shape), (*WIDTHS, TOPOLOGY), strict=True)])])

    return states.select(*cols, (pack_shape if topology_weight else pack)(*arrays).alias("v"))


def unpacked(v: pd.Series, topology_weight: float = 0.0) -> list[np.ndarray]:
    """The matrices of the layers, then that of the topology."""
    widths = (*WIDTHS, *([TOPOLOGY] if topology_weight else []))
    m = np.frombuffer(b"".join(v), float).reshape(len(v), sum(widths))
    return np.split(m, np.cumsum(widths)[:-1], axis=1)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k best matches of each state among what the groups found, each match once."""
    found = found.withColumn("topology_score", F.when(~F.isnan("topology_score"), F.col("topology_score")))
    w = Window.partitionBy("asset", "fingerprint_id").orderBy(F.col("score").desc(), "match_id")
    found = found.withColumn("_before", F.lag("match_id").over(w)).where("_before is null or _before != match_id").drop("_before")
    return top_per_key(found, ["asset", "fingerprint_id"], [F.col("score").desc(), F.col("match_id")], k)


def search(states: DataFrame, keys: list[str], k: int, euclid: tuple[int, ...] = (), bonus: bool = False, topology_weight: float = 0.0) -> DataFrame:
    """The k best earlier states of each state among those with the same keys.

    Layers in ``euclid`` are compared by distance, the others by cosine. bonus: the same
    session adds 5 %, then the same volatility 3 %, to at most 1. With a topology weight the
    cosine of the vectors in the column ``topology`` is mixed in where both states have one.
    """
    df = numbered(packed(states, keys, topology_weight), keys, "ts").drop("ts")
    df = df.withColumns({"_b": F.floor(F.col("_n") / BLOCK).cast("int"), "_s": F.floor(F.col("_n") / SPAN).cast("int")})
    df = df.join(df.groupBy(*keys).agg(F.max("_b").alias("_last")), keys)
    as_query = F.transform(F.sequence(F.lit(0), F.col("_s")), lambda c: F.struct(F.col("_b").alias("q"), c.alias("c"), F.lit(True).alias("query")))
    as_match = F.transform(F.sequence(F.col("_b"), F.col("_last")), lambda q: F.struct(q.alias("q"), F.col("_s").alias("c"), F.lit(False).alias("query")))
    df = df.withColumn("_p", F.explode(F.concat(as_query, as_match))).select("*", "_p.*").drop("_p", "_b", "_s", "_last")
    return best(df.groupBy(*keys, "q", "c").applyInPandas(scorer(k, euclid, bonus, topology_weight), FOUND), k)


def engine_search(states: DataFrame, k: int = TOP) -> DataFrame:
    """Only states of the same regime; context layers by distance."""
    return search(states, ["asset", "vol_regime", "trend_regime"], min(k, TOP), euclid=(4, 5))


def batch_search(states: DataFrame, k: int = TOP, topology_weight: float = 0.0) -> DataFrame:
    """All earlier states of the asset by cosine, with the bonus of session and volatility; with a topology weight, blended with the column topology."""
    return search(states, ["asset"], k, bonus=True, topology_weight=topology_weight)


#: Vectors of a block of a search for a set of queries.
ROWS, ASKED = 8192, 2048


def nearest(vectors: DataFrame, asked: Column, k: int, by: Column, euclid: bool = False) -> DataFrame:
    """q_vec_id, vec_id, score, rank: for each vector (vec_id, v) that is asked for, the k nearest others with the same ``by``, by cosine or closeness.

    Exact: blocks of queries meet blocks of vectors, each pair of blocks in a group of its
    own; the best k of each are ranked again. Every vector is sent once for each block of
    queries. Scores are rounded to six digits before they are ranked; ties go to the smaller id.
    """
    df = vectors.select("vec_id", "v", by.alias("_g"), asked.alias("_asked"))
    n = df.groupBy("_g").agg(F.ceil(F.count(F.lit(1)) / ROWS).cast("int").alias("_c"), F.ceil(F.count_if("_asked") / ASKED).cast("int").alias("_q"))
    df = df.join(n.where("_q > 0"), "_g")
    part = lambda of: F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int")
    here = F.transform(F.sequence(F.lit(0), F.col("_q") - 1), lambda q: F.struct(q.alias("q"), part("_c").alias("c"), F.lit(False).alias("query")))
    ask = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda c: F.struct(part("_q").alias("q"), c.alias("c"), F.lit(True).alias("query")))
    df = df.select("_g", "vec_id", "v", F.explode(F.when(F.col("_asked"), F.concat(here, ask)).otherwise(here)).alias("_p")).select("_g", "vec_id", "v", "_p.*")

    def run(b: pd.DataFrame) -> pd.DataFrame:
        q, c = b[b["query"]], b[~b["query"]]
        out = []
        if len(q) and len(c):
            x, y = (np.array(side["v"].tolist(), float) for side in (q, c))
            ids, mine = c["vec_id"].to_numpy(), q["vec_id"].to_numpy()
            for at in range(0, len(q), 256):  # so many rows of scores at once
                score = rounded((closenesses if euclid else cosines)(x[at : at + 256], y))
                for r, row in enumerate(score, at):
                    row = np.where(ids == mine[r], -np.inf, row)
                    some = np.flatnonzero(row >= (np.partition(row, len(row) - k)[len(row) - k] if len(row) > k else -1.5))
                    some = some[np.lexsort((ids[some], -row[some]))[:k]]
                    out.append(pd.DataFrame({"q_vec_id": mine[r], "vec_id": ids[some], "score": row[some]}))
        return pd.concat(out) if out else pd.DataFrame({"q_vec_id": [], "vec_id": [], "score": []})

    kind = dict(vectors.dtypes)["vec_id"]
    found = df.groupBy("_g", "q", "c").applyInPandas(run, f"q_vec_id {kind}, vec_id {kind}, score double")
    return top_per_key(found.where("score >= -1"), ["q_vec_id"], [F.col("score").desc(), F.col("vec_id")], k)


def explained(matches: DataFrame, threshold: float = MATCHED) -> DataFrame:
    """matched and mismatched layers, and the matched layer that contributes most."""
    parts = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"s{i}").alias("s"), (F.col(f"s{i}") * weight(F.col("vol_regime"), i - 1)).alias("c"), F.lit(-i).alias("o")) for i, n in enumerate(LAYERS, 1)])
    df = matches.withColumn("_p", parts)
    names = lambda x: F.array_join(F.transform(x, lambda p: p["name"]), ",")
    hit = F.filter("_p", lambda p: p["s"] >= threshold)
    top = F.array_max(F.transform(hit, lambda p: F.struct(r6(p["c"], 9).alias("c"), p["o"].alias("o"), p["name"].alias("name"))))
    return df.withColumns({"matched": names(hit), "mismatched": names(F.filter("_p", lambda p: p["s"] < threshold)), "reason": F.coalesce(top["name"], F.lit("none"))}).drop("_p")


def explained_briefly(matches: DataFrame, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """matched: which of the price layers are above ``high``; mismatched: which of the context layers are below ``low``; the reason is always the weighted sum."""
    named = lambda hits: F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in hits])), ",")
    s = {n: F.col(f"s{i}") for i, n in enumerate(LAYERS, 1)}
    return matches.withColumns({"matched": named([(n, s[n] > high) for n in LAYERS[:3]]), "mismatched": named([(n, s[n] < low) for n in LAYERS[3:]]), "reason": F.lit("weighted_vector_similarity")})


def merged_layers(layers: list[DataFrame]) -> DataFrame:
    """id and s1 ... of several searches (id, score), 0 where one did not return the id: a full outer merge by one aggregation."""
    tagged = None
    for i, d in enumerate(layers, 1):
        one = d.select("id", *[F.when(F.lit(i == j), F.col("score")).alias(f"s{j}") for j in range(1, len(layers) + 1)])
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("id").agg(*[F.coalesce(F.max(f"s{j}"), F.lit(0.0)).alias(f"s{j}") for j in range(1, len(layers) + 1)])
