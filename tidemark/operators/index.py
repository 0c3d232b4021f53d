"""An index of states by layer, so that a search reads a few lists of it instead of an asset's whole history.

For each of the five layers centres are learned (k-means on a bounded sample); every state is in
the list of its nearest centre, for each layer. A query reads the lists of its nearest centres,
layer by layer, until they are expected to hold ``reach`` states of its group (asset, or asset and
regime), and every state it meets there is scored exactly, over all layers. So scores are those of
the full search; what may be missed are states that share no list with the query in any layer.
Groups of up to ``reach`` states are searched whole.

A state is sent once for each layer, and as a query once for each list that it reads, whatever
the length of history. Lists are cut into spans and their queries into blocks, as in
``similarity.search``, so a list with very many equal states is no single task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import numbered
from .similarity import BLOCK, FOUND, SPAN, WIDTHS, best, packed, scorer, unpacked
from .writes import written


@dataclass(frozen=True)
class Index:
    #: States at most, about, from which centres are learned: by a hash of their ids.
    sample: int = 20_000
    steps: int = 10
    #: States of its group that a query reads in each layer, about, and the lists that hold them in the largest group.
    reach: int = 400
    lists: int = 4
    #: Lists of a layer, at most.
    most: int = 4096
    seed: int = 42


def _prepared(x: np.ndarray, euclid: bool) -> np.ndarray:
    """Rows as they are compared: of length one for the cosine, since then the nearest centre is the most alike."""
    if euclid:
        return x
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1.0)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


def centres(x: np.ndarray, n: int, how: Index) -> np.ndarray:
    """At most n centres of the rows of x: k-means from distinct rows; a centre that loses all its rows moves to the row farthest from its own."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(how.seed)
    at = x[rng.permutation(len(x))[:n]].copy()
    for _ in range(how.steps):
        d = _distances(x, at)
        own = d.argmin(1)
        sums, counts = np.zeros_like(at), np.bincount(own, minlength=len(at))
        np.add.at(sums, own, x)
        far = iter(np.argsort(-d[np.arange(len(x)), own]))
        for i in range(len(at)):
            at[i] = sums[i] / counts[i] if counts[i] else x[next(far)]
    return at


def trained(states: DataFrame, rows: int, largest: int, topology_weight: float, euclid: tuple[int, ...], how: Index) -> list[np.ndarray]:
    """The centres of each layer, learned in one task a layer; so many that the largest group has ``reach`` states in ``lists`` of them."""
    n = int(min(how.most, max(1, largest * how.lists // how.reach)))
    some = states.where(F.pmod(F.xxhash64("fingerprint_id"), F.lit(max(1, -(-rows // how.sample)))) == 0)
    each = some.select(F.explode(F.sequence(F.lit(0), F.lit(len(WIDTHS) - 1))).alias("layer"), "v")

    def learn(b: pd.DataFrame) -> pd.DataFrame:
        layer = int(b["layer"].iloc[0])
        found = centres(_prepared(unpacked(b["v"], topology_weight)[layer], layer + 1 in euclid), n, how)
        return pd.DataFrame({"layer": layer, "v": list(found)})

    learned: dict[int, list] = {i: [] for i in range(len(WIDTHS))}
    for r in each.groupBy("layer").applyInPandas(learn, "layer int, v array<double>").collect():
        learned[r["layer"]].append(r["v"])
    return [np.array(v or [[0.0] * w]) for v, w in zip(learned.values(), WIDTHS, strict=True)]


def indexed(states: DataFrame, model: list[np.ndarray], topology_weight: float, euclid: tuple[int, ...]) -> DataFrame:
    """states with ``lists``, the number of each layer's list."""

    @F.pandas_udf("array<int>")
    def nearest(v: pd.Series) -> pd.Series:
        own = [_distances(_prepared(x, i in euclid), at).argmin(1) for i, (x, at) in enumerate(zip(unpacked(v, topology_weight), model), 1)]
        return pd.Series(list(np.array(own, np.int32).T))

    return states.withColumn("lists", nearest("v"))


def probed(states: DataFrame, model: list[np.ndarray], totals: list[np.ndarray], topology_weight: float, euclid: tuple[int, ...], how: Index) -> DataFrame:
    """states with ``probes``, the lists (layer, list) that each reads as a query, nearest first. ``_share``: the part of all states that its group has."""

    @F.pandas_udf("array<struct<layer:int,list:int>>")
    def wanted(share: pd.Series, v: pd.Series) -> pd.Series:
        out: list[list[dict]] = [[] for _ in share]
        for i, (x, at, n) in enumerate(zip(unpacked(v, topology_weight), model, totals), 1):
            order = np.argsort(_distances(_prepared(x, i in euclid), at), axis=1, kind="stable")
            before = np.cumsum(n[order], axis=1) - n[order]
            for row, (lists, some) in enumerate(zip(order, before * share.to_numpy()[:, None] < how.reach, strict=True)):
                out[row] += [{"layer": i, "list": int(x)} for x in lists[some]]
        return pd.Series(out)

    return states.withColumn("probes", wanted("_share", "v"))


def search(states: DataFrame, keys: list[str], k: int, euclid: tuple[int, ...] = (), bonus: bool = False, topology_weight: float = 0.0, how: Index = Index()) -> DataFrame:
    """As ``similarity.search``, over the lists that the queries read."""
    df = numbered(packed(states, keys, topology_weight), keys, "ts").drop("ts")
    cols = [c for c in df.columns if c != "_n"]
    df = written(df.withColumn("_own", F.count(F.lit(1)).over(Window.partitionBy(*keys))), "states")
    rows, largest = df.agg(F.count(F.lit(1)), F.coalesce(F.max("_own"), F.lit(0))).first()
    whole = F.col("_own") <= how.reach
    model = trained(df, rows, largest, topology_weight, euclid, how)
    df = written(indexed(df, model, topology_weight, euclid), "index")
    totals = [np.zeros(len(at), np.int64) for at in model]
    for r in df.select(F.posexplode("lists").alias("layer", "list")).groupBy("layer", "list").count().collect():
        totals[r["layer"]][r["list"]] = r["count"]
    cell = ["_layer", "_list"]
    only = F.array(F.struct(F.lit(0).alias("layer"), F.lit(0).alias("list")))
    in_lists = F.transform("lists", lambda x, i: F.struct((i + 1).alias("layer"), x.alias("list")))

    def dealt(of: DataFrame, query: bool, size: int, as_: str) -> DataFrame:
        """Rows by cell, each in a part of ``size`` by its order there."""
        of = of.withColumn("_p", F.explode("_at")).select(*cols, "_n", F.col("_p.layer").alias("_layer"), F.col("_p.list").alias("_list"))
        at = F.floor((F.row_number().over(Window.partitionBy(*keys, *cell).orderBy("_n")) - 1) / size).cast("int")
        return of.withColumns({as_: at, "query": F.lit(query)})

    have = dealt(df.withColumn("_at", F.when(whole, only).otherwise(in_lists)), False, SPAN, "c")
    ask = probed(df.where(~whole).withColumn("_share", F.col("_own") / rows), model, totals, topology_weight, euclid, how).withColumn("_at", F.col("probes"))
    ask = dealt(df.where(whole).withColumn("_at", only).select(*cols, "_n", "_at").unionByName(ask.select(*cols, "_n", "_at")), True, BLOCK, "q")
    parts = lambda of, name: of.groupBy(*keys, *cell).agg(F.max(name).alias("_last"))
    upto = F.explode(F.sequence(F.lit(0), F.col("_last")))
    both = have.join(parts(ask, "q"), [*keys, *cell]).withColumn("q", upto).unionByName(ask.join(parts(have, "c"), [*keys, *cell]).withColumn("c", upto)).drop("_last")
    return best(both.groupBy(*keys, *cell, "q", "c").applyInPandas(scorer(k, euclid, bonus, topology_weight), FOUND), k)


def engine_search(states: DataFrame, k: int = 50, how: Index = Index()) -> DataFrame:
    """``similarity.engine_search`` through the index."""
    return search(states, ["asset", "vol_regime", "trend_regime"], min(k, 50), euclid=(4, 5), how=how)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """By asset: pairs of the exact search, how many of them were found, and their share."""
    pair = ["asset", "fingerprint_id", "match_id"]
    hit = exact.select(*pair).join(found.select(*pair, F.lit(1).alias("hit")), pair, "left")
    g = hit.groupBy("asset").agg(F.count(F.lit(1)).alias("pairs"), F.count("hit").alias("found"))
    return g.withColumn("recall", F.floor(F.col("found") / F.col("pairs") * 1e6 + 0.5) / 1e6)
