"""Joins and writes that Spark has no operator for, as compositions of equi joins, windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, marks: DataFrame, on: list[str], at: str, mark: str, before: int, after: int, step: int = 14_400) -> DataFrame:
    """Pairs with ``mark - before <= at <= mark + after`` (seconds): marks, the fewer, are dealt into all bins of ``step`` seconds that they look into, and joined with the points by bin."""
    sec = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    low, high = F.floor((sec(mark) - before) / step), F.floor((sec(mark) + after) / step)
    dealt = marks.withColumn("_bin", F.explode(F.sequence(low, high)))
    out = points.withColumn("_bin", F.floor(sec(at) / step)).join(dealt, [*on, "_bin"])
    near = (sec(at) >= sec(mark) - before) & (sec(at) <= sec(mark) + after)
    return out.where(near).drop("_bin")


def numbered(df: DataFrame, key: list[str], ts: str) -> DataFrame:
    """df with _n: 0, 1, ... in time order within a key. A key's rows are sorted in one task: they must be bounded, as bars on a time grid are."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(ts)) - 1)


def blocked(df: DataFrame, key: list[str], ts: str, size: int, back: int) -> DataFrame:
    """df with _n (order in the key), _block and _own: rows in blocks of ``size``, each with copies (not _own) of the ``back`` rows before it."""
    if back > size:
        raise ValueError("a block must hold what the next one looks back on")
    df = numbered(df, key, ts)
    block = F.floor(F.col("_n") / size)
    here, on = F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own"))
    late = F.col("_n") % size >= size - back
    df = df.withColumn("_at", F.explode(F.when(late, F.array(here, on)).otherwise(F.array(here))))
    return df.select(*[c for c in df.columns if c != "_at"], F.col("_at.b").alias("_block"), F.col("_at.own").alias("_own"))


def asof_next(df: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """The row's columns and those of the next row of its key, null behind the last."""
    w = Window.partitionBy(key).orderBy(ts)
    return df.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in cols])


def top_per_key(df: DataFrame, key: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col(rank) <= k)


def insert_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old and those of new whose key it lacks."""
    return old.unionByName(new.join(old.select(*key), key, "left_anti").select(old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """new over old: the last write of a key wins."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    return top_per_key(both, key, [F.col("_v").desc()], 1, "_r").drop("_v", "_r")


def first_of_each(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per_key(df, key, order, 1, "_r").drop("_r")


def updated(df: DataFrame, updates: DataFrame, key: list[str], col: str) -> DataFrame:
    """df with ``col`` replaced where updates has a value for the key."""
    new = updates.select(*key, F.col(col).alias("_new"))
    return df.join(new, key, "left").withColumn(col, F.coalesce("_new", col)).drop("_new")


def first_available(sources: list[DataFrame], key: list[str]) -> DataFrame:
    """For each key the row of the first source that has it, with the source's rank and how many have one."""
    tagged = sources[0].withColumn("source_rank", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        tagged = tagged.unionByName(s.withColumn("source_rank", F.lit(i)))
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return top_per_key(tagged.withColumn("sources", n), key, [F.col("source_rank")], 1, "_r").drop("_r")
