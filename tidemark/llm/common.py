"""Helpers that the operators share: shared storage, text measures, bounded broadcasts, ranks without hot tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Rows up to which a narrow side (ids, hashes, a few numbers) is broadcast; a hundred bytes a row at most, so 20 MB.
BROADCAST_ROWS = 200_000

#: Cells into which ``ranked`` deals a group: at most so many, and about so many rows in each below that.
MOST_CELLS, CELL_ROWS = 65_536, 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, held in the shared folder, without lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for wide rows that are read more than once by few columns."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


#: Rows of a key above which it is dealt out; at least, and as a part of all rows, so that there are at most 10,000 such keys.
LIGHT, MOST_HEAVY = 64, 10_000


def dealt_join(many: DataFrame, one: DataFrame, key: str, by: Column | str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """many joined with one, which has at most one row for a key, so that no task gets all rows of a heavy key.

    Heavy keys of many are dealt into salts by the column ``by``, and their rows of one are
    copied to each salt. ``counts`` (key, n) saves counting. Keys are not null.
    """
    if counts is None:
        counts = many.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows, most = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    light = max(LIGHT, rows // MOST_HEAVY)
    if most <= light:
        return many.join(one, key, how)
    heavy = cut(counts.where(F.col("n") > light).select(key, F.ceil(F.col("n") / light).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    many = many.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    one = one.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return many.join(one, [key, "_salt"], how).drop("_salt")


def key_join(many: DataFrame, one: DataFrame, key: str, how: str = "inner", by: Column | str | None = None, rows: int | None = None) -> DataFrame:
    """many joined with one, a narrow table with a row for a key: by broadcast if its counted rows are within the bound, else with heavy keys dealt out."""
    if (one.count() if rows is None else rows) <= BROADCAST_ROWS:
        return many.join(F.broadcast(one), key, how)
    return dealt_join(many, one, key, F.monotonically_increasing_id() if by is None else by, how)


def words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A double in (0, 1) from the first 13 hex digits of an MD5, the same in any engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def cells(rows: int) -> int:
    return max(1, min(MOST_CELLS, rows // CELL_ROWS))


def ranked(df: DataFrame, group: str, unit: str, order: list[str], amount: str, rows: int) -> DataFrame:
    """df with ``before``: the sum of ``amount`` over the rows of its group that stand before it.

    ``unit`` (0 to 1) must rise with ``order``. Groups are dealt into cells by it, so
    that no task holds a whole group: cell sums are added up first, and only the rows
    of one cell are sorted together.
    """
    n = cells(rows)
    at = df.withColumn("_cell", F.least(F.floor(F.col(unit) * n), F.lit(n - 1)).cast("int"))
    sums = at.groupBy(group, "_cell").agg(F.sum(amount).alias("_sum"))
    w = Window.partitionBy(group).orderBy("_cell")
    sums = sums.select(group, "_cell", (F.sum("_sum").over(w) - F.col("_sum")).alias("_offset"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = at.join(sums, [group, "_cell"])
    return out.withColumn("before", F.col("_offset") + F.sum(amount).over(inside) - F.col(amount)).drop("_cell", "_offset")
