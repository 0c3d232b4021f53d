"""Readers of bar and calendar files, and writers that keep their keys unique."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stamps import parse_stamp
from tidemark.functions.text import impact
from tidemark.operators.joins import insert_new, upsert


def bar_lines(lines: DataFrame, col: str = "value") -> DataFrame:
    """ts_text, open, high, low, close, volume, error of comma-separated lines; lines whose second to fifth fields are all no numbers are headers, blank ones go."""
    f = F.split(F.regexp_replace(F.col(col), "\r$", ""), ",")
    num = lambda i: F.get(f, F.lit(i)).try_cast("double")
    rows = lines.where(F.trim(col) != "").select(f.alias("_f"), *[num(i).alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"), 1)])
    header = F.coalesce(*[F.col(c) for c in ("open", "high", "low", "close")]).isNull()
    rows = rows.where(~header)
    bad = F.when(F.size("_f") < 6, "too few fields").when(F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in ("open", "high", "low", "close", "volume")]) != "", "not a number")
    return rows.select(F.get("_f", F.lit(0)).alias("ts_text"), "open", "high", "low", "close", "volume", bad.alias("error"))


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    return bar_lines(spark.read.text(path)).withColumn("ts", parse_stamp(F.col("ts_text")))


def bar_line(ts: Column, *numbers: str) -> Column:
    """The line of a bar: DD.MM.YYYY HH:MM:SS.mmm and its numbers."""
    return F.concat_ws(",", F.date_format(ts, "dd.MM.yyyy HH:mm:ss.SSS"), *[F.col(c).cast("string") for c in numbers])


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """event_date, name, currency, actual, estimate, previous of a CSV with a header; dates alone mean 09:00, rows without date or name go."""
    df = spark.read.csv(path, header=True)
    col = lambda c: F.nullif(F.nullif(F.trim(c), F.lit("")), F.lit("-")) if c in df.columns else F.lit(None).cast("string")
    ts = col("timestamp")
    ts = F.when(ts.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(ts, F.lit(" 09:00:00"))).otherwise(F.regexp_replace(F.regexp_replace(ts, "T", " "), "Z$", ""))
    num = lambda c: col(c).try_cast("double")
    out = df.select(F.try_to_timestamp(ts).cast("timestamp_ntz").alias("event_date"), col("name").alias("name"), F.coalesce(col("currency"), F.lit("USD")).alias("currency"), num("actual").alias("actual"), num("estimate").alias("estimate"), num("previous").alias("previous"))
    return out.where("event_date is not null and name is not null")


def read_positional_calendar(spark: SparkSession, path: str, now: str) -> DataFrame:
    """event_date, name, impact, actual, estimate, previous, currency of lines whose fields stand in the order time, name, impact, actual, estimate, previous, currency, no more than a day from ``now``.

    Lines of fewer than four fields and without a time (the header) go; the impact follows from the name; a missing currency is USD.
    """
    f = F.split(F.regexp_replace("value", "\r$", ""), ",")
    at = lambda i: F.nullif(F.trim(F.get(f, F.lit(i))), F.lit(""))
    when = F.coalesce(F.try_to_timestamp(at(0)), parse_stamp(at(0)))
    num = {c: at(i).try_cast("double").alias(c) for i, c in ((3, "actual"), (4, "estimate"), (5, "previous"))}
    df = spark.read.text(path).where(F.size(f) >= 4).select(when.cast("timestamp_ntz").alias("event_date"), F.coalesce(at(1), F.lit("")).alias("name"), *num.values(), F.coalesce(at(6), F.lit("USD")).alias("currency"))
    day, now_ = F.expr("interval 1 day"), F.lit(now).cast("timestamp_ntz")
    return df.where(F.col("event_date").between(now_ - day, now_ + day)).withColumn("impact", impact(F.col("name")))


def import_new(spark: SparkSession, path: str, new: DataFrame, key: list[str]) -> tuple[int, int]:
    """Appends rows with new keys to a Parquet table, for one writer at a time; how many came in and how many were there already."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.parquet(path)
        return spark.read.parquet(path).count(), 0
    total = new.count()
    fresh = new.join(old.select(*key), key, "left_anti").select(old.columns)
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n, total - n


def overwrite_keys(spark: SparkSession, path: str, staging: str, new: DataFrame, key: list[str]) -> None:
    """new over the table at path, by key; the table is staged, then replaced, never read and overwritten at once. If the second write fails, the whole new table is at ``staging``: write it to path again."""
    upsert(spark.read.parquet(path), new, key).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").parquet(path)


__all__ = ["bar_line", "bar_lines", "import_new", "insert_new", "overwrite_keys", "parse_stamp", "read_bars", "read_calendar", "read_positional_calendar"]
