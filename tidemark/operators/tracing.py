"""Traces of stages: rows and an order-free hash of what each gives, taken in the job that writes it."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .writes import written

RECORD = "position int, stage string, rows long, digest decimal(38,0), seconds double, error string"


def digest(df: DataFrame):
    """The sum of all rows' hashes, columns by name: equal rows in any order and partitioning give the same (an aggregate)."""
    return F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


class Trace:
    """Collects a record of each stage that goes through it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.records = spark, []

    def stage(self, name: str, make) -> DataFrame:
        """What ``make`` gives, written and read again; its rows are counted and hashed on the way, without another pass. A failure is recorded and raised."""
        began, seen, error, got = time.perf_counter(), Observation(), None, {}
        try:
            df = make()
            out = written(df.observe(seen, F.count(F.lit(1)).alias("rows"), digest(df).alias("digest")), "stage")
            got = seen.get
        except Exception as e:
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
            raise
        finally:
            self.records.append((len(self.records), name, got.get("rows"), got.get("digest"), round(time.perf_counter() - began, 3), error))
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.records, RECORD)
