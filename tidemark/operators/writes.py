"""Tables that operators write into the shared folder, to be read more than once or to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from tidemark.session import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of its own in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_made: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def once(spark: SparkSession, of: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` made of the inputs ``of``, written when it is first asked for and read from then on, within an application; made anew if its folder is gone."""
    key = (spark.sparkContext.applicationId, of, name)
    if key in _made:
        path, schema = _made[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    df = make()
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[key] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)
