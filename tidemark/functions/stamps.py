"""Timestamps in the formats of bar files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats, all in UTC. A text has one of them as a whole.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH:mm:ss", "dd.MM.yyyy HH:mm:ss.SSS")


def parse_stamp(text: Column) -> Column:
    """Null for any other format."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in FORMATS])
