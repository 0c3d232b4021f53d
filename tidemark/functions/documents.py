"""JSON documents and vectors as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(doc: Column) -> Column:
    """JSON with keys in order at every depth and no white space, -0 as 0; null for a null or malformed document."""
    text = F.to_json(F.try_parse_json(doc))
    return F.regexp_replace(text, r"(?<=[:\[,])-0(?:\.0*)?(?=[,\]}])", "0")


def lenient_vector(text: Column) -> Column:
    """The numbers of a JSON array; an empty array for null and for anything else."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def half_even(x: Column, digits: int = 0) -> Column:
    """Halves go to the even neighbour, on the decimal digits of x."""
    return F.bround(x.cast("decimal(20,8)"), digits).cast("double")
