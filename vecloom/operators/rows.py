"""Reports of one row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several frames of at most one row, as exactly one row.

    A union and a ``max`` per column put them side by side without any join; a column whose frame
    has no row is NULL.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.agg(*[F.max(F.col(f"`{c}`")).alias(c) for c in rows.columns])
