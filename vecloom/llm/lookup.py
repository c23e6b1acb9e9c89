"""Rows of chosen ids, by a broadcast while the ids are few and by a shuffle beyond."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ids that may be broadcast
BROADCAST_IDS = 1_000_000


def rows_of(source: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``source`` whose ``key`` is in ``ids`` (which has that column and is counted here)."""
    wanted = ids.select(key).distinct()
    return source.join(F.broadcast(wanted) if ids.count() <= BROADCAST_IDS else wanted, key, "left_semi")
