"""Row numbers that never sort a whole group, or the whole table, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: rows that one task sorts, about
ROWS_PER_BUCKET = 1_000_000


def salt_bucket(key: Column, buckets: int = 4096, seed: str = "salt") -> Column:
    """A bucket in [0, buckets), buckets <= 65536, from four hex digits of MD5."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), F.lit(seed)).cast("binary"))
    return (F.conv(F.substring(digest, 1, 4), 16, 10).cast("bigint") * buckets / 65536).cast("int")


def group_positions(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[Column | str],
    position: str = "position",
    size: str | None = None,
) -> DataFrame:
    """0-based position of every row in its group, ordered by (bucket, order).

    A group is cut into buckets; a row is numbered inside its bucket and moved up by the rows in
    earlier buckets. Only bucket counts are ever put in sequence, so a group that holds a third of
    the table is still spread over its buckets. ``keys`` must not be NULL.
    """
    rows = df.withColumn("_bucket", bucket)
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_bucket")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    offsets = counts.select(
        *keys,
        "_bucket",
        (F.sum("_n").over(earlier) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias("_size"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = rows.withColumn("_rn", F.row_number().over(inside))
    joined = numbered.join(offsets, [*keys, "_bucket"])
    out = joined.withColumn(position, (F.col("_offset") + F.col("_rn") - 1).cast("bigint"))
    if size:
        out = out.withColumn(size, F.col("_size").cast("bigint"))
    return out.drop("_bucket", "_rn", "_offset", "_size")


def sequence_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[Column | str] = (),
    position: str = "position",
    size: str | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """0-based position of every row in its group by a numeric column, then ``ties``, for groups of any size.

    Groups are counted first. Those of more than ``rows_per_bucket`` rows are cut at quantiles of the column into buckets of about that
    many; the others are one bucket. Rows of equal ``order`` stay in one bucket. ``keys`` must not be NULL.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    large = counts.where(F.col("_rows") > rows_per_bucket)
    # groups that large are few: one for each million rows at most
    cut = df.join(F.broadcast(large), [*keys]).groupBy(*keys).agg(
        F.percentile_approx(order, [i / 1024 for i in range(1, 1024)], 10_000).alias("_q"), F.first("_rows").alias("_rows")
    )
    step = F.greatest(F.lit(1), F.floor(F.lit(1024 * rows_per_bucket) / F.col("_rows"))).cast("int")
    borders = cut.select(*keys, F.array_distinct(F.filter("_q", lambda q, i: (i + 1) % step == 0)).alias("_borders"))
    marked = df.join(F.broadcast(borders), [*keys], "left")
    # the borders ascend, so the number of those below a row is found by halving
    bucket = F.when(F.col("_borders").isNull(), F.lit(0)).otherwise(_count_up_to("_borders", F.col(order)))
    placed = group_positions(marked, keys, bucket, [order, *ties], position, size)
    return placed.drop("_borders")


def _count_up_to(borders: str, x: Column) -> Column:
    """How many of at most 1,023 ascending borders are not above ``x``, in ten steps."""
    steps = F.array(*[F.lit(1 << k) for k in range(9, -1, -1)])

    def further(found: Column, step: Column) -> Column:
        at = found + step
        return F.when((at <= F.size(borders)) & (F.get(borders, at - 1) <= x), at).otherwise(found)

    return F.aggregate(steps, F.lit(0), further)


def global_positions(
    df: DataFrame, order: str, position: str = "position", buckets: int | None = None
) -> DataFrame:
    """0-based position of every row by a numeric, unique column, over the whole table.

    Splitters come from ``approx_percentile``; they are data, not partition numbers, so a
    recomputed task gives the same answer. There is a bucket for about a million rows.
    """
    buckets = buckets or max(16, -(-df.count() // ROWS_PER_BUCKET))
    points = [i / buckets for i in range(1, buckets)]
    splits = df.agg(F.percentile_approx(order, points, max(10_000, 40 * buckets)).alias("s")).first()["s"] or []
    splits = sorted(set(splits))
    if splits:
        borders = F.array(*[F.lit(s) for s in splits])
        bucket = F.size(F.filter(borders, lambda s: s <= F.col(order)))
    else:
        bucket = F.lit(0)
    return group_positions(df, [], bucket, [order], position)
