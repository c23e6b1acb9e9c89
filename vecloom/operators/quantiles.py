"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import materialize

#: a sketch's rank error is at most one in so many rows; groups whose brackets may be broadcast
ACCURACY, BROADCAST_GROUPS = 10_000, 100_000
#: share of a group on either side of a point that its bracket takes in, by the rows of the group; smaller groups are sorted whole
MARGINS = ((1_000_000, 2.0 / ACCURACY), (1_000, 0.005))


def exact_quantiles(
    df: DataFrame,
    value: str,
    points: Sequence[float],
    keys: Sequence[str] = (),
) -> DataFrame:
    """``keys, q`` with one number per point, equal to interpolating the sorted values.

    Two passes, and no shuffle of all values. The first merges quantile sketches, whose error bound gives a bracket of values around
    each point. The second counts what lies below a bracket, where the rows are, and sorts only the distinct values
    inside: a few of ``ACCURACY`` parts of a group. A bracket that missed its rank would raise, not mislead.
    """
    # one struct column stands for the keys, so NULL keys form a group like any other
    rows = df.where(F.col(value).isNotNull()).select(
        F.struct(F.lit(0).alias("_"), *keys).alias("g"), F.col(value).cast("double").alias("x")
    )
    fractions = [min(1.0, max(0.0, p + side * margin)) for p in points for side in (-1, 1) for _, margin in MARGINS]
    sketch = rows.groupBy("g").agg(F.percentile_approx("x", fractions, ACCURACY).alias("b"), F.count(F.lit(1)).alias("n"))
    few = True
    if keys:
        sketch = materialize(sketch, "quantile-brackets")
        few = sketch.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS

    def border(at: int, point: float, side: int) -> Column:
        out = F.when(F.lit(False), F.lit(0.0))
        for k, (least, margin) in enumerate(MARGINS):
            value = F.get("b", F.lit(len(MARGINS) * at + k)) if 0 < point + side * margin < 1 else F.lit(None).cast("double")
            out = out.when(F.col("n") >= least, value)
        return out

    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                (F.lit(float(p)) * (F.col("n") - 1)).alias("at"),
                border(2 * i, p, -1).alias("lo"),
                border(2 * i + 1, p, 1).alias("hi"),
            )
            for i, p in enumerate(points)
        ]
    )
    asked = sketch.select("g", brackets.alias("brackets"))
    met = rows.join(F.broadcast(asked) if few else asked, "g").select("g", "x", F.explode("brackets").alias("w"))
    below = F.coalesce(F.col("x") < F.col("w.lo"), F.lit(False))
    above = F.coalesce(F.col("x") > F.col("w.hi"), F.lit(False))
    # what is below a bracket is one row of it, without a value
    placed = met.where(~above).select("g", "w.i", "w.at", F.when(~below, F.col("x")).alias("x"))
    counts = placed.groupBy("g", "i", "at", "x").agg(F.count(F.lit(1)).alias("c"))
    line = Window.partitionBy("g", "i").orderBy(F.asc_nulls_first("x")).rowsBetween(Window.unboundedPreceding, 0)
    spans = counts.withColumn("to", F.sum("c").over(line)).where(F.col("x").isNotNull())
    floor, ceil = F.floor("at"), F.ceil("at")
    holds = lambda rank: ((rank >= F.col("to") - F.col("c")) & (rank < F.col("to"))).cast("int")
    part = F.col("at") - floor
    weight = holds(floor) * (1 - part) + holds(ceil) * part
    missed = F.raise_error(F.lit("a quantile sketch was outside its error bound")).cast("double")
    total = F.sum(F.when(weight > 0, F.col("x") * weight))
    values = spans.groupBy("g", "i").agg(F.when(F.sum(weight) > 1 - 1e-9, total).otherwise(missed).alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"])
    return values.groupBy("g").agg(listed.alias("q")).select(
        *[F.col("g")[k].alias(k) for k in keys], "q"
    )
