"""Numeric summaries, gates and report flattening."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom import fixed_values as fixed
from vecloom.operators.quantiles import exact_quantiles
from vecloom.operators.rows import one_row


def latency_summary(timings: DataFrame, value: str, keys: Sequence[str] = (), exact: bool = True, **kwargs) -> DataFrame:
    """p50, p90, p95, min and mean. ``exact=False`` uses the mergeable quantile sketch.

    Further arguments go to ``exact_quantiles``.
    """
    points = (0.5, 0.9, 0.95)
    named = [F.col("q")[i].alias(name) for i, name in enumerate(("p50", "p90", "p95"))]
    ends = [F.min(value).alias("min"), F.avg(value).alias("mean")]
    if not exact:
        sketch = F.percentile_approx(value, list(points)).alias("q")
        return timings.groupBy(*keys).agg(sketch, *ends).select(*keys, *named, "min", "mean")
    quantiles = exact_quantiles(timings, value, points, keys, **kwargs)
    plain = timings.groupBy(*keys).agg(*ends)
    both = plain.join(quantiles, list(keys)) if keys else one_row(plain, quantiles)
    return both.select(*keys, *named, "min", "mean")


def epoch_means(batches: DataFrame, epoch: str, value: str, keys: Sequence[str] = ()) -> DataFrame:
    return batches.groupBy(*keys, epoch).agg(F.avg(value).alias("mean"))


def best_checkpoint(epochs: DataFrame, run: str, epoch: str, metric: str, start: float = -1.0) -> DataFrame:
    """The epoch with the highest metric above ``start`` per run; the first one wins ties.

    A min over a struct, so partial results combine before the shuffle.
    """
    better = epochs.where(F.col(metric) > start)
    best = better.groupBy(run).agg(
        F.min(F.struct((-F.col(metric)).alias("minus"), F.col(epoch).alias("epoch"))).alias("b")
    )
    return best.select(run, F.col("b.epoch").alias("best_epoch"), (-F.col("b.minus")).alias("best_metric"))


def running_best(epochs: DataFrame, run: str, epoch: str, metric: str, start: float = -1.0) -> DataFrame:
    """Best metric so far and whether the epoch improved on it. One row per (run, epoch) goes in."""
    before = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prior = F.greatest(F.coalesce(F.max(metric).over(before), F.lit(start)), F.lit(start))
    out = epochs.withColumn("_prior", prior)
    return out.select(
        run,
        epoch,
        metric,
        F.greatest(F.col("_prior"), F.col(metric)).alias("best_so_far"),
        (F.col(metric) > F.col("_prior")).alias("improved"),
    )


def flatten_report(report: DataFrame) -> DataFrame:
    """Long table ``metric, value``: nested names joined by ``/``, numbers only.

    Booleans, strings, arrays, dates and NULLs are left out.
    """
    leaves = list(_numeric_leaves(report.schema, None, ""))
    if not leaves:
        return report.sparkSession.createDataFrame([], "metric string, value double")
    entries = F.array(
        *[F.struct(F.lit(name).alias("metric"), column.cast("double").alias("value")) for name, column in leaves]
    )
    return report.select(F.explode(entries).alias("e")).select("e.metric", "e.value").where(
        F.col("value").isNotNull()
    )


def _numeric_leaves(schema: T.StructType, parent: Column | None, prefix: str):
    for field in schema.fields:
        column = F.col(f"`{field.name}`") if parent is None else parent[field.name]
        name = f"{prefix}/{field.name}" if prefix else field.name
        if isinstance(field.dataType, T.StructType):
            yield from _numeric_leaves(field.dataType, column, name)
        elif isinstance(field.dataType, T.NumericType):
            yield name, column


def json_report(report: DataFrame) -> DataFrame:
    """The report rows as JSON text with sorted keys at every level."""
    return report.select(F.to_json(_sorted_struct(report.schema, None)).alias("json"))


def _sorted_struct(schema: T.StructType, parent: Column | None) -> Column:
    out = []
    for field in sorted(schema.fields, key=lambda f: f.name):
        column = F.col(f"`{field.name}`") if parent is None else parent[field.name]
        if isinstance(field.dataType, T.StructType):
            column = _sorted_struct(field.dataType, column)
        out.append(column.alias(field.name))
    return F.struct(*out)


def quality_gates(metrics: DataFrame, gates: Sequence[tuple[str, str, float]] = fixed.QUALITY_GATES) -> DataFrame:
    """Compare a long metric table with a gate list: ``pass`` or, softly, ``warn``."""
    table = metrics.sparkSession.createDataFrame(
        list(gates), "metric string, op string, threshold double"
    )
    # the gate list is a constant of a few rows
    joined = metrics.join(F.broadcast(table), "metric")
    met = F.when(F.col("op") == "<=", F.col("value") <= F.col("threshold")).otherwise(
        F.col("value") >= F.col("threshold")
    )
    return joined.select("metric", "value", "op", "threshold", F.when(met, "pass").otherwise("warn").alias("status"))


def size_report(listing: DataFrame, length: str = "length", keys: Sequence[str] = ()) -> DataFrame:
    """Files and megabytes (10^6 bytes, two decimals) per key."""
    return listing.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_files"), F.round(F.sum(length) / 1e6, 2).alias("megabytes")
    )


def size_ratio(before: Column, after: Column) -> Column:
    """How many times smaller, to two decimals."""
    return F.round(before / F.nullif(after, F.lit(0)), 2)
