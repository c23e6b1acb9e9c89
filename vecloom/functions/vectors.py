"""Scalar functions over one vector per row (``ARRAY<FLOAT>``), all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.hashing import uniform

TINY = 1e-12


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row.

    A value used inside a ``transform`` lambda would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def total(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in DOUBLE."""
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x)


def norm(vector: Column) -> Column:
    return F.sqrt(squared_norm(vector))


def l2_normalize(vector: Column) -> Column:
    """Divide by the norm; the zero vector stays as it is."""

    def divide(v: Column) -> Column:
        length = F.greatest(norm(v), F.lit(TINY))
        return bind(length, lambda n: F.transform(v, lambda x: x / n))

    return bind(doubles(vector), divide)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(TINY))


def standardize(vector: Column, eps: float = 1e-7, floor: float | None = None) -> Column:
    """(x - mean) / (sample std + eps), or / max(sample std, floor). One element gives NULL."""

    def center(v: Column) -> Column:
        return bind(total(v) / F.size(v), lambda m: F.transform(v, lambda x: x - m))

    def scale(c: Column) -> Column:
        std = F.sqrt(squared_norm(c) / (F.size(c) - 1))
        by = F.greatest(std, F.lit(floor)) if floor is not None else std + F.lit(eps)
        return bind(by, lambda d: F.transform(c, lambda x: x / d))

    v = doubles(vector)
    return F.when(F.size(v) > 1, bind(bind(v, center), scale))


def pad_or_trim(vector: Column, length: int | Column, start: int | Column = 0) -> Column:
    """Exactly ``length`` elements from ``start`` (clamped at 0), zeros past the end."""
    size = F.lit(length) if isinstance(length, int) else length
    begin = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0))

    def fill(kept: Column) -> Column:
        missing = (size - F.size(kept)).cast("int")
        return F.concat(kept, F.array_repeat(F.lit(0).cast("float"), missing))

    return bind(F.slice(vector, (begin + 1).cast("int"), size.cast("int")), fill)


def layer_pool(layers: Column, chosen: Sequence[int]) -> Column:
    """``layers`` is layer x time x dim. Mean over the chosen layers, then over time, then L2."""
    picked = F.filter(layers, lambda _, i: i.isin(*chosen))
    return l2_normalize(_mean_rows(F.flatten(picked)))


def mean_pool_rows(rows: Column) -> Column:
    """``rows`` is an array of vectors kept in one row. Element-wise mean, then L2."""
    return l2_normalize(_mean_rows(rows))


def _mean_rows(rows: Column) -> Column:
    def mean(r: Column) -> Column:
        first = F.transform(doubles(F.try_element_at(r, F.lit(1))), lambda x: x * 0.0)
        sums = F.aggregate(
            r, first, lambda acc, row: F.zip_with(acc, doubles(row), lambda a, b: a + b)
        )
        return bind(F.size(r), lambda n: F.transform(sums, lambda x: x / n))

    return bind(rows, mean)


def random_gain(vector: Column, key: Column, seed: str, max_db: float = 3.0) -> Column:
    """One gain in [-max_db, +max_db] dB per row, drawn from the key."""
    if max_db <= 0:
        return vector
    db = (uniform(key, f"{seed}:gain") * 2.0 - 1.0) * max_db
    gain = F.pow(F.lit(10.0), db / 20.0)
    return bind(gain, lambda g: F.transform(doubles(vector), lambda x: x * g))


def random_polarity(vector: Column, key: Column, seed: str, p: float = 0.5) -> Column:
    """Flip the sign of the row with probability ``p``."""
    if p <= 0:
        return vector
    sign = F.when(uniform(key, f"{seed}:polarity") < p, -1.0).otherwise(1.0)
    return bind(sign, lambda f: F.transform(doubles(vector), lambda x: x * f))


def mask_bands(
    spectrogram: Column,
    batch: Column,
    seed: str,
    *,
    freq_masks: int = 2,
    freq_mask_max: int = 8,
    time_masks: int = 2,
    time_mask_max: int = 25,
) -> Column:
    """Zero random frequency and time bands of a bands x frames array.

    The bands are drawn from the batch key, so every row of a batch has the same ones.
    """

    def masked(grid: Column) -> Column:
        n_frames = F.size(F.try_element_at(grid, F.lit(1)))
        rows = _band_list(batch, f"{seed}:freq", freq_masks, freq_mask_max, F.size(grid))
        cols = _band_list(batch, f"{seed}:time", time_masks, time_mask_max, n_frames)
        return bind(rows, lambda r: bind(cols, lambda c: _zero_bands(grid, r, c)))

    return bind(spectrogram, masked)


def _zero_bands(grid: Column, rows: Column, cols: Column) -> Column:
    def hit(bands: Column, i: Column) -> Column:
        return F.exists(bands, lambda b: (i >= b["start"]) & (i < b["start"] + b["width"]))

    def line(row: Column, row_hit: Column) -> Column:
        return F.transform(
            row, lambda x, j: F.when(row_hit | hit(cols, j), F.lit(0.0)).otherwise(x.cast("double"))
        )

    return F.transform(grid, lambda row, i: bind(hit(rows, i), lambda h: line(row, h)))


def _band_list(batch: Column, seed: str, count: int, widest: int, size: Column) -> Column:
    out = []
    for m in range(count):
        drawn = 1 + F.floor(uniform(batch, f"{seed}:{m}:width") * widest)
        width = F.least(drawn, F.greatest(F.lit(1), size - 1))
        start = F.floor(uniform(batch, f"{seed}:{m}:start") * F.greatest(F.lit(1), size - width))
        out.append(F.struct(start.cast("bigint").alias("start"), width.cast("bigint").alias("width")))
    return F.array(*out).cast("array<struct<start:bigint,width:bigint>>")


def norm_audit(df: DataFrame, vector: str = "embedding", eps: float = 1e-3) -> DataFrame:
    """Norm range, and how many rows are NULL or not of unit length."""
    length = norm(F.col(vector))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(vector).isNull()).alias("n_null"),
        F.min(length).alias("min_norm"),
        F.max(length).alias("max_norm"),
        F.count_if(F.abs(length - 1) > eps).alias("n_off_unit"),
    )


def mean_vector(vector: str) -> Column:
    """Aggregate: element-wise mean. Partial means merge before the shuffle, one vector per group
    and task travels. NULL vectors must be filtered out."""
    return vector_to_array(Summarizer.mean(array_to_vector(doubles(F.col(vector)))))


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str = "embedding") -> DataFrame:
    """Element-wise mean of the vectors of every group, renormalized."""
    rows = df.where(F.col(vector).isNotNull())
    pooled = rows.groupBy(*keys).agg(mean_vector(vector).alias(vector))
    return pooled.withColumn(vector, l2_normalize(F.col(vector)))
