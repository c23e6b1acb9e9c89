"""Window plans and cuts over a sequence kept in one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as WindowSpec
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions import vectors as V
from vecloom.functions.hashing import uniform_int


def _col(value: int | Column) -> Column:
    return F.lit(value) if isinstance(value, int) else value


def window_count(n: int | Column, window: int, hop: int) -> Column:
    """1 when the sequence fits the window, else 1 + ceil((n - window) / hop)."""
    if window <= 0 or hop <= 0:
        raise ValueError("window and hop must be positive")
    n = _col(n)
    return F.when(n <= window, F.lit(1)).otherwise(1 + F.ceil((n - window) / hop)).cast("int")


def sliding_windows(vector: Column, window: int, hop: int) -> Column:
    """Array of windows; the last one is zero-padded. ``posexplode`` it for one row per window."""

    def cut(v: Column) -> Column:
        count = window_count(F.size(v), window, hop)
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda i: V.pad_or_trim(v, window, i * hop)
        )

    return V.bind(vector, cut)


def windows_of_position(position: Column, n: Column, window: int, hop: int) -> Column:
    """Numbers of the windows that hold a position: the long form of ``sliding_windows``."""
    last = window_count(n, window, hop) - 1
    first = F.greatest(F.ceil((position - window + 1) / hop), F.lit(0))
    to = F.least(F.floor(position / hop), last)
    return F.when(first <= to, F.sequence(first.cast("int"), to.cast("int")))


def long_windows(rows: DataFrame, keys: Sequence[str], window: int, hop: int, aggregates: dict[str, Column], position: str = "pos", size: str = "n", piece: int = 1 << 16) -> DataFrame:
    """Aggregates over the sliding windows of sequences kept one element a row: ``keys, w`` and the named columns.

    ``position`` numbers the elements of a sequence from 0, ``size`` is its length. Sequences are cut into pieces of ``piece`` positions, and
    the first elements of a piece are copied to the piece before, so that every window lies whole in the piece it starts in. A row is
    shuffled once, or twice near a border, however much the windows overlap, and a long sequence is as many tasks as it has pieces.
    """
    if window <= 0 or hop <= 0:
        raise ValueError("window and hop must be positive")
    piece = max(piece, window)
    own = F.floor(F.col(position) / piece)
    near = (F.col(position) % piece < window - 1) & (own > 0)
    dealt = rows.withColumn("_piece", F.explode(F.when(near, F.array(own, own - 1)).otherwise(F.array(own))))
    ahead = WindowSpec.partitionBy(*keys, "_piece").orderBy(position).rowsBetween(0, window - 1)
    starts = (F.col(position) % hop == 0) & (own == F.col("_piece")) & (F.col(position) / hop < window_count(F.col(size), window, hop))
    made = dealt.select("*", *(a.over(ahead).alias(f"_a{k}") for k, a in enumerate(aggregates.values())))
    return made.where(starts).select(*keys, (F.col(position) / hop).cast("int").alias("w"), *(F.col(f"_a{k}").alias(name) for k, name in enumerate(aggregates)))


def plan_windows(n: int | Column, count: int, window: int = fixed.WINDOW_SAMPLES) -> Column:
    """Start offsets of ``count`` windows spread evenly over ``n`` samples."""
    if count <= 0:
        raise ValueError("the window count must be positive")
    n = _col(n)
    room = n - window
    if count == 1:
        spread = F.array(F.floor(room / 2).cast("bigint"))
    else:
        step = room.cast("double") / (count - 1)
        spread = F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.when(i == count - 1, room.cast("bigint")).otherwise((i * step).cast("bigint")),
        )
    zeros = F.array_repeat(F.lit(0).cast("bigint"), count)
    return F.when(n <= window, zeros).otherwise(spread)


def estimate_samples(frames: Column, rate: Column, target: int = fixed.TARGET_SR) -> Column:
    """Sample count after resampling, rounded half to even."""
    return F.bround(frames / rate.cast("double") * target).cast("bigint")


def rescale_offset(start: Column, source: int = fixed.TARGET_SR, target: int = fixed.TEACHER_SR) -> Column:
    """The same place in a signal of another sample rate."""
    return F.bround(start.cast("double") * (target / source)).cast("bigint")


def random_crop(vector: Column, length: int, key: Column, seed: str | Column) -> Column:
    """``length`` elements from a start drawn in [0, n - length]; a short sequence is padded."""

    def cut(v: Column) -> Column:
        start = crop_start(F.size(v), length, key, seed)
        return V.bind(start, lambda s: V.pad_or_trim(v, length, s))

    return V.bind(vector, cut)


def crop_start(n: Column, length: int, key: Column, seed: str | Column) -> Column:
    room = F.greatest(n - length, F.lit(0)) + 1
    return uniform_int(key, seed, room).cast("int")
