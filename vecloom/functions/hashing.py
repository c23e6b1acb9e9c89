"""Ids, digests and hash-derived uniform draws."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom import fixed_values as fixed


def uniform(key: Column, seed: str | Column) -> Column:
    """A draw in [0, 1) that depends on the key and the seed only.

    Unlike ``rand`` it gives the same value after a retry or a repartitioning.
    """
    salt = F.lit(seed) if isinstance(seed, str) else seed
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), salt).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def uniform_int(key: Column, seed: str | Column, bound: Column) -> Column:
    """A whole number in [0, bound)."""
    return F.floor(uniform(key, seed) * bound).cast("bigint")


def fingerprint_input(content: Column, head_tail: int = fixed.HEAD_TAIL_BYTES) -> Column:
    """Size as 8 little-endian bytes, then the head and the tail, or all of a short content."""
    size = F.length(content)
    big_endian = F.lpad(F.hex(size.cast("bigint")), 16, "0")
    little_endian = F.unhex(
        F.concat(*[F.substring(big_endian, 15 - 2 * i, 2) for i in range(8)])
    )
    ends = F.concat(
        F.substring(content, F.lit(1), F.lit(head_tail)),
        F.substring(content, size - head_tail + 1, F.lit(head_tail)),
    )
    body = F.when(size <= 2 * head_tail, content).otherwise(ends)
    return F.concat(little_endian, body)


def content_fingerprint(content: Column, head_tail: int = fixed.HEAD_TAIL_BYTES) -> Column:
    """16 hex digits from Spark's built-in XXH64 (whose seed is 42)."""
    return F.lower(F.lpad(F.hex(F.xxhash64(fingerprint_input(content, head_tail))), 16, "0"))


def content_fingerprint_sha(content: Column, head_tail: int = fixed.HEAD_TAIL_BYTES) -> Column:
    """The same sparse view under SHA-256, for stores beyond 10^9 files."""
    return F.sha2(fingerprint_input(content, head_tail), 256)


def content_fingerprint_seed0(content: Column, head_tail: int = fixed.HEAD_TAIL_BYTES) -> Column:
    """Ids equal to XXH64 with seed 0, for stores that hold such ids already (Arrow batches)."""

    @F.pandas_udf(T.StringType())
    def digest(data: pd.Series) -> pd.Series:
        import xxhash

        return data.map(lambda b: None if b is None else xxhash.xxh64(bytes(b)).hexdigest())

    return digest(fingerprint_input(content, head_tail))


def resolution_cache_key(
    raw: Column, limit: Column, min_duration: Column, max_duration: Column
) -> Column:
    """First 16 hex digits of SHA-256 over the four fields; NULL is spelled ``None``."""
    fields = [raw, limit.cast("string")] + [
        F.coalesce(value.cast("double").cast("string"), F.lit("None"))
        for value in (min_duration, max_duration)
    ]
    joined = F.concat(*[part for f in fields for part in (f, F.lit("\0"))][:-1])
    return F.left(F.sha2(joined, 256), F.lit(16))


def manifest_digest(df: DataFrame, order: str, path: str = "path", label: int = fixed.TARGET_SR) -> DataFrame:
    """One digest for an ordered path list: any added, removed or moved row changes it.

    Rows are digested first, then buckets of consecutive rows, then the bucket digests, so no task
    holds the whole list; ``order`` must number the rows from 0 without gaps.
    """
    per_bucket = 4096
    rows = df.select(
        F.floor(F.col(order) / per_bucket).alias("bucket"),
        F.struct(F.col(order).alias("o"), F.sha2(F.col(path), 256).alias("d")).alias("e"),
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["d"]), "\n")
    buckets = rows.groupBy("bucket").agg(F.sha2(joined, 256).alias("d"))
    level2 = buckets.groupBy(F.floor(F.col("bucket") / per_bucket).alias("top")).agg(
        F.sha2(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda e: e["d"]),
                "\n",
            ),
            256,
        ).alias("d")
    )
    joined_top = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("top", "d"))), lambda e: e["d"]), "\n"
    )
    return level2.agg(
        F.left(F.sha2(F.concat(F.lit(f"{label}\n"), joined_top), 256), F.lit(16)).alias("digest")
    )


def path_to_id(path: Column) -> Column:
    """The number in a file name whose stem is exactly six digits, else NULL."""
    digits = F.regexp_extract(path, r"(?:^|/)([0-9]{6})(?:\.[^./]*)?$", 1)
    return F.nullif(digits, F.lit("")).cast("int")


def id_to_path(root: str, track: Column) -> Column:
    return F.format_string(
        f"{root.rstrip('/').replace('%', '%%')}/%03d/%06d.mp3",
        F.floor(track / 1000).cast("bigint"),
        track.cast("bigint"),
    )


def relative_path(path: Column, root: str) -> Column:
    """The part below the root, else NULL."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path)))


def video_id_from_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, fixed.VIDEO_ID, 1), F.lit(""))
