"""Label and tag CSV files, target tables and the cache of ragged arrays."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.sources.lines import csv_records
from vecloom.sources.paths import exists


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with two header rows as columns ``upper.lower``; the first column is the id.

    The file is read in splits; a quoted field that spans lines is one field all the same (``csv_records``). Only the two header
    rows come to the driver. Rows whose first field is not a number (the headers, and the line with the index name) are dropped.
    """
    if not exists(spark, path):
        raise FileNotFoundError(f"label file not found at {path}")
    records = csv_records(spark, path)
    rules = {"quote": '"', "escape": '"'}
    head = [r["record"] for r in records.orderBy("line_no").limit(2).collect()]
    upper, lower = (next(csv.reader([line])) if line else [] for line in (head + ["", ""])[:2])
    width = max(len(upper), len(lower), 1)
    upper, lower = (row + [""] * (width - len(row)) for row in (upper, lower))
    fields = ", ".join(f"_c{k} string" for k in range(width))
    raw = records.select(F.from_csv("record", fields, rules).alias("r")).select("r.*")
    names = ["fma_track_id"] + [f"{u}.{v}" for u, v in zip(upper[1:], lower[1:], strict=True)]
    body = raw.where(F.col("_c0").rlike("^[0-9]+$")).toDF(*names)
    return body.withColumn("fma_track_id", F.col("fma_track_id").cast("bigint"))


def label_index(tracks: DataFrame) -> DataFrame:
    """The manifest columns of a label CSV; split and artist columns may be missing."""
    wanted = {
        "subset": "set.subset",
        "split": "set.split",
        "genre_top": "track.genre_top",
        "artist_id": "artist.id",
        "artist_name": "artist.name",
    }
    for required in ("set.subset", "track.genre_top"):
        if required not in tracks.columns:
            raise ValueError(f"label file lacks the column {required}")
    have = [F.col(f"`{c}`").alias(name) for name, c in wanted.items() if c in tracks.columns]
    return tracks.select("fma_track_id", *have)


def read_tag_csv(spark: SparkSession, folder: str, top_k: int = 50) -> tuple[DataFrame, tuple[str, ...]]:
    """(wide 0/1 annotations, chosen tag names): the CSV, or else the TSV of the folder."""
    base = folder.rstrip("/")
    for suffix, sep in (("csv", ","), ("tsv", "\t")):
        path = f"{base}/annotations_final.{suffix}"
        if exists(spark, path):
            df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
            break
    else:
        raise FileNotFoundError(f"annotations not found in {folder}")
    if "mp3_path" not in df.columns:
        raise ValueError("annotations file is missing 'mp3_path' column")
    tags = choose_tags(df.columns, top_k)
    ints = [F.col(f"`{t}`").cast("int").alias(t) for t in tags]
    return df.select("mp3_path", *ints), tags


def choose_tags(columns: Sequence[str], top_k: int = 50) -> tuple[str, ...]:
    """The benchmark tags present for 50, else the first ``top_k`` columns that are no id."""
    if top_k == 50:
        return tuple(t for t in fixed.BENCHMARK_TAGS if t in columns)
    return tuple(c for c in columns if c not in ("clip_id", "mp3_path"))[:top_k]


def tag_sets(annotations: DataFrame, tags: Sequence[str], key: str = "mp3_path") -> DataFrame:
    """Wide 0/1 columns as one array of tag names."""
    names = F.array_compact(
        F.array(*[F.when(F.col(f"`{t}`") == 1, F.lit(t)) for t in tags]).cast("array<string>")
    )
    return annotations.select(key, names.alias("tags"))


def read_targets(
    source: SparkSession | DataFrame,
    path: str | None = None,
    split: str | None = None,
    limit: int | None = None,
    order: Sequence[str] = ("fma_track_id", "window_index"),
) -> DataFrame:
    """Rows of a split, the first ``limit`` in a stated order; none at all is an error."""
    df = source if isinstance(source, DataFrame) else source.read.parquet(path)
    if split is not None:
        if "split" not in df.columns:
            raise ValueError("targets have no 'split' column")
        df = df.where(F.col("split") == split)
    if df.isEmpty():
        raise ValueError(f"no target rows for split {split!r}")
    return df if limit is None else df.orderBy(*order).limit(limit)


def write_targets(df: DataFrame, path: str, partition: str = "split") -> None:
    df.write.mode("overwrite").partitionBy(partition).parquet(path)


def cached_arrays(clips: DataFrame, folder: str, label: str, digest: str, rate: int = fixed.TARGET_SR) -> DataFrame:
    """Arrays cached under ``label_rate_digest``; reused when complete and of equal row count.

    ``clips`` is evaluated only on a miss. NULL arrays keep their rows. The commit marker of the
    Parquet writer tells a finished cache from a broken one.
    """
    spark = clips.sparkSession
    path = f"{folder.rstrip('/')}/{label}_{rate}_{digest}"
    if exists(spark, f"{path}/_SUCCESS"):
        cached = spark.read.parquet(path)
        if cached.count() == clips.count():
            return cached
    clips.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """Sorted-key JSON; a report is one row, so it is written as one file."""
    from vecloom.operators.reports import json_report

    json_report(report).coalesce(1).write.mode("overwrite").text(path)
