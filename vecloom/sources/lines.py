"""Text files read in splits, with line numbers, and CSV records that may span lines.

A file of any size is read by as many tasks as it has splits. Each split numbers its own lines and counts its quotes; sums over the
splits before it, a row per split, turn these into numbers and quote parities of the file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: splits whose sums may be broadcast
BROADCAST_SPLITS = 1_000_000


def _within(quote: str):
    """``nth`` line of its split and ``quotes`` in the split's earlier lines. Lines of a split come in order, one split after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, lines, quotes = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            files = batch.column(0).dictionary_encode()
            starts = batch.column(1).to_numpy()
            codes = np.asarray(files.indices)
            edges = np.flatnonzero((np.diff(codes, prepend=codes[0]) != 0) | (np.diff(starts, prepend=starts[0]) != 0)).tolist()
            nth, before = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            own = np.asarray(pc.count_substring(batch.column(2), quote)).astype(np.int64)
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if (files[a].as_py(), starts[a]) != split:
                    split, lines, quotes = (files[a].as_py(), starts[a]), 0, 0
                nth[a:b] = lines + np.arange(b - a)
                before[a:b] = quotes + np.cumsum(own[a:b]) - own[a:b]
                lines, quotes = lines + b - a, quotes + int(own[a:b].sum())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(before), pa.array(own)], names=["file", "split", "raw", "nth", "before", "own"])

    return run


def numbered_lines(spark: SparkSession, paths: str | list[str], quote: str = '"') -> DataFrame:
    """``file, line_no, raw`` (from 0) and ``open``: whether an odd number of quotes comes before the line."""
    text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("raw"))
    lines = text.mapInArrow(_within(quote), "file string, split long, raw string, nth long, before long, own long")
    sums = lines.groupBy("file", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("q"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        "file", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("quotes_before")
    )
    few = offsets.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS
    placed = lines.join(F.broadcast(offsets) if few else offsets, ["file", "split"])
    return placed.select("file", (F.col("lines_before") + F.col("nth")).alias("line_no"), "raw", ((F.col("quotes_before") + F.col("before")) % 2 == 1).alias("open"))


def csv_records(spark: SparkSession, paths: str | list[str], quote: str = '"') -> DataFrame:
    """``file, line_no, record``: the lines of a CSV file, with those put together that a quoted field spans. ``line_no`` is the first's.

    Lines without an open quote pass as they are; only the lines of records that go on are brought together, each record by itself.
    """
    lines = numbered_lines(spark, paths, quote)
    odd = (F.length("raw") - F.length(F.replace("raw", F.lit(quote), F.lit("")))) % 2 == 1
    marked = lines.withColumn("goes_on", odd != F.col("open"))
    single = marked.where(~F.col("open") & ~F.col("goes_on")).select("file", "line_no", F.col("raw").alias("record"))
    parts = marked.where(F.col("open") | F.col("goes_on"))
    # the first line of such a record is the last one before that isn't inside a quote
    line = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.last(F.when(~F.col("open"), F.col("line_no")), ignorenulls=True).over(line)
    joined = parts.withColumn("first", first).groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("l"))
    whole = joined.select("file", F.col("first").alias("line_no"), F.array_join(F.transform("l", lambda x: x["raw"]), "\n").alias("record"))
    return single.unionByName(whole)
