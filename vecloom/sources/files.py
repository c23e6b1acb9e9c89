"""Listings of audio files and lists of inputs."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from vecloom import fixed_values as fixed
from vecloom.functions.hashing import relative_path
from vecloom.sources.lines import numbered_lines
from vecloom.sources.paths import qualified_directory
from vecloom.sources.remote import list_tree, reachable


def scan_files(
    spark: SparkSession, root: str, suffixes: Iterable[str] = fixed.AUDIO_SUFFIXES, content: bool = False
) -> DataFrame:
    """``path, length, modified`` of the audio files below ``root``.

    Tasks list the tree level by level (``list_tree``), so every name counts that has no dot in front, also one that starts with ``_``.
    Only on a file system that tasks can't open themselves, or with ``content``, does Spark's file source list: it hides names that
    start with ``_``; where such files matter, keep a listing table there and give it to ``select_audio``.
    The root is qualified by its file system first, so a plain root of a remote default system works; paths come back with
    scheme and host, but for local files. A root that is missing or a file raises ``NotADirectoryError``.
    """
    qualified = qualified_directory(spark, root)
    if qualified is None:
        raise NotADirectoryError(f"{root} is not a directory")
    plain_root = re.sub("^file:/+", "/", qualified)
    if not content and reachable(qualified):
        listing = list_tree(spark, plain_root, skip_hidden=True).where("NOT is_directory")
        return select_audio(listing.select("path", "length", "modified"), plain_root, suffixes)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    try:
        files = reader.load(qualified)
    except AnalysisException as error:
        raise NotADirectoryError(f"{root} is not a directory") from error
    wanted = ["path", "length", F.col("modificationTime").alias("modified")]
    listing = files.select(*wanted, *(["content"] if content else []))
    plain = F.regexp_replace("path", "^file:/+", "/")
    return select_audio(listing.withColumn("path", plain), plain_root, suffixes)


def select_audio(
    listing: DataFrame, root: str, suffixes: Iterable[str] = fixed.AUDIO_SUFFIXES, path: str = "path"
) -> DataFrame:
    """Rows of a listing with an audio suffix and no dot-name anywhere below the root."""
    below = relative_path(F.col(path), root)
    suffix = F.lower(F.regexp_extract(below, r"[^/.][^/]*\.([^./]+)$", 1))
    hidden = F.exists(F.split(below, "/"), lambda part: part.startswith("."))
    return listing.where(below.isNotNull() & suffix.isin([s.lower() for s in suffixes]) & ~hidden)


def scan_order(path: str | Column = "path") -> Column:
    """Sort key by path components: ``a/b`` comes before ``a.flac``."""
    return F.split(path, "/")


def read_input_list(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """``file, line_no, raw`` of list files, stripped, without blank and ``#`` lines. Files are read in splits; numbers are the file's."""
    return select_inputs(numbered_lines(spark, paths).select("file", "line_no", "raw"))


def select_inputs(lines: DataFrame, raw: str = "raw") -> DataFrame:
    stripped = F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")
    return lines.withColumn(raw, stripped).where((F.col(raw) != "") & ~F.col(raw).startswith("#"))
