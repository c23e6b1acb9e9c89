"""Files as tasks reach them: listings and ranged reads on the cluster's file systems, in Arrow batches.

Spark's own file source hides names that start with ``_`` and reads whole contents of at most 2 GiB. Here the tasks open the file system
themselves: a listing asks for one directory at a time, a fingerprint reads the first and the last mebibyte of a file.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.session import materialize, spread

#: names that a file system has in Spark and in Arrow
_SCHEMES = {"s3a": "s3", "s3n": "s3"}
_LISTED = "path string, is_directory boolean, length long, modified timestamp, reason string"


@lru_cache(maxsize=64)
def _opened(scheme: str, host: str) -> tuple[pafs.FileSystem, str]:
    if scheme in ("", "file"):
        return pafs.LocalFileSystem(), ""
    system, base = pafs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{host}/")
    return system, base.rstrip("/")


def locate(path: str) -> tuple[pafs.FileSystem, str, str]:
    """The file system of a path, the path as that spells it, and the prefix that makes it a path of Spark's again."""
    match = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)?$", path)
    scheme, host, rest = (match[1].lower(), match[2] or "", match[3] or "/") if match else ("", "", path)
    if scheme in ("", "file"):
        return _opened("", "")[0], re.sub("^/+", "/", rest), ""
    system, base = _opened(scheme, host)
    return system, base + rest, f"{scheme}://{host}"


def reachable(path: str) -> bool:
    """Whether tasks can open the file system of a path; asked on the driver, which has the same libraries."""
    try:
        system, own, _ = locate(path)
        return system.get_file_info(own).type != pafs.FileType.NotFound
    except (OSError, ValueError, pa.ArrowException):
        return False


def _children(skip_hidden: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                rows = []
                system, own, prefix = locate(directory)
                try:
                    entries = system.get_file_info(pafs.FileSelector(own, recursive=False))
                except OSError as error:
                    entries, rows = [], [(directory, None, None, None, f"{type(error).__name__}: {error}")]
                above = (directory if prefix else own).rstrip("/")
                for e in entries:
                    name = e.base_name
                    if skip_hidden and name.startswith("."):
                        continue
                    folder = e.type == pafs.FileType.Directory
                    # links to folders are no way down: they may lead back up
                    if folder and isinstance(system, pafs.LocalFileSystem) and os.path.islink(e.path):
                        continue
                    if folder or e.type == pafs.FileType.File:
                        rows.append((f"{above}/{name}", folder, None if folder else e.size, e.mtime, None))
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                    names=["path", "is_directory", "length", "modified", "reason"],
                )

    return run


def list_tree(spark: SparkSession, root: str, skip_hidden: bool = False) -> DataFrame:
    """Everything below a directory: ``path, is_directory, length, modified, reason``.

    Level by level: the directories of a level are dealt out to the tasks, each of which asks for its own, and those they
    find are the next level. Nothing but the root comes from the driver, and there are as many rounds as the tree is deep. A
    directory that can't be read is a row with a ``reason``. ``skip_hidden`` leaves out dot names, and what is below them.
    """
    cores = spark.sparkContext.defaultParallelism
    asked, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        levels.append(materialize(asked.mapInArrow(_children(skip_hidden), _LISTED), f"listing-{len(levels)}"))
        below = levels[-1].where("is_directory").select("path")
        n = below.count()
        if not n:
            return reduce(DataFrame.unionByName, levels)
        asked = below.repartition(min(n, max(cores, n // 256)))


def sparse_digest(path: str, head_tail: int, algorithm: str, seed: int) -> str:
    """Hex digest of a file's size (8 little-endian bytes), head and tail; of all of a short file. Reads no more than these."""
    import hashlib

    import xxhash

    digest = hashlib.sha256() if algorithm == "sha256" else xxhash.xxh64(seed=seed)
    system, own, _ = locate(path)
    with system.open_input_file(own) as file:
        size = file.size()
        digest.update(size.to_bytes(8, "little"))
        if size <= 2 * head_tail:
            digest.update(file.read(size))
        else:
            digest.update(file.read(head_tail))
            file.seek(size - head_tail)
            digest.update(file.read(head_tail))
    return digest.hexdigest()


def fingerprint_files(
    listing: DataFrame,
    path: str = "path",
    head_tail: int = fixed.HEAD_TAIL_BYTES,
    algorithm: str = "xxh64",
    seed: int = 42,
) -> DataFrame:
    """A listing with ``track_id``, the content id of each file, and ``reason`` where it couldn't be read (then the id is null).

    The ids are those of ``content_fingerprint`` (with ``seed=0`` of stores that hold such ids, with ``algorithm="sha256"`` of
    ``content_fingerprint_sha``), but only the ends of a file are read, so its size doesn't matter. One file after the other: a task
    holds two heads at most.
    """
    if algorithm not in ("xxh64", "sha256"):
        raise ValueError(f"unknown algorithm {algorithm}")
    columns = [c for c in listing.columns if c not in ("track_id", "reason")]
    rows = spread(listing.select(F.col(path).alias("_path"), *columns))
    kinds = {f.name: f.dataType.simpleString() for f in listing.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "track_id string", "reason string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, reasons = [], []
            for name in batch.column(0).to_pylist():
                try:
                    ids.append(sparse_digest(name, head_tail, algorithm, seed) if name is not None else None)
                    reasons.append(None if name is not None else "no path")
                except (OSError, pa.ArrowException) as error:
                    ids.append(None)
                    reasons.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array(ids, pa.string()), pa.array(reasons, pa.string())], names=[*columns, "track_id", "reason"]
            )

    return rows.mapInArrow(run, schema)


def write_files(files: DataFrame, root: str, path: str = "path", content: str = "content") -> DataFrame:
    """Write a file for each row, at its path below ``root``; returns ``path, length, reason`` of what was written.

    A retried task writes the same bytes again. Null contents are empty files.
    """
    rows = files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top, _ = locate(root)
        for batch in batches:
            sizes, reasons = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{top.rstrip('/')}/{name.lstrip('/')}"
                try:
                    system.create_dir(os.path.dirname(target), recursive=True)
                    with system.open_output_stream(target) as out:
                        out.write(data or b"")
                    sizes.append(len(data or b""))
                    reasons.append(None)
                except OSError as error:
                    sizes.append(None)
                    reasons.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(reasons, pa.string())], names=["path", "length", "reason"]
            )

    return materialize(rows.mapInArrow(run, "path string, length long, reason string"), "written-files")
