"""Continuous ingest into the store."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from vecloom.schemas import STORE
from vecloom.sources import commits
from vecloom.sources.files import scan_order
from vecloom.sources.paths import child_names
from vecloom.sources.store import (
    compact,
    conform,
    drop_superseded,
    ingest_incremental,
    latest_rows,
    scan_store,
    write_delta,
)

#: columns that order the rows of an id, and tell the store's own ids from rows
_PARTS, _KNOWN = "_parts", "_known"


def ingest_stream(
    spark: SparkSession,
    source: str,
    store_path: str,
    checkpoint: str,
    *,
    schema: T.StructType = STORE,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    files_per_trigger: int = 200,
    available_now: bool = True,
    replace: bool = False,
    name: str = "ingest",
    compact_every: int | None = 50,
    grace_seconds: float = 3600.0,
) -> StreamingQuery:
    """Read Parquet files as they appear and add their rows to the store.

    Every micro-batch is one delta named by its batch id, so a batch that is run again after a
    failure replaces itself. With ``replace`` rows of known ids are updated (the last row per id of
    a batch wins by path order); otherwise known ids are skipped, and of the rows of one id in a batch the first good one by path order
    is taken. ``available_now`` catches up and stops. After every ``compact_every`` batches the deltas are folded into a new base,
    and folders it supersedes go once they are ``grace_seconds`` old, so their number stays bounded; a batch that
    is run again after that changes nothing.

    Ids that were seen are keyed state of the stream, so a batch doesn't read the store. When the stream starts, ids that the
    store has from elsewhere since the last start are written beside the checkpoint (``announce_ids``) and enter the state
    with the next batch; what others add while it runs counts from the next start on.
    """
    stream = (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    )
    if transform is not None:
        stream = transform(stream)
    if not replace:
        announced = announce_ids(spark, store_path, checkpoint, name)
        known = spark.readStream.schema("track_id string").option("recursiveFileLookup", "true").parquet(announced)
        stream = unseen_rows(stream, known)

    def save(batch: DataFrame, batch_id: int) -> None:
        tag = f"{name}.{batch_id}"
        if replace:
            write_batch(batch, store_path, tag, replace=True)
        else:
            write_delta(batch, store_path, tag)
        if compact_every and (batch_id + 1) % compact_every == 0:
            compact(spark, store_path)
            drop_superseded(spark, store_path, grace_seconds)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{checkpoint.rstrip('/')}/stream")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def announce_ids(spark: SparkSession, store_path: str, checkpoint: str, name: str) -> str:
    """Write the ids that commits of others have brought since the last call; returns the folder the stream reads.

    The first call writes all ids of the store. A folder is named by the version it is up to; a later call reads the deltas
    after it, or all ids where a base replaced them.
    """
    folder, store_path = f"{checkpoint.rstrip('/')}/known", store_path.rstrip("/")
    done = max((int(n) for n in child_names(spark, folder) if n.isdigit() and "_SUCCESS" in child_names(spark, f"{folder}/{n}")), default=-1)
    now = commits.state(spark, store_path)
    if now.version > done:
        live = {d.version for d in now.deltas}
        since = [commits.load(spark, store_path, v) for v in commits.versions(spark, store_path) if v > done]
        others = [c for c in since if c.kind == "delta" and not (c.tag and commits.series_of(c.tag)[0] == name)]
        replaced = any(c.kind == "base" and c.covers == c.version for c in since)
        if done < 0 or replaced or any(c.version not in live for c in others):
            ids = scan_store(spark, store_path).select("track_id")
        else:
            ids = spark.createDataFrame([], "track_id string")
            for c in others:
                ids = ids.unionByName(spark.read.parquet(f"{store_path}/{c.folder}").select("track_id"))
        ids.where("track_id IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/{now.version}")
    return folder


def unseen_rows(stream: DataFrame, known: DataFrame) -> DataFrame:
    """Store rows of a stream whose id neither an earlier row nor ``known`` has brought: the first good one of each id.

    State is one mark for each id, held by the state store of the task that the id belongs to.
    """
    rows = conform(stream).withColumn(_PARTS, scan_order("path")).withColumn(_KNOWN, F.lit(False))
    ids = conform(known).withColumn(_PARTS, F.lit(None).cast("array<string>")).withColumn(_KNOWN, F.lit(True))
    good = F.col("track_id").isNotNull() & (F.col(_KNOWN) | F.col("embedding").isNotNull())
    columns = [f.name for f in STORE.fields]

    def first_unseen(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = None
        listed = False
        for part in parts:
            if state.exists or listed:
                continue
            if part[_KNOWN].any():
                listed = True
                continue
            for at in range(len(part)):
                order = (list(part[_PARTS].iloc[at]) if part[_PARTS].iloc[at] is not None else [], part["path"].iloc[at] or "")
                if best is None or order < best[0]:
                    best = order, part.iloc[[at]][columns]
        if not state.exists and (listed or best is not None):
            state.update((True,))
            if not listed:
                yield best[1]

    union = rows.unionByName(ids).where(good)
    return union.groupBy("track_id").applyInPandasWithState(first_unseen, STORE, "seen boolean", "append", "NoTimeout")


def write_batch(batch: DataFrame, store_path: str, tag: str, replace: bool = False) -> None:
    """Add one batch under a tag. Its own earlier delta is not counted as known, so it may be rerun."""
    spark = batch.sparkSession
    rows = conform(batch)
    if replace:
        rows = latest_rows(rows.withColumn("seq", scan_order("path")))
    else:
        known = scan_store(spark, store_path, skip_tag=tag)
        status = ingest_incremental(rows, known)
        rows = status.where("status = 'new'").drop("status")
    write_delta(rows, store_path, tag)
