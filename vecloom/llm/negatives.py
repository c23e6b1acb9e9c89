"""Hard negatives by a secondary-sort shuffle.

Scores of (anchor, other) pairs are packed into keys (anchor, descending score, kind, id), dealt out by anchor and sorted within partitions by
the shuffle. One pass over an anchor's keys meets its positives in order of score; each opens a window of scores below its own, and
the negatives that follow fall into the open windows. Only the open windows are held, never an anchor's pairs.

The score of every pair is computed in blocks, twice: first for the best positives, then, their windows known, for the negatives that
are among the first in a window within their block. No other pair can be in the answer, so only these are shuffled.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.session import materialize

#: rows of a block of the store, anchors of a chunk, scores held at once, keys that a sorting task gets, about
BLOCK_ROWS, CHUNK_ROWS, CELLS, KEYS_PER_TASK = 4096, 4096, 2_000_000, 500_000
_POSITIVE, _NEGATIVE = 0, 1


def _known(rows: DataFrame, id_col: str, vector: str, label: str, anchors: Column) -> DataFrame:
    """One row per id with a label and a vector of finite numbers; of rows that share an id, the least label and vector."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    taken = rows.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & finite)
    record = F.struct(F.col(label).alias("_label"), F.col(vector).cast("array<double>").alias("_v"), F.coalesce(anchors, F.lit(False)).alias("_anchor"))
    return taken.select(F.col(id_col).alias("_id"), record.alias("_r")).groupBy("_id").agg(F.min("_r").alias("_r")).select("_id", "_r.*")


# ---- scores of a block and a chunk


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _steps(column: pa.ChunkedArray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole steps ``floor(steps * x)`` of all vectors end to end, and their offsets."""
    lists = _whole(column)
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = np.asarray(lists.offsets)
    return np.floor(steps * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)), offsets - (offsets[0] if len(offsets) else 0)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as 64-bit integers."""
    bound = float(a.shape[1]) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("inner products beyond 62 bits: use fewer steps")


def best_columns(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """The allowed cells that are among the first k of their row; of equal scores the earlier columns."""
    if scores.shape[1] <= k:
        return allowed
    least = np.iinfo(np.int64).min
    masked = np.where(allowed, scores, least)
    limit = np.partition(masked, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    taken = allowed & (masked >= limit)
    crowded = np.flatnonzero(taken.sum(axis=1) > k)
    if len(crowded):
        above = taken[crowded] & (masked[crowded] > limit[crowded])
        ties = taken[crowded] & ~above
        ties &= ties.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)
        taken[crowded] = above | ties
    return taken


def _scored(pick, steps: int, id_type: pa.DataType):
    """A cogroup function: ``pick(anchors, same_label, other_id, scores)`` marks the cells to keep."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[pa.Table] = []
        if left.num_rows and right.num_rows:
            right = right.sort_by("_id")
            # ids and labels as numbers that hold for both sides
            sides = [pa.concat_arrays([_whole(t.column(c)).cast(kind) for t in (left, right)]) for c, kind in (("_id", id_type), ("_label", left.schema.field("_label").type))]
            ids, labels = (np.asarray(s.dictionary_encode().indices) for s in sides)
            n = left.num_rows
            (a, a_at), (b, b_at) = (_steps(t.column("_v"), steps) for t in (left, right))
            widths = [np.diff(x) for x in (a_at, b_at)]
            for width in np.intersect1d(*widths):  # vectors of unlike widths have no score
                rows, cols = (np.flatnonzero(w == width) for w in widths)
                theirs = b[(b_at[cols][:, None] + np.arange(width))]
                step = max(1, CELLS // len(cols))
                for lo in range(0, len(rows), step):
                    part = rows[lo : lo + step]
                    scores = _products(a[(a_at[part][:, None] + np.arange(width))], theirs)
                    same = labels[part][:, None] == labels[n + cols][None, :]
                    other = ids[part][:, None] != ids[n + cols][None, :]
                    i, j = np.nonzero(pick(left, part, same, other, scores))
                    found.append(
                        pa.table({
                            "_anchor": _whole(left.column("_id")).take(pa.array(part[i])),
                            "_score": pa.array(scores[i, j]),
                            "_other": _whole(right.column("_id")).take(pa.array(cols[j])),
                        })
                    )
        none = pa.table({"_anchor": pa.array([], id_type), "_score": pa.array([], pa.int64()), "_other": pa.array([], id_type)})
        return pa.concat_tables([none, *(t.cast(none.schema) for t in found)])

    return run


def _pick_positives(k: int):
    return lambda left, part, same, other, scores: best_columns(scores, same & other, k)


def _pick_negatives(k: int, low: int, high: int):
    def pick(left: pa.Table, part: np.ndarray, same: np.ndarray, other: np.ndarray, scores: np.ndarray) -> np.ndarray:
        windows = [[(-(-low * p // 100), high * p // 100) for p in left.column("_positives")[int(r)].as_py()] for r in part]
        kept, unlike = np.zeros(scores.shape, bool), ~same & other
        for w in range(max(map(len, windows), default=0)):
            edges = np.array([x[w] if w < len(x) else (1, 0) for x in windows])
            kept |= best_columns(scores, unlike & (scores >= edges[:, :1]) & (scores <= edges[:, 1:]), k)
        return kept

    return pick


def _in_blocks(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, pick, steps: int) -> DataFrame:
    """``_anchor, _score, _other`` of the picked pairs. Every chunk of anchors meets every block of rows once, in one task."""
    n_blocks, n_chunks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_anchors // CHUNK_ROWS))

    def dealt(side: DataFrame, own: str, n: int, other: str, m: int) -> DataFrame:
        renewed = side.select(*(F.col(c).alias(c) for c in side.columns))  # both sides come from one table
        placed = renewed.withColumn(own, F.pmod(F.xxhash64("_id", F.lit(own)), F.lit(n))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))))
        return placed.repartition(min(4 * n_blocks * n_chunks, 100_000), "_block", "_chunk").groupBy("_block", "_chunk")

    left = dealt(anchors, "_chunk", n_chunks, "_block", n_blocks)
    right = dealt(rows.select("_id", "_label", "_v"), "_block", n_blocks, "_chunk", n_chunks)
    id_type = rows.schema["_id"].dataType
    arrow_id = T.StructType([T.StructField("_id", id_type)])
    schema = T.StructType([T.StructField("_anchor", id_type), T.StructField("_score", T.LongType()), T.StructField("_other", id_type)])
    from pyspark.sql.pandas.types import to_arrow_schema

    return left.cogroup(right).applyInArrow(_scored(pick, steps, to_arrow_schema(arrow_id).field(0).type), schema)


# ---- the stream of sorted keys


def open_windows(keys: Iterator[tuple], n_positives: int, n_negatives: int, low: int, high: int) -> Iterator[tuple]:
    """Rows ``(anchor, positive, rank, negative, positive_score, negative_score)`` of keys in order (anchor, -score, kind, id).

    Holds the open windows of one anchor: at most ``n_positives`` of them.
    """
    anchor, windows = object(), []
    for (of, falling, kind, other), _ in keys:
        if of != anchor:
            anchor, windows, opened = of, [], 0
        score = -falling
        if kind == _POSITIVE:
            if opened < n_positives:
                windows.append([other, score, 0])
                opened += 1
            continue
        for window in windows:
            if low * window[1] <= 100 * score <= high * window[1]:
                window[2] += 1
                yield of, window[0], window[2], other, window[1], score
        windows = [w for w in windows if w[2] < n_negatives and 100 * score >= low * w[1]]


def mine_hard_negatives(
    store: DataFrame,
    anchors: Column,
    id_col: str = "track_id",
    vector: str = "embedding",
    label: str = "genre",
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    steps: int = 256,
) -> DataFrame:
    """Tracks of another ``label`` that score close to, but below, an anchor's nearest tracks of its own label.

    ``anchors`` is a condition on the rows of ``store``. A score is the inner product of vectors whose components were made whole
    numbers, ``floor(steps * x)``; higher scores come first, ties by the smaller id. An anchor's positives are its first
    ``n_positives`` other tracks of its label. Returns for each anchor and positive the first ``n_negatives`` tracks of another
    label whose score lies between ``low`` and ``high`` percent of the positive's: ``anchor_id``, ``positive_id``, ``rank`` (from 1),
    ``negative_id``, ``positive_score`` and ``negative_score``. Where there are fewer, all are returned.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. Of rows that share an id one
    takes part, the one with the least label, then vector. Vectors of unlike widths have no score. A positive with a negative score has an empty
    window. Other columns are dropped; an empty table gives no rows. Every anchor is scored against every row, in blocks: work
    grows with their product, the shuffle with anchors times blocks.
    """
    rows = materialize(_known(store, id_col, vector, label, anchors), "mining-rows")
    chosen = rows.filter("_anchor").select("_id", "_label", "_v")
    n_rows, n_anchors = rows.count(), chosen.count()
    place = Window.partitionBy("_anchor").orderBy(F.desc("_score"), "_other")
    near = _in_blocks(chosen, rows, n_anchors, n_rows, _pick_positives(n_positives), steps)
    near = materialize(near.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= n_positives).drop("_place"), "mining-positives")
    scores = near.groupBy(F.col("_anchor").alias("_id")).agg(F.array_sort(F.collect_set("_score")).alias("_positives"))
    below = _in_blocks(chosen.join(scores, "_id"), rows, n_anchors, n_rows, _pick_negatives(n_negatives, low, high), steps)
    pairs = materialize(
        near.withColumn("_kind", F.lit(_POSITIVE)).unionByName(below.withColumn("_kind", F.lit(_NEGATIVE))).select("_anchor", (-F.col("_score")).alias("_falling"), "_kind", "_other"),
        "mining-pairs",
    )
    keys = pairs.rdd.map(lambda r: (tuple(r), None))
    n_parts = max(store.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // KEYS_PER_TASK))
    ordered = keys.repartitionAndSortWithinPartitions(n_parts, lambda key: zlib.crc32(str(key[0]).encode()))
    mined = ordered.mapPartitions(lambda part: open_windows(part, n_positives, n_negatives, low, high))
    kind = rows.schema["_id"].dataType.simpleString()
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    return store.sparkSession.createDataFrame(mined, T.StructType.fromDDL(schema), verifySchema=False)
