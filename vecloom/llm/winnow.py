"""Benchmark decontamination by winnowing: training text that repeats evaluation text is found and measured.

Of the hashes of all runs of ``GRAM`` words, each window of ``SPAN - GRAM + 1`` neighbours keeps its smallest (the last one of
equals). Two texts that share ``SPAN`` words share such a window, hence a kept hash, so joining the kept hashes of both sides
misses no shared span. A hit names a diagonal (item, offset); the words along it are compared to the ends of both texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import bytesets as B
from vecloom.session import materialize

#: words of a window, words of a fingerprint
SPAN, GRAM = 13, 6
#: fingerprints of the evaluation side that may be broadcast (16 bytes each and the item's id); more are joined by a shuffle
BROADCAST_FINGERPRINTS = 200_000


def keep_minima(hashes: np.ndarray, row: np.ndarray, window: int) -> np.ndarray:
    """Indices of the hashes that some window of neighbours of one row keeps, ascending."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = hashes[:n].copy(), np.arange(n)
    for step in range(1, window):
        later = hashes[step : step + n]
        smaller = later <= least
        place[smaller] = np.flatnonzero(smaller) + step
        np.minimum(least, later, out=least)
    place = place[row[:n] == row[window - 1 :]]
    return place[np.flatnonzero(np.diff(place, prepend=-1))]


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, B.Words]]:
    data, offsets = B.text_bytes(batch.column(at))
    for lo, hi in B.row_slices(offsets):
        part = offsets[lo : hi + 1]
        yield lo, hi, B.Words(data[part[0] : part[-1]], part - part[0], B.ALNUM_WORDS)


def _marks(words: B.Words, short: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of a slice and the word each starts at: the winnowed ones, and all runs of the lengths in ``short``."""
    grams, at = words.grams(GRAM)
    kept = keep_minima(grams, words.row[at], SPAN - GRAM + 1)
    marks, places = [grams[kept]], [at[kept]]
    for size in short:
        grams, at = words.grams(size)
        marks.append(B.mix(grams + np.uint64(size)))
        places.append(at)
    return np.concatenate(marks), np.concatenate(places)


def _text_marks(tracks: DataFrame, short: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _slices(batch, 1):
                marks, places = _marks(words, short)
                rows = words.row[places]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo).take(pa.array(rows)),
                        pa.array(marks.view(np.int64)),
                        pa.array((places - words.first[rows]).astype(np.int32)),
                    ],
                    names=["_id", "_mark", "_at"],
                )

    schema = T.StructType(
        [T.StructField("_id", tracks.schema["_id"].dataType), T.StructField("_mark", T.LongType()), T.StructField("_at", T.IntegerType())]
    )
    return tracks.select("_id", "_text").mapInArrow(run, schema)


def _item_words(items: DataFrame) -> DataFrame:
    """Word hashes of each evaluation text as one binary, and their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, words in _slices(batch, 1):
                parts = [words.hash[words.first[r] : words.first[r + 1]] for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array([p.tobytes() for p in parts], pa.binary()),
                        pa.array([len(p) for p in parts], pa.int32()),
                    ],
                    names=["_item", "_words", "_n"],
                )

    schema = T.StructType(
        [T.StructField("_item", items.schema["_item"].dataType), T.StructField("_words", T.BinaryType()), T.StructField("_n", T.IntegerType())]
    )
    return items.select("_item", "_text").mapInArrow(run, schema).filter("_n > 0")


def _item_marks(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (text, n) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                hashes = np.frombuffer(text, np.uint64)
                if n < SPAN:
                    marks, at = B.mix(B.combine(hashes, np.zeros(1, np.int64), n) + np.uint64(n)), np.zeros(1, np.int64)
                else:
                    grams = B.combine(hashes, np.arange(n - GRAM + 1), GRAM)
                    at = keep_minima(grams, np.zeros(len(grams), np.int8), SPAN - GRAM + 1)
                    marks = grams[at]
                same = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks.view(np.int64)), batch.column(0).take(same), pa.array(at.astype(np.int32)), batch.column(1).take(same)],
                    names=["_mark", "_item", "_item_at", "_words"],
                )

    schema = T.StructType(
        [
            T.StructField("_mark", T.LongType()),
            T.StructField("_item", items.schema["_item"].dataType),
            T.StructField("_item_at", T.IntegerType()),
            T.StructField("_words", T.BinaryType()),
        ]
    )
    return items.mapInArrow(run, schema)


def covered(text: np.ndarray, item: np.ndarray, offset: int) -> np.ndarray:
    """Words of ``text`` inside a window of ``item`` that lies on this diagonal, as indices."""
    lo, hi = max(0, -offset), min(len(item), len(text) - offset)
    if hi <= lo:
        return np.zeros(0, np.int64)
    same = np.zeros(hi - lo + 2, np.int8)
    same[1:-1] = text[offset + lo : offset + hi] == item[lo:hi]
    turn = np.diff(same)
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    long_enough = end - begin >= min(SPAN, len(item))
    runs = [np.arange(b, e) for b, e in zip(begin[long_enough], end[long_enough], strict=True)]
    return np.concatenate(runs) + offset + lo if runs else np.zeros(0, np.int64)


def mark_contamination(
    tracks: DataFrame,
    held_out: DataFrame,
    id_col: str = "track_id",
    text_col: str = "title",
    held_out_id: str = "track_id",
    held_out_text: str = "title",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How much of each training track's text repeats the text of held-out (validation or test) tracks.

    Returns the id, the ``carry`` columns, ``n_words``, ``n_hit`` (words inside an occurrence of 13 consecutive words of a
    held-out text, or of a whole one that is shorter), ``hit_items`` (ids of the texts with such occurrences, distinct, sorted)
    and ``contaminated`` (at least 5 % of the words are hit). Words are runs of letters and digits after lower-casing A-Z;
    every byte above ASCII belongs to a word.

    Null or empty texts have no words and hit nothing. Repeated rows are judged each for itself; rows with a null id are judged
    like any other; a held-out text with a null id marks words but is not listed. Other columns of either table are not read.
    An empty table on either side gives no rows, or rows without hits.

    The two sides meet in one join on fingerprints: the held-out side is broadcast while it has at most
    ``BROADCAST_FINGERPRINTS`` of them, else Spark shuffles both. The pairs of a text are its distinct diagonals.
    """
    source = tracks.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)))
    items = held_out.select(F.col(held_out_id).alias("_item"), F.col(held_out_text).alias("_text"))
    words = materialize(_item_words(items), "held-out-words")
    marks = materialize(_item_marks(words), "held-out-marks")
    # at most SPAN - 1 rows
    short = tuple(sorted(r["_n"] for r in words.filter(F.col("_n") < SPAN).select("_n").distinct().collect()))
    known = marks.select("_mark", "_item", "_item_at", "_words")
    if marks.count() <= BROADCAST_FINGERPRINTS:
        known = F.broadcast(known)
    hits = (
        _text_marks(source, short)
        .join(known, "_mark")
        .select("_id", "_item", (F.col("_at") - F.col("_item_at")).alias("_offset"), "_words")
        .distinct()
        .groupBy(F.col("_id").alias("_hit_id"))
        .agg(F.collect_list(F.struct("_item", "_offset", "_words")).alias("_hits"))
    )
    item_type = items.schema["_item"].dataType
    names = [c for c in source.columns if c != "_text"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits_of = batch.column(batch.schema.names.index("_hits"))
            place = batch.schema.names.index("_text")
            n_words, n_hit, found = [], [], []
            for lo, hi, text in _slices(batch, place):
                n_words.append(np.diff(text.first))
                for r in range(hi - lo):
                    listed = hits_of[lo + r]
                    hit, which = set(), set()
                    if listed.is_valid:
                        own = text.hash[text.first[r] : text.first[r + 1]]
                        inside = np.zeros(len(own), bool)
                        for h in listed.as_py():
                            at = covered(own, np.frombuffer(h["_words"], np.uint64), h["_offset"])
                            if len(at):
                                inside[at] = True
                                which.add(h["_item"])
                        hit = int(inside.sum())
                    n_hit.append(hit or 0)
                    found.append(sorted(x for x in which if x is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(c)) for c in names]
                + [pa.array(np.concatenate(n_words) if n_words else [], pa.int64()), pa.array(n_hit, pa.int64()), pa.array(found, out_items)],
                names=names + ["n_words", "n_hit", "hit_items"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    out_items = pa.list_(to_arrow_type(item_type))
    schema = T.StructType(
        [source.schema[c] for c in names]
        + [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("hit_items", T.ArrayType(item_type))]
    )
    judged = source.join(hits, F.col("_id").eqNullSafe(F.col("_hit_id")), "left").drop("_hit_id").mapInArrow(judge, schema)
    back = [F.col("_id").alias(id_col), *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry))]
    return judged.select(
        *back, "n_words", "n_hit", "hit_items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated")
    )
