"""Best-fit packing of token sequences.

Track titles become token ids, and the pieces fill sequences of a fixed capacity by best-fit decreasing: longest pieces first, each
into the open sequence with the least room that still takes it. A segment tree over remaining capacities finds that sequence in
logarithmic time. Pieces of one length are interchangeable, so the tree holds counts and a step places a whole run of equal pieces:
the plan depends on the histogram of lengths (``capacity`` numbers), never on the rows. Rows are then numbered by length where they
lie, and a number says which run, sequence and offset a piece has.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom.llm import bytesets as B
from vecloom.llm.lookup import BROADCAST_IDS
from vecloom.session import materialize

# The split pattern of byte-level BPE vocabularies
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_MOVE = "length int, first long, last long, per_sequence long, sequence long, offset int"


# ---- token ids


def _byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Encoder:
    """Token ids by a ``tokenizers`` JSON file, given as text; no special tokens are added.

    A plain byte-level BPE file whose merges come in the order of their ids is run by ``tiktoken``, which gives the same ids several
    times faster. Any other file, and any text that holds an added token, goes to ``tokenizers``.
    """

    def __init__(self, source: str):
        self.source, self.slow, self.fast = source, None, None
        given = json.loads(source)
        self.added = [t["content"] for t in given.get("added_tokens") or []]
        model, before = given["model"], given.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and not given.get("normalizer") and before.get("type") == "ByteLevel"
        plain = plain and not before.get("add_prefix_space") and before.get("use_regex", True)
        plain = plain and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if plain and not given.get("post_processor") and not given.get("truncation") and not given.get("padding"):
            signs, vocabulary = _byte_signs(), model["vocab"]
            merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
            ranks = {bytes(signs[s] for s in word): k for word, k in vocabulary.items() if word not in self.added}
            if sorted(ranks.values()) == list(range(len(ranks))) and [vocabulary[m] for m in merges] == list(range(256, 256 + len(merges))):
                import tiktoken

                self.fast = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(t in text for t in self.added):
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.source)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


_ENCODERS: dict[int, Encoder] = {}


def cut(n: int, capacity: int) -> list[int]:
    """Where the pieces of ``n`` ids start: all pieces are full, except that the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def _pieces(shared, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _ENCODERS.get(shared.id)
        if encode is None:
            encode = _ENCODERS[shared.id] = Encoder(shared.value)
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            texts = batch.column(1)
            _, offsets = B.text_bytes(texts)
            for lo, hi in B.row_slices(offsets):
                rows, numbers, starts, lengths, values, nth = [], [], [], [], [], []
                for row, text in enumerate(texts.slice(lo, hi - lo).to_pylist(), lo):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    edges = cut(len(ids), capacity)
                    for k, (a, b) in enumerate(zip(edges, [*edges[1:], len(ids)], strict=True)):
                        rows.append(row), numbers.append(k), starts.append(a), lengths.append(b - a), values.append(ids[a:b].tobytes()), nth.append(seen[b - a])
                        seen[b - a] += 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows, pa.int64())),
                        pa.array(numbers, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int32()),
                        pa.array(values, pa.binary()),
                        pa.array([part] * len(rows), pa.int32()),
                        pa.array(nth, pa.int64()),
                    ],
                    names=["_id", "piece", "start", "length", "ids", "_part", "_nth"],
                )

    return run


# ---- the plan


class CapacityTree:
    """Open sequences by remaining capacity; ``tightest`` finds the least one of at least ``need`` in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, room: int, n: int) -> None:
        at = room + self.size
        while at:
            self.open[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        at = need + self.size
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):  # up, until the right neighbour holds something
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        return at - self.size


def best_fit(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``{length: pieces}``, as moves ``(length, first, last, per_sequence, sequence, offset)``.

    Piece number p of a length, ``first <= p < last``, goes to ``sequence + (p - first) // per_sequence`` and starts at
    ``offset + (p - first) % per_sequence * length``. The tightest sequence keeps taking pieces of a length until it has less room than
    one needs, so equal pieces fill runs of equal sequences, as they would one by one. A length splits one run at most: runs, and
    moves, are bounded by the capacity.
    """
    tree, runs = CapacityTree(capacity), [deque() for _ in range(capacity + 1)]
    moves, opened = [], 0

    def put(room: int, sequence: int, n: int) -> None:
        if n and room:
            runs[room].append((sequence, n))
            tree.add(room, n)

    for length in sorted(histogram, reverse=True):
        left, first = histogram[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, n = capacity, -(-left // (capacity // length))
                sequence, opened = opened, opened + n
            else:
                sequence, n = runs[room].popleft()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            rest = left - full * each if full < n else 0
            if full:
                moves.append((length, first, first + full * each, each, sequence, capacity - room))
                put(room - each * length, sequence, full)
            if rest:
                moves.append((length, first + full * each, first + full * each + rest, rest, sequence + full, capacity - room))
                put(room - rest * length, sequence + full, 1)
            untouched = n - full - bool(rest)
            if untouched:
                runs[room].appendleft((sequence + full + bool(rest), untouched))
                tree.add(room, untouched)
            first, left = first + full * each + rest, left - full * each - rest
    return moves


# ---- the operator


def pack_best_fit(
    tracks: DataFrame, tokenizer: str, end_id: int, id_col: str = "track_id", text_col: str = "title", capacity: int = 1024, broadcast_rows: int = BROADCAST_IDS
) -> DataFrame:
    """Every track's text as token pieces, packed into as few sequences of at most ``capacity`` ids as best-fit decreasing needs.

    ``tokenizer`` is the path of a ``tokenizers`` JSON file that the driver reads; ``end_id`` follows each text. Texts with more ids
    than the capacity are cut into full pieces, of which the first may be shorter. Returns a row per piece: the id, ``piece`` (from 0),
    ``start`` (ids of its text before it), ``length``, ``ids`` (little-endian 32-bit integers), ``sequence_id`` (from 0) and
    ``offset`` (from 0, without gaps). Each text stays whole in its pieces; ``sequences`` joins the pieces of a sequence.

    A null text is empty and still has its end id. Null and repeated ids keep their rows, each a text of its own; ties between pieces
    of a length fall to the order in which tasks read them. Very long texts are read whole. Other columns are dropped; an empty
    table gives no rows. Token ids are written once; numbering them reads only lengths. The number of a piece needs the counts of
    the tasks before its own, which are broadcast while they were counted to be at most ``broadcast_rows`` and joined beyond.
    """
    spark = tracks.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        shared = _broadcast(spark, file.read())
    source = tracks.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    columns = f"_id {kind}, piece int, start long, length int, ids binary, _part int, _nth long"
    pieces = materialize(source.mapInArrow(_pieces(shared, end_id, capacity), columns), "token-pieces")

    counts = materialize(pieces.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n")), "length-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    # a row for a run of equal pieces: their number follows from the capacity, not from the table
    moves = F.broadcast(spark.createDataFrame(best_fit(histogram, capacity), _MOVE))
    earlier = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    if counts.count() <= broadcast_rows:
        before = F.broadcast(before)
    numbered = pieces.join(before, ["length", "_part"]).withColumn("_number", F.col("_before") + F.col("_nth"))
    at = numbered.join(moves.withColumnRenamed("length", "_length"), (F.col("length") == F.col("_length")) & F.col("_number").between(F.col("first"), F.col("last") - 1))
    within = F.col("_number") - F.col("first")
    return at.select(
        F.col("_id").alias(id_col),
        "piece",
        "start",
        F.col("length").cast("long").alias("length"),
        "ids",
        (F.col("sequence") + F.expr("(_number - first) div per_sequence")).alias("sequence_id"),
        (F.col("offset") + within % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
    )


class _Shared:
    """A broadcast with a name that workers may keep what they built from it under."""

    def __init__(self, broadcast, name: int):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def _broadcast(spark, text: str) -> _Shared:
    return _Shared(spark.sparkContext.broadcast(text), hash(text))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences, ready for training: ``sequence_id``, ``ids`` and the ``lengths`` of the pieces in them.

    A sequence has at most ``capacity`` pieces, so a group is bounded.
    """
    listed = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("_p"))
    joined = F.aggregate("_p", F.lit(b""), lambda total, p: F.concat(total, p["ids"]))
    return listed.select("sequence_id", joined.alias("ids"), F.transform("_p", lambda p: p["length"]).alias("lengths"))
