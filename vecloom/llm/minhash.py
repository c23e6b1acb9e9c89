"""Near-duplicate tracks by circulant MinHash.

A shingle's hash is its place on a ring of 2^32 (the first permutation). One second permutation ``pi`` of the ring serves all
coordinates: coordinate k is the smallest ``pi(place + k * step)``, that is ``pi`` circularly shifted k times. The signature is
cut into bands; tracks that agree in a band are candidates, and candidates are confirmed on their full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import bytesets as B
from vecloom.llm.graph import components
from vecloom.session import materialize

WORDS = 5
#: similarity in percent from which two tracks are linked
PERCENT = 75
#: 40 bands of 4: two sets at 0.75 share no band with probability 0.684^40 = 2.5e-7
BANDS, ROWS = 40, 4
COORDINATES = BANDS * ROWS
#: equal coordinates below which a pair isn't confirmed: 5.8 standard deviations under those of two sets at 0.75
LEAST_EQUAL = 88
#: entries of a band value that are compared in one group; more are cut into blocks, and pairs of blocks are the groups
BLOCK = 1024
#: members of a family whose full sets are compared in one group, in blocks likewise
FAMILY_BLOCK = 256
#: rows of a counted table of ids that may be broadcast
BROADCAST_ROWS = 500_000

_STEPS = (np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B1)).astype(np.uint32)[:, None]
_PIECE = 4096


def _pi(x: np.ndarray) -> np.ndarray:
    """A permutation of the ring, in place: odd factors and an xor-shift are bijections modulo 2^32."""
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    return x


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["_id", "_shingles"])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The coordinates of a set of 64-bit shingle hashes."""
    places = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(places), _PIECE):
        np.minimum(least, _pi(places[None, lo : lo + _PIECE] + _STEPS).min(axis=1), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit value for each row and band."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        total = B.mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return total


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text, ascending; empty without words."""
    data, offsets = B.text_bytes(column)
    for lo, hi in B.row_slices(offsets):
        part = offsets[lo : hi + 1]
        words = B.Words(data[part[0] : part[-1]], part - part[0], B.SPACED_WORDS)
        grams, at = words.grams(WORDS)
        first = np.searchsorted(at, words.first)
        for r in range(hi - lo):
            begin, end = words.first[r], words.first[r + 1]
            if 0 < end - begin < WORDS:
                yield B.combine(words.hash, np.array([begin]), int(end - begin))
            else:
                yield np.unique(grams[first[r] : first[r + 1]])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, sets, signatures = [], [], []
        for shingles in shingle_sets(batch.column(1)):
            sizes.append(len(shingles))
            if len(shingles):
                whole = np.array([shingles.sum(), B.mix(shingles).sum()], np.uint64)
                sets.append(whole.tobytes())
                signatures.append(signature(shingles))
            else:
                sets.append(None)
        full = np.array([s is not None for s in sets], bool)
        keys = np.zeros((len(sets), BANDS), np.int64)
        small: list[bytes | None] = [None] * len(sets)
        if signatures:
            stacked = np.stack(signatures)
            keys[full] = band_keys(stacked).view(np.int64)
            for place, row in zip(np.flatnonzero(full), stacked.astype(np.uint8), strict=True):
                small[place] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes, pa.int64()),
                pa.array(sets, pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel())),
                pa.array(small, pa.binary()),
            ],
            names=["_id", "_n", "_set", "_bands", "_sketch"],
        )


def _equal(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of equal coordinates of paired sketches."""
    return (left == right).sum(axis=1)


def _bytes_of(column: pa.Array) -> np.ndarray:
    data, _ = B.text_bytes(column)
    return data.reshape(-1, COORDINATES)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            near = _equal(_bytes_of(batch.column(2)), _bytes_of(batch.column(3))) >= LEAST_EQUAL
            kept = batch.filter(pa.array(near))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["_lead", "_id"])


def _linked(left: np.ndarray, right: np.ndarray) -> bool:
    together = np.sort(np.concatenate([left, right]), kind="stable")
    both = int((together[1:] == together[:-1]).sum())
    return len(left) > 0 and 100 * both >= PERCENT * (len(left) + len(right) - both)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3)), strict=True)
        kept = batch.filter(pa.array([_linked(left, right) for left, right in pairs], pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["_lead", "_id"])


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups. Rows come sorted by the first columns; the last group of a batch may go on in the next."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
        turn = np.flatnonzero(_turns(table, n_keys))
        last = int(turn[-1]) if len(turn) else 0
        held = next(iter(table.slice(last).combine_chunks().to_batches()), None)
        if last:
            yield table.slice(0, last).combine_chunks()
    if held is not None and held.num_rows:
        yield pa.Table.from_batches([held])


def _turns(table: pa.Table, n_keys: int) -> np.ndarray:
    """Whether a row starts a new group; the first row doesn't count."""
    keys = np.stack([B.integers(table.column(k).combine_chunks()) for k in range(n_keys)])
    return np.concatenate([[False], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])


def _contacts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of band groups that look alike but have different labels, each with the first member of its cluster."""
    for table in _groups(batches, 3):
        number = np.cumsum(_turns(table, 3))
        side_a, side_b, block, label = (B.integers(table.column(k).combine_chunks()) for k in (1, 2, 3, 4))
        ids, sketches = table.column(5).combine_chunks(), _bytes_of(table.column(6).combine_chunks())
        found = [np.zeros((2, 0), np.int64)]
        for step in range(1, int(np.bincount(number).max())):
            left = np.flatnonzero(number[:-step] == number[step:])
            right = left + step
            asked = (label[left] != label[right]) & ((side_a[left] == side_b[left]) | (block[left] != block[right]))
            left, right = left[asked], right[asked]
            for k in range(0, len(left), 8192):
                near = _equal(sketches[left[k : k + 8192]], sketches[right[k : k + 8192]]) >= LEAST_EQUAL
                found.append(np.stack([left[k : k + 8192][near], right[k : k + 8192][near]]))
        left, right = np.concatenate(found, axis=1)
        if len(left):
            head = np.arange(len(ids))
            while True:
                lowest = np.minimum(head[left], head[right])
                new = head.copy()
                np.minimum.at(new, left, lowest)
                np.minimum.at(new, right, lowest)
                new = new[new]
                if (new == head).all():
                    break
                head = new
            met = np.unique(np.concatenate([left, right]))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(head[met])), ids.take(pa.array(met))], names=["_lead", "_id"])


def _family_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links between members with different labels; links that only repeat a connection are left out."""
    for table in _groups(batches, 3):
        edges = [0, *np.flatnonzero(_turns(table, 3)).tolist(), table.num_rows]
        for lo, hi in zip(edges, edges[1:], strict=False):
            links = _spanning(table.slice(lo, hi - lo).combine_chunks())
            if links:
                ids = table.column(5).combine_chunks().slice(lo, hi - lo)
                sides = [ids.take(pa.array([link[k] for link in links])) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(sides, names=["_lead", "_id"])


def _spanning(group: pa.Table) -> list[tuple[int, int]]:
    whole = B.integers(group.column(1).combine_chunks())[0] == B.integers(group.column(2).combine_chunks())[0]
    block = B.integers(group.column(3).combine_chunks())
    _, number = np.unique(B.integers(group.column(4).combine_chunks()), return_inverse=True)
    sketches = _bytes_of(group.column(6).combine_chunks())
    sets = [np.frombuffer(v, np.uint64) for v in group.column(7).to_pylist()]
    links = []
    for x in range(len(sets) - 1):
        asked = number[x + 1 :] != number[x]
        if not whole:
            asked &= block[x + 1 :] != block[x]
        rest = x + 1 + np.flatnonzero(asked)
        equal = (sketches[rest] == sketches[x]).sum(axis=1)
        for k in np.argsort(-equal, kind="stable"):
            y = rest[k]
            if equal[k] < LEAST_EQUAL:
                break
            if number[y] != number[x] and _linked(sets[x], sets[y]):
                links.append((x, int(y)))
                number[number == number[y]] = number[x]
    return links


def near_duplicates(tracks: DataFrame, id_col: str = "track_id", text_col: str = "title") -> DataFrame:
    """Groups of tracks whose texts are near-copies, one row per row of ``tracks``.

    A track's set holds the distinct runs of five words of its lower-cased (A-Z) text; a shorter text is one run. Tracks are
    linked when the sets overlap by 75 % or more; links are confirmed on full sets. Returns the id, ``n_shingles``,
    ``component_id`` (smallest id reachable over links, itself included) and ``kept`` (id = component_id).

    Null texts and texts without words have an empty set and stand alone; so do rows with a null id, which are kept. Rows that
    repeat an id are one track with several texts. Other columns are not read; an empty table gives no rows.

    Equal sets are one from the start, so a copy group of any size costs one row. In a band value's group all members meet its
    smallest id. Members that stay apart are compared by sketch inside tasks, in blocks of ``BLOCK``; clusters that look alike are
    families, whose full sets are compared in blocks of ``FAMILY_BLOCK``. Either kind of group is bounded however hot its key is,
    and hands on one row for each member at most, never its pairs. Links become components by stars.
    """
    spark = tracks.sparkSession
    source = tracks.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = source.schema["_id"].dataType
    sketches = source.mapInArrow(
        _sketches,
        T.StructType(
            [
                T.StructField("_id", id_type),
                T.StructField("_n", T.LongType()),
                T.StructField("_set", T.BinaryType()),
                T.StructField("_bands", T.ArrayType(T.LongType())),
                T.StructField("_sketch", T.BinaryType()),
            ]
        ),
    )
    sketches = materialize(sketches, "sketches")
    pair_type = T.StructType([T.StructField("_lead", id_type), T.StructField("_id", id_type)])
    named = sketches.filter("_n > 0 AND _id IS NOT NULL")
    firsts = named.groupBy("_set").agg(F.min("_id").alias("_first"))
    copies = materialize(named.select("_id", "_set").join(firsts, "_set").select("_id", "_first").distinct(), "copies")
    distinct = materialize(named.join(firsts, "_set").filter("_id = _first").select("_id", "_bands", "_sketch").dropDuplicates(["_id", "_bands"]), "distinct")
    looks = distinct.select("_id", "_sketch")
    entries = distinct.select("_id", F.explode("_bands").alias("_band"))
    leads = entries.groupBy("_band").agg(F.min("_id").alias("_lead"), F.count("*").alias("_size")).filter("_size > 1")
    members = materialize(entries.join(leads, "_band"), "members")

    def few(rows: DataFrame) -> DataFrame:
        """A written table, broadcast while it is small."""
        return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (_lead, _id) whose full sets overlap enough."""
        pairs = few(materialize(pairs, "pairs"))
        near = looks.join(pairs, "_id").join(looks.withColumnsRenamed({"_id": "_lead", "_sketch": "_left"}), "_lead")
        likely = materialize(near.select("_lead", "_id", "_left", "_sketch").mapInArrow(_likely, pair_type), "likely")
        texts = materialize(source.join(few(likely.select("_id").union(likely.select("_lead"))), "_id", "left_semi"), "texts")
        full = texts.join(few(likely), "_id").join(texts.withColumnsRenamed({"_id": "_lead", "_text": "_other"}), "_lead")
        return materialize(full.select("_lead", "_id", "_text", "_other").mapInArrow(_confirm, pair_type), "links")

    def in_blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
        """A row for each pair of blocks it is in: (key, _a, _b) are groups of at most about two blocks."""
        n_blocks = F.ceil(F.col("_size") / size).cast("int")
        dealt = rows.withColumn("_block", F.pmod(F.xxhash64("_id"), n_blocks).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        return dealt.select(
            key, F.least("_block", "_other").alias("_a"), F.greatest("_block", "_other").alias("_b"), "_block", F.xxhash64("_label").alias("_label"), "_id"
        )

    def by_group(rows: DataFrame, key: str) -> DataFrame:
        return rows.repartition(parts, key, "_a", "_b").sortWithinPartitions(key, "_a", "_b", "_id")

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    first = confirmed(members.filter("_id <> _lead").select("_lead", "_id").distinct())
    labels = materialize(first.groupBy("_id").agg(F.min("_lead").alias("_label")), "labels")
    labelled = members.filter("_size > 2").join(few(labels), "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))
    met = in_blocks(labelled, "_band", BLOCK).join(looks, "_id").select("_band", "_a", "_b", "_block", "_label", "_id", "_sketch")
    met = materialize(by_group(met, "_band").mapInArrow(_contacts, pair_type).distinct(), "contacts")
    sizes = met.groupBy("_lead").agg(F.count("*").alias("_size"))
    sets = source.join(few(met.select("_id")), "_id", "left_semi").mapInArrow(
        _full_sets, T.StructType([T.StructField("_id", id_type), T.StructField("_shingles", T.BinaryType())])
    )
    sets = sets.join(looks, "_id")
    family = met.join(sizes, "_lead").join(few(labels), "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))
    family = few(materialize(in_blocks(family.withColumn("_family", F.xxhash64("_lead")), "_family", FAMILY_BLOCK), "families"))
    family = sets.join(family, "_id").select("_family", "_a", "_b", "_block", "_label", "_id", "_sketch", "_shingles")
    second = materialize(by_group(family, "_family").mapInArrow(_family_links, pair_type), "family-links")

    links = first.union(second).toDF("a", "b")
    own = copies.groupBy("_id").agg(F.min("_first").alias("_first"), F.max("_first").alias("_last"))
    if not own.filter("_first <> _last").isEmpty():  # rows of one id with several sets are one track
        links = links.union(copies.select("_first", "_id"))
        own = own.withColumn("_first", F.col("_id"))
    found = own.join(components(links), F.col("_first") == F.col("node"), "left").select(
        F.col("_id").alias("_key"), F.coalesce("component", "_first").alias("_component")
    )
    return (
        sketches.select("_id", "_n")
        .join(found, F.col("_id") == F.col("_key"), "left")
        .select(
            F.col("_id").alias(id_col),
            F.col("_n").alias("n_shingles"),
            F.coalesce("_component", "_id").alias("component_id"),
            F.col("_id").eqNullSafe(F.coalesce("_component", "_id")).alias("kept"),
        )
    )
