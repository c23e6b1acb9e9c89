"""A Merkle manifest of a dataset, with leaf coordinates from bitmap ranks.

Leaves of a group (a split, a language) are ordered by id. Ids never get sorted: each task collects them in compressed bitmaps of 4,096
ids, the bitmaps of a group are merged, and popcount directories count the ids before each word, bitmap and range of bitmaps. The
rank of an id, looked up in them, is the coordinate of its leaf. Coordinates then address slots: 4,096 neighbours fill an
array of slots by key, and an array reduces twelve levels of the tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import materialize

#: levels that one array of slots reduces
LEVELS = 12
SLOTS = 1 << LEVELS
#: low bits of an id that a bitmap tells apart; the digits of the rest
BITS, DIGIT = 12, 17
#: ids from which on the bits of a bitmap are smaller than a list of places
SPARSE = 1 << (BITS - 4)
#: the fields of a manifest row
FIELDS = ("fma_track_id", "subset", "split", "genre_top", "artist_id", "artist_name", "path")

_RANGE = ("_g", "_top", "_high", "_mid")
#: the top digit of a null id, before all others
_NULL_TOP = -(1 << (63 - BITS - 2 * DIGIT)) - 1


def leaf_hash(fields: Sequence[str | Column]) -> Column:
    """Hex SHA-256 of the fields, each as its UTF-8 byte count, ``:`` and text; a null field is ``-``."""

    def framed(field: str | Column) -> Column:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*(framed(f) for f in fields)), 256)


def _leaves(rows: DataFrame, id_col: str, group_col: str, fields: Sequence[str]) -> DataFrame:
    """``_g`` (orders groups, null first), ``_i`` and ``_leaf`` of every row."""
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    return rows.select(group.alias("_g"), F.col(id_col).cast("long").alias("_i"), leaf_hash(fields).alias("_leaf"))


# ---- bitmaps and their directories


def _keyed(entries: DataFrame) -> DataFrame:
    """The digits of an id: the place in a bitmap (``_low``) and three for the range the bitmap is of."""
    digit = lambda shift, bits: F.coalesce(F.shiftrightunsigned("_i", shift).bitwiseAND((1 << bits) - 1), F.lit(0)).cast("int")
    return entries.select(
        "*",
        F.coalesce(F.shiftright("_i", BITS + 2 * DIGIT), F.lit(_NULL_TOP)).cast("int").alias("_top"),
        digit(BITS + DIGIT, DIGIT).alias("_high"),
        digit(BITS, DIGIT).alias("_mid"),
        digit(0, BITS).alias("_low"),
    )


def pack_bits(places: np.ndarray) -> bytes:
    """Distinct places as a compressed bitmap: a sorted list of 16-bit numbers, or all bits where that is less."""
    places = np.unique(places)
    if len(places) < SPARSE:
        return places.astype("<u2").tobytes()
    bits = np.zeros(1 << BITS, np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def unpack_bits(packed: bytes) -> np.ndarray:
    if len(packed) < 2 * SPARSE:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))


def popcounts(packed: bytes) -> bytes:
    """The directory of a bitmap: bits set before each of its words. A list needs none."""
    if len(packed) < 2 * SPARSE:
        return b""
    ones = np.bitwise_count(np.frombuffer(packed, "<u8")).astype(np.int64)
    return (np.cumsum(ones) - ones).astype("<u2").tobytes()


def ranks(packed: bytes, directory: bytes, places: np.ndarray) -> np.ndarray:
    """How many ids of the bitmap come before each place."""
    if not directory:
        return np.searchsorted(np.frombuffer(packed, "<u2"), places)
    words, before = np.frombuffer(packed, "<u8"), np.frombuffer(directory, "<u2")
    word, bit = places >> 6, (places & 63).astype(np.uint64)
    return before[word].astype(np.int64) + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))


def _partial_bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.Table.from_batches([batch])
        grouped = keys.group_by(list(_RANGE)).aggregate([("_low", "list")]) if batch.num_rows else None
        if grouped is not None:
            packed = [pack_bits(np.array(x)) for x in grouped.column("_low_list").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(grouped.column(c).combine_chunks() for c in _RANGE), pa.array(packed, pa.binary())], names=[*_RANGE, "_bits"])


def _merge(key: tuple, parts: pa.Table) -> pa.Table:
    merged = pack_bits(np.concatenate([unpack_bits(x) for x in parts.column("_bits").to_pylist()]))
    n = len(unpack_bits(merged))
    values = [*(k.as_py() for k in key), merged, popcounts(merged), n]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[*_RANGE, "_bits", "_directory", "_n"])


def rank_index(entries: DataFrame) -> DataFrame:
    """The merged bitmaps of all groups: a row per range, with its bitmap, its directory, ``_before`` and ``_size``.

    ``_before`` counts the ids of the group in earlier ranges. It is added up digit by digit, over at most 2^18 rows each time.
    """
    keys = "_g string, _top int, _high int, _mid int"
    partial = _keyed(entries).select(*_RANGE, "_low").mapInArrow(_partial_bitmaps, f"{keys}, _bits binary")
    bitmaps = materialize(partial.groupBy(*_RANGE).applyInArrow(_merge, f"{keys}, _bits binary, _directory binary, _n long"), "bitmaps")
    found, level = bitmaps, bitmaps.select(*_RANGE, "_n")
    for depth in (3, 2, 1):
        upper, digit = _RANGE[:depth], _RANGE[depth]
        window = Window.partitionBy(*upper).orderBy(digit).rowsBetween(Window.unboundedPreceding, -1)
        before = level.select(*upper, digit, F.coalesce(F.sum("_n").over(window), F.lit(0)).alias(f"_b{depth}"))
        found = found.join(before, [*upper, digit])
        level = level.groupBy(*upper).agg(F.sum("_n").alias("_n"))
    sized = found.join(level.withColumnRenamed("_n", "_size"), "_g")
    return sized.select(*_RANGE, "_bits", "_directory", (F.col("_b1") + F.col("_b2") + F.col("_b3")).alias("_before"), "_size")


def _coordinates(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    packed, directory, before, size = (right.column(c)[0].as_py() for c in ("_bits", "_directory", "_before", "_size"))
    place = before + ranks(packed, directory, left.column("_low").to_numpy().astype(np.int64))
    return pa.table([left.column("_g"), left.column("_i"), left.column("_leaf"), pa.array(place, pa.int64()), pa.array(np.full(len(place), size), pa.int64())], names=["_g", "_i", "_hash", "_pos", "_size"])


# ---- slots


def _node(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def _depth(size: int) -> int:
    """Levels that this round reduces: all of an array, or as many as leave one node."""
    return LEVELS if size > SLOTS else (size - 1).bit_length()


def _slots(nodes: pa.Table) -> tuple[np.ndarray, list[list[bytes]]]:
    """The slot of each row, and the levels of the array from the slots up."""
    slot = nodes.column("_pos").to_numpy() % SLOTS
    level: list[bytes] = [b""] * nodes.num_rows
    for at, value in zip(slot.tolist(), nodes.column("_hash").to_pylist(), strict=True):
        level[at] = value.encode()
    levels = [level]
    for _ in range(_depth(nodes.column("_size")[0].as_py())):
        level = [_node(b"".join(level[k : k + 2])) for k in range(0, len(level), 2)]
        levels.append(level)
    return slot, levels


def _reduce(key: tuple, nodes: pa.Table) -> pa.Table:
    size = nodes.column("_size")[0].as_py()
    values = [key[0].as_py(), key[1].as_py(), _slots(nodes)[1][-1][0].decode(), -(-size // SLOTS)]
    return pa.table([pa.array([v], t) for v, t in zip(values, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["_g", "_pos", "_hash", "_size"])


def _block() -> Column:
    return F.floor(F.col("_pos") / SLOTS).cast("long").alias("_block")


def reduce_levels(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of nodes ``_g, _pos, _hash, _size``: the given ones first, one node per group last."""
    rounds = [nodes]
    while rounds[-1].filter("_size > 1").limit(1).count():
        level = rounds[-1].select("_g", _block(), "_pos", "_hash", "_size").groupBy("_g", "_block")
        rounds.append(materialize(level.applyInArrow(_reduce, "_g string, _pos long, _hash string, _size long"), f"slots-{len(rounds)}"))
    return rounds


_PATH = "_path array<string>, _subroot string"


def _descend(extra: tuple[str, ...]):
    """Each node's siblings up to the top of its array, then those of the array's own node.

    A step is one sign and a hash: ``<`` for a sibling on the left, ``>`` on the right, ``=`` for a node that stands alone.
    """

    def run(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        slot, levels = _slots(nodes)
        upper = above.column("_path")[0].as_py()
        steps = np.empty((nodes.num_rows, len(levels) - 1 + len(upper)), object)
        for k, level in enumerate(levels[:-1]):
            at = slot >> k
            near = np.array([(("<" if j < i else ">") + level[j].decode()) if (j := i ^ 1) < len(level) else "=" for i in range(len(level))], object)
            steps[:, k] = near[at]
        steps[:, len(levels) - 1 :] = upper
        offsets = np.arange(nodes.num_rows + 1, dtype=np.int32) * steps.shape[1]
        paths = pa.ListArray.from_arrays(pa.array(offsets), pa.array(steps.ravel(), pa.string()))
        subroot = pa.array([above.column("_subroot")[0].as_py()] * nodes.num_rows, pa.string())
        return pa.table([*(nodes.column(c) for c in ("_g", "_pos", "_hash", *extra)), paths, subroot], names=["_g", "_pos", "_hash", *extra, "_path", "_subroot"])

    return run


def _paths(rounds: list[DataFrame], top: DataFrame, last: tuple[str, ...] = ()) -> DataFrame:
    """The rows of ``rounds[0]`` with their siblings, from ``top``: one row of ``_g, _path, _subroot`` per group."""
    above = top.withColumn("_block", F.lit(0).cast("long"))
    for k in range(len(rounds) - 2, -1, -1):
        extra = last if k == 0 else ()
        schema = "_g string, _pos long, _hash string, " + "".join(f"{c} long, " for c in extra) + _PATH
        nodes = rounds[k].withColumn("_block", _block())
        level = nodes.groupBy("_g", "_block").cogroup(above.groupBy("_g", "_block")).applyInArrow(_descend(extra), schema)
        above = level.withColumn("_block", F.col("_pos")) if k else level
    return above if len(rounds) > 1 else rounds[0].join(top, "_g")


# ---- the operator


def merkle_manifest(rows: DataFrame, id_col: str = "fma_track_id", group_col: str = "split", fields: Sequence[str] = FIELDS) -> DataFrame:
    """The Merkle tree over a dataset manifest, a row per leaf with all that proves it.

    A leaf is the hash of ``fields`` (``leaf_hash``). The leaves of a group ascend by id; while several nodes remain, each two neighbours
    (the last may stand alone) become the hash of their hex digests. A group's last node is its ``subroot``; the subroots, by group name
    (null first, then by UTF-8 bytes), give the ``root`` in the same way. Returns the id, the group, ``leaf``, ``position`` (from 0 in
    the group), ``siblings`` (from the leaf up to the root: ``side`` is ``left``, ``right`` or ``none`` where a node stands alone,
    and ``hash``), ``subroot`` and ``root``.

    Ids are integers; a null id comes before all others, a null group before all others. Fields may be null, empty or very long.
    An id is one leaf of its group: of rows that repeat it, the least hash stands for them, so equal rows share a leaf and
    others can be told by ``verify_rows``. Other columns are not read; an empty table gives no rows. Every array and every
    bitmap is bounded, whatever the size of a group.
    """
    spark = rows.sparkSession
    kept = materialize(_leaves(rows, id_col, group_col, fields).groupBy("_g", "_i").agg(F.min("_leaf").alias("_leaf")), "manifest-leaves")
    keyed = _keyed(kept).groupBy(*_RANGE)
    placed = keyed.cogroup(rank_index(kept).groupBy(*_RANGE)).applyInArrow(_coordinates, "_g string, _i long, _hash string, _pos long, _size long")
    rounds = reduce_levels(materialize(placed, "manifest-slots"))
    groups = _ordered(rounds[-1].select(F.col("_g").alias("_of"), F.col("_hash").alias("_subroot")))
    upper = reduce_levels(groups.select(F.lit("").alias("_g"), "_pos", F.col("_subroot").alias("_hash"), "_size"))
    root = (upper[-1].select("_hash").first() or [None])[0]
    none = spark.createDataFrame([("", [], "")], "_g string, " + _PATH)
    above = _paths(upper, none).select("_pos", "_path")
    top = materialize(groups.join(above, "_pos").select(F.col("_of").alias("_g"), "_path", "_subroot"), "manifest-tops")
    proved = _paths(rounds, top, ("_i",))
    side = lambda s: F.when(s.startswith("<"), "left").when(s.startswith(">"), "right").otherwise("none")
    steps = F.transform("_path", lambda s: F.struct(side(s).alias("side"), F.nullif(F.substr(s, F.lit(2)), F.lit("")).alias("hash")))
    given = {f.name: f.dataType for f in rows.schema}
    return proved.select(
        F.col("_i").cast(given[id_col]).alias(id_col),
        F.when(F.col("_g") != "", F.substr("_g", F.lit(2))).cast(given[group_col]).alias(group_col),
        F.col("_hash").alias("leaf"),
        F.col("_pos").alias("position"),
        steps.alias("siblings"),
        F.col("_subroot").alias("subroot"),
        F.lit(root).cast("string").alias("root"),
    )


def _ordered(groups: DataFrame) -> DataFrame:
    """Groups with ``_pos`` in the order of their names, and ``_size``. Ranges of names are numbered where they lie."""
    spark = groups.sparkSession
    by_name = groups.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "_of").sortWithinPartitions("_of")
    local = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    parts = materialize(by_name.select("*", F.spark_partition_id().alias("_part"), local.alias("_nth")), "group-order")
    counts = parts.groupBy("_part").count()
    before = counts.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = parts.count()
    placed = parts.join(F.broadcast(before), "_part")  # a row per partition
    return placed.select("_of", "_subroot", (F.col("_before") + F.col("_nth")).alias("_pos"), F.lit(total).cast("long").alias("_size"))


def fold(leaf: Column, siblings: Column) -> Column:
    """The root that a leaf and its siblings lead to."""

    def up(node: Column, s: Column) -> Column:
        joined = F.when(s["side"] == "left", F.concat(s["hash"], node)).when(s["side"] == "right", F.concat(node, s["hash"])).otherwise(node)
        return F.sha2(joined, 256)

    return F.aggregate(siblings, leaf, up)


def verify_rows(manifest: DataFrame, rows: DataFrame, id_col: str = "fma_track_id", group_col: str = "split", fields: Sequence[str] = FIELDS) -> DataFrame:
    """Rows that claim to be of a dataset, held against its manifest (of ``merkle_manifest``, with the same fields).

    Returns every row's id and group, the manifest's ``leaf``, ``siblings``, ``subroot`` and ``root``, ``folded_root`` (what the row's own
    hash and the siblings lead to) and ``verified``. Rows that the manifest doesn't list have nulls and aren't verified; null ids
    and groups meet null ones. Repeated rows are judged one by one; an id that holds a third of the rows is split by adaptive execution.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    listed = manifest.select(group.alias("_mg"), F.col(id_col).cast("long").alias("_mi"), "leaf", "siblings", "subroot", "root")
    own = _leaves(rows, id_col, group_col, fields)
    met = own.join(listed, (F.col("_g") == F.col("_mg")) & F.col("_i").eqNullSafe(F.col("_mi")), "left")
    folded = met.withColumn("folded_root", F.when(F.col("leaf").isNotNull(), fold(F.col("_leaf"), F.col("siblings"))))
    given = {f.name: f.dataType for f in rows.schema}
    return folded.select(
        F.col("_i").cast(given[id_col]).alias(id_col),
        F.when(F.col("_g") != "", F.substr("_g", F.lit(2))).cast(given[group_col]).alias(group_col),
        "leaf",
        "siblings",
        "subroot",
        "root",
        "folded_root",
        F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)).alias("verified"),
    )
