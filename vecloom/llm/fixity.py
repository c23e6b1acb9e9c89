"""Fixity audit of archived files by Merkle trees, in DataFrame operations.

Files are packed as WARC resource records into volumes. A record's address is its volume's base plus its offset; a leaf of the tree
is a range of addresses, a node a range of ``FANOUT`` ranges, up to one root. Two replicas are compared root first, and only the
branches that differ are followed, down to the records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialize

#: records of a volume, about
RECORDS_PER_VOLUME = 10_000
#: bytes of addresses in a leaf, children of a node
LEAF_BYTES, FANOUT = 1 << 18, 16


def warc_record(path: Column, content: Column) -> Column:
    """The bytes of a WARC/1.0 resource record; null parts are empty."""
    content = F.coalesce(content.cast("binary"), F.lit(b""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "),
        F.coalesce(path, F.lit("")),
        F.lit("\r\nContent-Type: application/octet-stream\r\nContent-Length: "),
        F.octet_length(content).cast("string"),
        F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), content, F.lit(b"\r\n\r\n"))


def pack_records(
    files: DataFrame, id_col: str = "track_id", path_col: str = "path", content_col: str = "content", records_per_volume: int = RECORDS_PER_VOLUME
) -> DataFrame:
    """Files of the library as WARC records in volumes: id, ``volume``, ``offset``, ``length`` and ``record``.

    A hash of the id deals the volumes; within one, records follow each other by id, then path and record, so equal input gives equal
    offsets. Null ids, paths and contents are empty strings to the hash and the record; repeated rows are records of their own.
    Other columns are dropped. An empty table gives no records.
    """
    n_volumes = F.lit(max(1, -(-files.count() // records_per_volume)))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    digits = F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")
    records = files.select(
        F.col(id_col).alias("_id"), F.pmod(digits, n_volumes).alias("volume"), F.col(path_col).alias("_path"), warc_record(F.col(path_col), F.col(content_col)).alias("record")
    ).withColumn("length", F.octet_length("record").cast("long"))
    # offsets are summed over narrow rows; a volume is about ``records_per_volume`` of them
    before = F.expr(
        "sum(length) OVER (PARTITION BY volume ORDER BY _id NULLS FIRST, _path NULLS FIRST, record ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    return records.withColumn("offset", F.coalesce(before, F.lit(0).cast("long"))).select(F.col("_id").alias(id_col), "volume", "offset", "length", "record")


def _digests(records: DataFrame, id_col: str) -> DataFrame:
    return records.select(
        F.col(id_col).alias("_id"),
        F.col("volume").cast("long").alias("_volume"),
        F.col("offset").cast("long").alias("_offset"),
        F.octet_length("record").cast("long").alias("_length"),
        F.sha2(F.coalesce("record", F.lit(b"")), 256).alias("_hash"),
    ).filter("_volume IS NOT NULL AND _offset IS NOT NULL")


def _parents(nodes: DataFrame, width: int) -> DataFrame:
    """Nodes one level up. A node has at most ``FANOUT`` children, a leaf the records that start in its range."""
    grouped = nodes.groupBy(F.floor(F.col("node") / width).cast("long").alias("_up")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("_of"))
    joined = F.array_join(F.transform("_of", lambda c: F.concat(c["node"].cast("string"), F.lit(":"), c["hash"])), ",")
    return grouped.select(F.col("_up").alias("node"), F.sha2(joined, 256).alias("hash"))


def build_tree(records: DataFrame, span: int, height: int) -> list[DataFrame]:
    """Levels of a tree (``node, hash``) over record digests: the records first, the root last."""
    own = records.select((F.col("_volume") * span + F.col("_offset")).alias("node"), F.concat_ws("|", "_offset", "_length", "_hash").alias("hash"))
    levels = [own, materialize(_parents(own, LEAF_BYTES), "merkle-leaves")]
    while len(levels) < height + 2:
        levels.append(materialize(_parents(levels[-1], FANOUT), f"merkle-{len(levels)}"))
    return levels


def audit_fixity(primary: DataFrame, replica: DataFrame, id_col: str = "track_id") -> DataFrame:
    """Records of ``primary`` that ``replica`` doesn't hold as they are, and those that only it holds.

    Both tables are as ``pack_records`` returns them (``id_col, volume, offset, record``). Returns the id, ``volume``, ``offset``,
    ``length`` and ``kind``: ``changed``, ``missing`` (not in the replica at its offset) or ``extra``. Equal roots give an empty result
    without a look at the branches.

    A null record is an empty one; rows without volume or offset can't be addressed and are reported by neither side. Two records at
    one address are both hashed; if they differ between the replicas, each is reported. Other columns are not read; an empty table
    has an empty tree, so the other's records are all missing or extra.
    """
    left, right = (materialize(_digests(side, id_col), "digests") for side in (primary, replica))
    both = left.unionByName(right).agg(F.max(F.col("_offset") + 1).alias("bytes"), F.max("_volume").alias("volumes")).first()
    span = LEAF_BYTES
    while span < (both["bytes"] or 1):
        span *= FANOUT
    height, reach = 0, LEAF_BYTES
    while reach < span * ((both["volumes"] or 0) + 1):
        height, reach = height + 1, reach * FANOUT
    trees = [build_tree(side, span, height) for side in (left, right)]
    wrong = None
    for level in range(height + 1, -1, -1):
        a, b = (tree[level] for tree in trees)
        if wrong is not None:
            width = LEAF_BYTES if level == 0 else FANOUT
            a, b = (t.withColumn("_up", F.floor(F.col("node") / width).cast("long")).join(wrong, "_up", "left_semi").drop("_up") for t in (a, b))
        if level == 0:
            a, b = (t.dropDuplicates() for t in (a, b))
            differ = a.join(b, ["node", "hash"], "left_anti").select("node", "hash", F.lit(True).alias("_own"))
            differ = differ.unionByName(b.join(a, ["node", "hash"], "left_anti").select("node", "hash", F.lit(False).alias("_own")))
        else:
            differ = a.withColumnRenamed("hash", "_a").join(b.withColumnRenamed("hash", "_b"), "node", "full").filter(~F.col("_a").eqNullSafe(F.col("_b")))
            wrong = materialize(differ.select(F.col("node").alias("_up")), f"differing-{level}")
            if wrong.isEmpty():
                differ = trees[0][0].filter(F.lit(False)).withColumn("_own", F.lit(True))
                break
    differ = materialize(differ.select("node", "hash", "_own"), "differing-records")
    sides = []
    for own, records in ((True, left), (False, right)):
        keyed = records.withColumn("node", F.col("_volume") * span + F.col("_offset")).withColumn("hash", F.concat_ws("|", "_offset", "_length", "_hash"))
        sides.append(keyed.join(differ.filter(F.col("_own") == own).select("node", "hash").distinct(), ["node", "hash"], "left_semi"))
    met = [s.select("node").distinct() for s in sides]
    changed = sides[0].join(met[1], "node", "left_semi").withColumn("kind", F.lit("changed"))
    missing = sides[0].join(met[1], "node", "left_anti").withColumn("kind", F.lit("missing"))
    extra = sides[1].join(met[0], "node", "left_anti").withColumn("kind", F.lit("extra"))
    return changed.unionByName(missing).unionByName(extra).select(
        F.col("_id").alias(id_col), F.col("_volume").alias("volume"), F.col("_offset").alias("offset"), F.col("_length").alias("length"), "kind"
    )
