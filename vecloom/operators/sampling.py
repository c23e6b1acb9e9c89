"""Reproducible draws: positive pairs, views, shuffles and samples.

Every draw is a hash of a key, a seed and an epoch, so another epoch or seed is another draw and a
retried task repeats its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.functions.hashing import uniform, uniform_int
from vecloom.functions.windows import crop_start, random_crop
from vecloom.operators.ranking import group_positions, salt_bucket


def draw_seed(seed: str, epoch: int = 0, worker: int = 0) -> str:
    """The seed text of one epoch and worker."""
    return f"{seed}/{epoch}/{worker}"


def artist_pool_size(rows: DataFrame, artist: str = "artist", prob: float = 1.0) -> DataFrame:
    """Rows whose artist has another row. NULL artists do not count; 0 when ``prob`` is 0."""
    if prob <= 0:
        return rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("pool_size"))
    sizes = rows.where(F.col(artist).isNotNull()).groupBy(artist).agg(F.count(F.lit(1)).alias("m"))
    mates = sizes.where(F.col("m") > 1)
    return mates.agg(F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("pool_size"))


def positive_pairs(
    rows: DataFrame,
    prob: float,
    seed: str,
    *,
    id_col: str = "id",
    artist: str = "artist",
    buckets: int = 4096,
) -> DataFrame:
    """``id, partner_id, is_mate``: with probability ``prob`` another row of the same artist.

    Each row of an artist has a number; the partner is the row a drawn offset further on. That is
    uniform over the others and never the row itself, with one equi-join and no pair listing.
    Numbers come from bucketed counts, so a hot artist is not sorted in one task.
    """
    base = rows.select(F.col(id_col).alias("id"), F.col(artist).alias("artist"))
    numbered = group_positions(
        base.where(F.col("artist").isNotNull()),
        ["artist"],
        salt_bucket(F.col("id"), buckets),
        ["id"],
        "r",
        "m",
    )
    wants = (uniform(F.col("id"), f"{seed}:mate") < prob) & (F.col("m") > 1)
    offset = 1 + uniform_int(F.col("id"), f"{seed}:offset", F.col("m") - 1)
    asked = numbered.where(wants).select(
        "id", "artist", F.pmod(F.col("r") + offset, F.col("m")).alias("r")
    )
    partner = numbered.select(F.col("id").alias("partner_id"), "artist", "r")
    found = asked.join(partner, ["artist", "r"]).select("id", "partner_id")
    out = base.select("id").join(found, "id", "left")
    return out.select(
        "id",
        F.coalesce("partner_id", F.col("id")).alias("partner_id"),
        F.col("partner_id").isNotNull().alias("is_mate"),
    )


def two_view_rows(
    clips: DataFrame,
    pairs: DataFrame,
    view_samples: int,
    seed: str,
    *,
    id_col: str = "id",
    clip: str = "clip",
    label: str = "label",
) -> DataFrame:
    """``id, view1, view2, label``: one crop of the row and one of its partner, drawn apart."""
    own = clips.select(
        F.col(id_col).alias("id"),
        F.col(clip).alias("c1"),
        F.coalesce(F.col(label).cast("string"), F.lit("unknown")).alias("label"),
    )
    other = clips.select(F.col(id_col).alias("partner_id"), F.col(clip).alias("c2"))
    joined = own.join(pairs.select("id", "partner_id"), "id").join(other, "partner_id")
    return joined.select(
        "id",
        "partner_id",
        random_crop(F.col("c1"), view_samples, F.col("id"), f"{seed}:view1").alias("view1"),
        random_crop(F.col("c2"), view_samples, F.col("id"), f"{seed}:view2").alias("view2"),
        "label",
    )


def epoch_batches(
    rows: DataFrame,
    batch_size: int,
    seed: str,
    *,
    id_col: str = "id",
    drop_last: bool = True,
    buckets: int = 4096,
) -> DataFrame:
    """Rows in the shuffled order of an epoch, cut into batches of fixed size.

    The order is by hash bucket, then by hash, then by id; the place in it is the number inside the
    bucket plus the rows of earlier buckets.
    """
    key = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:order")).cast("binary"))
    bucket = salt_bucket(F.col(id_col), buckets, f"{seed}:order")
    placed = group_positions(rows.withColumn("_key", key), [], bucket, ["_key", id_col], "place")
    out = placed.drop("_key").withColumn("batch_id", F.floor(F.col("place") / batch_size).cast("bigint"))
    if drop_last:
        full = rows.count() // batch_size
        out = out.where(F.col("batch_id") < full)
    return out


def validation_batch_size(batch_size: int, n_rows: int) -> int:
    return min(batch_size, max(2, n_rows))


def sample_views(
    clips: DataFrame, n: int, window: int, hop: int, seed: str, *, id_col: str = "id", clip: str = "clip"
) -> DataFrame:
    """``n`` windows: one random crop per clip in hashed order, and a second one at ``hop`` from
    clips long enough when there are fewer clips than ``n``. Too few windows are an error."""
    usable = clips.where(F.col(clip).isNotNull())
    size = F.size(clip)
    # the last start is never drawn, hence one sample less than in ``random_crop``
    start = F.when(size < window, F.lit(0)).otherwise(
        crop_start(F.greatest(size - 1, F.lit(window)), window, F.col(id_col), f"{seed}:crop")
    )
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}:files")).cast("binary"))
    first = usable.select(
        F.col(id_col).alias("id"),
        order.alias("o"),
        F.lit(0).alias("part"),
        start.cast("int").alias("start"),
        V.pad_or_trim(F.col(clip), window, start).alias("window"),
    )
    parts = first
    if clips.count() < n:
        extra = usable.where(size >= window + hop).select(
            F.col(id_col).alias("id"),
            order.alias("o"),
            F.lit(1).alias("part"),
            F.lit(hop).alias("start"),
            V.pad_or_trim(F.col(clip), window, hop).alias("window"),
        )
        parts = first.unionByName(extra)
    have = parts.count()
    if have < n:
        raise ValueError(f"only collected {have} samples, wanted {n}")
    return parts.orderBy("o", "id", "part").limit(n).drop("o")

