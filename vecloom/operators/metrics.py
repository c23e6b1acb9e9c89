"""Retrieval metrics over a neighbour table ``query_id, neighbor_id, rank, score``.

``knn_join`` gives every seed the same number of neighbours, min(k, n - 1), so the mean over seeds
of the mean over neighbours is one global mean: no grouping by seed is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions import vectors as V
from vecloom.operators.rows import one_row


def recall_at_k(
    neighbors: DataFrame,
    labels: DataFrame,
    k_values: Sequence[int] = fixed.EVAL_KS,
    *,
    id_col: str = "id",
    label: str = "label",
) -> DataFrame:
    """Share of top-k neighbours that carry the label of their seed: one row, ``recall_at_{k}``."""
    seen = _with_labels(neighbors, labels, id_col, label)
    hit = (F.col("seed_label") == F.col("neighbor_label")).cast("double")
    return seen.agg(
        *[
            F.avg(F.when(F.col("rank") < k, F.coalesce(hit, F.lit(0.0)))).alias(f"recall_at_{k}")
            for k in k_values
        ]
    )


def _with_labels(neighbors: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    seed = labels.select(F.col(id_col).alias("query_id"), F.col(label).alias("seed_label"))
    near = labels.select(F.col(id_col).alias("neighbor_id"), F.col(label).alias("neighbor_label"))
    return neighbors.select("query_id", "neighbor_id", "rank").join(seed, "query_id").join(
        near, "neighbor_id"
    )


def tag_jaccard_at_k(
    neighbors: DataFrame,
    tags: DataFrame,
    k_values: Sequence[int] = fixed.EVAL_KS,
    *,
    id_col: str = "id",
    tag_set: str = "tags",
) -> DataFrame:
    """Mean Jaccard of the seed's tag set and its neighbours'. Seeds without tags are left out."""
    no_tags = F.array().cast("array<string>")
    have = tags.select(id_col, F.coalesce(F.col(tag_set), no_tags).alias("t"))
    seeds = have.where(F.size("t") > 0).select(
        F.col(id_col).alias("query_id"), F.col("t").alias("seed")
    )
    near = have.select(F.col(id_col).alias("neighbor_id"), F.col("t").alias("near"))
    joined = (
        neighbors.select("query_id", "neighbor_id", "rank")
        .join(seeds, "query_id")
        .join(near, "neighbor_id", "left")
    )
    near_tags = F.coalesce(F.col("near"), no_tags)
    both = F.size(F.array_intersect("seed", near_tags))
    either = F.greatest(F.size(F.array_union("seed", near_tags)), F.lit(1))
    return joined.agg(
        F.count_if(F.col("rank") == 0).alias("n_seeds"),
        *[
            F.coalesce(F.avg(F.when(F.col("rank") < k, both / either)), F.lit(0.0)).alias(
                f"jaccard_at_{k}"
            )
            for k in k_values
        ],
    )


def group_cohesion(
    df: DataFrame, group: str = "album", vector: str = "embedding", min_tracks: int = 4
) -> DataFrame:
    """Mean cosine inside groups against across groups, without forming a single pair.

    With S_a the vector sum of group a, the off-diagonal mean is
    (|S_a|^2 - sum |x|^2) / (m (m - 1)), and the cross mean follows from the S_a in the same way.
    The summarizer merges partial sums before the shuffle, so a hot group sends one vector per task.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    per_group = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("m"),
        F.sum(V.squared_norm(F.col(vector))).alias("self"),
        Summarizer.sum(array_to_vector(V.doubles(F.col(vector)))).alias("s"),
    )
    eligible = per_group.where(F.col("m") >= min_tracks)
    squares = eligible.withColumn("sq", V.squared_norm(vector_to_array("s")))
    m = F.col("m")
    # grouped by a constant: no eligible group gives no row rather than an empty summarizer
    totals = squares.groupBy(F.lit(1).alias("_one")).agg(
        F.avg((F.col("sq") - F.col("self")) / (m * (m - 1))).alias("intra"),
        F.count(F.lit(1)).alias("n_albums"),
        F.sum("m").alias("n"),
        F.sum(m * m).alias("mm"),
        F.sum("sq").alias("sq"),
        V.squared_norm(vector_to_array(Summarizer.sum(F.col("s")))).alias("all"),
    )
    both = one_row(totals)
    cross_pairs = F.col("n") * F.col("n") - F.col("mm")
    cross = F.when(cross_pairs > 0, (F.col("all") - F.col("sq")) / cross_pairs).otherwise(0.0)
    intra = F.coalesce(F.col("intra"), F.lit(0.0))
    cross = F.coalesce(cross, F.lit(0.0))
    return both.select(
        intra.alias("intra_mean"),
        cross.alias("cross_mean"),
        (intra - cross).alias("gap"),
        F.coalesce(F.col("n_albums"), F.lit(0)).cast("bigint").alias("n_albums"),
        F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("n_tracks"),
    )


def label_confusion(
    neighbors: DataFrame, labels: DataFrame, k: int = 10, *, id_col: str = "id", label: str = "label"
) -> DataFrame:
    """Seed label x neighbour label counts over the top k, and their share of the seed label."""
    seen = _with_labels(neighbors.where(F.col("rank") < k), labels, id_col, label)
    counts = seen.groupBy("seed_label", "neighbor_label").agg(F.count(F.lit(1)).alias("n"))
    row = F.greatest(F.sum("n").over(Window.partitionBy("seed_label")), F.lit(1))
    return counts.withColumn("share", F.col("n") / row)


def random_baseline(labels: DataFrame, label: str = "label") -> DataFrame:
    """Expected recall of a random ranking: 1/L, and the form for unbalanced labels."""
    per_label = labels.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = per_label.agg(
        F.count(F.lit(1)).alias("n_labels"),
        F.sum("n").alias("rows"),
        F.sum(F.col("n") * (F.col("n") - 1)).alias("same"),
    )
    rows = F.col("rows")
    return totals.select(
        "n_labels",
        (1.0 / F.col("n_labels")).alias("baseline"),
        F.when(rows > 1, F.col("same") / (rows * (rows - 1))).alias("baseline_unbalanced"),
    )


def neighbour_overlap(
    a: DataFrame, b: DataFrame, n_rows: int, k_values: Sequence[int] = fixed.OVERLAP_KS
) -> DataFrame:
    """Mean share of common neighbours of two neighbour tables over the same ``n_rows`` ids.

    Seeds without any common neighbour count as 0, hence the division by all seeds.
    """
    if n_rows < 2:
        return a.sparkSession.range(1).select(*[F.lit(0.0).alias(f"overlap_at_{k}") for k in k_values])
    left = a.select("query_id", "neighbor_id", F.col("rank").alias("ra"))
    right = b.select("query_id", "neighbor_id", F.col("rank").alias("rb"))
    common = left.join(right, ["query_id", "neighbor_id"])
    out = []
    for k in k_values:
        kk = min(k, max(k_values), n_rows - 1)
        value = (
            F.count_if((F.col("ra") < kk) & (F.col("rb") < kk)) / F.lit(float(n_rows) * kk)
            if kk > 0
            else F.lit(0.0)
        )
        out.append(value.alias(f"overlap_at_{k}"))
    return common.agg(*out)
