"""The evaluation report of a store: by label, by tags or by the store's own albums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions.hashing import relative_path
from vecloom.operators import knn, metrics
from vecloom.operators.labels import align_labels, align_tags
from vecloom.operators.rows import one_row


def eval_report(
    store: DataFrame,
    mode: str,
    *,
    labels: DataFrame | None = None,
    tags: DataFrame | None = None,
    root: str | None = None,
    k_values: Sequence[int] = fixed.EVAL_KS,
) -> DataFrame:
    """One row: store size, aligned rows, model versions and the metrics of the mode.

    ``label`` needs ``labels`` (fma_track_id, genre_top), ``tags`` needs ``tags`` (mp3_path, tags)
    and the audio ``root``, ``library`` uses the album column. Nothing aligned is an error.
    """
    if mode == "label":
        aligned = align_labels(store, labels).withColumn("_row", F.col("track_id"))
        extra = [F.count_distinct("genre_top").alias("unique_labels")]
    elif mode == "tags":
        aligned = align_tags(store, tags, root).withColumn("_row", F.col("track_id"))
        extra = []
    elif mode == "library":
        aligned, extra = store.dropna(subset=["album"]), []
    else:
        raise ValueError(f"unknown mode {mode!r}")

    counted = aligned.agg(F.count(F.lit(1)).alias("n_aligned"), *extra)
    sizes = counted.first()
    if not sizes["n_aligned"]:
        raise ValueError(f"no store rows aligned for mode {mode!r}")
    versions = F.array_join(F.array_sort(F.collect_set("model_version")), ",")
    head = store.agg(F.count(F.lit(1)).alias("n_store"), versions.alias("model_versions"))
    known = [F.lit(v).cast("bigint").alias(name) for name, v in sizes.asDict().items()]
    head = head.select("n_store", *known, "model_versions")

    if mode == "library":
        body = metrics.group_cohesion(aligned, "album")
    else:
        near = knn.knn_join(
            aligned, aligned, max(k_values), query_id="_row", corpus_id="_row", exclude_self=True
        )
        if mode == "label":
            body = metrics.recall_at_k(near, aligned, k_values, id_col="_row", label="genre_top")
        else:
            tagged = store.select(
                F.col("track_id").alias("_row"), relative_path(F.col("path"), root).alias("mp3_path")
            ).join(tags, "mp3_path")
            body = metrics.tag_jaccard_at_k(near, tagged, k_values, id_col="_row")
    return one_row(head, body)
