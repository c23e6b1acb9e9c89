"""Manifests, label joins, subsets and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions.hashing import id_to_path, path_to_id, relative_path
from vecloom.functions.vectors import l2_normalize, mean_vector
from vecloom.functions.windows import estimate_samples, plan_windows
from vecloom.operators.ranking import global_positions


def align_labels(store: DataFrame, labels: DataFrame, label: str = "genre_top") -> DataFrame:
    """Store rows whose path carries a labelled id; duplicates in the store stay."""
    with_id = store.withColumn("fma_track_id", path_to_id(F.col("path")))
    named = labels.select("fma_track_id", label)
    return with_id.where(F.col("fma_track_id").isNotNull()).join(named, "fma_track_id")


def align_tags(store: DataFrame, annotations: DataFrame, root: str, key: str = "mp3_path") -> DataFrame:
    """Store rows below ``root`` whose relative path is annotated."""
    with_path = store.withColumn(key, relative_path(F.col("path"), root))
    return with_path.where(F.col(key).isNotNull()).join(
        annotations.select(key).distinct(), key, "left_semi"
    )


def tag_matrix_for(paths: DataFrame, annotations: DataFrame, tags: Sequence[str], key: str = "mp3_path") -> DataFrame:
    """0/1 tag columns for every listed path; unknown paths and NULL tags are 0."""
    wide = annotations.select(key, *tags)
    joined = paths.join(wide, key, "left")
    filled = [F.coalesce(F.col(t).cast("int"), F.lit(0)).alias(t) for t in tags]
    return joined.select(*[c for c in paths.columns], *filled)


def subset_levels(subset: str) -> tuple[str, ...]:
    levels = fixed.SUBSET_LEVELS.get(subset.lower())
    if levels is None:
        raise ValueError(f"unknown subset {subset!r}")
    return levels


def filter_subset(df: DataFrame, subset: str, column: str = "subset") -> DataFrame:
    """Keep the subset and the smaller ones it contains."""
    return df.where(F.col(column).isin(*subset_levels(subset)))


def drop_null_label(df: DataFrame, label: str = "genre_top") -> DataFrame:
    return df.dropna(subset=[label])


def load_manifest(
    tracks: DataFrame,
    root: str,
    subset: str = "small",
    listing: DataFrame | None = None,
    min_bytes: int = fixed.MIN_AUDIO_BYTES,
) -> DataFrame:
    """Manifest rows of a subset with label, split, artist and derived path.

    With a ``listing`` (path, length) only files of at least ``min_bytes`` remain: one semi join
    in place of a look at every file.
    """

    def optional(name: str, default: Column) -> Column:
        return (F.col(name) if name in tracks.columns else default).alias(name)

    kept = drop_null_label(filter_subset(tracks, subset))
    manifest = kept.select(
        "fma_track_id",
        "subset",
        optional("split", F.lit("training")),
        "genre_top",
        optional("artist_id", F.lit(None).cast("string")),
        optional("artist_name", F.lit(None).cast("string")),
        id_to_path(root, F.col("fma_track_id")).alias("path"),
    )
    if listing is not None:
        real = listing.where(F.col("length") >= min_bytes).select("path")
        manifest = manifest.join(real, "path", "left_semi").select(*manifest.columns)
    return manifest


def split_or_fallback(df: DataFrame, split: str, order: str, column: str = "split") -> DataFrame:
    """Rows of a split; when it has none, the last tenth of the table (at least one row).

    The tail is not taken out of any other split.
    """
    chosen = df.where(F.col(column) == split)
    if not chosen.isEmpty():
        return chosen
    return _tail(df, order, take=True)


def prepare_splits(df: DataFrame, order: str, column: str = "split") -> tuple[DataFrame, DataFrame]:
    """(training, validation). Without validation rows the last tenth validates, the rest trains."""
    validation = df.where(F.col(column) == "validation")
    if not validation.isEmpty():
        return df.where(F.col(column) == "training"), validation
    return _tail(df, order, take=False), _tail(df, order, take=True)


def _tail(df: DataFrame, order: str, take: bool) -> DataFrame:
    n = df.count()
    first = n - max(1, round(0.1 * n))
    placed = global_positions(df, order, "_position")
    keep = F.col("_position") >= first
    return placed.where(keep if take else ~keep).drop("_position")


def limit_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows in a stated order."""
    return df.orderBy(*order).limit(n)


def value_counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(key)


def distinct_count(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count_distinct(key).alias("n_distinct"))


def expand_windows(
    manifest: DataFrame, count: int, window: int = fixed.WINDOW_SAMPLES, rate: int = fixed.TARGET_SR
) -> DataFrame:
    """One row per planned window of every manifest row, from its ``frames`` and ``rate``.

    A row whose frame count is unknown (unreadable file) stays as one row with status ``failed``.
    """
    n = estimate_samples(F.col("frames"), F.col("rate"), rate)
    sized = manifest.withColumn("_n", n)
    starts = F.when(F.col("_n").isNotNull(), plan_windows(F.col("_n"), count, window))
    kept = [c for c in manifest.columns if c not in ("frames", "rate")]
    long = sized.select(*kept, "_n", F.posexplode_outer(starts).alias("window_index", "start_sample"))
    good = F.col("_n").isNotNull()
    return long.select(
        *kept,
        F.when(good, "ok").otherwise("failed").alias("status"),
        "window_index",
        "start_sample",
        F.when(good, F.lit(window).cast("bigint")).alias("duration_samples"),
        (F.col("start_sample") / float(rate)).alias("start_seconds"),
        F.when(good, F.lit(window / rate)).alias("duration_seconds"),
    )


def aggregate_windows_to_tracks(windows: DataFrame, vector: str = "embedding") -> DataFrame:
    """One pooled vector per track, with the path and label of its first window."""
    rows = windows.where(F.col(vector).isNotNull())
    tracks = rows.groupBy("fma_track_id").agg(
        mean_vector(vector).alias(vector),
        F.min_by("path", "window_index").alias("path"),
        F.min_by("genre_top", "window_index").alias("genre"),
        F.count(F.lit(1)).alias("n_windows"),
    )
    track_id = F.format_string("fma-%06d", F.col("fma_track_id").cast("bigint"))
    return tracks.select(
        track_id.alias("track_id"), "path", "genre", "n_windows", l2_normalize(F.col(vector)).alias(vector)
    )


def valid_clips(df: DataFrame, clip: str, view_samples: int, min_samples: int = fixed.MIN_CLIP_SAMPLES) -> DataFrame:
    """Clips that decoded (at least ``min_samples``) and fill half a view."""
    n = F.size(clip)
    return df.where(F.col(clip).isNotNull() & (n >= min_samples) & (n >= view_samples // 2))
