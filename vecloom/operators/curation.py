"""Deduplication, skipping and resolving of collected inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions.hashing import resolution_cache_key, video_id_from_url
from vecloom.functions.titles import title_dedup_key
from vecloom.session import cut_lineage, scratch_path

#: rounds before chains are looked for
PLAIN_ROUNDS = 4


def dedup_first_wins(
    rows: DataFrame,
    *,
    url: str = "url",
    title: str = "title",
    seq: str = "seq",
    allow_title_duplicates: bool = False,
) -> DataFrame:
    """Status of every row when rows are taken in ``seq`` order and a row is dropped if its video
    id, or its non-empty title key, was kept before. Dropped rows claim neither.

    Status is ``kept``, ``no_id``, ``id_dupe`` or ``title_dupe``. That is a sequential rule; the
    parallel form keeps, in every round, the rows that come first in both of their groups and removes
    what shares an id or key with them, until nothing is left. Only one row per (id, key) enters,
    and the first rows come from ``min`` aggregates that combine before the shuffle.

    After ``PLAIN_ROUNDS`` only chains are left as a rule: a row waits for one that waits for another. They are settled by pointer
    jumping (``_settle_chains``), a chain of n links in about log n steps. Kept rows are appended to one table.
    """
    spark = rows.sparkSession
    key = F.lit("") if allow_title_duplicates else title_dedup_key(F.col(title))
    keyed = rows.withColumn("video_id", video_id_from_url(F.col(url))).withColumn("title_key", key)
    alive = cut_lineage(
        keyed.where(F.col("video_id").isNotNull())
        .groupBy("video_id", "title_key")
        .agg(F.min(seq).cast("bigint").alias("seq"))
    )
    path, n_rounds = scratch_path(spark, "kept-tracks"), 0
    while not alive.isEmpty():
        won = _first_in_both(alive) if n_rounds < PLAIN_ROUNDS else _settle_chains(alive)
        won = cut_lineage(won)
        won.write.mode("append").parquet(path)
        won_keys = won.where(F.col("title_key") != "").select("title_key")
        alive = cut_lineage(
            alive.join(won.select("video_id"), "video_id", "left_anti").join(
                won_keys, "title_key", "left_anti"
            )
        )
        n_rounds += 1
    if not n_rounds:
        first = keyed.withColumn("kept_seq", F.lit(None).cast("bigint"))
    else:
        kept = spark.read.schema("video_id string, seq long, title_key string").parquet(path)
        first = keyed.join(kept.select("video_id", F.col("seq").alias("kept_seq")), "video_id", "left")
    status = (
        F.when(F.col("video_id").isNull(), "no_id")
        .when(F.col(seq) == F.col("kept_seq"), "kept")
        .when(F.col("kept_seq") < F.col(seq), "id_dupe")
        .otherwise("title_dupe")
    )
    return first.withColumn("status", status).drop("kept_seq")


def _first_in_both(alive: DataFrame) -> DataFrame:
    """Rows that come first in their id and, if they have one, in their title key."""
    by_id = alive.groupBy("video_id").agg(F.min(F.struct("seq", "title_key")).alias("f"))
    by_id = by_id.select("video_id", "f.seq", "f.title_key")
    by_key = alive.where(F.col("title_key") != "").groupBy("title_key").agg(F.min("seq").alias("seq"))
    both = by_id.join(by_key, ["title_key", "seq"], "left_semi").select("video_id", "seq", "title_key")
    return by_id.where(F.col("title_key") == "").unionByName(both)


def _settle_chains(alive: DataFrame) -> DataFrame:
    """Rows that are kept for sure: first in both groups, or an even number of single waits behind such a row.

    A row that waits for exactly one earlier row is kept if that one isn't. Jumping from row to row, with the number of nots
    on the way, brings every such row to the start of its chain: a row that waits for none, or one that waits for several
    and is decided in a later round.
    """
    groups = []
    for name in ("video_id", "title_key"):
        members = alive.where(F.col(name) != "") if name == "title_key" else alive
        first = members.groupBy(name).agg(F.min("seq").alias(f"_{name}_1"))
        later = members.join(first, name).where(F.col("seq") > F.col(f"_{name}_1"))
        groups.append(first.join(later.groupBy(name).agg(F.min("seq").alias(f"_{name}_2")), name, "left"))
    placed = alive.join(groups[0], "video_id").join(groups[1], "title_key", "left")

    def waits(name: str) -> tuple[Column, Column]:
        """How many earlier rows the group has, counted up to two, and the first of them."""
        one, two = F.col(f"_{name}_1"), F.col(f"_{name}_2")
        n = F.when(one.isNull() | (F.col("seq") == one), 0).when(F.col("seq") == two, 1).otherwise(2)
        return n, F.when(n > 0, one)

    (n_id, by_id), (n_key, by_key) = waits("video_id"), waits("title_key")
    same = (n_id == 1) & (n_key == 1) & (by_id == by_key)
    n = F.when(same, 1).otherwise(n_id + n_key)
    links = placed.select(
        "video_id", "seq", "title_key", F.least(n, F.lit(2)).alias("n"), F.when(n == 1, F.coalesce(by_id, by_key)).alias("to"), F.when(n == 1, 1).otherwise(0).alias("nots")
    )
    links = cut_lineage(links)
    while True:
        ahead = links.select(F.col("seq").alias("_at"), F.col("to").alias("_to"), F.col("nots").alias("_nots"))
        jumped = links.join(ahead, F.col("to") == F.col("_at"), "left")
        moves = F.col("_to").isNotNull()
        jumped = jumped.select(
            "video_id", "seq", "title_key", "n", F.when(moves, F.col("_to")).otherwise(F.col("to")).alias("to"),
            F.when(moves, (F.col("nots") + F.col("_nots")) % 2).otherwise(F.col("nots")).alias("nots"), moves.alias("moved"),
        )
        jumped = cut_lineage(jumped)
        if jumped.where("moved").isEmpty():
            break
        links = jumped.drop("moved")
    start = links.where("n = 0").select(F.col("seq").alias("_start"))
    known = links.join(start, F.coalesce("to", "seq") == F.col("_start"), "left_semi")
    return known.where("nots = 0").select("video_id", "seq", "title_key")


def keep_tracks(deduped: DataFrame, max_tracks: int | None = None, seq: str = "seq") -> DataFrame:
    """Kept rows, at most the first ``max_tracks``."""
    kept = deduped.where(F.col("status") == "kept")
    return kept if max_tracks is None else kept.orderBy(seq).limit(max_tracks)


def skip_collected(
    inputs: DataFrame, listing: DataFrame, *, url: str = "url", path: str = "path", overwrite: bool = False
) -> DataFrame:
    """Flag ``skipped`` on inputs whose video id already ends a file name ``[id].opus``."""
    with_id = inputs.withColumn("video_id", video_id_from_url(F.col(url)))
    if overwrite:
        return with_id.withColumn("skipped", F.lit(False))
    have = F.nullif(F.regexp_extract(path, r"\[([A-Za-z0-9_-]{11})\]\.opus$", 1), F.lit(""))
    done = listing.select(have.alias("video_id")).where(F.col("video_id").isNotNull()).distinct()
    marked = with_id.join(done.withColumn("_done", F.lit(True)), "video_id", "left")
    return marked.withColumn("skipped", F.coalesce("_done", F.lit(False))).drop("_done")


def duration_filter(
    duration: Column, min_duration: float | None = None, max_duration: float | None = None
) -> Column:
    """First pass: limits are inclusive, an unknown duration passes."""
    ok = F.lit(True)
    if min_duration is not None:
        ok = ok & (duration >= min_duration)
    if max_duration is not None:
        ok = ok & (duration <= max_duration)
    return duration.isNull() | ok


def duration_verdict(
    duration: Column,
    min_duration: float = fixed.MIN_DURATION,
    max_duration: float = fixed.MAX_DURATION,
) -> Column:
    """Second pass: ``too_long``, ``too_short`` or ``ok``; a limit of 0 is off."""
    out = F.when(duration.isNull(), "ok")
    if max_duration > 0:
        out = out.when(duration > max_duration, "too_long")
    if min_duration > 0:
        out = out.when(duration < min_duration, "too_short")
    return out.otherwise("ok")


def purge_report(files: DataFrame, max_duration: float, duration: str = "duration") -> DataFrame:
    """How many files were inspected and how many are over the limit. Nothing is deleted."""
    over = F.count_if(F.col(duration) > max_duration) if max_duration > 0 else F.lit(0).cast("bigint")
    inspected = F.count(F.lit(1)) if max_duration > 0 else F.lit(0).cast("bigint")
    return files.agg(inspected.alias("inspected"), over.alias("over_limit"))


def resolve_incremental(
    inputs: DataFrame,
    cache: DataFrame,
    resolve: Callable[[DataFrame], DataFrame],
    *,
    search_limit: int,
    min_duration: float | None = None,
    max_duration: float | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(flat entries in input order, cache to store).

    ``inputs`` is ``pos, raw``; ``resolve`` turns ``cache_key, raw`` into ``cache_key, entries``
    and is asked for keys the cache lacks, once each. What it does not answer is cached as empty.
    """
    key = resolution_cache_key(
        F.col("raw"), F.lit(search_limit), F.lit(min_duration), F.lit(max_duration)
    )
    keyed = inputs.withColumn("cache_key", key)
    missing = (
        keyed.join(cache.select("cache_key"), "cache_key", "left_anti")
        .groupBy("cache_key")
        .agg(F.min("raw").alias("raw"))
    )
    answered = missing.select("cache_key").join(resolve(missing), "cache_key", "left")
    nothing = F.array().cast(cache.schema["entries"].dataType)
    fresh = answered.select("cache_key", F.coalesce("entries", nothing).alias("entries"))
    full = cache.select("cache_key", "entries").unionByName(fresh)
    flat = keyed.join(full, "cache_key").select("pos", F.posexplode("entries").alias("entry_pos", "e"))
    return flat.select("pos", "entry_pos", "e.url", "e.title"), full


def outcome_summary(outcomes: DataFrame, status: str = "status") -> DataFrame:
    return outcomes.groupBy(status).agg(F.count(F.lit(1)).alias("n"))
