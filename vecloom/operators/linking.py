"""Linking of tracks to the recordings of a metadata table.

A track is tried by (title, artist, album), then by (title, artist), then by title; the first stage
whose best candidate scores at least 60 wins. The score is the base score of the candidate, minus
the duration gap in seconds (30 at most), plus 20 for a matching artist and 20 for a matching album.

No stage lists the pairs of a key. Each (stage, kind of match) is a set of keys with a fixed bonus, so
what is left to maximize inside a key is base - min(gap, 30): the best candidate at or below the
duration, the best above it, or the best one regardless of duration. Running minima over 30-second
buckets give the first two, an aggregate the third. A title shared by a third of the rows thus costs
as much as any other row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions.linkage import norm_text, tokens
from vecloom.session import materialize, materialize_all

CAP_MS = 30_000
GRAM = 6


def best_match(tracks: DataFrame, recordings: DataFrame, min_score: float = fixed.LINK_MIN_SCORE) -> DataFrame:
    """``src, stage, cand, score`` for every track with a confident match.

    ``tracks``: src, title, artist, album, ms. ``recordings``: cand, title, artist_names,
    releases (array of titles), length (ms), base (score with at most three decimals). NULL or 0
    durations are unknown.
    """
    left = tracks.select(
        "src",
        norm_text(F.col("title")).alias("t"),
        norm_text(F.col("artist")).alias("a"),
        norm_text(F.col("album")).alias("b"),
        tokens(F.col("artist")).alias("words"),
        F.coalesce(F.col("ms").cast("bigint"), F.lit(0)).alias("ms"),
        (F.coalesce(F.trim("artist"), F.lit("")) != "").alias("has_a"),
        (F.coalesce(F.trim("album"), F.lit("")) != "").alias("has_b"),
    ).where(F.col("t") != "")
    right = recordings.select(
        "cand",
        norm_text(F.col("title")).alias("t"),
        norm_text(F.col("artist_names")).alias("a"),
        tokens(F.col("artist_names")).alias("words"),
        F.array_distinct(F.transform(F.coalesce("releases", F.array().cast("array<string>")), norm_text)).alias("rel"),
        F.coalesce(F.col("length").cast("bigint"), F.lit(0)).alias("length"),
        F.round(F.coalesce(F.col("base").cast("double"), F.lit(0.0)) * 1000).cast("bigint").alias("base"),
    ).where(F.col("t") != "")
    left, right = materialize_all((left, "tracks"), (right, "recordings"))

    albums = _album_pairs(left, right)
    offers = right.select("cand", "length", "base", "t", "a", "words")
    by_album = (
        right.select("cand", "length", "base", "t", "a", "words", F.explode("rel").alias("r"))
        .join(albums, ["t", "r"])
        .dropDuplicates(["cand", "t", "b"])
    )
    by_album = materialize(by_album, "albums")
    spread = by_album.withColumn("w", F.explode("words"))
    asks_w = left.withColumn("w", F.explode("words"))
    known_artist = F.size("words") > 0
    plain = ~F.col("has_a") & ~F.col("has_b")

    # (stage, bonus, asking side, offering side, key columns)
    exact_album = right.select(
        "cand", "length", "base", "t", "a", F.explode("rel").alias("b")
    ).where(F.col("b") != "")
    full = left.where((F.col("a") != "") & (F.col("b") != ""))
    with_artist = left.where(F.col("a") != "")
    with_album = left.where(F.col("b") != "")
    sets = [
        (1, 40, full.where(known_artist), exact_album, ["t", "a", "b"]),
        (1, 20, full.where(~known_artist), exact_album, ["t", "a", "b"]),
        (2, 20, with_artist.where(known_artist), offers, ["t", "a"]),
        (2, 40, full.where(known_artist), by_album, ["t", "a", "b"]),
        (2, 20, full.where(~known_artist), by_album, ["t", "a", "b"]),
        (3, 20, asks_w, offers.withColumn("w", F.explode("words")), ["t", "w"]),
        (3, 40, asks_w.where(F.col("b") != ""), spread, ["t", "w", "b"]),
        (3, 20, with_album, by_album, ["t", "b"]),
        (3, 0, left.where(plain), offers, ["t"]),
    ]

    def tagged(side: DataFrame, i: int, keys: list[str], *columns: str) -> DataFrame:
        return side.select(F.concat_ws("\x1f", F.lit(str(i)), *keys).alias("key"), *columns)

    asks = reduce(
        DataFrame.unionByName,
        [
            tagged(ask.withColumn("stage", F.lit(stage)).withColumn("bonus", F.lit(bonus * 1000)), i, keys, "src", "ms", "stage", "bonus")
            for i, (stage, bonus, ask, _, keys) in enumerate(sets)
        ],
    )
    asks = materialize(asks, "asks")
    offered = reduce(
        DataFrame.unionByName,
        [tagged(offer, i, keys, "cand", "length", "base") for i, (_, _, _, offer, keys) in enumerate(sets)],
    )
    best = best_by_duration(asks.select("key", "ms").distinct(), offered)
    scored = asks.join(best, ["key", "ms"]).select(
        "src", "stage", (F.col("value") + F.col("bonus")).alias("score"), "cand"
    )
    confident = scored.where(F.col("score") >= round(min_score * 1000))
    winner = confident.groupBy("src").agg(
        F.min(F.struct("stage", (-F.col("score")).alias("minus"), "cand")).alias("w")
    )
    return winner.select(
        "src", "w.stage", "w.cand", (-F.col("w.minus") / 1000.0).alias("score")
    )


def _grams(text: Column) -> Column:
    """All runs of ``GRAM`` characters; a shorter text is one of its own length."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def _album_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (t, b, r): album b asked for under title t is contained in release r of that title.

    An inverted index of the releases: under each title, the runs of ``GRAM`` characters and how many releases have them. An album
    is looked up by its rarest run alone, and not at all if no release has one of its runs; so a title of many tracks, or
    a run that many releases share, lists no pairs that aren't nearly matches. Albums shorter than a run are looked up
    among the words' beginnings and insides of their own length, under the titles that have such albums.
    """
    asked = left.where(F.col("b") != "").select("t", "b").distinct()
    asked = asked.withColumn("size", F.least(F.length("b"), F.lit(GRAM)))
    sizes = asked.groupBy("t").agg(F.collect_set("size").alias("sizes"))  # at most GRAM of them
    have = right.join(sizes, "t").select("t", "sizes", F.explode("rel").alias("r")).where(F.col("r") != "").distinct()
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.length("r") - n + 1), lambda i: F.substring(F.col("r"), i, n))
    listed = F.flatten(F.transform(F.filter("sizes", lambda n: n <= F.length("r")), runs))
    index = materialize(have.select("t", "r", F.explode(F.array_distinct(listed)).alias("gram")), "release-index")
    counts = index.groupBy("t", "gram").agg(F.count(F.lit(1)).alias("n"))
    probes = asked.select("t", "b", F.explode(_grams(F.col("b"))).alias("gram")).join(counts, ["t", "gram"], "left")
    rarest = probes.groupBy("t", "b").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("p")
    ).where("p.n > 0").select("t", "b", "p.gram")
    return rarest.join(index, ["t", "gram"]).where(F.col("r").contains(F.col("b"))).select("t", "b", "r")


def best_by_duration(asks: DataFrame, offers: DataFrame) -> DataFrame:
    """For every distinct (key, ms): the offer of that key with the highest
    base - min(|length - ms|, 30 s) in thousandths; the smaller ``cand`` wins ties."""
    per_length = offers.groupBy("key", "length").agg(
        F.min(F.struct((-F.col("base")).alias("minus"), "cand")).alias("o")
    ).select("key", "length", (-F.col("o.minus")).alias("base"), "o.cand")
    per_length = materialize(per_length, "offers")
    entry = F.struct((-F.col("base")).alias("minus"), "cand", "length")
    overall = per_length.groupBy("key").agg(
        F.min(entry).alias("any"), F.min(F.when(F.col("length") == 0, entry)).alias("unknown")
    )

    known = per_length.where(F.col("length") > 0)
    near = known.withColumn("home", F.floor(F.col("length") / CAP_MS)).withColumn(
        "bucket", F.explode(F.array(*[F.col("home") + d for d in (-1, 0, 1)]))
    )
    cand_type = offers.schema["cand"].dataType.simpleString()
    no_offer = F.lit(None).cast(f"struct<minus:bigint,cand:{cand_type},length:bigint>")

    def shifted(sign: int) -> Column:
        return F.struct(
            (-(F.col("base") + sign * F.col("length"))).alias("minus"), F.col("cand"), F.col("length")
        )

    timeline = near.select(
        "key", "bucket", F.col("length").alias("ms"), shifted(1).alias("below"), shifted(-1).alias("above"),
        F.lit(False).alias("ask"),
    ).unionByName(
        asks.where(F.col("ms") > 0).select(
            "key", F.floor(F.col("ms") / CAP_MS).alias("bucket"), "ms",
            no_offer.alias("below"), no_offer.alias("above"), F.lit(True).alias("ask"),
        )
    )
    line = Window.partitionBy("key", "bucket").orderBy("ms")
    down = line.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # both running minima grow with the frame; one that shrinks would be worked out anew for every row
    up = Window.partitionBy("key", "bucket").orderBy(F.desc("ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    close = (
        timeline.select(
            "key", "ms", "ask", F.min("below").over(down).alias("below"), F.min("above").over(up).alias("above")
        )
        .where("ask")
        .select("key", "ms", "below", "above")
    )
    joined = asks.join(overall, "key").join(close, ["key", "ms"], "left")

    def value(offer: Column, base: Column) -> Column:
        gap = F.least(F.abs(offer["length"] - F.col("ms")), F.lit(CAP_MS))
        paid = F.when((offer["length"] == 0) | (F.col("ms") == 0), F.lit(0)).otherwise(gap)
        return F.when(
            offer.isNotNull(), F.struct((-(base - paid)).alias("minus"), offer["cand"].alias("cand"))
        )

    options = F.array(
        value(F.col("any"), -F.col("any.minus")),
        value(F.col("unknown"), -F.col("unknown.minus")),
        value(F.col("below"), -F.col("below.minus") - F.col("below.length")),
        value(F.col("above"), -F.col("above.minus") + F.col("above.length")),
    )
    best = F.array_min(F.array_compact(options))
    return joined.select("key", "ms", (-best["minus"]).alias("value"), best["cand"].alias("cand"))
