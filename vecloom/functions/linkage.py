"""Column rules for linking a track to a recording of a metadata table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom.functions.titles import casefold, clean_value


def norm_text(text: Column) -> Column:
    """Case-folded runs of [0-9a-z] with single spaces; other scripts become empty."""
    return F.trim(F.regexp_replace(casefold(F.coalesce(text, F.lit(""))), "[^0-9a-z]+", " "))


def tokens(text: Column) -> Column:
    """Distinct normalized tokens of three or more characters."""
    return F.array_distinct(
        F.filter(F.split(norm_text(text), " "), lambda t: F.length(t) >= 3)
    )


def artist_match(artist: Column, names: Column) -> Column:
    """``names`` is one text of all credited names. No artist never matches."""
    return F.arrays_overlap(tokens(artist), tokens(names))


def album_match(album: Column, release_titles: Column) -> Column:
    """Some release title equals the album, or contains it (both normalized)."""
    wanted = norm_text(album)
    found = F.exists(
        F.coalesce(release_titles, F.array().cast("array<string>")),
        lambda title: norm_text(clean_value(title)).contains(wanted),
    )
    return (wanted != "") & found


def duration_penalty(ms: Column, length: Column) -> Column:
    """|difference| in seconds, at most 30; 0 when either side is unknown."""
    known = (F.coalesce(ms, F.lit(0)) != 0) & (F.coalesce(length, F.lit(0)) != 0)
    gap = F.least(F.abs(length - ms) / 1000.0, F.lit(30.0))
    return F.when(known, gap).otherwise(F.lit(0.0))


def recording_score(
    base: Column, penalty: Column, by_artist: Column, by_album: Column, something_given: Column
) -> Column:
    bonus = F.when(by_artist, 20.0).otherwise(0.0) + F.when(by_album, 20.0).otherwise(0.0)
    value = F.coalesce(base.cast("double"), F.lit(0.0)) - penalty + bonus
    return F.when(something_given & ~(by_artist | by_album), F.lit(-999.0)).otherwise(value)


def release_score(title: Column, status: Column, date: Column, album: Column) -> Column:
    """30 for an equal title or 15 for a containing one, 20 up or down by status, 2 for a date."""
    wanted, have = norm_text(album), norm_text(clean_value(title))
    by_title = F.when((wanted != "") & (have == wanted), 30.0).when(
        (wanted != "") & have.contains(wanted), 15.0
    )
    kind = F.lower(clean_value(status))
    by_status = F.when(kind == "official", 20.0).when(kind == "pseudo-release", -20.0)
    by_date = F.when(clean_value(date) != "", 2.0)
    zero = F.lit(0.0)
    return F.coalesce(by_title, zero) + F.coalesce(by_status, zero) + F.coalesce(by_date, zero)


def best_release(releases: Column, album: Column) -> Column:
    """The release struct of the highest score; the first one wins a tie."""
    ranked = F.transform(
        releases,
        lambda r, i: F.struct(
            release_score(r["title"], r["status"], r["date"], album).alias("score"),
            (-i).alias("place"),
            r.alias("release"),
        ),
    )
    # NULL fields of the release never decide: score and place are unique together
    return F.array_max(ranked)["release"]


def artist_credit_fold(credits: Column) -> Column:
    """Struct of joined names, sort names and ids; a missing name falls back to the artist's."""

    def joined(pick) -> Column:
        values = F.filter(F.transform(credits, pick), lambda x: x != "")
        return F.coalesce(F.array_join(values, "; "), F.lit(""))

    name = lambda c: F.coalesce(
        F.nullif(clean_value(c["name"]), F.lit("")), clean_value(c["artist"]["name"])
    )
    return F.struct(
        joined(name).alias("names"),
        joined(lambda c: clean_value(c["artist"]["sort-name"])).alias("sort_names"),
        joined(lambda c: clean_value(c["artist"]["id"])).alias("ids"),
    )


def release_to_tags(release: Column, recording_id: Column) -> Column:
    """Flatten a nested release to a tag map; empty tags are left out."""
    empty = F.lit("")
    credit = artist_credit_fold(release["artist-credit"])
    group = release["release-group"]
    types = F.concat(
        F.array(clean_value(group["primary-type"])),
        F.transform(
            F.coalesce(group["secondary-types"], F.array().cast("array<string>")), clean_value
        ),
    )
    first_date = clean_value(group["first-release-date"])

    def joined(pick) -> Column:
        values = F.filter(F.transform(release["label-info"], pick), lambda x: x != "")
        return F.coalesce(F.array_join(values, "; "), empty)

    media = release["media"]
    places = F.flatten(
        F.transform(
            media,
            lambda m: F.transform(
                m["tracks"],
                lambda t: F.struct(
                    clean_value(t["recording"]["id"]).alias("recording"),
                    F.coalesce(
                        F.nullif(clean_value(t["number"]), empty),
                        F.nullif(t["position"], F.lit(0)).cast("string"),
                        empty,
                    ).alias("track"),
                    F.coalesce(F.nullif(m["track-count"], F.lit(0)), F.size(m["tracks"]))
                    .cast("string")
                    .alias("total"),
                    F.coalesce(F.nullif(m["position"], F.lit(0)).cast("string"), empty).alias("disc"),
                ),
            ),
        )
    )
    place = F.try_element_at(F.filter(places, lambda p: p["recording"] == recording_id), F.lit(1))
    values = {
        "album": clean_value(release["title"]),
        "date": clean_value(release["date"]),
        "releasecountry": clean_value(release["country"]),
        "barcode": clean_value(release["barcode"]),
        "releasestatus": clean_value(release["status"]),
        "album_artist": credit["names"],
        "albumartistsort": credit["sort_names"],
        "musicbrainz_albumartistid": credit["ids"],
        "musicbrainz_albumid": clean_value(release["id"]),
        "musicbrainz_releasegroupid": clean_value(group["id"]),
        "musicbrainz_trackid": recording_id,
        "originaldate": first_date,
        "originalyear": F.substring(first_date, 1, 4),
        "releasetype": F.array_join(
            F.transform(F.filter(types, lambda t: t != ""), lambda t: F.lower(t)), ";"
        ),
        "label": joined(lambda x: clean_value(x["label"]["name"])),
        "catalognumber": joined(lambda x: clean_value(x["catalog-number"])),
        "disctotal": F.coalesce(F.size(media), F.lit(0)).cast("string"),
        "track": place["track"],
        "tracktotal": place["total"],
        "disc": place["disc"],
    }
    pairs = [x for name, c in values.items() for x in (F.lit(name), F.coalesce(c, empty))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")
