"""Text rules for titles, descriptions and tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions.vectors import bind

SPACE = r"(?U)\s+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
NOISE = "(?iuU)" + "|".join(fixed.TITLE_NOISE)


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _squeeze(text: Column) -> Column:
    return strip(F.regexp_replace(text, SPACE, " "))


def _case_folds() -> dict[str, str]:
    """Built from the Unicode rule: characters whose folding is not their lower case."""
    return {
        chr(c): chr(c).casefold()
        for c in range(0x80, 0x20000)
        if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c).lower() and chr(c) not in "ßẞ"
    }


_FOLDS = _case_folds()
_FOLDED = "".join(_FOLDS)
# quick test: the few Latin letters with a fold, or anything beyond Latin
_MAY_FOLD = "[" + "".join(c for c in _FOLDS if c < "\u0250") + r"\x{250}-\x{10FFFF}]"


def casefold(text: Column) -> Column:
    """Lower case plus the full case foldings that ``lower`` leaves alone.

    Sharp s is common and replaced at once; text with any of the rare others goes through a map.
    """
    pairs = "\n".join(f"{k}\t{v}" for k, v in _FOLDS.items())
    table = F.str_to_map(F.lit(pairs), F.lit("\n"), F.lit("\t"))

    def fold(lowered: Column) -> Column:
        letters = F.transform(
            F.split(lowered, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)
        )
        plain = ~lowered.rlike(_MAY_FOLD) | (F.translate(lowered, _FOLDED, "") == lowered)
        return F.when(plain, lowered).otherwise(F.array_join(letters, ""))

    return bind(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), fold)


def clean_value(text: Column) -> Column:
    """NULL and ``NA`` become the empty string."""
    stripped = strip(F.coalesce(text.cast("string"), F.lit("")))
    return F.when(stripped == "NA", "").otherwise(stripped)


def safe_filename(text: Column, fallback: str = "track") -> Column:
    name = F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(fallback))
    name = F.replace(F.replace(name, F.lit("/"), F.lit("-")), F.lit(":"), F.lit(" -"))
    name = _squeeze(F.regexp_replace(name, r"[\x00\r\n\t]", " "))
    name = F.regexp_replace(F.left(name, F.lit(180)), r"[ .]+$", "")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit(fallback))


def normalize_title(text: Column) -> Column:
    """Case-folded title without presentation noise and punctuation; token order is kept."""
    folded = strip(casefold(F.coalesce(text, F.lit(""))))
    quiet = F.regexp_replace(folded, NOISE, "")
    return _squeeze(F.regexp_replace(quiet, r"(?U)[^\w\s]+", " "))


def title_dedup_key(text: Column) -> Column:
    """Distinct tokens of two or more characters, sorted: the same for any token order."""
    tokens = F.filter(F.split(normalize_title(text), " "), lambda t: F.length(t) >= 2)
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def classify_input(raw: Column, search_limit: int) -> tuple[Column, Column]:
    """(kind, target) of one input line; both are NULL for blank and comment lines."""
    line = strip(raw)
    is_url = line.startswith("http://") | line.startswith("https://")
    playlist = is_url & line.contains("list=") & ~line.contains("/watch?")
    skip = (line == "") | line.startswith("#")
    kind = (
        F.when(skip, F.lit(None).cast("string"))
        .when(playlist, "playlist")
        .when(is_url, "single")
        .otherwise("search")
    )
    bare = ~is_url & ~line.startswith("ytsearch")
    target = F.when(skip, F.lit(None).cast("string")).when(
        bare, F.concat(F.lit(f"ytsearch{search_limit}:"), line)
    )
    return kind, target.otherwise(line)


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, "(?U)" + fixed.YEAR, 1)


def release_date(raw: Column, description: Column) -> Column:
    """ISO date or year from the field, else from the description."""
    value = clean_value(raw)
    iso = F.concat_ws(
        "-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2)
    )
    told = F.regexp_extract(description, fixed.RELEASED_ON, 1)
    return (
        F.when(value.rlike("^[0-9]{8}$"), iso)
        .when(value.rlike("^[0-9]{4}(-[0-9]{2}-[0-9]{2})?$"), value)
        .when(told != "", told)
        .otherwise(first_year(description))
    )


def copyright_line(description: Column) -> Column:
    lines = F.transform(F.split(description, LINE_END), strip)
    hit = F.filter(lines, lambda line: line.contains("℗") | line.startswith("©"))
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.lit(""))


def parse_artist_title(title: Column) -> tuple[Column, Column]:
    """Split ``artist - track`` at the first separator; ("", title) without one."""
    parts = F.split(title, " - ", 2)
    track = F.try_element_at(parts, F.lit(2))
    track = strip(F.regexp_replace(track, "(?iU)" + fixed.OFFICIAL_SUFFIX, ""))
    track = strip(F.regexp_replace(track, "(?iU)" + fixed.HD_SUFFIX, ""))
    has = title.contains(" - ")
    artist = F.when(has, strip(F.try_element_at(parts, F.lit(1)))).otherwise("")
    return artist, F.when(has & (track != ""), track).otherwise(title)


def infer_artist_title(
    artist: Column, track: Column, title: Column
) -> tuple[Column, Column, Column]:
    """(artist, title, album artist): given values win, parsing only fills a missing artist."""
    raw_title = clean_value(title)
    given_artist = clean_value(artist)
    given_title = F.coalesce(F.nullif(clean_value(track), F.lit("")), raw_title)
    parsed_artist, parsed_title = parse_artist_title(raw_title)
    missing = given_artist == ""
    final_artist = F.when(missing, parsed_artist).otherwise(given_artist)
    final_title = F.when(missing, parsed_title).otherwise(given_title)
    return final_artist, final_title, strip(F.split(final_artist, ",").getItem(0))


def infer_genre(
    title: Column,
    album: Column,
    artist: Column,
    given: Column,
    rules: Sequence[tuple] = fixed.GENRE_RULES,
    whole_words: bool = False,
) -> Column:
    """First rule with a needle in ``title album artist``; else the given genre, else Pop.

    Needles match inside words too, unless ``whole_words``. ``rules`` rows are (priority, needles,
    label, needle of the exception, its label).
    """
    text = F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in (title, album, artist)]))

    def has(needle: str) -> Column:
        if whole_words:
            return text.rlike(rf"(?U)\b\Q{needle}\E\b")
        return text.contains(needle)

    out = None
    for _, needles, label, special, special_label in sorted(rules, key=lambda r: r[0]):
        fires = has(needles[0])
        for needle in needles[1:]:
            fires = fires | has(needle)
        value = F.lit(label)
        if special:
            value = F.when(has(special), special_label).otherwise(label)
        out = F.when(fires, value) if out is None else out.when(fires, value)
    fallback = F.coalesce(F.nullif(clean_value(given), F.lit("")), F.lit(fixed.DEFAULT_GENRE))
    return fallback if out is None else out.otherwise(fallback)


def first_tag(values: Column) -> Column:
    """First element of a tag list, stripped; empty means NULL."""
    return F.nullif(strip(F.try_element_at(values, F.lit(1))), F.lit(""))


def parse_year(text: Column) -> Column:
    """The leading four digits when they are a year from 1900 to 2100."""
    head = F.substring(strip(text), 1, 4)
    year = F.when(head.rlike("^[0-9]{4}$"), head).cast("int")
    return F.when(year.between(1900, 2100), year)


def parse_tags(tags: Column) -> dict[str, Column]:
    """Columns from a ``MAP<STRING, ARRAY<STRING>>`` of file tags; a NULL map gives NULLs."""

    def listed(*names: str) -> Column:
        some = [F.when(F.size(tags[name]) > 0, tags[name]) for name in names]
        return F.coalesce(*some)

    return {
        "title": first_tag(listed("title")),
        "artist": first_tag(listed("artist", "albumartist")),
        "album": first_tag(listed("album")),
        "genre": first_tag(listed("genre")),
        "year": parse_year(first_tag(listed("date", "year", "originaldate"))),
    }


def tag_merge(inferred: Column, linked: Column) -> Column:
    """Inferred tags win when non-empty, linked tags fill the rest, empty values are left out."""
    own = F.map_filter(F.coalesce(inferred, _no_tags()), lambda _, v: v != "")
    more = F.map_filter(
        F.coalesce(linked, _no_tags()), lambda k, v: (v != "") & ~F.map_contains_key(own, k)
    )
    return F.map_concat(own, more)


def _no_tags() -> Column:
    return F.create_map().cast("map<string,string>")


def source_note(description: Column) -> Column:
    provider = strip(F.split(description, LINE_END).getItem(0))
    told = F.concat(provider, F.lit(f". {fixed.NOTE_DEFAULT}"))
    return (
        F.when(description.contains(fixed.NOTE_PROVIDER), told)
        .when(F.coalesce(description, F.lit("")) != "", fixed.NOTE_INFERRED)
        .otherwise(fixed.NOTE_DEFAULT)
    )


def literal_tags(values: Mapping[str, Column]) -> Column:
    """A tag map from columns, without the empty ones."""
    pairs = [x for name, c in values.items() for x in (F.lit(name), F.coalesce(c, F.lit("")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v != "")
