"""Text curation and record linkage over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom import schemas
from vecloom.functions import linkage as K
from vecloom.functions import titles as T
from vecloom.functions.hashing import resolution_cache_key, video_id_from_url
from vecloom.operators import curation, linking
from vecloom.plans import fixtures as X
from vecloom.plans.registry import query, r6, sql_r6, table
from vecloom.session import spread

# white space as Spark's Unicode classes see it, written out for RE2
_WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip_sql(text: str) -> str:
    return f"regexp_replace({text}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _md5(column):
    return F.md5(column.cast("binary"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


@query("h7_video_id", f"WITH {X.TITLES_SQL} SELECT seq, substr(url, 27, 11) AS video_id FROM titles UNION ALL SELECT page_id, NULL FROM pages")
def h7(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("seq"), "url")
    both = X.titles(spark, sf_dir).select("seq", "url").unionByName(pages)
    return both.select("seq", video_id_from_url(F.col("url")).alias("video_id"))


@query(
    "t1_clean_value",
    f"""SELECT doc_id, md5({_strip_sql('text')}) AS cleaned, CASE WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN '' ELSE lang END AS lang FROM documents""",
)
def t1(spark, sf_dir):
    lang = F.when(F.col("lang") == "fr", " NA\t").when(F.col("lang") != "de", F.col("lang"))
    return _documents(spark, sf_dir).select(
        "doc_id", _md5(T.clean_value(F.col("text"))).alias("cleaned"), T.clean_value(lang).alias("lang")
    )


_FILE_SQL = f"""WITH a AS (SELECT doc_id, replace(replace(coalesce(nullif({_strip_sql('text')}, ''), 'track'), '/', '-'), ':', ' -') AS x FROM documents),
    b AS (SELECT doc_id, {_strip_sql(f"regexp_replace(regexp_replace(x, '[\\x00\\r\\n\\t]', ' ', 'g'), '[{_WS}]+', ' ', 'g')")} AS x FROM a)
    SELECT doc_id, coalesce(nullif(regexp_replace(left(x, 180), '[ .]+$', ''), ''), 'track') AS name FROM b"""


@query("t2_safe_filename", _FILE_SQL)
def t2(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.safe_filename(F.col("text")).alias("name"))


_NOISE_SQL = "|".join(fixed.TITLE_NOISE)
_NORM_SQL = rf"""trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(title)), '{_NOISE_SQL}', '', 'gi'), '[^\w\s]+', ' ', 'g'), '\s+', ' ', 'g'))"""
_KEY_SQL = f"array_to_string(list_sort(list_distinct(list_filter(string_split({_NORM_SQL}, ' '), lambda t: length(t) >= 2))), ' ')"


@query("t3_t4_titles", f"WITH {X.TITLES_SQL} SELECT seq, {_NORM_SQL} AS norm, {_KEY_SQL} AS key FROM titles")
def t3(spark, sf_dir):
    title = F.col("title")
    return X.titles(spark, sf_dir).select(
        "seq", T.normalize_title(title).alias("norm"), T.title_dedup_key(title).alias("key")
    )


# the rule as it is told: rows in order, with the ids and keys kept so far as state
_WALK_SQL = f"""k AS (SELECT seq, url, substr(url, 27, 11) AS vid, {_KEY_SQL} AS key, row_number() OVER (ORDER BY seq) AS n FROM titles),
walk AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS keys, CAST('' AS VARCHAR) AS status
  UNION ALL SELECT n, CASE WHEN status = 'kept' THEN list_append(ids, vid) ELSE ids END,
    CASE WHEN status = 'kept' AND key <> '' THEN list_append(keys, key) ELSE keys END, status
  FROM (SELECT k.n, ids, keys, vid, key, CASE WHEN list_contains(ids, vid) THEN 'id_dupe'
          WHEN key <> '' AND list_contains(keys, key) THEN 'title_dupe' ELSE 'kept' END AS status FROM walk JOIN k ON k.n = walk.n + 1))"""


@query(
    "t5_dedup_first_wins",
    f"WITH RECURSIVE {X.TITLES_SQL}, {_WALK_SQL} SELECT seq, vid AS video_id, key AS title_key, status FROM walk JOIN k USING (n)",
)
def t5(spark, sf_dir):
    got = curation.dedup_first_wins(X.titles(spark, sf_dir))
    return got.select("seq", "video_id", "title_key", "status")


@query(
    "t5_keep_tracks",
    f"WITH RECURSIVE {X.TITLES_SQL}, {_WALK_SQL} SELECT seq, url FROM walk JOIN k USING (n) WHERE status = 'kept' ORDER BY seq LIMIT 50",
)
def t5_limit(spark, sf_dir):
    kept = curation.keep_tracks(curation.dedup_first_wins(X.titles(spark, sf_dir)), 50)
    return kept.select("seq", "url")


@query(
    "t5_dedup_by_id_only",
    f"""WITH {X.TITLES_SQL} SELECT seq, CASE WHEN row_number() OVER (PARTITION BY url ORDER BY seq) = 1 THEN 'kept' ELSE 'id_dupe' END AS status FROM titles""",
)
def t5_ids(spark, sf_dir):
    return curation.dedup_first_wins(X.titles(spark, sf_dir), allow_title_duplicates=True).select("seq", "status")


@query(
    "t6_skip_collected",
    f"""WITH {X.TITLES_SQL} SELECT seq, substr(url, 27, 11) AS video_id, substr(url, 27, 11) IN (SELECT substr(url, 27, 11) FROM titles WHERE p_size > 40) AS skipped FROM titles""",
)
def t6(spark, sf_dir):
    titles = X.titles(spark, sf_dir)
    name = F.concat(F.lit("/out/x ["), F.substring("url", 27, 11), F.lit("].opus"))
    listing = titles.where("p_size > 40").select(name.alias("path"))
    return curation.skip_collected(titles, listing).select("seq", "video_id", "skipped")


_RAW_SQL = """raws AS (SELECT seq, CASE seq % 7 WHEN 0 THEN url WHEN 1 THEN 'https://x.example/playlist?list=' || seq
    WHEN 2 THEN 'ytsearch5:' || title WHEN 3 THEN '# ' || title WHEN 4 THEN '   ' WHEN 5 THEN url || '&list=' || seq ELSE ' ' || title END AS raw FROM titles)"""


def _raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("seq") % 7, F.col("seq").cast("string")
    raw = (
        F.when(k == 0, F.col("url"))
        .when(k == 1, F.concat(F.lit("https://x.example/playlist?list="), n))
        .when(k == 2, F.concat(F.lit("ytsearch5:"), "title"))
        .when(k == 3, F.concat(F.lit("# "), "title"))
        .when(k == 4, F.lit("   "))
        .when(k == 5, F.concat("url", F.lit("&list="), n))
        .otherwise(F.concat(F.lit(" "), "title"))
    )
    return X.titles(spark, sf_dir).select("seq", raw.alias("raw"))


@query(
    "t7_classify_input",
    f"""WITH {X.TITLES_SQL}, {_RAW_SQL}, s AS (SELECT seq, trim(raw) AS r FROM raws)
    SELECT seq, CASE WHEN r = '' OR r LIKE '#%' THEN NULL WHEN r LIKE 'http%' AND r LIKE '%list=%' AND r NOT LIKE '%/watch?%' THEN 'playlist'
      WHEN r LIKE 'http%' THEN 'single' ELSE 'search' END AS kind,
    CASE WHEN r = '' OR r LIKE '#%' THEN NULL WHEN r LIKE 'http%' OR r LIKE 'ytsearch%' THEN r ELSE 'ytsearch10:' || r END AS target FROM s""",
)
def t7(spark, sf_dir):
    kind, target = T.classify_input(F.col("raw"), 10)
    return _raws(spark, sf_dir).select("seq", kind.alias("kind"), target.alias("target"))


_DURATION_SQL = "CASE WHEN p_size % 7 <> 0 THEN p_size * 20.0 END"


def _durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    duration = F.when(F.col("p_size") % 7 != 0, F.col("p_size") * F.lit(20.0))
    return X.titles(spark, sf_dir).withColumn("duration", duration)


@query(
    "t8_duration_filter",
    f"""WITH {X.TITLES_SQL}, d AS (SELECT seq, {_DURATION_SQL} AS d FROM titles)
    SELECT seq, d IS NULL OR d BETWEEN 60 AND 600 AS listed,
    CASE WHEN d IS NULL THEN 'ok' WHEN d > 600 THEN 'too_long' WHEN d < 60 THEN 'too_short' ELSE 'ok' END AS verdict FROM d""",
)
def t8(spark, sf_dir):
    d = F.col("duration")
    return _durations(spark, sf_dir).select(
        "seq", curation.duration_filter(d, 60.0, 600.0).alias("listed"), curation.duration_verdict(d).alias("verdict")
    )


@query("t9_purge_report", f"WITH {X.TITLES_SQL} SELECT count(*) AS inspected, count(*) FILTER ({_DURATION_SQL} > 600) AS over_limit FROM titles")
def t9(spark, sf_dir):
    return curation.purge_report(_durations(spark, sf_dir), 600.0)


@query(
    "t10_resolve_incremental",
    f"""WITH {X.TITLES_SQL}, known AS (SELECT DISTINCT title FROM titles WHERE p_size > 25)
    SELECT seq AS pos, CAST(i AS INTEGER) AS entry_pos, CASE WHEN k.title IS NOT NULL THEN 'old:' ELSE 'new:' END || i || t.title AS url, t.title AS title
    FROM titles t LEFT JOIN known k ON k.title = t.title, range(2) r(i)
    WHERE k.title IS NOT NULL OR t.title NOT LIKE '%Channel%'""",
)
def t10(spark, sf_dir):
    titles = X.titles(spark, sf_dir)

    def entries(word: str):
        return F.array(
            *[F.struct(F.concat(F.lit(f"{word}:{i}"), "raw").alias("url"), F.col("raw").alias("title")) for i in (0, 1)]
        )

    def resolve(missing: DataFrame) -> DataFrame:
        answered = missing.where(~F.col("raw").contains("Channel"))
        return answered.select("cache_key", entries("new").alias("entries"))

    key = resolution_cache_key(F.col("raw"), F.lit(10), F.lit(60.0), F.lit(600.0))
    cache = titles.where("p_size > 25").select(F.col("title").alias("raw")).distinct()
    cache = cache.select(key.alias("cache_key"), entries("old").alias("entries"))
    inputs = titles.select(F.col("seq").alias("pos"), F.col("title").alias("raw"))
    flat, _ = curation.resolve_incremental(
        inputs, cache, resolve, search_limit=10, min_duration=60.0, max_duration=600.0
    )
    return flat


_TOLD_SQL = """told AS (SELECT seq, title, p_name, p_brand, p_size,
    CASE seq % 5 WHEN 0 THEN 'Provided to YouTube by ' || p_brand || chr(10) || chr(10) || title || chr(10) || '  ℗ ' || (1960 + p_size) || ' Label' || chr(10) || 'Released on: 2012-03-' || lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')
      WHEN 1 THEN title || ' in ' || (1960 + p_size) || '1' WHEN 2 THEN '© ' || p_brand || chr(13) || chr(10) || 'x℗' || p_size
      WHEN 3 THEN '' ELSE 'a' || p_size || ' ©' || (1900 + p_size) || '-01-02' END AS told,
    CASE seq % 4 WHEN 0 THEN '2001' || lpad(CAST(p_size % 12 + 1 AS VARCHAR), 2, '0') || '07' WHEN 1 THEN '1999' WHEN 2 THEN '2005-06-07' END AS raw FROM titles)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s, n = F.col("seq"), F.col("p_size")
    provided = F.concat(
        F.lit("Provided to YouTube by "), "p_brand", F.lit("\n\n"), "title", F.lit("\n  ℗ "),
        (1960 + n).cast("string"), F.lit(" Label\nReleased on: 2012-03-"), two(n % 28 + 1),
    )
    told = (
        F.when(s % 5 == 0, provided)
        .when(s % 5 == 1, F.concat("title", F.lit(" in "), (1960 + n).cast("string"), F.lit("1")))
        .when(s % 5 == 2, F.concat(F.lit("© "), "p_brand", F.lit("\r\nx℗"), n.cast("string")))
        .when(s % 5 == 3, F.lit(""))
        .otherwise(F.concat(F.lit("a"), n.cast("string"), F.lit(" ©"), (1900 + n).cast("string"), F.lit("-01-02")))
    )
    raw = (
        F.when(s % 4 == 0, F.concat(F.lit("2001"), two(n % 12 + 1), F.lit("07")))
        .when(s % 4 == 1, "1999")
        .when(s % 4 == 2, "2005-06-07")
    )
    return X.titles(spark, sf_dir).select("seq", "title", "p_name", "p_brand", "p_size", told.alias("told"), raw.alias("raw"))


_YEAR_SQL = "regexp_extract(told, '(?:℗|©|Released on:|\\b)([0-9]{4})(?:-[0-9]{2}-[0-9]{2})?', 1)"


@query(
    "t11_t12_t13_t19_descriptions",
    f"""WITH {X.TITLES_SQL}, {_TOLD_SQL} SELECT seq, {_YEAR_SQL} AS first_year,
    CASE WHEN raw LIKE '________' THEN substr(raw, 1, 4) || '-' || substr(raw, 5, 2) || '-' || substr(raw, 7, 2) WHEN raw IS NOT NULL THEN raw
      WHEN told LIKE '%Released on:%' THEN regexp_extract(told, 'Released on:\\s*([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) ELSE {_YEAR_SQL} END AS release_date,
    coalesce(list_filter(list_transform(string_split_regex(told, '\\r\\n|\\n'), lambda l: trim(l)), lambda l: contains(l, '℗') OR starts_with(l, '©'))[1], '') AS copyright,
    CASE WHEN contains(told, 'Provided to YouTube by') THEN split_part(told, chr(10), 1) || '. Auto-generated by YouTube.'
      WHEN told <> '' THEN 'Source: YouTube Music. Metadata inferred where needed.' ELSE 'Auto-generated by YouTube.' END AS note FROM told""",
)
def t11(spark, sf_dir):
    told = F.col("told")
    return _told(spark, sf_dir).select(
        "seq",
        T.first_year(told).alias("first_year"),
        T.release_date(F.col("raw"), told).alias("release_date"),
        T.copyright_line(told).alias("copyright"),
        T.source_note(told).alias("note"),
    )


_GIVEN_SQL = "given AS (SELECT seq, title || CASE WHEN seq % 4 = 0 THEN ' (Official Audio)' WHEN seq % 4 = 1 THEN ' HD' ELSE '' END AS title, CASE WHEN p_size > 40 THEN p_brand || ', ' || p_type WHEN p_size > 30 THEN 'NA' END AS artist, CASE WHEN p_size % 3 = 0 THEN p_name END AS track FROM titles)"
_PARSED_SQL = "trim(regexp_replace(trim(regexp_replace(substr(title, strpos(title, ' - ') + 3), '\\s*\\(?official (audio|video)\\)?\\s*', '', 'gi')), '\\s+HD$', '', 'i'))"


@query(
    "t14_artist_title",
    f"""WITH {X.TITLES_SQL}, {_GIVEN_SQL}, p AS (SELECT *, coalesce(artist, 'NA') = 'NA' AS missing, contains(title, ' - ') AS has FROM given),
    q AS (SELECT seq, CASE WHEN NOT missing THEN artist WHEN has THEN trim(split_part(title, ' - ', 1)) ELSE '' END AS artist,
      CASE WHEN NOT missing THEN coalesce(track, title) WHEN has AND {_PARSED_SQL} <> '' THEN {_PARSED_SQL} ELSE title END AS title FROM p)
    SELECT seq, artist, title, trim(split_part(artist, ',', 1)) AS album_artist FROM q""",
)
def t14(spark, sf_dir):
    s, n = F.col("seq"), F.col("p_size")
    end = F.when(s % 4 == 0, " (Official Audio)").when(s % 4 == 1, " HD").otherwise("")
    given = F.when(n > 40, F.concat("p_brand", F.lit(", "), "p_type")).when(n > 30, "NA")
    artist, title, album_artist = T.infer_artist_title(
        given, F.when(n % 3 == 0, F.col("p_name")), F.concat("title", end)
    )
    return X.titles(spark, sf_dir).select(
        "seq", artist.alias("artist"), title.alias("title"), album_artist.alias("album_artist")
    )


def _genre_sql() -> str:
    out = []
    for _, needles, label, special, special_label in fixed.GENRE_RULES:
        hit = " OR ".join(f"contains(x, '{n}')" for n in needles)
        value = f"'{label}'"
        if special:
            value = f"CASE WHEN contains(x, '{special}') THEN '{special_label}' ELSE '{label}' END"
        out.append(f"WHEN {hit} THEN {value}")
    return "CASE " + " ".join(out) + " ELSE coalesce(given, 'Pop') END"


@query(
    "t15_infer_genre",
    f"""WITH d AS (SELECT doc_id, lower(text || ' ' || lang || ' ' || source) AS x, CASE WHEN lang = 'fr' THEN 'Chanson' END AS given FROM documents)
    SELECT doc_id, {_genre_sql()} AS genre FROM d""",
)
def t15(spark, sf_dir):
    given = F.when(F.col("lang") == "fr", "Chanson")
    genre = T.infer_genre(F.col("text"), F.col("lang"), F.col("source"), given)
    return _documents(spark, sf_dir).select("doc_id", genre.alias("genre"))


@query(
    "t16_t17_parse_tags",
    f"""SELECT event_id, CASE WHEN user_id % 6 <> 0 THEN event_type END AS title,
    CASE WHEN user_id % 6 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'u' || user_id ELSE 'v' || user_id END AS artist,
    CASE WHEN user_id % 6 <> 0 AND event_id % 2 = 0 THEN CAST(1880 + event_id % 250 AS VARCHAR) ELSE '' END AS raw_year,
    CASE WHEN user_id % 6 <> 0 AND event_id % 2 = 0 AND 1880 + event_id % 250 BETWEEN 1900 AND 2100 THEN CAST(1880 + event_id % 250 AS INTEGER) ELSE -1 END AS year FROM events""",
)
def t16(spark, sf_dir):
    u, e = F.col("user_id"), F.col("event_id")
    one = lambda c: F.array(c.cast("string"))
    none = F.array().cast("array<string>")
    year = (1880 + e % 250).cast("string")
    tags = F.create_map(
        F.lit("title"), one(F.concat(F.lit(" "), "event_type", F.lit(" "))),
        F.lit("artist"), F.when(u % 3 == 1, one(F.concat(F.lit("u"), u))).otherwise(none),
        F.lit("albumartist"), one(F.concat(F.lit("v"), u)),
        F.lit("date"), F.when(e % 2 == 0, one(F.concat(year, F.lit("-05-06")))).otherwise(one(F.lit("n/a"))),
    )
    parsed = T.parse_tags(F.col("m"))
    with_map = table(spark, sf_dir, "events").withColumn("m", F.when(u % 6 != 0, tags))
    raw = F.when((u % 6 != 0) & (e % 2 == 0), year).otherwise("")
    return with_map.select(
        "event_id", parsed["title"].alias("title"), parsed["artist"].alias("artist"), raw.alias("raw_year"),
        F.coalesce(parsed["year"], F.lit(-1)).alias("year"),
    )


@query(
    "t18_tag_merge",
    f"""WITH {X.TITLES_SQL} SELECT seq, 'title' AS tag, title AS value FROM titles
    UNION ALL SELECT seq, 'artist', CASE WHEN p_size > 25 THEN p_brand ELSE 'linked' END FROM titles
    UNION ALL SELECT seq, 'label', p_type FROM titles WHERE p_size % 2 = 0""",
)
def t18(spark, sf_dir):
    big = F.col("p_size") > 25
    inferred = F.create_map(F.lit("title"), F.col("title"), F.lit("artist"), F.when(big, F.col("p_brand")).otherwise(""))
    label = F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("")
    linked = F.create_map(F.lit("title"), F.lit("other"), F.lit("artist"), F.lit("linked"), F.lit("label"), label)
    merged = X.titles(spark, sf_dir).select("seq", F.explode(T.tag_merge(inferred, linked)).alias("tag", "value"))
    return merged


@query("t20_outcome_summary", f"WITH {X.TITLES_SQL} SELECT CASE WHEN p_size > 40 THEN 'skipped' WHEN p_size > 38 THEN 'failed' ELSE 'downloaded' END AS status, count(*) AS n FROM titles GROUP BY 1")
def t20(spark, sf_dir):
    n = F.col("p_size")
    status = F.when(n > 40, "skipped").when(n > 38, "failed").otherwise("downloaded")
    return curation.outcome_summary(X.titles(spark, sf_dir).withColumn("status", status))


# ---------------------------------------------------------------- linkage


def _norm_sql(text: str) -> str:
    return f"trim(regexp_replace(replace(lower({text}), 'ß', 'ss'), '[^0-9a-z]+', ' ', 'g'))"


def _tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm_sql(text)}, ' '), lambda t: length(t) >= 3))"


@query("l1_norm_tokens", f"SELECT doc_id, md5({_norm_sql('text')}) AS norm, len({_tokens_sql('text')}) AS n_tokens FROM documents")
def l1(spark, sf_dir):
    text = F.col("text")
    return _documents(spark, sf_dir).select(
        "doc_id", _md5(K.norm_text(text)).alias("norm"), F.size(K.tokens(text)).cast("bigint").alias("n_tokens")
    )


@query(
    "l2_l3_l4_scores",
    f"""WITH {X.TITLES_SQL}, m AS (SELECT seq, p_size, p_retailprice, len(list_intersect({_tokens_sql('p_brand')}, {_tokens_sql('title')})) > 0 AS by_artist,
      contains({_norm_sql('title')}, {_norm_sql('p_name')}) OR {_norm_sql('p_type')} = {_norm_sql('p_name')} AS by_album,
      least(abs(p_size * 1000 - CAST(floor(p_retailprice) AS BIGINT) * 30) / 1000.0, 30) AS gap FROM titles)
    SELECT seq, by_artist, by_album, {sql_r6("CASE WHEN NOT (by_artist OR by_album) THEN -999 ELSE 50 + p_size - CASE WHEN p_size % 5 <> 0 THEN gap ELSE 0 END + CASE WHEN by_artist THEN 20 ELSE 0 END + CASE WHEN by_album THEN 20 ELSE 0 END END")} AS score FROM m""",
)
def l2(spark, sf_dir):
    n = F.col("p_size")
    by_artist = K.artist_match(F.col("p_brand"), F.col("title"))
    by_album = K.album_match(F.col("p_name"), F.array("title", F.lit(None).cast("string")))
    pen = K.duration_penalty(F.when(n % 5 != 0, n * 1000), F.floor("p_retailprice") * 30)
    same = K.norm_text(F.col("p_type")) == K.norm_text(F.col("p_name"))
    scored = X.titles(spark, sf_dir).select("seq", by_artist.alias("by_artist"), (by_album | same).alias("by_album"), pen.alias("pen"), "p_size")
    score = K.recording_score(50 + n, F.col("pen"), F.col("by_artist"), F.col("by_album"), F.lit(True))
    return scored.select("seq", "by_artist", "by_album", r6(score).alias("score"))


# tracks: every part; recordings: every part under its plain name, with two release titles
_LINK_SQL = f"""l AS (SELECT p_partkey AS src, {_norm_sql('p_name')} AS t, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 = 1 THEN 'a b' ELSE {_norm_sql('p_brand')} END AS a,
    CASE WHEN p_partkey % 5 = 0 THEN '' WHEN p_partkey % 5 = 1 THEN left({_norm_sql('p_type')}, 4) ELSE {_norm_sql('p_type')} END AS b,
    CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE CAST(p_size AS BIGINT) * 4000 END AS ms FROM part),
  r AS (SELECT p_partkey AS cand, {_norm_sql('p_name')} AS t, {_norm_sql('p_brand')} AS a,
    CASE WHEN p_partkey % 3 = 0 THEN [{_norm_sql('p_type')}] ELSE [{_norm_sql('p_type')} || ' deluxe', 'best of'] END AS rel,
    CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE (p_partkey % 50) * 4000 + p_partkey % 97 END AS length, 40 + p_size AS base FROM part),
  p AS (SELECT src, cand, l.a AS la, r.a AS ra, l.b AS lb, rel, base, (l.a <> '' OR l.b <> '') AS given,
      len(list_intersect(list_filter(string_split(l.a, ' '), lambda w: length(w) >= 3), list_filter(string_split(r.a, ' '), lambda w: length(w) >= 3))) > 0 AS am,
      l.b <> '' AND len(list_filter(rel, lambda x: contains(x, l.b))) > 0 AS bm,
      CASE WHEN ms > 0 AND length > 0 THEN least(abs(length - ms), 30000) ELSE 0 END AS pen FROM l JOIN r USING (t)),
  s AS (SELECT src, cand, la, ra, lb, rel, CASE WHEN given AND NOT (am OR bm) THEN -999000 ELSE base * 1000 - pen + CASE WHEN am THEN 20000 ELSE 0 END + CASE WHEN bm THEN 20000 ELSE 0 END END AS score FROM p),
  c AS (SELECT src, 1 AS stage, cand, score FROM s WHERE la <> '' AND lb <> '' AND la = ra AND list_contains(rel, lb)
        UNION ALL SELECT src, 2, cand, score FROM s WHERE la <> '' AND la = ra
        UNION ALL SELECT src, 3, cand, score FROM s)"""


def _link_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tracks = part.select(
        k.alias("src"),
        F.col("p_name").alias("title"),
        F.when(k % 7 == 1, "A.b").when(k % 7 != 0, F.col("p_brand")).alias("artist"),
        F.when(k % 5 == 0, "").when(k % 5 == 1, F.left("p_type", F.lit(4))).otherwise(F.col("p_type")).alias("album"),
        F.when(k % 11 != 0, F.col("p_size").cast("bigint") * 4000).alias("ms"),
    )
    deluxe = F.array(F.concat("p_type", F.lit(" (Deluxe)")), F.lit("Best of"))
    recordings = part.select(
        k.alias("cand"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("artist_names"),
        F.when(k % 3 == 0, F.array("p_type")).otherwise(deluxe).alias("releases"),
        F.when(k % 13 != 0, (k % 50) * 4000 + k % 97).alias("length"),
        (40 + F.col("p_size")).alias("base"),
    )
    return tracks, recordings


@query(
    "l5_best_match",
    f"""WITH {_LINK_SQL} SELECT src, CAST(stage AS INTEGER) AS stage, cand, {sql_r6('score / 1000.0')} AS score FROM c WHERE score >= 60000
    QUALIFY row_number() OVER (PARTITION BY src ORDER BY stage, score DESC, cand) = 1""",
)
def l5(spark, sf_dir):
    return linking.best_match(*_link_inputs(spark, sf_dir)).withColumn("score", r6(F.col("score")))


@query(
    "l6_best_release",
    f"""WITH {X.TITLES_SQL}, r AS (SELECT seq, i, CASE i WHEN 0 THEN p_type || ' x' WHEN 1 THEN p_type ELSE p_name END AS title, CASE (i + seq) % 3 WHEN 0 THEN 20 WHEN 1 THEN -20 ELSE 0 END
      + CASE WHEN (i + seq) % 2 = 0 THEN 2 ELSE 0 END AS extra, p_type FROM titles, range(3) x(i)),
    s AS (SELECT seq, i, title, extra + CASE WHEN {_norm_sql('title')} = {_norm_sql('p_type')} THEN 30 WHEN contains({_norm_sql('title')}, {_norm_sql('p_type')}) THEN 15 ELSE 0 END AS score FROM r)
    SELECT seq, title, CAST(score AS DOUBLE) AS score FROM s QUALIFY row_number() OVER (PARTITION BY seq ORDER BY score DESC, i) = 1""",
)
def l6(spark, sf_dir):
    names = ("p_type_x", "p_type", "p_name")
    df = X.titles(spark, sf_dir).withColumn("p_type_x", F.concat("p_type", F.lit(" x")))
    releases = F.array(
        *[
            F.struct(
                F.col(name).alias("title"),
                F.when((F.col("seq") + i) % 3 == 0, "Official").when((F.col("seq") + i) % 3 == 1, "Pseudo-Release").alias("status"),
                F.when((F.col("seq") + i) % 2 == 0, "2001-01-01").otherwise(" NA ").alias("date"),
            )
            for i, name in enumerate(names)
        ]
    )
    best = df.select("seq", "p_type", K.best_release(releases, F.col("p_type")).alias("r"))
    score = K.release_score(F.col("r.title"), F.col("r.status"), F.col("r.date"), F.col("p_type"))
    return best.select("seq", F.col("r.title").alias("title"), score.alias("score"))


def _release_json():
    n = F.col("p_size")
    credit = F.array(
        F.struct(F.col("p_brand").alias("name"), F.struct(F.lit("x").alias("name"), F.concat("p_brand", F.lit(", The")).alias("sort-name"), F.lit("id1").alias("id")).alias("artist")),
        F.struct(F.lit("NA").alias("name"), F.struct(F.col("p_type").alias("name"), F.lit("").alias("sort-name"), F.lit("id2").alias("id")).alias("artist")),
    )
    group = F.struct(
        F.lit("g1").alias("id"), F.concat((1950 + n).cast("string"), F.lit("-02-03")).alias("first-release-date"),
        F.lit("Album").alias("primary-type"), F.when(n % 2 == 0, F.array(F.lit("Live"), F.lit("NA"))).otherwise(F.array().cast("array<string>")).alias("secondary-types"),
    )
    labels = F.array(
        F.struct(F.lit("C-1").alias("catalog-number"), F.struct(F.col("p_brand").alias("name")).alias("label")),
        F.struct(F.lit(None).cast("string").alias("catalog-number"), F.struct(F.col("p_type").alias("name")).alias("label")),
    )
    track = lambda number, position, rid: F.struct(
        F.lit(number).alias("number"), F.lit(position).alias("position"), F.struct(rid.alias("id")).alias("recording"))
    own = F.concat(F.lit("r"), "seq")
    media = F.array(
        F.struct(F.lit(1).alias("position"), F.lit(9).alias("track-count"), F.array(track("A1", 1, F.lit("other"))).alias("tracks")),
        F.struct(F.lit(2).alias("position"), F.lit(0).alias("track-count"), F.array(track("", 4, F.when(n % 3 == 0, F.lit("z")).otherwise(own)), track("B2", 5, own)).alias("tracks")),
    )
    return F.to_json(F.struct(
        F.lit("rel").alias("id"), F.col("p_name").alias("title"), F.lit("NA").alias("date"), F.lit("GB").alias("country"), F.lit("Official").alias("status"),
        credit.alias("artist-credit"), group.alias("release-group"), labels.alias("label-info"), media.alias("media"),
    ))


_TAG_VALUES = {
    "album": "p_name",
    "releasecountry": "'GB'",
    "releasestatus": "'Official'",
    "album_artist": "p_brand || '; ' || p_type",
    "albumartistsort": "p_brand || ', The'",
    "musicbrainz_albumartistid": "'id1; id2'",
    "musicbrainz_albumid": "'rel'",
    "musicbrainz_releasegroupid": "'g1'",
    "musicbrainz_trackid": "'r' || seq",
    "originaldate": "(1950 + p_size) || '-02-03'",
    "originalyear": "CAST(1950 + p_size AS VARCHAR)",
    "releasetype": "CASE WHEN p_size % 2 = 0 THEN 'album;live' ELSE 'album' END",
    "label": "p_brand || '; ' || p_type",
    "catalognumber": "'C-1'",
    "disctotal": "'2'",
    "track": "CASE WHEN p_size % 3 = 0 THEN 'B2' ELSE '4' END",
    "tracktotal": "'2'",
    "disc": "'2'",
}


@query(
    "l7_l8_release_tags",
    f"WITH {X.TITLES_SQL} " + " UNION ALL ".join(f"SELECT seq, '{tag}' AS tag, {value} AS value FROM titles" for tag, value in _TAG_VALUES.items()),
)
def l8(spark, sf_dir):
    parsed = X.titles(spark, sf_dir).select("seq", F.from_json(_release_json(), schemas.RELEASE).alias("r"))
    tags = K.release_to_tags(F.col("r"), F.concat(F.lit("r"), "seq"))
    return parsed.select("seq", F.explode(tags).alias("tag", "value"))
