"""Store, identity, manifest, window, sampling and report queries over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom import fixed_values as fixed
from vecloom.functions import hashing as H
from vecloom.functions import vectors as V
from vecloom.functions import windows as W
from vecloom.operators import inference, reports, sampling
from vecloom.operators import labels as L
from vecloom.operators.ranking import global_positions, group_positions, sequence_positions
from vecloom.plans import fixtures as X
from vecloom.plans.registry import query, r6, sql_r6, sql_salt, sql_uniform, table
from vecloom.session import scratch_path, spread
from vecloom.sources import files as files_source
from vecloom.sources import remote
from vecloom.sources import store as store_source
from vecloom.sources import tables as tables_source
from vecloom.streaming.ingest import ingest_stream

# ---------------------------------------------------------------- sources and the store

_LISTING_SQL = """listing AS (SELECT '/lib/' || source || '/' ||
    CASE WHEN doc_id % 9 = 0 THEN '.hidden/' WHEN doc_id % 9 = 1 THEN '_kept/' ELSE lang || '/' END ||
    CASE WHEN doc_id % 14 = 0 THEN '.dot' ELSE 'd' END || doc_id || '.' ||
    ['flac', 'MP3', 'txt', 'jpg', 'opus', 'm4a', 'wav', 'Ogg'][doc_id % 8 + 1] AS path,
    n_chars * 100 AS length FROM documents)"""


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    suffixes = F.array(*[F.lit(s) for s in ("flac", "MP3", "txt", "jpg", "opus", "m4a", "wav", "Ogg")])
    folder = F.when(d % 9 == 0, ".hidden/").when(d % 9 == 1, "_kept/").otherwise(F.concat("lang", F.lit("/")))
    name = F.when(d % 14 == 0, ".dot").otherwise("d")
    path = F.concat(
        F.lit("/lib/"), "source", F.lit("/"), folder, name, d.cast("string"), F.lit("."),
        F.get(suffixes, (d % 8).cast("int")),
    )
    return table(spark, sf_dir, "documents").select(path.alias("path"), (F.col("n_chars") * 100).alias("length"))


_AUDIO = "regexp_matches(lower(path), '[.](flac|wav|ogg|opus|mp3|m4a)$') AND NOT regexp_matches(path, '/[.]')"


@query("s1_select_audio", f"WITH {_LISTING_SQL} SELECT path, length FROM listing WHERE {_AUDIO}")
def s1(spark, sf_dir):
    return files_source.select_audio(_listing(spark, sf_dir), "/lib")


# a tree of files: names with an underscore count, dot names and what is below them don't
_TREE_SQL = """tree AS (SELECT CASE vec_id % 6 WHEN 0 THEN 'a/' || vec_id || '.flac' WHEN 1 THEN '_x/' || vec_id || '.MP3' WHEN 2 THEN '.hidden/b/' || vec_id || '.flac'
    WHEN 3 THEN 'a/_b/' || vec_id || '.txt' WHEN 4 THEN 'a/.c' || vec_id || '.mp3' ELSE 'deep/er/' || vec_id % 5 || '/_' || vec_id || '.ogg' END AS path,
    repeat('ab', vec_id % 50) AS content FROM embeddings)"""


@query(
    "s1_scan_files",
    f"""WITH {_TREE_SQL} SELECT path, CAST(length(content) AS BIGINT) AS length, row_number() OVER (ORDER BY string_split(path, '/')) - 1 AS place
    FROM tree WHERE regexp_matches(path, '[.](flac|MP3|ogg|mp3)$') AND NOT regexp_matches(path, '(^|/)[.]')""",
)
def s1_files(spark, sf_dir):
    """Files written by tasks and listed by tasks, in scan order."""
    i = F.col("vec_id")
    names = ("a/%d.flac", "_x/%d.MP3", ".hidden/b/%d.flac", "a/_b/%d.txt", "a/.c%d.mp3")
    name = F.concat(F.lit("deep/er/"), (i % 5).cast("string"), F.format_string("/_%d.ogg", i))
    for k, form in enumerate(names):
        name = F.when(i % 6 == k, F.format_string(form, i)).otherwise(name)
    tree = table(spark, sf_dir, "embeddings").select(name.alias("path"), F.repeat(F.lit("ab"), (i % 50).cast("int")).alias("content"))
    root = scratch_path(spark, "tree")
    remote.write_files(tree, root)
    found = files_source.scan_files(spark, root)
    below = H.relative_path(F.col("path"), re.sub("^file:/+", "/", root))
    place = F.row_number().over(Window.orderBy(files_source.scan_order(below))) - 1
    return found.select(below.alias("path"), "length", place.cast("long").alias("place"))


_STORE_OUT = "track_id, path, title, artist, album, genre, year, model_version, embedding_dim"


def _store_rows(df: DataFrame) -> DataFrame:
    weight = V.total(V.doubles(F.col("embedding")))
    return df.select(*_STORE_OUT.split(", "), r6(weight).alias("weight"))


_WEIGHT = sql_r6("list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE)))") + " AS weight"


@query("s2_s3_store_round_trip", f"WITH {X.STORE_SQL} SELECT {_STORE_OUT}, {_WEIGHT} FROM store")
def s2(spark, sf_dir):
    path = scratch_path(spark, "store")
    store_source.write_store(X.store(spark, sf_dir), path)
    return _store_rows(store_source.scan_store(spark, path))


_CHANGED_SQL = f"""new_rows AS (
    SELECT track_id, path, CAST(NULL AS VARCHAR) AS title, artist, album, 'changed' AS genre, year, model_version, embedding_dim, embedding, 1 AS seq FROM store WHERE label < 3
    UNION ALL SELECT track_id, path, 'twice', artist, album, 'changed', year, model_version, embedding_dim, embedding, 2 FROM store WHERE label < 2
    UNION ALL SELECT 'x' || track_id, path, title, artist, album, genre, year, model_version, embedding_dim, embedding, 1 FROM store WHERE label = 9),
  latest AS (SELECT * FROM new_rows QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY seq DESC) = 1)
  SELECT {_STORE_OUT}, {_WEIGHT} FROM (
    SELECT * EXCLUDE (seq) FROM latest
    UNION ALL SELECT track_id, path, title, artist, album, genre, year, model_version, embedding_dim, embedding FROM store
    WHERE track_id NOT IN (SELECT track_id FROM latest))"""


def _changes(store: DataFrame) -> list[DataFrame]:
    first = store.where("label < 3").withColumn("title", F.lit(None).cast("string"))
    first = first.withColumn("genre", F.lit("changed"))
    second = store.where("label < 2").withColumn("title", F.lit("twice")).withColumn("genre", F.lit("changed"))
    added = store.where("label = 9").withColumn("track_id", F.concat(F.lit("x"), "track_id"))
    return [first.unionByName(added), second]


@query("s4_upsert", f"WITH {X.STORE_SQL}, {_CHANGED_SQL}")
def s4(spark, sf_dir):
    store = X.store(spark, sf_dir)
    first, second = _changes(store)
    new = first.withColumn("seq", F.lit(1)).unionByName(second.withColumn("seq", F.lit(2)))
    return _store_rows(store_source.upsert(store, new))


@query("s4_store_deltas", f"WITH {X.STORE_SQL}, {_CHANGED_SQL}")
def s4_deltas(spark, sf_dir):
    path = scratch_path(spark, "store")
    store = X.store(spark, sf_dir)
    store_source.write_store(store, path)
    for change in _changes(store):
        store_source.write_delta(change, path)
    return _store_rows(store_source.scan_store(spark, path))


@query(
    "s5_width_audit",
    """SELECT count(DISTINCT len(embedding)) AS n_widths, CAST(min(len(embedding)) AS INTEGER) AS min_width,
    CAST(max(len(embedding)) AS INTEGER) AS max_width FROM embeddings""",
)
def s5(spark, sf_dir):
    return store_source.width_audit(table(spark, sf_dir, "embeddings"))


@query(
    "s6_contains",
    f"""WITH {X.STORE_SQL} SELECT track_id, track_id IN (SELECT track_id FROM store) AS present
    FROM (SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') AS track_id FROM documents)""",
)
def s6(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("track_id"))
    return store_source.contains(X.store(spark, sf_dir), ids)


@query(
    "s6_get_embeddings",
    f"""WITH {X.STORE_SQL} SELECT track_id, {_WEIGHT} FROM store
    WHERE track_id IN (SELECT lpad(CAST(doc_id AS VARCHAR), 6, '0') FROM labels)""",
)
def s6_get(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.lpad(F.col("doc_id").cast("string"), 6, "0").alias("track_id"))
    got = store_source.get_embeddings(X.store(spark, sf_dir), ids)
    return got.select("track_id", r6(V.total(V.doubles(F.col("embedding")))).alias("weight"))


# files: a store row per vector and a copy elsewhere; ids repeat, some cannot be read or embedded
_FILES_SQL = """files AS (
    SELECT CASE WHEN vec_id % 19 <> 0 THEN 'i' || (vec_id % 400) END AS track_id, '/new/' || artist || '/' || vec_id || '.mp3' AS path,
           CASE WHEN vec_id % 23 <> 0 THEN embedding END AS embedding FROM (SELECT * REPLACE (coalesce(artist, 'none') AS artist) FROM store_f)),
  known AS (SELECT DISTINCT 'i' || (vec_id % 400) AS track_id FROM embeddings WHERE label < 3)"""


def _files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = F.col("vec_id")
    track_id = F.concat(F.lit("i"), (v % 400).cast("string"))
    path = F.concat(F.lit("/new/"), F.coalesce("artist", F.lit("none")), F.lit("/"), v.cast("string"), F.lit(".mp3"))
    files = X.store(spark, sf_dir).select(
        F.when(v % 19 != 0, track_id).alias("track_id"),
        path.alias("path"),
        F.when(v % 23 != 0, F.col("embedding")).alias("embedding"),
    )
    known = table(spark, sf_dir, "embeddings").where("label < 3").select(track_id.alias("track_id"))
    return files, known.distinct()


_INGEST_SQL = f"""{X.STORE_SQL}, store_f AS (SELECT vec_id, artist, embedding FROM store), {_FILES_SQL},
  firsts AS (SELECT track_id, min(string_split(path, '/')) AS f FROM files WHERE track_id IS NOT NULL AND embedding IS NOT NULL GROUP BY track_id),
  marked AS (SELECT s.track_id, s.path, CASE
      WHEN s.track_id IN (SELECT track_id FROM known) OR f < string_split(path, '/') THEN 'skipped_existing'
      WHEN f = string_split(path, '/') THEN 'new' ELSE 'failed' END AS status
    FROM files s LEFT JOIN firsts USING (track_id))"""


@query("s7_ingest_incremental", f"WITH {_INGEST_SQL} SELECT track_id, path, status FROM marked")
def s7(spark, sf_dir):
    files, known = _files(spark, sf_dir)
    return store_source.ingest_incremental(files, known).select("track_id", "path", "status")


@query(
    "s7_ingest_counters",
    f"""WITH {_INGEST_SQL}, lim AS (SELECT string_split(path, '/') AS p FROM marked WHERE status = 'new' ORDER BY 1 LIMIT 100)
    SELECT count(*) FILTER (status = 'new') AS n_new, count(*) FILTER (status = 'skipped_existing') AS n_skipped_existing,
    count(*) FILTER (status = 'failed') AS n_failed FROM marked WHERE string_split(path, '/') <= (SELECT max(p) FROM lim) OR (SELECT count(*) FROM lim) < 100""",
)
def s7_counters(spark, sf_dir):
    """A run that stops after 100 new files."""
    files, known = _files(spark, sf_dir)
    return store_source.ingest_counters(store_source.ingest_incremental(files, known, limit=100))


@query(
    "s8_ingest_stream",
    f"""WITH {X.STORE_SQL} SELECT track_id, path, CASE WHEN label < 3 THEN 'old' ELSE title END AS title, artist, album, genre, year, model_version, embedding_dim, {_WEIGHT} FROM store""",
)
def s8(spark, sf_dir):
    """A store that knows some ids catches up with the vector files."""
    path = scratch_path(spark, "store")
    old = X.store(spark, sf_dir).where("label < 3").withColumn("title", F.lit("old"))
    store_source.write_store(old, path)
    ingest_stream(
        spark, f"{sf_dir.rstrip('/')}/embeddings*.parquet", path, scratch_path(spark, "stream"),
        schema=table(spark, sf_dir, "embeddings").schema, transform=X.store_of,
    ).awaitTermination()
    return _store_rows(store_source.scan_store(spark, path))


@query(
    "s9_label_index",
    f"WITH {X.LABELS_SQL} SELECT fma_track_id, subset, split, genre_top, artist_id FROM labels_dim",
)
def s9(spark, sf_dir):
    """The columns of a label file under their two-level names; reading such a file is in the tests."""
    names = {"subset": "set.subset", "split": "set.split", "genre_top": "track.genre_top", "artist_id": "artist.id"}
    return tables_source.label_index(X.labels_dim(spark, sf_dir).withColumnsRenamed(names))


_WIDE = fixed.BENCHMARK_TAGS


def _wide_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    flags = [F.when(v % (i + 2) == 0, 1).otherwise(0).alias(t) for i, t in enumerate(_WIDE)]
    return table(spark, sf_dir, "embeddings").select(v.cast("string").alias("mp3_path"), *flags)


@query(
    "s10_tag_sets",
    "SELECT CAST(vec_id AS VARCHAR) AS mp3_path, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN vec_id % {i + 2} = 0 THEN '{t}' END" for i, t in enumerate(_WIDE))
    + "], lambda t: t IS NOT NULL), ';') AS tags FROM embeddings",
)
def s10(spark, sf_dir):
    wide = _wide_tags(spark, sf_dir)
    sets = tables_source.tag_sets(wide, tables_source.choose_tags(wide.columns))
    return sets.select("mp3_path", F.array_join("tags", ";").alias("tags"))


@query(
    "s11_read_targets",
    f"""WITH {X.LABELS_SQL} SELECT fma_track_id, genre_top, subset FROM labels_dim
    WHERE split = 'validation' ORDER BY fma_track_id LIMIT 40""",
)
def s11(spark, sf_dir):
    targets = tables_source.read_targets(
        X.labels_dim(spark, sf_dir), split="validation", limit=40, order=["fma_track_id"]
    )
    return targets.select("fma_track_id", "genre_top", "subset")


@query(
    "s12_write_targets",
    f"""WITH {X.LABELS_SQL} SELECT split, count(*) AS n, count(genre_top) AS n_labelled FROM labels_dim GROUP BY split""",
)
def s12(spark, sf_dir):
    path = scratch_path(spark, "targets")
    tables_source.write_targets(X.labels_dim(spark, sf_dir), path)
    back = spark.read.parquet(path)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("genre_top").alias("n_labelled"))


@query(
    "s13_input_list",
    """SELECT doc_id, CAST(line_no - 1 AS INTEGER) AS line_no, md5(raw) AS raw FROM (
      SELECT doc_id, line_no, regexp_replace(line, '^[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+|[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+$', '', 'g') AS raw
      FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no
            FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|\\n|\\r') AS l FROM documents)))
    WHERE raw <> '' AND raw NOT LIKE '#%'""",
)
def s13(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line_no", "raw")
    )
    return files_source.select_inputs(lines).select("doc_id", "line_no", F.md5(F.col("raw").cast("binary")).alias("raw"))


@query(
    "s14_cached_arrays",
    f"""WITH {X.SIGNAL_SQL} SELECT count(*) AS n_rows, count(*) FILTER (len(s) < 20) AS n_null,
    CAST(sum(CASE WHEN len(s) >= 20 THEN len(s) END) AS BIGINT) AS n_values FROM signals""",
)
def s14(spark, sf_dir):
    clips = X.signals(spark, sf_dir).select("doc_id", F.when(F.size("s") >= 20, F.col("s")).alias("clip"))
    folder = scratch_path(spark, "arrays")
    tables_source.cached_arrays(clips, folder, "train", "0123456789abcdef")
    cached = tables_source.cached_arrays(clips, folder, "train", "0123456789abcdef")
    return cached.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("clip").isNull()).alias("n_null"),
        F.sum(F.size("clip")).alias("n_values"),
    )


@query(
    "s15_json_report",
    """SELECT '{"dataset":"library","labels":{"max":' || max(label) || ',"min":' || min(label) || '},"n_store":' || count(*) || '}' AS json FROM embeddings""",
)
def s15(spark, sf_dir):
    report = table(spark, sf_dir, "embeddings").agg(
        F.count(F.lit(1)).alias("n_store"),
        F.struct(F.min("label").alias("min"), F.max("label").alias("max")).alias("labels"),
        F.lit("library").alias("dataset"),
    )
    return reports.json_report(report)


# ---------------------------------------------------------------- identity


@query("h1_content_fingerprint")
def h1(spark, sf_dir):
    content = F.encode("text", "utf-8")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", H.content_fingerprint(content, 1024).alias("track_id"),
        H.content_fingerprint_seed0(content, 1024).alias("seed0_id"),
    )


@query(
    "h1_same_content",
    """WITH b AS (SELECT doc_id, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY n, CASE WHEN n <= 2048 THEN x ELSE substr(x, 1, 2048) || substr(x, 2 * (n - 1024) + 1, 2048) END) AS first_doc_id FROM b""",
)
def h1_same(spark, sf_dir):
    """Equal ids stand for equal size, head and tail: the first document of each id."""
    ids = h1(spark, sf_dir).select("doc_id", "track_id", "seed0_id")
    first = ids.groupBy("track_id", "seed0_id").agg(F.min("doc_id").alias("first_doc_id"))
    return ids.join(first, ["track_id", "seed0_id"]).select("doc_id", "first_doc_id")


_FINGERPRINT_SQL = """WITH b AS (SELECT doc_id, encode(text) AS c, octet_length(encode(text)) AS n FROM documents),
    z AS (SELECT *, format('{:016x}', n) AS x FROM b)
    SELECT doc_id, sha256(unhex(substr(x, 15, 2) || substr(x, 13, 2) || substr(x, 11, 2) || substr(x, 9, 2) || substr(x, 7, 2) || substr(x, 5, 2) || substr(x, 3, 2) || substr(x, 1, 2))
      || CASE WHEN n <= 2048 THEN c ELSE unhex(substr(hex(c), 1, 2048)) || unhex(substr(hex(c), 2 * (n - 1024) + 1, 2048)) END) AS track_id
    FROM z"""


@query("h1_content_fingerprint_sha", _FINGERPRINT_SQL)
def h1_sha(spark, sf_dir):
    content = F.encode("text", "utf-8")
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", H.content_fingerprint_sha(content, 1024).alias("track_id")
    )


@query("h1_fingerprint_files", _FINGERPRINT_SQL)
def h1_files(spark, sf_dir):
    """The same ids from files, of which only the ends are read."""
    name = F.format_string("%d/%d.flac", F.col("doc_id") % 10, F.col("doc_id"))
    root = scratch_path(spark, "files")
    remote.write_files(spread(table(spark, sf_dir, "documents")).select(name.alias("path"), F.encode("text", "utf-8").alias("content")), root)
    found = remote.fingerprint_files(files_source.scan_files(spark, root), head_tail=1024, algorithm="sha256")
    return found.select(F.regexp_extract("path", r"([0-9]+)\.flac$", 1).cast("long").alias("doc_id"), "track_id")


@query(
    "h2_manifest_digest",
    f"""WITH {X.STORE_SQL}, r AS (SELECT vec_id, sha256(path) AS d, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM store),
    b AS (SELECT o // 4096 AS bucket, sha256(string_agg(d, chr(10) ORDER BY o)) AS d FROM r GROUP BY 1),
    t AS (SELECT bucket // 4096 AS top, sha256(string_agg(d, chr(10) ORDER BY bucket)) AS d FROM b GROUP BY 1)
    SELECT substr(sha256('24000' || chr(10) || string_agg(d, chr(10) ORDER BY top)), 1, 16) AS digest FROM t""",
)
def h2(spark, sf_dir):
    placed = global_positions(X.store(spark, sf_dir).select("vec_id", "path"), "vec_id", "o", 16)
    return H.manifest_digest(placed, "o")


@query(
    "h3_resolution_cache_key",
    f"""WITH {X.TITLES_SQL}, z AS (SELECT seq, title, CASE WHEN p_size > 25 THEN CAST(p_size AS DOUBLE) END AS lo FROM titles)
    SELECT seq, substr(sha256(encode(title) || unhex('00') || encode('10') || unhex('00') || encode(coalesce(CAST(lo AS VARCHAR), 'None')) || unhex('00') || encode('600.0')), 1, 16) AS cache_key FROM z""",
)
def h3(spark, sf_dir):
    low = F.when(F.col("p_size") > 25, F.col("p_size").cast("double"))
    return X.titles(spark, sf_dir).select(
        "seq",
        H.resolution_cache_key(F.col("title"), F.lit(10), low, F.lit(600.0)).alias("cache_key"),
    )


@query(
    "h4_h5_h6_paths",
    f"""WITH {X.STORE_SQL}, p AS (SELECT vec_id, path, CASE WHEN label = 0 THEN replace(path, '.mp3', '7.mp3') ELSE path END AS odd FROM store)
    SELECT vec_id, coalesce(CAST(nullif(regexp_extract(odd, '(?:^|/)([0-9]{{6}})(?:[.][^./]*)?$', 1), '') AS INTEGER), -1) AS parsed,
    '/root/' || lpad(CAST(vec_id // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.mp3' AS made,
    CASE WHEN starts_with(path, '/lib/000/') THEN substr(path, 10) END AS relative FROM p""",
)
def h4(spark, sf_dir):
    odd = F.when(F.col("label") == 0, F.replace("path", F.lit(".mp3"), F.lit("7.mp3"))).otherwise(F.col("path"))
    return X.store(spark, sf_dir).select(
        "vec_id",
        F.coalesce(H.path_to_id(odd), F.lit(-1)).alias("parsed"),
        H.id_to_path("/root/", F.col("vec_id")).alias("made"),
        H.relative_path(F.col("path"), "/lib/000").alias("relative"),
    )


# ---------------------------------------------------------------- joins, splits, manifests


@query(
    "j1_align_labels",
    f"""WITH {X.STORE_SQL}, {X.LABELS_SQL} SELECT track_id, CAST(vec_id AS INTEGER) AS fma_track_id, genre_top FROM store JOIN labels_dim ON vec_id = labels_dim.fma_track_id
    WHERE subset IN ('small', 'medium') AND genre_top IS NOT NULL""",
)
def j1(spark, sf_dir):
    labels = L.drop_null_label(L.filter_subset(X.labels_dim(spark, sf_dir), "Medium"))
    return L.align_labels(X.store(spark, sf_dir), labels).select("track_id", "fma_track_id", "genre_top")


_ANNOTATED_SQL = "annotated AS (SELECT '000/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.mp3' AS mp3_path, CASE WHEN label > 4 THEN 1 WHEN label > 2 THEN 0 END AS loud, CAST(label % 2 AS INTEGER) AS slow FROM embeddings WHERE label > 1)"


def _annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("000/"), F.lpad(F.col("vec_id").cast("string"), 6, "0"), F.lit(".mp3"))
    label = F.col("label")
    return table(spark, sf_dir, "embeddings").where("label > 1").select(
        name.alias("mp3_path"), F.when(label > 4, 1).when(label > 2, 0).alias("loud"), (label % 2).cast("int").alias("slow")
    )


@query(
    "j2_align_tags",
    f"""WITH {X.STORE_SQL}, {_ANNOTATED_SQL} SELECT track_id, substr(path, 6) AS mp3_path FROM store
    WHERE substr(path, 6) IN (SELECT mp3_path FROM annotated)""",
)
def j2(spark, sf_dir):
    return L.align_tags(X.store(spark, sf_dir), _annotated(spark, sf_dir), "/lib").select("track_id", "mp3_path")


@query(
    "j3_tag_matrix",
    f"""WITH {X.STORE_SQL}, {_ANNOTATED_SQL} SELECT s.vec_id, substr(path, 6) AS mp3_path, coalesce(loud, 0) AS loud, coalesce(slow, 0) AS slow
    FROM store s LEFT JOIN annotated a ON a.mp3_path = substr(path, 6)""",
)
def j3(spark, sf_dir):
    paths = X.store(spark, sf_dir).select("vec_id", H.relative_path(F.col("path"), "/lib").alias("mp3_path"))
    return L.tag_matrix_for(paths, _annotated(spark, sf_dir), ["loud", "slow"])


@query(
    "j4_j5_subset_levels",
    f"""WITH {X.LABELS_SQL} SELECT level, count(*) AS n FROM labels_dim JOIN
    (VALUES ('small', 'small'), ('medium', 'small'), ('medium', 'medium'), ('large', 'small'), ('large', 'medium'), ('large', 'large')) v(level, subset) USING (subset)
    WHERE genre_top IS NOT NULL GROUP BY level""",
)
def j4(spark, sf_dir):
    out = None
    for level in fixed.SUBSET_LEVELS:
        kept = L.drop_null_label(L.filter_subset(X.labels_dim(spark, sf_dir), level))
        part = kept.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "j6_load_manifest",
    f"""WITH {X.LABELS_SQL} SELECT fma_track_id, subset, split, genre_top, artist_id, CAST(NULL AS VARCHAR) AS artist_name,
    '/fma/' || lpad(CAST(fma_track_id // 1000 AS VARCHAR), 3, '0') || '/' || lpad(CAST(fma_track_id AS VARCHAR), 6, '0') || '.mp3' AS path
    FROM labels_dim WHERE subset IN ('small', 'medium') AND genre_top IS NOT NULL AND fma_track_id * 400 >= 50000""",
)
def j6(spark, sf_dir):
    tracks = X.labels_dim(spark, sf_dir)
    listing = tracks.select(
        H.id_to_path("/fma", F.col("fma_track_id")).alias("path"), (F.col("fma_track_id") * 400).alias("length")
    )
    return L.load_manifest(tracks, "/fma", "medium", listing)


@query("j7_split_or_fallback", f"WITH {X.LABELS_SQL} SELECT fma_track_id, split FROM labels_dim WHERE split = 'validation'")
def j7(spark, sf_dir):
    return L.split_or_fallback(X.labels_dim(spark, sf_dir), "validation", "fma_track_id").select("fma_track_id", "split")


_TAIL_SQL = "(SELECT *, row_number() OVER (ORDER BY fma_track_id) - 1 AS o, count(*) OVER () AS n FROM labels_dim)"
_FIRST = "(n - greatest(1, round_even(0.1 * n, 0)))"


@query("j7_split_fallback_tail", f"WITH {X.LABELS_SQL} SELECT fma_track_id, split FROM {_TAIL_SQL} WHERE o >= {_FIRST}")
def j7_tail(spark, sf_dir):
    """No row has the split: the last tenth stands in."""
    return L.split_or_fallback(X.labels_dim(spark, sf_dir), "holdout", "fma_track_id").select("fma_track_id", "split")


@query(
    "j8_prepare_splits",
    f"""WITH {X.LABELS_SQL}, u AS (SELECT * FROM {_TAIL_SQL})
    SELECT fma_track_id, CASE WHEN o >= {_FIRST} THEN 'validation' ELSE 'training' END AS part FROM u""",
)
def j8(spark, sf_dir):
    everything = X.labels_dim(spark, sf_dir).withColumn("split", F.lit("training"))
    train, validation = L.prepare_splits(everything, "fma_track_id")
    return train.select("fma_track_id", F.lit("training").alias("part")).unionByName(
        validation.select("fma_track_id", F.lit("validation").alias("part"))
    )


@query("j9_limit_rows", f"WITH {X.LABELS_SQL} SELECT fma_track_id, split FROM labels_dim ORDER BY split, fma_track_id DESC LIMIT 60")
def j9(spark, sf_dir):
    return L.limit_rows(X.labels_dim(spark, sf_dir), 60, F.col("split"), F.desc("fma_track_id")).select("fma_track_id", "split")


@query(
    "j10_counts",
    f"""WITH {X.LABELS_SQL} SELECT 'split' AS what, split AS value, count(*) AS n FROM labels_dim GROUP BY split
    UNION ALL SELECT 'genre', genre_top, count(*) FROM labels_dim GROUP BY genre_top
    UNION ALL SELECT 'tracks', NULL, count(DISTINCT fma_track_id) FROM labels_dim""",
)
def j10(spark, sf_dir):
    df = X.labels_dim(spark, sf_dir)
    splits = L.value_counts(df, "split").select(F.lit("split").alias("what"), F.col("split").alias("value"), "n")
    genres = L.value_counts(df, "genre_top").select(F.lit("genre").alias("what"), F.col("genre_top").alias("value"), "n")
    tracks = L.distinct_count(df, "fma_track_id").select(
        F.lit("tracks").alias("what"), F.lit(None).cast("string").alias("value"), F.col("n_distinct").alias("n")
    )
    return splits.unionByName(genres).unionByName(tracks)


@query(
    "j12_valid_clips",
    f"WITH {X.SIGNAL_SQL} SELECT doc_id, CAST(len(s) AS INTEGER) AS n FROM signals WHERE len(s) >= 20 AND len(s) >= 75",
)
def j12(spark, sf_dir):
    kept = L.valid_clips(X.signals(spark, sf_dir), "s", 151, min_samples=20)
    return kept.select("doc_id", F.size("s").alias("n"))


# ---------------------------------------------------------------- windows

_WINDOWS_SQL = """cuts AS (SELECT doc_id, lang, source, s, unnest(range(CASE WHEN len(s) <= 16 THEN 1 ELSE 1 + CAST(ceil((len(s) - 16) / 8) AS BIGINT) END)) AS w FROM signals),
  windows AS (SELECT doc_id, lang, source, w, list_transform(range(16), lambda i: coalesce(s[w * 8 + i + 1], 0.0)) AS x FROM cuts)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = W.sliding_windows(F.col("s"), 16, 8)
    return X.signals(spark, sf_dir).select("doc_id", "lang", "source", F.posexplode(cut).alias("w", "x"))


@query(
    "w1_sliding_windows",
    f"""WITH {X.SIGNAL_SQL}, {_WINDOWS_SQL} SELECT doc_id, CAST(w AS INTEGER) AS w, CAST(len(x) AS INTEGER) AS n,
    {sql_r6('list_sum(x)')} AS total, {sql_r6('x[1]')} AS head, {sql_r6('x[16]')} AS tail FROM windows""",
)
def w1(spark, sf_dir):
    x = F.col("x")
    return _windows(spark, sf_dir).select(
        "doc_id", "w", F.size(x).alias("n"), r6(V.total(V.doubles(x))).alias("total"),
        r6(F.get(x, F.lit(0))).alias("head"), r6(F.get(x, F.lit(15))).alias("tail"),
    )


@query(
    "w1_event_windows",
    f"""WITH p AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('day', ts), ts, event_id) - 1 AS pos,
      count(*) OVER (PARTITION BY user_id) AS n FROM events),
    w AS (SELECT user_id, value, unnest(range(CAST(greatest(ceil((pos - 15) / 8), 0) AS BIGINT),
      CAST(least(floor(pos / 8), CASE WHEN n <= 16 THEN 0 ELSE ceil((n - 16) / 8) END) AS BIGINT) + 1)) AS w FROM p)
    SELECT user_id, CAST(w AS INTEGER) AS w, count(*) AS n, {sql_r6('sum(value)')} AS total FROM w GROUP BY user_id, w""",
)
def w1_events(spark, sf_dir):
    """The long form: a user's events are the sequence; a busy user is cut into ranges, ranges into pieces that overlap."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    placed = sequence_positions(events, ["user_id"], "at", ["event_id"], "pos", "n")
    sums = W.long_windows(placed, ["user_id"], 16, 8, {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return sums.withColumn("total", r6(F.col("total")))


def _starts_sql(count: int) -> str:
    spread = (
        "[(len(s) - 16) // 2]" if count == 1 else
        f"list_transform(range({count}), lambda i: CASE WHEN i = {count - 1} THEN len(s) - 16 ELSE CAST(floor(i * (CAST(len(s) - 16 AS DOUBLE) / {count - 1})) AS BIGINT) END)"
    )
    return f"CASE WHEN len(s) <= 16 THEN list_transform(range({count}), lambda i: 0) ELSE {spread} END"


@query(
    "w2_plan_windows",
    f"WITH {X.SIGNAL_SQL} "
    + " UNION ALL ".join(
        f"SELECT doc_id, {c} AS planned, CAST(p - 1 AS INTEGER) AS window_index, CAST(start AS BIGINT) AS start_sample FROM "
        f"(SELECT doc_id, unnest({_starts_sql(c)}) AS start, generate_subscripts({_starts_sql(c)}, 1) AS p FROM signals)"
        for c in (1, 3, 5)
    ),
)
def w2(spark, sf_dir):
    out = None
    for count in (1, 3, 5):
        starts = W.plan_windows(F.size("s"), count, 16)
        part = X.signals(spark, sf_dir).select(
            "doc_id", F.lit(count).alias("planned"), F.posexplode(starts).alias("window_index", "start_sample")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "w3_expand_windows",
    f"""WITH {X.LABELS_SQL}, m AS (SELECT *, CASE WHEN fma_track_id % 29 <> 0 THEN CAST(round_even((fma_track_id * 997 + 40000) / 44100.0 * 24000, 0) AS BIGINT) END AS n FROM labels_dim WHERE genre_top IS NOT NULL),
    e AS (SELECT *, unnest(CASE WHEN n IS NULL THEN [NULL] WHEN n <= 120000 THEN [0, 0, 0] ELSE [0, CAST(floor((n - 120000) / 2.0) AS BIGINT), n - 120000] END) AS start,
          generate_subscripts(CASE WHEN n IS NULL THEN [NULL] WHEN n <= 120000 THEN [0, 0, 0] ELSE [0, 1, 2] END, 1) AS p FROM m)
    SELECT fma_track_id, genre_top, split, CASE WHEN n IS NULL THEN 'failed' ELSE 'ok' END AS status,
    CASE WHEN n IS NOT NULL THEN CAST(p - 1 AS INTEGER) ELSE -1 END AS window_index, coalesce(CAST(start AS BIGINT), -1) AS start_sample,
    CASE WHEN n IS NOT NULL THEN CAST(120000 AS BIGINT) ELSE -1 END AS duration_samples, {sql_r6('start / 24000.0')} AS start_seconds,
    CASE WHEN n IS NOT NULL THEN CAST(5.0 AS DOUBLE) END AS duration_seconds FROM e""",
)
def w3(spark, sf_dir):
    t = F.col("fma_track_id")
    frames = F.when(t % 29 != 0, t * 997 + 40000)
    manifest = L.drop_null_label(X.labels_dim(spark, sf_dir)).withColumn("frames", frames)
    manifest = manifest.withColumn("rate", F.lit(44100))
    got = L.expand_windows(manifest, 3)
    return got.select(
        "fma_track_id", "genre_top", "split", "status",
        *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("window_index", "start_sample", "duration_samples")],
        r6(F.col("start_seconds")).alias("start_seconds"), "duration_seconds",
    )


@query(
    "w4_w5_sample_counts",
    f"""SELECT vec_id, CAST(round_even((vec_id * 997 + 40000) / 44100.0 * 24000, 0) AS BIGINT) AS n_samples,
    CAST(round_even((vec_id * 31) * (24000.0 / 48000), 0) AS BIGINT) AS moved FROM embeddings""",
)
def w4(spark, sf_dir):
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        W.estimate_samples(v * 997 + 40000, F.lit(44100)).alias("n_samples"),
        W.rescale_offset(v * 31, 48_000, 24_000).alias("moved"),
    )


def _crop_sql(key: str, seed: str, n: int, signal: str = "s") -> str:
    start = f"CAST(floor({sql_uniform(key, seed)} * (greatest(len({signal}) - {n}, 0) + 1)) AS BIGINT)"
    return f"list_transform(range({n}), lambda i: coalesce({signal}[{start} + i + 1], 0.0))"


@query(
    "w6_random_crop",
    f"""WITH {X.SIGNAL_SQL}, c AS (SELECT doc_id, {_crop_sql('doc_id', 'w6', 12)} AS x FROM signals)
    SELECT doc_id, CAST(len(x) AS INTEGER) AS n, {sql_r6('list_sum(x)')} AS total, {sql_r6('x[1]')} AS head FROM c""",
)
def w6(spark, sf_dir):
    crop = W.random_crop(F.col("s"), 12, F.col("doc_id"), "w6")
    x = F.col("x")
    return X.signals(spark, sf_dir).select("doc_id", crop.alias("x")).select(
        "doc_id", F.size(x).alias("n"), r6(V.total(V.doubles(x))).alias("total"), r6(F.get(x, F.lit(0))).alias("head")
    )


_MODEL_SQL = "list_transform(range(4), lambda j: list_sum(list_transform(range(16), lambda i: x[i + 1] * cos(1.0 + 7.0 * i + 13.0 * j))))"


@query(
    "w7_batched_inference",
    f"""WITH {X.SIGNAL_SQL}, {_WINDOWS_SQL}, o AS (SELECT doc_id, w, {_MODEL_SQL} AS e FROM windows)
    SELECT doc_id, CAST(w AS INTEGER) AS w, 'ok' AS status, (round(e[1] / 10, 3) + 0.0) AS e0, (round(e[4] / 10, 3) + 0.0) AS e3 FROM o""",
)
def w7(spark, sf_dir):
    got = inference.batched_inference(_windows(spark, sf_dir), inference.projection_model(16, 4), 16, column="x", precise=True)
    e = F.col("embedding").cast("array<double>")
    return got.select(
        "doc_id", "w", "status", (F.round(F.get(e, F.lit(0)) / 10, 3) + 0.0).alias("e0"),
        (F.round(F.get(e, F.lit(3)) / 10, 3) + 0.0).alias("e3"),
    )


@query(
    "j11_windows_to_tracks",
    f"""WITH {X.SIGNAL_SQL}, {_WINDOWS_SQL}, o AS (SELECT doc_id, lang, w, {_MODEL_SQL} AS e FROM windows),
    u AS (SELECT doc_id, lang, w, list_transform(e, lambda y: y / greatest(sqrt(list_inner_product(e, e)), 1e-12)) AS e FROM o),
    m AS (SELECT doc_id, [avg(e[1]), avg(e[2]), avg(e[3]), avg(e[4])] AS m, arg_min(lang, w) AS genre, count(*) AS n FROM u GROUP BY doc_id)
    SELECT 'fma-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') AS track_id, 'p' || doc_id AS path, genre, n AS n_windows,
    (round(m[1] / greatest(sqrt(list_inner_product(m, m)), 1e-12), 3) + 0.0) AS e0 FROM m""",
)
def j11(spark, sf_dir):
    windows = _windows(spark, sf_dir).select(
        F.col("doc_id").alias("fma_track_id"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
        F.col("lang").alias("genre_top"),
        F.col("w").alias("window_index"),
        F.col("x").alias("window"),
    )
    got = inference.embed_tracks(windows, inference.projection_model(16, 4), 16, precise=True)
    return got.select(
        "track_id", "path", "genre", "n_windows",
        (F.round(F.get(F.col("embedding"), F.lit(0)), 3) + 0.0).alias("e0"),
    )


@query("w8_log_mel")
def w8(spark, sf_dir):
    """Word lengths taken as a waveform of 4800 samples: 96 bands, 11 frames."""
    mel = X.signals(spark, sf_dir).select("doc_id", inference.log_mel(F.col("s"), 4800).alias("m"))
    flat = F.flatten("m")
    return mel.select(
        "doc_id",
        F.size("m").alias("bands"),
        F.size(F.get("m", F.lit(0))).alias("frames"),
        F.round(F.array_min(flat), 3).alias("lowest"),
        F.round(F.array_max(flat), 3).alias("highest"),
    )


# ---------------------------------------------------------------- pair sampling


@query(
    "p1_artist_pool_size",
    f"WITH {X.STORE_SQL} SELECT CAST(coalesce(sum(m), 0) AS BIGINT) AS pool_size FROM (SELECT count(*) AS m FROM store WHERE artist IS NOT NULL GROUP BY artist HAVING count(*) > 1)",
)
def p1(spark, sf_dir):
    return sampling.artist_pool_size(X.store(spark, sf_dir))


def _pairs_sql(rows: str, prob: float, seed: str) -> str:
    return f"""numbered AS (SELECT id, artist, row_number() OVER (PARTITION BY artist ORDER BY {sql_salt('id')}, id) - 1 AS r,
      count(*) OVER (PARTITION BY artist) AS m FROM {rows} WHERE artist IS NOT NULL),
    asked AS (SELECT id, artist, (r + 1 + CAST(floor({sql_uniform('id', seed + ':offset')} * (m - 1)) AS BIGINT)) % m AS r
      FROM numbered WHERE {sql_uniform('id', seed + ':mate')} < {prob} AND m > 1),
    found AS (SELECT a.id, n.id AS partner_id FROM asked a JOIN numbered n USING (artist, r)),
    pairs AS (SELECT b.id, coalesce(partner_id, b.id) AS partner_id, partner_id IS NOT NULL AS is_mate FROM {rows} b LEFT JOIN found USING (id))"""


@query(
    "p2_positive_pairs",
    f"WITH {X.STORE_SQL}, base AS (SELECT vec_id AS id, artist FROM store), {_pairs_sql('base', 0.6, 's/3/0')} SELECT * FROM pairs",
)
def p2(spark, sf_dir):
    """Epoch 3 of a run."""
    return sampling.positive_pairs(X.store(spark, sf_dir), 0.6, sampling.draw_seed("s", 3), id_col="vec_id")


@query(
    "p2_event_pairs",
    f"""WITH base AS (SELECT event_id AS id, event_type AS artist FROM events), {_pairs_sql('base', 0.9, 'e')}
    SELECT * FROM pairs""",
)
def p2_events(spark, sf_dir):
    """Five groups hold all events: the hot-group case."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("artist"))
    return sampling.positive_pairs(events, 0.9, "e", id_col="event_id")


@query(
    "p3_two_view_rows",
    f"""WITH {X.SIGNAL_SQL}, base AS (SELECT doc_id AS id, source AS artist FROM signals), {_pairs_sql('base', 0.5, 'v')},
    v AS (SELECT p.id, p.partner_id, a.lang, {_crop_sql('p.id', 'v:view1', 12, 'a.s')} AS x, {_crop_sql('p.id', 'v:view2', 12, 'b.s')} AS y
      FROM pairs p JOIN signals a ON a.doc_id = p.id JOIN signals b ON b.doc_id = p.partner_id)
    SELECT id, partner_id, lang AS label, {sql_r6('list_sum(x)')} AS view1, {sql_r6('list_sum(y)')} AS view2 FROM v""",
)
def p3(spark, sf_dir):
    clips = X.signals(spark, sf_dir)
    pairs = sampling.positive_pairs(clips, 0.5, "v", id_col="doc_id", artist="source")
    views = sampling.two_view_rows(clips, pairs, 12, "v", id_col="doc_id", clip="s", label="lang")
    total = lambda c: r6(V.total(V.doubles(F.col(c)))).alias(c)
    return views.select("id", "partner_id", "label", total("view1"), total("view2"))


@query(
    "p4_reseed",
    f"""WITH {X.STORE_SQL}, base AS (SELECT vec_id AS id, artist FROM store), a AS (WITH {_pairs_sql('base', 0.6, 's/3/0')} SELECT * FROM pairs),
    b AS (WITH {_pairs_sql('base', 0.6, 's/3/1')} SELECT * FROM pairs)
    SELECT count(*) AS n_rows, count(*) FILTER (a.partner_id <> b.partner_id) AS n_changed FROM a JOIN b USING (id)""",
)
def p4(spark, sf_dir):
    """Two workers of one epoch draw apart."""
    store = X.store(spark, sf_dir)
    draws = [
        sampling.positive_pairs(store, 0.6, sampling.draw_seed("s", 3, worker), id_col="vec_id")
        for worker in (0, 1)
    ]
    both = draws[0].join(draws[1].select("id", F.col("partner_id").alias("other")), "id")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("partner_id") != F.col("other")).alias("n_changed")
    )


@query(
    "p5_epoch_batches",
    f"""WITH o AS (SELECT event_id, row_number() OVER (ORDER BY {sql_salt('event_id', 4096, 's/1/0:order')}, md5(event_id || ':s/1/0:order'), event_id) - 1 AS place,
      count(*) OVER () AS n FROM events)
    SELECT event_id, place, place // 96 AS batch_id FROM o WHERE place // 96 < n // 96""",
)
def p5(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return sampling.epoch_batches(events, 96, sampling.draw_seed("s", 1), id_col="event_id")


@query(
    "p6_sample_views",
    f"""WITH {X.SIGNAL_SQL}, o AS (SELECT doc_id, s, md5(doc_id || ':p6:files') AS o,
      CASE WHEN len(s) < 12 THEN 0 ELSE CAST(floor({sql_uniform('doc_id', 'p6:crop')} * (greatest(greatest(len(s) - 1, 12) - 12, 0) + 1)) AS BIGINT) END AS start FROM signals)
    SELECT doc_id AS id, 0 AS part, CAST(start AS INTEGER) AS start, {sql_r6('list_sum(list_transform(range(12), lambda i: coalesce(s[start + i + 1], 0.0)))')} AS total
    FROM o ORDER BY o, doc_id LIMIT 100""",
)
def p6(spark, sf_dir):
    got = sampling.sample_views(X.signals(spark, sf_dir), 100, 12, 6, "p6", id_col="doc_id", clip="s")
    return got.select("id", "part", "start", r6(V.total(V.doubles(F.col("window")))).alias("total"))


# ---------------------------------------------------------------- reports


_LATENCY_SQL = (
    "SELECT event_type, "
    + ", ".join(f"{sql_r6(f'quantile_cont(value, {q})')} AS {name}" for name, q in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95)))
    + f", {sql_r6('min(value)')} AS min, {sql_r6('avg(value)')} AS mean FROM events GROUP BY event_type"
)


@query("r1_latency_summary", _LATENCY_SQL)
def r1(spark, sf_dir, **kwargs):
    got = reports.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"], **kwargs)
    return got.select("event_type", *[r6(F.col(c)).alias(c) for c in ("p50", "p90", "p95", "min", "mean")])


@query("r1_latency_summary_spread", _LATENCY_SQL)
def r1_spread(spark, sf_dir):
    """One report over all event types in the same table: every group is a part of one plan."""
    return r1(spark, sf_dir)


_EPOCHS_SQL = "epochs AS (SELECT event_type, CAST(dayofyear(ts) AS INTEGER) AS epoch, avg(value) AS mean FROM events GROUP BY ALL)"


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("epoch", F.dayofyear("ts"))
    return reports.epoch_means(events, "epoch", "value", ["event_type"])


@query("r2_epoch_means", f"WITH {_EPOCHS_SQL} SELECT event_type, epoch, {sql_r6('mean')} AS mean FROM epochs")
def r2(spark, sf_dir):
    return _epochs(spark, sf_dir).select("event_type", "epoch", r6(F.col("mean")).alias("mean"))


@query(
    "m14_best_checkpoint",
    f"""WITH {_EPOCHS_SQL} SELECT event_type, epoch AS best_epoch, {sql_r6('mean')} AS best_metric FROM epochs
    WHERE mean > -1 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY mean DESC, epoch) = 1""",
)
def m14(spark, sf_dir):
    got = reports.best_checkpoint(_epochs(spark, sf_dir), "event_type", "epoch", "mean")
    return got.withColumn("best_metric", r6(F.col("best_metric")))


@query(
    "m14_running_best",
    f"""WITH {_EPOCHS_SQL}, p AS (SELECT *, greatest(coalesce(max(mean) OVER (PARTITION BY event_type ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), -1.0) AS prior FROM epochs)
    SELECT event_type, epoch, {sql_r6('mean')} AS mean, {sql_r6('greatest(prior, mean)')} AS best_so_far, mean > prior AS improved FROM p""",
)
def m14_running(spark, sf_dir):
    got = reports.running_best(_epochs(spark, sf_dir), "event_type", "epoch", "mean")
    return got.withColumn("mean", r6(F.col("mean"))).withColumn("best_so_far", r6(F.col("best_so_far")))


def _nested_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(True).alias("flag"),
        F.lit("events").alias("name"),
        F.struct(
            F.struct(F.min("value").alias("min"), F.max("value").alias("max")).alias("range"),
            F.avg("value").alias("mean"),
            F.lit(None).cast("double").alias("missing"),
        ).alias("value"),
    )


_FLAT_SQL = f"""flat AS (SELECT unnest(['n', 'value/range/min', 'value/range/max', 'value/mean']) AS metric,
    unnest([CAST(count(*) AS DOUBLE), min(value), max(value), avg(value)]) AS value FROM events)"""


@query("r4_flatten_report", f"WITH {_FLAT_SQL} SELECT metric, {sql_r6('value')} AS value FROM flat")
def r4(spark, sf_dir):
    got = reports.flatten_report(_nested_report(spark, sf_dir))
    return got.withColumn("value", r6(F.col("value")))


@query(
    "r3_quality_gates",
    f"""WITH {_FLAT_SQL}, gates AS (SELECT * FROM (VALUES ('n', '>=', 500.0), ('value/mean', '<=', 1.0), ('value/range/max', '>=', 0.5)) g(metric, op, threshold))
    SELECT metric, {sql_r6('value')} AS value, op, CAST(threshold AS DOUBLE) AS threshold,
    CASE WHEN (op = '>=' AND value >= threshold) OR (op = '<=' AND value <= threshold) THEN 'pass' ELSE 'warn' END AS status FROM flat JOIN gates USING (metric)""",
)
def r3(spark, sf_dir):
    gates = [("n", ">=", 500.0), ("value/mean", "<=", 1.0), ("value/range/max", ">=", 0.5)]
    got = reports.quality_gates(reports.flatten_report(_nested_report(spark, sf_dir)), gates)
    return got.withColumn("value", r6(F.col("value")))


@query(
    "r5_size_report",
    f"""WITH {_LISTING_SQL} SELECT lower(regexp_extract(path, '[.]([^.]+)$', 1)) AS suffix, count(*) AS n_files,
    (round(sum(length) / 1e6, 2) + 0.0) AS megabytes FROM listing GROUP BY 1""",
)
def r5(spark, sf_dir):
    suffix = F.lower(F.regexp_extract("path", r"[.]([^.]+)$", 1))
    return reports.size_report(_listing(spark, sf_dir).withColumn("suffix", suffix), keys=["suffix"])
