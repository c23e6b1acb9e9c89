"""Tables derived from the given ones, in Spark and in SQL. Both texts define the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.plans.registry import table
from vecloom.session import spread

# ---- an embedding store with tags

STORE_SQL = """store AS (
  SELECT lpad(CAST(vec_id AS VARCHAR), 6, '0') AS track_id,
         '/lib/' || lpad(CAST(vec_id // 1000 AS VARCHAR), 3, '0') || '/'
                 || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.mp3' AS path,
         't' || vec_id AS title,
         CASE WHEN vec_id % 13 <> 0 THEN 'r' || (vec_id % 90) END AS artist,
         'a' || (vec_id % 60) AS album,
         'g' || label AS genre,
         CAST(1990 + vec_id % 30 AS INTEGER) AS year,
         'v' || (vec_id % 2) AS model_version,
         CAST(len(embedding) AS INTEGER) AS embedding_dim,
         embedding, vec_id, label
  FROM embeddings)"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_of(table(spark, sf_dir, "embeddings"))


def store_of(embeddings: DataFrame) -> DataFrame:
    v = F.col("vec_id")
    track_id = F.lpad(v.cast("string"), 6, "0")
    folder = F.lpad(F.floor(v / 1000).cast("string"), 3, "0")
    return embeddings.select(
        track_id.alias("track_id"),
        F.concat(F.lit("/lib/"), folder, F.lit("/"), track_id, F.lit(".mp3")).alias("path"),
        F.concat(F.lit("t"), v).alias("title"),
        F.when(v % 13 != 0, F.concat(F.lit("r"), v % 90)).alias("artist"),
        F.concat(F.lit("a"), v % 60).alias("album"),
        F.concat(F.lit("g"), "label").alias("genre"),
        (1990 + v % 30).cast("int").alias("year"),
        F.concat(F.lit("v"), v % 2).alias("model_version"),
        F.size("embedding").alias("embedding_dim"),
        "embedding",
        "vec_id",
        "label",
    )


# ---- a label dimension: one id has several splits and subsets, some labels are missing

LABELS_SQL = """labels_dim AS (
  SELECT vec_id AS fma_track_id,
         CASE WHEN vec_id % 17 <> 0 THEN 'g' || label END AS genre_top,
         CASE vec_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS subset,
         CASE WHEN vec_id % 10 <= 7 THEN 'training' WHEN vec_id % 10 = 8 THEN 'validation'
              ELSE 'test' END AS split,
         CASE WHEN vec_id % 13 <> 0 THEN 'r' || (vec_id % 90) END AS artist_id
  FROM embeddings)"""


def labels_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        v.alias("fma_track_id"),
        F.when(v % 17 != 0, F.concat(F.lit("g"), "label")).alias("genre_top"),
        F.when(v % 3 == 0, "small").when(v % 3 == 1, "medium").otherwise("large").alias("subset"),
        F.when(v % 10 <= 7, "training").when(v % 10 == 8, "validation").otherwise("test").alias("split"),
        F.when(v % 13 != 0, F.concat(F.lit("r"), v % 90)).alias("artist_id"),
    )


# ---- tag sets, empty for some rows

TAGS_SQL = """tags AS (
  SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN CAST([] AS VARCHAR[])
         ELSE list_distinct(['t' || label, 't' || (vec_id % 5), 't' || (vec_id % 7)]) END AS tags
  FROM embeddings)"""


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    some = F.array_distinct(
        F.array(F.concat(F.lit("t"), "label"), F.concat(F.lit("t"), v % 5), F.concat(F.lit("t"), v % 7))
    )
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.when(v % 11 == 0, none).otherwise(some).alias("tags")
    )


# ---- a second view of every vector: its first 48 dimensions, normalized

VIEW_SQL = """cut AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a, CAST(embedding[1:48] AS DOUBLE[]) AS c
  FROM embeddings),
views AS (
  SELECT vec_id, label, a,
         list_transform(c, lambda x: x / greatest(sqrt(list_inner_product(c, c)), 1e-12)) AS b48,
         list_concat(list_transform(c, lambda x: x / greatest(sqrt(list_inner_product(c, c)), 1e-12)),
                     list_transform(range(16), lambda i: 0.0::DOUBLE)) AS b
  FROM cut)"""


def view_b(spark: SparkSession, sf_dir: str, pad: bool = True) -> DataFrame:
    cut = V.l2_normalize(F.slice("embedding", 1, 48))
    if pad:
        cut = F.concat(cut, F.array_repeat(F.lit(0.0), 16))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", cut.alias("embedding"))


# ---- one ragged signal per document: the lengths of its words

SIGNAL_SQL = """signals AS (
  SELECT doc_id, lang, source, list_transform(string_split(text, ' '), lambda t: CAST(length(t) AS DOUBLE)) AS s
  FROM documents)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.transform(F.split("text", " "), lambda t: F.length(t).cast("float"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", s.alias("s"))


# ---- collected titles and URLs: ids and titles both repeat

TITLES_SQL = """titles AS (
  SELECT p_partkey AS seq,
         CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (Official Video)'
              WHEN 2 THEN p_name || ' [Lyrics]' WHEN 3 THEN p_brand || ' - ' || p_name || ' ft. X'
              WHEN 4 THEN p_name || ' | Channel'
              ELSE split_part(p_name, ' ', 2) || ' - ' || split_part(p_name, ' ', 1) END AS title,
         'https://x.example/watch?v=' || lpad(CAST(p_partkey % 1500 AS VARCHAR), 11, '0') AS url,
         p_name, p_brand, p_type, p_size, p_retailprice
  FROM part)"""


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    words = F.split("p_name", " ")
    title = (
        F.when(k % 6 == 0, F.col("p_name"))
        .when(k % 6 == 1, F.concat("p_name", F.lit(" (Official Video)")))
        .when(k % 6 == 2, F.concat("p_name", F.lit(" [Lyrics]")))
        .when(k % 6 == 3, F.concat("p_brand", F.lit(" - "), "p_name", F.lit(" ft. X")))
        .when(k % 6 == 4, F.concat("p_name", F.lit(" | Channel")))
        .otherwise(F.concat(words[1], F.lit(" - "), words[0]))
    )
    video = F.lpad((k % 1500).cast("string"), 11, "0")
    return table(spark, sf_dir, "part").select(
        k.alias("seq"),
        title.alias("title"),
        F.concat(F.lit("https://x.example/watch?v="), video).alias("url"),
        "p_name",
        "p_brand",
        "p_type",
        "p_size",
        "p_retailprice",
    )
