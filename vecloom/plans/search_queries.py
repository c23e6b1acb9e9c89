"""Vector algebra, search and retrieval metrics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.functions.hashing import relative_path
from vecloom.operators import cell_index, compare, knn, metrics
from vecloom.operators import labels as L
from vecloom.operators.evaluation import eval_report
from vecloom.plans import fixtures as X
from vecloom.plans.registry import query, r6, sql_r6, sql_uniform, table
from vecloom.session import materialize, scratch_path


def _long(df: DataFrame, column, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(column).alias("pos", "x")).select(
        *keys, "pos", r6(F.col("x")).alias("x")
    )


def _long_sql(source: str, vector: str, key: str = "vec_id") -> str:
    return f"""SELECT {key}, CAST(pos - 1 AS INTEGER) AS pos, {sql_r6('x')} AS x FROM (
      SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS pos
      FROM (SELECT {key}, {vector} AS v FROM {source}))"""


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


# ---------------------------------------------------------------- vector algebra

_SCALED = "(SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + label)) AS s FROM embeddings)"


def _scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    scale = 1 + F.col("label")
    s = F.transform(V.doubles(F.col("embedding")), lambda x: x * scale)
    return _embeddings(spark, sf_dir).select("vec_id", "label", s.alias("s"))


@query(
    "v1_l2_normalize",
    _long_sql(_SCALED, "list_transform(s, lambda x: x / greatest(sqrt(list_inner_product(s, s)), 1e-12))"),
)
def v1(spark, sf_dir):
    return _long(_scaled(spark, sf_dir), V.l2_normalize(F.col("s")), "vec_id")


@query(
    "v2_norm_audit",
    f"""SELECT count(*) AS n_rows, CAST(count(*) FILTER (s IS NULL) AS BIGINT) AS n_null,
    {sql_r6('min(n)')} AS min_norm, {sql_r6('max(n)')} AS max_norm,
    CAST(count(*) FILTER (abs(n - 1) > 0.001) AS BIGINT) AS n_off_unit
    FROM (SELECT s, sqrt(list_inner_product(s, s)) AS n FROM {_SCALED})""",
)
def v2(spark, sf_dir):
    audit = V.norm_audit(_scaled(spark, sf_dir), "s")
    return audit.select("n_rows", "n_null", r6(F.col("min_norm")).alias("min_norm"),
                        r6(F.col("max_norm")).alias("max_norm"), "n_off_unit")


@query(
    "v3_dot_cosine",
    f"""WITH {X.VIEW_SQL}
    SELECT vec_id, {sql_r6('list_inner_product(a, b)')} AS dot,
    {sql_r6('list_inner_product(a, b) / greatest(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 1e-12)')} AS cosine
    FROM views""",
)
def v3(spark, sf_dir):
    pairs = compare.pair_views(_embeddings(spark, sf_dir), X.view_b(spark, sf_dir), "vec_id")
    a, b = F.col("a"), F.col("b")
    return pairs.select(F.col("id").alias("vec_id"), r6(V.dot(a, b)).alias("dot"), r6(V.cosine(a, b)).alias("cosine"))


@query(
    "v4_mean_pool",
    _long_sql(
        """(WITH cells AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings),
        means AS (SELECT label, p, avg(CAST(x AS DOUBLE)) AS m FROM cells GROUP BY label, p)
        SELECT label, list(m ORDER BY p) AS m FROM means GROUP BY label)""",
        "list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12))",
        "label",
    ),
)
def v4(spark, sf_dir):
    return _long(V.mean_pool(_embeddings(spark, sf_dir), ["label"]), F.col("embedding"), "label")


_LAYERS = """(WITH m AS (SELECT vec_id, list_transform(range(4), lambda d:
      (list_sum(list_transform([1, 2], lambda l: list_sum(list_transform(range(4), lambda t:
         CAST(embedding[l * 16 + t * 4 + d + 1] AS DOUBLE))))) / 8)) AS v FROM embeddings)
    SELECT vec_id, v FROM m)"""


@query(
    "v5_layer_pool",
    _long_sql(_LAYERS, "list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12))"),
)
def v5(spark, sf_dir):
    e = F.col("embedding")
    index = lambda n: F.sequence(F.lit(0), F.lit(n - 1))
    layers = F.transform(
        index(4), lambda l: F.transform(index(4), lambda t: F.slice(e, l * 16 + t * 4 + 1, 4))
    )
    return _long(_embeddings(spark, sf_dir), V.layer_pool(layers, (1, 2)), "vec_id")


@query(
    "v6_standardize",
    f"""WITH base AS (SELECT vec_id, s, list_sum(s) / len(s) AS m FROM {_SCALED}),
    spread AS (SELECT vec_id, s, m, sqrt(list_sum(list_transform(s, lambda x: (x - m) * (x - m))) / (len(s) - 1)) AS d FROM base)
    SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, {sql_r6('(x - m) / (d + 1e-7)')} AS x,
    {sql_r6('(x - m) / greatest(d, 1e-5)')} AS floored
    FROM (SELECT vec_id, m, d, unnest(s) AS x, generate_subscripts(s, 1) AS p FROM spread)""",
)
def v6(spark, sf_dir):
    df = _scaled(spark, sf_dir)
    both = F.arrays_zip(
        V.standardize(F.col("s")).alias("x"), V.standardize(F.col("s"), floor=1e-5).alias("floored")
    )
    long = df.select("vec_id", F.posexplode(both).alias("pos", "e"))
    return long.select("vec_id", "pos", r6(F.col("e.x")).alias("x"), r6(F.col("e.floored")).alias("floored"))


@query(
    "v7_pad_or_trim",
    f"""WITH {X.SIGNAL_SQL},
    p AS (SELECT doc_id, list_transform(range(40), lambda i: coalesce(s[i + 1], 0.0)) AS a,
                 list_transform(range(40), lambda i: coalesce(s[i + 8], 0.0)) AS b FROM signals)
    SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, {sql_r6('x')} AS x, {sql_r6('y')} AS y
    FROM (SELECT doc_id, unnest(a) AS x, unnest(b) AS y, generate_subscripts(a, 1) AS pos FROM p)""",
)
def v7(spark, sf_dir):
    s = F.col("s")
    both = F.arrays_zip(V.pad_or_trim(s, 40).alias("x"), V.pad_or_trim(s, 40, 7).alias("y"))
    long = X.signals(spark, sf_dir).select("doc_id", F.posexplode(both).alias("pos", "e"))
    return long.select("doc_id", "pos", r6(F.col("e.x")).alias("x"), r6(F.col("e.y")).alias("y"))


_CENTROIDS = """centroids AS (SELECT label, list(m ORDER BY p) AS m FROM (
  SELECT label, p, avg(CAST(x AS DOUBLE)) AS m FROM (
    SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)
  GROUP BY label, p) GROUP BY label),
unit AS (SELECT label, list_transform(m, lambda x: x / greatest(sqrt(list_inner_product(m, m)), 1e-12)) AS v FROM centroids)"""


@query(
    "v8_pairwise_similarity",
    f"""WITH {_CENTROIDS} SELECT a.label AS id_a, b.label AS id_b, {sql_r6('list_inner_product(a.v, b.v)')} AS score
    FROM unit a, unit b""",
)
def v8(spark, sf_dir):
    centroids = V.mean_pool(_embeddings(spark, sf_dir), ["label"])
    return knn.pairwise_similarity(centroids, id_col="label").withColumn("score", r6(F.col("score")))


_GAIN = f"pow(10.0, ({sql_uniform('vec_id', 's9:gain')} * 2.0 - 1.0) * 3.0 / 20.0)"
_SIGN = f"CASE WHEN {sql_uniform('vec_id', 's9:polarity')} < 0.5 THEN -1.0 ELSE 1.0 END"


@query(
    "v9_gain_polarity",
    _long_sql(
        f"(SELECT vec_id, embedding, {_GAIN} AS g, {_SIGN} AS f FROM embeddings)",
        "list_transform(embedding, lambda x: CAST(x AS DOUBLE) * g * f)",
    ),
)
def v9(spark, sf_dir):
    gained = V.random_gain(F.col("embedding"), F.col("vec_id"), "s9")
    return _long(_embeddings(spark, sf_dir), V.random_polarity(gained, F.col("vec_id"), "s9"), "vec_id")


def _band_sql(kind: str, m: int, widest: int, size: int) -> tuple[str, str]:
    width = f"least(1 + floor({sql_uniform('label', f's10:{kind}:{m}:width')} * {widest}), {size - 1})"
    start = f"floor({sql_uniform('label', f's10:{kind}:{m}:start')} * greatest(1, {size} - {width}))"
    return start, width


def _hit_sql(kind: str, index: str, count: int, widest: int, size: int) -> str:
    parts = []
    for m in range(count):
        start, width = _band_sql(kind, m, widest, size)
        parts.append(f"({index} >= {start} AND {index} < {start} + {width})")
    return " OR ".join(parts)


@query(
    "v10_mask_bands",
    f"""SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos,
    {sql_r6(f"CASE WHEN {_hit_sql('freq', '((p - 1) // 8)', 2, 3, 8)} OR {_hit_sql('time', '((p - 1) % 8)', 2, 3, 8)} THEN 0.0 ELSE x END")} AS x
    FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS p FROM embeddings)""",
)
def v10(spark, sf_dir):
    e = F.col("embedding")
    grid = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(e, i * 8 + 1, 8))
    masked = V.mask_bands(grid, F.col("label"), "s10", freq_mask_max=3, time_mask_max=3)
    return _long(_embeddings(spark, sf_dir), F.flatten(masked), "vec_id")


# ---------------------------------------------------------------- search

_SEED = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 7)"
_SCORES = f"scores AS (SELECT s.*, list_inner_product(CAST(s.embedding AS DOUBLE[]), q.q) AS score FROM store s, {_SEED} q)"


def _ranked_sql(where: str, k: int, columns: str) -> str:
    return f"""WITH {X.STORE_SQL}, {_SCORES}
    SELECT CAST(row_number() OVER (ORDER BY score DESC, track_id) - 1 AS INTEGER) AS rank, {columns}, {sql_r6('score')} AS score
    FROM scores WHERE {where} ORDER BY score DESC, track_id LIMIT {k}"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", r6(F.col("score")))


@query("k1_cosine_topk", _ranked_sql("genre <> 'g3'", 25, "track_id"))
def k1(spark, sf_dir):
    store = X.store(spark, sf_dir)
    seed = knn.get_embedding(store, "000007")
    hits = knn.cosine_topk(store, seed, 25, exclude=store.where("genre = 'g3'"))
    return _rounded(hits.select("rank", "track_id", "score"))


_TAGS = "track_id, path, title, artist, album, genre"


@query("k2_search", _ranked_sql("track_id NOT IN ('000001', '000009')", 10, _TAGS))
def k2(spark, sf_dir):
    store = X.store(spark, sf_dir)
    seed = knn.get_embedding(store, "000007")
    return _rounded(knn.search(store, seed, 10, exclude_ids=["000001", "000009", "no such id"]))


@query("k3_search_by_id", _ranked_sql("track_id <> '000007'", 10, _TAGS))
def k3(spark, sf_dir):
    return _rounded(knn.search_by_id(X.store(spark, sf_dir), "000007", 10))


@query("k3_search_by_id_with_self", _ranked_sql("true", 10, _TAGS))
def k3_self(spark, sf_dir):
    return _rounded(knn.search_by_id(X.store(spark, sf_dir), "000007", 10, exclude_self=False))


@query("k5_search_one_version", _ranked_sql("track_id <> '000007' AND model_version = 'v1'", 10, _TAGS))
def k5_version(spark, sf_dir):
    return _rounded(knn.search_by_id(X.store(spark, sf_dir), "000007", 10, model_version="v1"))


@query(
    "k7_format_hits",
    f"""WITH {X.STORE_SQL}, {_SCORES},
    top AS (SELECT *, row_number() OVER (ORDER BY score DESC, track_id) - 1 AS r FROM scores WHERE track_id <> '000007' QUALIFY r < 15)
    SELECT CAST(r AS INTEGER) AS rank, track_id, coalesce(nullif(concat_ws(' - ', artist, title, album), ''), path) AS label FROM top""",
)
def k7(spark, sf_dir):
    hits = knn.search_by_id(X.store(spark, sf_dir), "000007", 15)
    return knn.format_hits(hits).select("rank", "track_id", "label")


def _near_sql(k: int, vector: str = "embedding", source: str = "embeddings", on: str = "") -> str:
    """The neighbours of every row, by scoring every pair: the plain check of the join."""
    return f"""SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
      row_number() OVER (PARTITION BY a.vec_id
        ORDER BY list_inner_product(CAST(a.{vector} AS DOUBLE[]), CAST(b.{vector} AS DOUBLE[])) DESC, b.vec_id) - 1 AS rank,
      list_inner_product(CAST(a.{vector} AS DOUBLE[]), CAST(b.{vector} AS DOUBLE[])) AS score
    FROM {source} a, {source} b WHERE a.vec_id <> b.vec_id {on} QUALIFY rank < {k}"""


def _near_rows_sql(k: int, on: str = "", source: str = "embeddings") -> str:
    return f"""SELECT query_id, neighbor_id, CAST(rank AS INTEGER) AS rank, {sql_r6('score')} AS score
    FROM ({_near_sql(k, on=on, source=source)})"""


def _near(df: DataFrame, k: int, **kwargs) -> DataFrame:
    return knn.knn_join(df, df, k, query_id="vec_id", corpus_id="vec_id", exclude_self=True, **kwargs)


@query("k4_knn_join", _near_rows_sql(20))
def k4(spark, sf_dir):
    return _rounded(_near(_embeddings(spark, sf_dir), 20))


@query("k4_knn_join_cells", _near_rows_sql(20))
def k4_cells(spark, sf_dir):
    """The way a corpus of more than one block goes, forced by a small block."""
    return _rounded(_near(_embeddings(spark, sf_dir), 20, block_rows=256, pivots=8))


@query("k5_knn_join_by_key", _near_rows_sql(10, "AND a.label = b.label"))
def k5(spark, sf_dir):
    return _rounded(_near(_embeddings(spark, sf_dir), 10, key="label", block_rows=64))


# an index over centres that are rows themselves, so that SQL can say which cells a search visits and what it finds there
_K6_SQL = f"""centers AS (SELECT vec_id // 32 AS cell, CAST(embedding AS DOUBLE[]) AS c FROM embeddings WHERE vec_id % 32 = 0),
    near AS (SELECT vec_id, cell, list_inner_product(CAST(embedding AS DOUBLE[]), c) AS dot, list_inner_product(c, c) AS square FROM embeddings, centers),
    placed AS (SELECT vec_id, cell FROM near QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dot - square / 2 DESC, cell) = 1),
    places AS (SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY dot DESC, cell) AS place FROM near WHERE cell IN (SELECT cell FROM placed)),
    exact AS ({_near_sql(10)}),
    found AS (SELECT query_id, place FROM exact JOIN placed ON placed.vec_id = neighbor_id JOIN places ON places.vec_id = query_id AND places.cell = placed.cell),
    asked AS (SELECT * FROM found WHERE query_id % 5 = 0),
    visited AS (SELECT min(p.place) AS cells FROM (SELECT DISTINCT place FROM places) p
      WHERE (SELECT count(*) FROM asked a WHERE a.place <= p.place) >= 0.92 * (SELECT count(*) FROM asked))"""


def _k6_index(spark, sf_dir):
    """An index whose number of visited cells was measured on a fifth of the vectors, for 0.92 there, to hold 0.9 over all."""
    df = _embeddings(spark, sf_dir)
    centers = df.where("vec_id % 32 = 0").select((F.col("vec_id") / 32).cast("int").alias("cell"), F.col("embedding").alias("center"))
    path = scratch_path(spark, "cell-index")
    cell_index.build_index(df, path, centers=centers, id_col="vec_id")
    index = cell_index.open_index(spark, path)
    measured = cell_index.calibrate(index, df.where("vec_id % 5 = 0"), 10, 0.92, "vec_id", exclude_self=True)
    return df, index, measured


@query(
    "k6_ann_topk",
    f"""WITH {_K6_SQL}
    SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id,
      CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) - 1 AS INTEGER) AS rank,
      {sql_r6('list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS score
    FROM embeddings a JOIN places ON places.vec_id = a.vec_id AND place <= (SELECT cells FROM visited) JOIN placed USING (cell) JOIN embeddings b ON b.vec_id = placed.vec_id
    WHERE a.vec_id <> b.vec_id QUALIFY rank < 10""",
)
def k6(spark, sf_dir):
    df, index, _ = _k6_index(spark, sf_dir)
    return _rounded(cell_index.search_index(index, df, 10, query_id="vec_id", exclude_self=True))


@query(
    "k6_ann_quality",
    f"""WITH {_K6_SQL}, share AS (SELECT avg(CAST(place <= (SELECT cells FROM visited) AS INTEGER)) AS recall FROM found)
    SELECT (SELECT count(*) FROM embeddings) AS n_queries, CAST((SELECT cells FROM visited) AS INTEGER) AS cells,
      {sql_r6("(SELECT avg(CAST(place <= (SELECT cells FROM visited) AS INTEGER)) FROM asked)")} AS measured, {sql_r6('recall')} AS recall, recall >= 0.9 AS enough FROM share""",
)
def k6_quality(spark, sf_dir):
    """Recall of the search over all vectors against brute force, and the one that was measured on the sample."""
    df, index, measured = _k6_index(spark, sf_dir)
    near = cell_index.search_index(index, df, 10, query_id="vec_id", exclude_self=True)
    true = knn.knn_join(df, df, 10, query_id="vec_id", corpus_id="vec_id", exclude_self=True).select("query_id", "neighbor_id", F.lit(1).alias("hit"))
    # every true neighbour, found or not
    met = true.join(near.select("query_id", "neighbor_id", F.lit(1).alias("got")), ["query_id", "neighbor_id"], "left")
    recall = F.avg(F.coalesce("got", F.lit(0)))
    return met.agg(
        F.count_distinct("query_id").alias("n_queries"),
        F.lit(measured["cells"]).alias("cells"),
        r6(F.lit(measured["recall"])).alias("measured"),
        r6(recall).alias("recall"),
        (recall >= 0.9).alias("enough"),
    )


# ---------------------------------------------------------------- retrieval metrics


def _recall_columns(hit: str = "(a.label = b.label)") -> str:
    return ", ".join(
        f"{sql_r6(f'avg(CASE WHEN n.rank < {k} THEN CAST({hit} AS INTEGER) END)')} AS recall_at_{k}"
        for k in (1, 5, 10, 20)
    )


RECALL_SQL = f"""WITH n AS ({_near_sql(20)}) SELECT {_recall_columns()}
    FROM n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.neighbor_id"""


@query("m1_recall_at_k", RECALL_SQL)
def m1(spark, sf_dir):
    df = _embeddings(spark, sf_dir)
    recall = metrics.recall_at_k(_near(df, 20), df, id_col="vec_id")
    return recall.select(*[r6(F.col(c)).alias(c) for c in recall.columns])


@query(
    "m2_tag_jaccard_at_k",
    f"""WITH {X.TAGS_SQL}, n AS ({_near_sql(20)})
    SELECT count(*) FILTER (n.rank = 0) AS n_seeds, """
    + ", ".join(
        sql_r6(
            f"avg(CASE WHEN n.rank < {k} THEN len(list_intersect(a.tags, b.tags)) / greatest(len(list_distinct(list_concat(a.tags, b.tags))), 1) END)"
        )
        + f" AS jaccard_at_{k}"
        for k in (1, 5, 10, 20)
    )
    + """ FROM n JOIN tags a ON a.vec_id = n.query_id JOIN tags b ON b.vec_id = n.neighbor_id WHERE len(a.tags) > 0""",
)
def m2(spark, sf_dir):
    got = metrics.tag_jaccard_at_k(
        _near(_embeddings(spark, sf_dir), 20), X.tags(spark, sf_dir), id_col="vec_id"
    )
    return got.select("n_seeds", *[r6(F.col(c)).alias(c) for c in got.columns if c != "n_seeds"])


COHESION_SQL = f"""eligible AS (SELECT * FROM store WHERE album IN (SELECT album FROM store GROUP BY album HAVING count(*) >= 4)),
  pairs AS (SELECT a.album AS x, b.album AS y, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s
            FROM eligible a, eligible b WHERE a.vec_id <> b.vec_id),
  per AS (SELECT x, avg(s) AS s FROM pairs WHERE x = y GROUP BY x),
  means AS (SELECT (SELECT avg(s) FROM per) AS i, (SELECT avg(s) FROM pairs WHERE x <> y) AS c)"""


@query(
    "m3_group_cohesion",
    f"""WITH {X.STORE_SQL}, {COHESION_SQL}
    SELECT {sql_r6('i')} AS intra_mean, {sql_r6('c')} AS cross_mean, {sql_r6('i - c')} AS gap,
    (SELECT count(DISTINCT album) FROM eligible) AS n_albums, (SELECT count(*) FROM eligible) AS n_tracks FROM means""",
)
def m3(spark, sf_dir):
    got = metrics.group_cohesion(X.store(spark, sf_dir))
    return got.select(*[r6(F.col(c)).alias(c) for c in ("intra_mean", "cross_mean", "gap")], "n_albums", "n_tracks")


@query(
    "m4_label_confusion",
    f"""WITH n AS ({_near_sql(10)}),
    c AS (SELECT 'g' || a.label AS seed_label, 'g' || b.label AS neighbor_label, count(*) AS n
          FROM n JOIN embeddings a ON a.vec_id = n.query_id JOIN embeddings b ON b.vec_id = n.neighbor_id GROUP BY ALL)
    SELECT seed_label, neighbor_label, n, {sql_r6('n / sum(n) OVER (PARTITION BY seed_label)')} AS share FROM c""",
)
def m4(spark, sf_dir):
    got = metrics.label_confusion(
        _near(_embeddings(spark, sf_dir), 10), X.store(spark, sf_dir), id_col="vec_id", label="genre"
    )
    return got.withColumn("share", r6(F.col("share")))


@query(
    "m5_random_baseline",
    f"""WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label)
    SELECT count(*) AS n_labels, {sql_r6('1.0 / count(*)')} AS baseline,
    {sql_r6('sum(n * (n - 1)) / (sum(n) * (sum(n) - 1))')} AS baseline_unbalanced FROM c""",
)
def m5(spark, sf_dir):
    got = metrics.random_baseline(_embeddings(spark, sf_dir))
    return got.select("n_labels", r6(F.col("baseline")).alias("baseline"),
                      r6(F.col("baseline_unbalanced")).alias("baseline_unbalanced"))


def _summary_sql(score: str) -> str:
    quartiles = ", ".join(
        f"{sql_r6(f'quantile_cont({score}, {q / 100})')} AS cosine_p{q}" for q in (25, 50, 75)
    )
    return f"{sql_r6(f'avg({score})')} AS cosine_mean, {sql_r6(f'min({score})')} AS cosine_min, {quartiles}"


_DOT = "list_inner_product(a, b)"
_COS = "(list_inner_product(a, b) / greatest(sqrt(list_inner_product(a, a)) * sqrt(list_inner_product(b, b)), 1e-12))"


def _pairs(spark: SparkSession, sf_dir: str, keep=()) -> DataFrame:
    return compare.pair_views(_embeddings(spark, sf_dir), X.view_b(spark, sf_dir), "vec_id", keep=keep)


def _all6(df: DataFrame, *same: str) -> DataFrame:
    return df.select(*[F.col(c) if c in same else r6(F.col(c)).alias(c) for c in df.columns])


@query("m6_cosine_summary", f"WITH {X.VIEW_SQL} SELECT {_summary_sql(_DOT)} FROM views")
def m6(spark, sf_dir):
    return _all6(compare.cosine_summary(_pairs(spark, sf_dir)))


@query(
    "m6_cosine_gate",
    f"""WITH {X.VIEW_SQL} SELECT {_summary_sql(_COS)},
    CASE WHEN avg({_COS}) >= 0.9995 THEN 'pass' ELSE 'warn' END AS status FROM views""",
)
def m6_gate(spark, sf_dir):
    return _all6(compare.cosine_gate(_pairs(spark, sf_dir), 0.9995), "status")


def _two_near_sql(k: int) -> str:
    return f"""a_near AS ({_near_sql(k, 'a', 'views')}), b_near AS ({_near_sql(k, 'b', 'views')}),
    both_near AS (SELECT x.query_id, x.rank AS ra, y.rank AS rb FROM a_near x JOIN b_near y USING (query_id, neighbor_id))"""


def _overlap_sql(k: int) -> str:
    n = "(SELECT count(*) FROM views)"
    return f"{sql_r6(f'(SELECT count(*) FROM both_near WHERE ra < {k} AND rb < {k}) / ({n} * {k}.0)')} AS overlap_at_{k}"


@query(
    "m7_neighbour_overlap",
    f"WITH {X.VIEW_SQL}, {_two_near_sql(20)} SELECT " + ", ".join(_overlap_sql(k) for k in (5, 10, 20)),
)
def m7(spark, sf_dir):
    a, b = _embeddings(spark, sf_dir), X.view_b(spark, sf_dir)
    return _all6(metrics.neighbour_overlap(_near(a, 20), _near(b, 20), a.count()))


def _mse_sql(key: str, group: str) -> str:
    return f"""WITH {X.VIEW_SQL}, g AS (SELECT {key} AS key, vec_id, a, b FROM views),
    n AS (SELECT key, count(*) AS n_rows FROM g GROUP BY key),
    e AS (SELECT x.key, avg(pow(list_inner_product(x.a, y.a) - list_inner_product(x.b, y.b), 2)) AS m
          FROM g x JOIN g y ON x.key = y.key AND x.vec_id <> y.vec_id GROUP BY x.key)
    SELECT {group} n_rows, {sql_r6('coalesce(m, 0.0)')} AS relational_mse FROM n LEFT JOIN e USING (key)"""


@query("m8_relational_mse", _mse_sql("''", ""))
def m8(spark, sf_dir):
    return _all6(compare.relational_mse(_pairs(spark, sf_dir)), "n_rows")


@query("m8_relational_mse_by_batch", _mse_sql("CAST(vec_id % 8 AS VARCHAR)", "key,"))
def m8_batches(spark, sf_dir):
    return _all6(compare.relational_mse(_pairs(spark, sf_dir), F.col("id") % 8), "key", "n_rows")


def _redundancy_sql(key: str, group: str) -> str:
    return f"""WITH {X.VIEW_SQL}, g AS (SELECT {key} AS key, vec_id, a, b FROM views),
    n AS (SELECT key, count(*) AS n_rows FROM g GROUP BY key HAVING count(*) >= 2),
    cells AS (SELECT key, vec_id, 'a' AS side, unnest(a) AS x, generate_subscripts(a, 1) AS p FROM g
              UNION ALL SELECT key, vec_id, 'b', unnest(b), generate_subscripts(b, 1) FROM g),
    sim AS (SELECT key, avg(pow(u.x - w.x, 2)) AS sim FROM cells u JOIN cells w USING (key, vec_id, p) WHERE u.side = 'a' AND w.side = 'b' GROUP BY key),
    std AS (SELECT key, 0.5 * sum(h) / 64 AS std FROM (SELECT key, side, p, greatest(1 - sqrt(var_samp(x) + 1e-4), 0) AS h FROM cells GROUP BY key, side, p) GROUP BY key),
    cov AS (SELECT key, sum(c * c) / 64 AS cov FROM (
        SELECT u.key, u.side, u.p, w.p AS q, covar_samp(u.x, w.x) AS c FROM cells u JOIN cells w ON u.key = w.key AND u.side = w.side AND u.vec_id = w.vec_id AND u.p <> w.p GROUP BY u.key, u.side, u.p, w.p) GROUP BY key)
    SELECT {group} n_rows, {sql_r6('sim')} AS sim, {sql_r6('std')} AS std, {sql_r6('cov')} AS cov,
    {sql_r6('25 * sim + 25 * std + cov')} AS total FROM n JOIN sim USING (key) JOIN std USING (key) JOIN cov USING (key)"""


@query("m9_redundancy_report", _redundancy_sql("''", ""))
def m9(spark, sf_dir):
    return _all6(compare.redundancy_report(_pairs(spark, sf_dir)), "n_rows")


@query("m9_redundancy_by_batch", _redundancy_sql("'g' || label", "key,"))
def m9_batches(spark, sf_dir):
    got = compare.redundancy_report(
        _pairs(spark, sf_dir, keep=["label"]), F.concat(F.lit("g"), "label")
    )
    return _all6(got, "key", "n_rows")


@query("m10_view_cosine", f"WITH {X.VIEW_SQL} SELECT {sql_r6(f'avg({_COS})')} AS view_cosine FROM views")
def m10(spark, sf_dir):
    return _all6(compare.view_cosine(_pairs(spark, sf_dir)))


@query(
    "m11_distillation_loss",
    f"""WITH {X.VIEW_SQL}, c AS (SELECT avg(1.0 - {_COS}) AS l FROM views),
    e AS (SELECT avg(pow(list_inner_product(x.a, y.a) - list_inner_product(x.b, y.b), 2)) AS m FROM views x JOIN views y ON x.vec_id <> y.vec_id)
    SELECT {sql_r6('l')} AS cosine_loss, {sql_r6('m')} AS relational_mse, {sql_r6('l + 0.25 * m')} AS loss FROM c, e""",
)
def m11(spark, sf_dir):
    return _all6(compare.distillation_loss(_pairs(spark, sf_dir)))


def _side_recall_sql(side: str) -> str:
    out = []
    for k in (5, 10, 20):
        out.append(
            f"(SELECT {sql_r6('avg(CAST(u.label = w.label AS INTEGER))')} FROM {side}_near n JOIN views u ON u.vec_id = n.query_id "
            f"JOIN views w ON w.vec_id = n.neighbor_id WHERE n.rank < {k}) AS {side}_recall_at_{k}"
        )
    return ", ".join(out)


@query(
    "m12_compare_report",
    f"""WITH {X.VIEW_SQL}, {_two_near_sql(20)} SELECT (SELECT count(*) FROM views) AS n_rows, {_summary_sql(_DOT)},
    {", ".join(_overlap_sql(k) for k in (5, 10, 20))}, {_side_recall_sql('a')}, {_side_recall_sql('b')} FROM views""",
)
def m12(spark, sf_dir):
    got = compare.compare_report(_embeddings(spark, sf_dir), X.view_b(spark, sf_dir), id_col="vec_id")
    return _all6(got, "n_rows")


_ALIGNED = f"""{X.STORE_SQL}, {X.LABELS_SQL},
  joined AS (SELECT s.vec_id, s.model_version, s.embedding, l.genre_top FROM store s JOIN labels_dim l
             ON l.fma_track_id = CAST(regexp_extract(s.path, '([0-9]{{6}})[.][^./]*$', 1) AS INTEGER)
             WHERE l.genre_top IS NOT NULL AND l.subset IN ('small'))"""


@query(
    "m13_eval_report_label",
    f"""WITH {_ALIGNED}, n AS ({_near_sql(20, source='joined')})
    SELECT (SELECT count(*) FROM store) AS n_store, (SELECT count(*) FROM joined) AS n_aligned,
    (SELECT count(DISTINCT genre_top) FROM joined) AS unique_labels,
    (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT model_version AS v FROM store)) AS model_versions,
    {_recall_columns('(a.genre_top = b.genre_top)')}
    FROM n JOIN joined a ON a.vec_id = n.query_id JOIN joined b ON b.vec_id = n.neighbor_id""",
)
def m13_label(spark, sf_dir):
    labels = L.drop_null_label(L.filter_subset(X.labels_dim(spark, sf_dir), "small"))
    got = eval_report(X.store(spark, sf_dir), "label", labels=labels)
    return _all6(got, "n_store", "n_aligned", "unique_labels", "model_versions")


@query(
    "m13_eval_report_tags",
    f"""WITH {X.STORE_SQL}, {X.TAGS_SQL}, n AS ({_near_sql(20)})
    SELECT (SELECT count(*) FROM store) AS n_store, (SELECT count(*) FROM store) AS n_aligned,
    (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT model_version AS v FROM store)) AS model_versions,
    count(*) FILTER (n.rank = 0) AS n_seeds, """
    + ", ".join(
        sql_r6(
            f"avg(CASE WHEN n.rank < {k} THEN len(list_intersect(a.tags, b.tags)) / greatest(len(list_distinct(list_concat(a.tags, b.tags))), 1) END)"
        )
        + f" AS jaccard_at_{k}"
        for k in (1, 5, 10, 20)
    )
    + """ FROM n JOIN tags a ON a.vec_id = n.query_id JOIN tags b ON b.vec_id = n.neighbor_id WHERE len(a.tags) > 0""",
)
def m13_tags(spark, sf_dir):
    named = X.store(spark, sf_dir).select("vec_id", relative_path(F.col("path"), "/lib").alias("mp3_path"))
    tags = X.tags(spark, sf_dir).join(named, "vec_id").select("mp3_path", "tags")
    got = eval_report(X.store(spark, sf_dir), "tags", tags=tags, root="/lib")
    return _all6(got, "n_store", "n_aligned", "model_versions", "n_seeds")


@query(
    "m13_eval_report_library",
    f"""WITH {X.STORE_SQL}, {COHESION_SQL}
    SELECT (SELECT count(*) FROM store) AS n_store, (SELECT count(*) FROM store WHERE album IS NOT NULL) AS n_aligned,
    (SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT DISTINCT model_version AS v FROM store)) AS model_versions,
    {sql_r6('i')} AS intra_mean, {sql_r6('c')} AS cross_mean, {sql_r6('i - c')} AS gap,
    (SELECT count(DISTINCT album) FROM eligible) AS n_albums, (SELECT count(*) FROM eligible) AS n_tracks FROM means""",
)
def m13_library(spark, sf_dir):
    got = eval_report(X.store(spark, sf_dir), "library")
    return _all6(got, "n_store", "n_aligned", "model_versions", "n_albums", "n_tracks")
