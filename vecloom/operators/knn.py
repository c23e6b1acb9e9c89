"""Exact cosine neighbours; approximate ones are in ``cell_index``.

One query is a scan with a top-k at the end. A join of two tables takes one of three ways:

* the corpus fits one block (its size is checked): the block is broadcast, queries never move;
* a key restricts the pairs: rows meet on the key, big keys are cut into a few parts, so a row is sent a few times;
* otherwise blocks of the corpus are visited best first along a ball tree, in waves (``balls``).

Copies of a vector are collapsed to one before any of this: only the smallest ids of a copy group
can be in an answer. Matrix products run in Arrow batches of bounded size inside the tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions import vectors as V
from vecloom.session import materialize

BLOCK_BYTES = 4 << 20
SCORE_CELLS = 1_000_000
PAIRS_PER_TASK = 200_000_000
#: a large side is cut into this many parts, into more only where a part would pass the bytes
CUTS, PART_BYTES = 4, 16 << 20


# ---------------------------------------------------------------- one query


def cosine_topk(
    corpus: DataFrame,
    query: list[float],
    k: int,
    *,
    id_col: str = "track_id",
    vector: str = "embedding",
    exclude: DataFrame | list | None = None,
) -> DataFrame:
    """The k rows with the highest inner product, 0-based ``rank``; ties go to the smaller id.

    Excluded rows are removed. Every task scores its rows in Arrow batches (many times faster than
    array lambdas) and passes on its best k; ``TakeOrderedAndProject`` merges them. No row is shuffled.
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    if query is None or not len(query):
        raise ValueError("query must be a non-empty vector")
    rows = corpus.where(F.col(vector).isNotNull())
    if exclude is not None:
        if isinstance(exclude, DataFrame):
            rows = rows.join(exclude.select(id_col), id_col, "left_anti")
        elif len(exclude):
            rows = rows.where(~F.col(id_col).isin(list(exclude)))
    q = np.asarray(query, dtype=np.float64)
    schema = T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            v = _matrix(batch.column(vector), len(q))
            scores = v @ q
            at = np.arange(len(scores))
            if len(scores) > k:
                limit = np.partition(scores, len(scores) - k)[len(scores) - k]
                longest = np.sqrt(np.einsum("ij,ij->i", v, v).max() * (q @ q))
                at = np.nonzero(scores >= limit - (len(q) + 8) * 2.0**-51 * longest)[0]
            exact = _row_dot(v[at], np.broadcast_to(q, (len(at), len(q))))
            part = pa.Table.from_batches([batch]).take(pa.array(at))
            part = part.append_column("score", pa.array(exact))
            kept = part if kept is None else pa.concat_tables([kept, part])
            order = pc.sort_indices(kept, sort_keys=[("score", "descending"), (id_col, "ascending")])
            kept = kept.take(order[:k])
        if kept is not None:
            yield from kept.to_batches()

    hits = rows.mapInArrow(best, schema).orderBy(F.desc("score"), F.asc(id_col)).limit(k)
    # at most k rows are left here
    order = Window.orderBy(F.desc("score"), F.asc(id_col))
    return hits.withColumn("rank", (F.row_number().over(order) - 1).cast("int"))


def search(
    store: DataFrame,
    query: list[float],
    k: int = 10,
    exclude_ids: list | DataFrame | None = None,
    model_version: str | None = None,
) -> DataFrame:
    """Search hits of a store, with their tags. An empty store gives no rows."""
    if model_version is not None:
        store = store.where(F.col("model_version") == model_version)
    tags = [c for c in ("path", "title", "artist", "album", "genre") if c in store.columns]
    hits = cosine_topk(store.select("track_id", *tags, "embedding"), query, k, exclude=exclude_ids)
    return hits.select("rank", "track_id", *tags, "score")


def search_by_id(
    store: DataFrame, track_id: str, k: int = 10, exclude_self: bool = True, **kwargs
) -> DataFrame:
    """Neighbours of a stored row; an unknown id is an error."""
    return search(
        store,
        get_embedding(store, track_id),
        k,
        exclude_ids=[track_id] if exclude_self else None,
        **kwargs,
    )


def get_embedding(store: DataFrame, track_id: str) -> list[float]:
    """One vector by key; the filter is pushed to the Parquet scan."""
    row = store.where(F.col("track_id") == track_id).select("embedding").first()
    if row is None:
        raise KeyError(f"unknown track_id: {track_id}")
    return row["embedding"]


def format_hits(hits: DataFrame) -> DataFrame:
    """One text line per hit: artist - title - album, or the path if all are empty."""
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("artist", "title", "album")]
    label = F.coalesce(F.nullif(F.concat_ws(" - ", *parts), F.lit("")), F.col("path"))
    line = F.format_string("%3d  %+.4f  %s  %s", "rank", "score", "track_id", label)
    return hits.select("rank", "track_id", label.alias("label"), line.alias("line"))


# ---------------------------------------------------------------- all queries


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    query_id: str = "id",
    corpus_id: str = "id",
    vector: str = "embedding",
    key: str | None = None,
    exclude_self: bool = False,
    block_rows: int | None = None,
    pivots: int | None = None,
    stats: dict | None = None,
) -> DataFrame:
    """Top-k of the corpus for every query: ``query_id, neighbor_id, rank`` (0-based), ``score``.

    With ``key`` only rows of equal key are compared; rows whose key is NULL match nothing. NaN, infinite or NULL elements raise,
    whichever way the join takes; so do ids that repeat, where a row is to be kept from meeting itself. ``pivots`` is the number of
    leaves of the ball tree; ``stats`` receives what it took (``balls.ball_join``).
    """
    if k <= 0:
        raise ValueError(f"k must be positive, got {k}")
    spark = corpus.sparkSession
    id_type = corpus.schema[corpus_id].dataType
    plan = _Plan(k, exclude_self, id_type, queries.schema[query_id].dataType)

    def view(df: DataFrame, id_col: str) -> DataFrame:
        group = F.col(key).cast("string") if key else F.lit("")
        out = df.select(F.col(id_col).alias("id"), group.alias("g"), F.col(vector).alias("v"))
        return out.where(F.col("v").isNotNull() & F.col("g").isNotNull())

    q, c = view(queries, query_id), view(corpus, corpus_id)
    first = c.select("v").first()
    if first is None:
        return spark.createDataFrame([], plan.result_schema)
    plan.dim = len(first["v"])
    fitting = max(256, min(16_384, BLOCK_BYTES // (4 * plan.dim)))
    plan.block_rows = block_rows or fitting

    if exclude_self:
        n_rows, most = c.groupBy("id").count().agg(F.sum("count"), F.max("count")).first()
        if most > 1:
            raise ValueError(f"{corpus_id} repeats in the corpus: with exclude_self every id must name one row")
    else:
        n_rows = corpus.count()
    # the broadcast is bounded by bytes, whatever block size is asked for
    if n_rows <= min(plan.block_rows, fitting):
        return _one_block(q, c.toArrow(), plan)
    if key:
        return _keyed(q, c, plan, n_rows)
    from vecloom.operators.balls import ball_join

    return ball_join(q, c, plan, n_rows, pivots, stats)


class _Plan:
    """What the three strategies share; plain values, so it travels to the tasks."""

    def __init__(self, k: int, exclude_self: bool, id_type: T.DataType, query_type: T.DataType):
        self.k = k
        self.exclude_self = exclude_self
        self.want = k + 1 if exclude_self else k
        self.id_type = id_type
        self.query_type = query_type
        self.dim = 0
        self.block_rows = 0

    @property
    def result_schema(self) -> T.StructType:
        return T.StructType(
            [
                T.StructField("query_id", self.query_type),
                T.StructField("neighbor_id", self.id_type),
                T.StructField("rank", T.IntegerType()),
                T.StructField("score", T.DoubleType()),
            ]
        )


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of a list column as float64; a row of another width, or with NaN, infinite or NULL elements, is an error."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, dim))
    widths = np.diff(np.asarray(column.offsets))
    if (widths != dim).any():
        other = int(widths[widths != dim][0])
        raise ValueError(f"embedding_dim mismatch: store has {dim}, got {other}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(flat).all():
        raise ValueError("embedding holds NaN, infinite or NULL elements: split such rows off first (split_bad_vectors)")
    return flat.reshape(-1, dim)


def _positions(groups: np.ndarray) -> dict[str, np.ndarray]:
    """Row numbers of every group, from one sort."""
    names, codes = np.unique(groups.astype(str), return_inverse=True)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(1, len(names)))
    return dict(zip(names.tolist(), np.split(order, ends)))


def _row_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise products whose last bit does not depend on the block shape."""
    out = np.empty(len(a))
    step = max(1, SCORE_CELLS // max(1, a.shape[1]))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = (a[lo : lo + step] * b[lo : lo + step]).sum(axis=1)
    return out


def _block_topk(
    q: np.ndarray,
    c: np.ndarray,
    copies: np.ndarray,
    id_order: np.ndarray,
    k: int,
    floor: np.ndarray | None = None,
    allowed: np.ndarray | None = None,
    cell: np.ndarray | None = None,
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (query row, flat id index, score) of the best k ids per query, best first.

    Corpus row j owns ``copies[j]`` consecutive flat ids; ``id_order`` ranks the flat ids. A 32-bit
    product picks the candidates, wider than needed by its error bound; their scores are then
    computed in 64 bits. With a ``floor`` (a score k ids are known to reach) a selection is only needed
    where many rows reach it. ``allowed`` says by query which values of ``cell`` (one per corpus row) count.
    """
    n, m = len(q), len(c)
    if not n or not m:
        return
    starts = np.cumsum(copies) - copies
    small_c = c.astype(np.float32).T
    largest = np.sqrt((c * c).sum(axis=1).max())
    error = 2 * (q.shape[1] + 8) * 2.0**-24
    step = max(1, SCORE_CELLS // m)
    for lo in range(0, n, step):
        part = q[lo : lo + step]
        scores = part.astype(np.float32) @ small_c
        limit = np.full(len(part), -np.inf)
        if floor is not None:
            limit = floor[lo : lo + step].copy()
        slack = error * (np.sqrt((part * part).sum(axis=1)) * largest + 1e-30)
        bar = np.nextafter((limit - slack).astype(np.float32), np.float32(-np.inf))
        reached = scores >= bar[:, None]
        many = np.flatnonzero(np.count_nonzero(reached, axis=1) > 4 * k) if m > k else np.zeros(0, np.int64)
        if len(many):
            chosen = scores[many]
            if allowed is not None:
                chosen[~allowed[lo + many][:, cell]] = -np.inf
            limit[many] = np.maximum(limit[many], np.partition(chosen, m - k, axis=1)[:, m - k])
            bar[many] = np.nextafter((limit[many] - slack[many]).astype(np.float32), np.float32(-np.inf))
            reached[many] = chosen >= bar[many, None]
        rows, cols = np.nonzero(reached)
        if allowed is not None:
            counts = allowed[lo + rows, cell[cols]]
            rows, cols = rows[counts], cols[counts]
        exact = np.empty(len(rows))
        hop = max(1, SCORE_CELLS // q.shape[1])
        for at in range(0, len(rows), hop):
            cut = slice(at, at + hop)
            exact[cut] = _row_dot(part[rows[cut]], c[cols[cut]])
        reps = copies[cols]
        rows, exact = np.repeat(rows, reps), np.repeat(exact, reps)
        inner = np.arange(len(rows)) - np.repeat(np.cumsum(reps) - reps, reps)
        flat = np.repeat(starts[cols], reps) + inner
        order = np.lexsort((id_order[flat], -exact, rows))
        rows, exact, flat = rows[order], exact[order], flat[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        yield lo + rows[keep], flat[keep], exact[keep]


def _order_of(ids: pa.Array) -> np.ndarray:
    """Position of each id in ascending order."""
    order = np.asarray(pc.array_sort_indices(ids))
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.arange(len(order))
    return out


# ---- the corpus is one block


def _one_block(queries: DataFrame, block: pa.Table, plan: _Plan) -> DataFrame:
    """The corpus was counted to fit one block: send it to every task, leave the queries in place."""
    ids = block.column("id").combine_chunks()
    corpus = _matrix(block.column("v"), plan.dim)
    groups = np.asarray(block.column("g").to_pylist(), dtype=object)
    shared = queries.sparkSession.sparkContext.broadcast((ids, corpus, groups, _order_of(ids)))
    dim, want, k, drop_self = plan.dim, plan.want, plan.k, plan.exclude_self
    comparable = plan.id_type == plan.query_type

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, corpus, groups, order = shared.value
        members = _positions(groups)
        for batch in batches:
            q = _matrix(batch.column("v"), dim)
            q_groups = np.asarray(batch.column("g").to_pylist(), dtype=object)
            for g, at in _positions(q_groups).items():
                mine = members.get(g)
                if mine is None:
                    continue
                ones = np.ones(len(mine), dtype=np.int64)
                for rows, flat, score in _block_topk(q[at], corpus[mine], ones, order[mine], want):
                    q_ids = batch.column("id").take(pa.array(at[rows]))
                    n_ids = ids.take(pa.array(mine[flat]))
                    keep = np.ones(len(rows), dtype=bool)
                    if drop_self and comparable:
                        keep = ~np.asarray(pc.equal(q_ids, n_ids))
                    rows, score = rows[keep], score[keep]
                    q_ids, n_ids = q_ids.filter(pa.array(keep)), n_ids.filter(pa.array(keep))
                    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    top = pa.array(place < k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            q_ids.filter(top),
                            n_ids.filter(top),
                            pa.array(place.astype(np.int32)).filter(top),
                            pa.array(score).filter(top),
                        ],
                        names=["query_id", "neighbor_id", "rank", "score"],
                    )

    return queries.mapInArrow(answer, plan.result_schema)


# ---- shared pieces of the two shuffled strategies


def _with_vid(df: DataFrame) -> DataFrame:
    """``vid`` names the vector: 128 hash bits and the key."""
    return df.withColumn(
        "vid", F.concat_ws(":", "g", F.xxhash64("v"), F.xxhash64(F.lit("second"), F.col("v")))
    )


def _distinct_corpus(corpus: DataFrame, want: int) -> DataFrame:
    """One row per distinct vector with its ``want`` smallest ids.

    ``row_number() <= want`` is cut down before the exchange (WindowGroupLimit), so a copy group of
    any size sends at most ``want`` rows per map task.
    """
    first_ids = Window.partitionBy("vid").orderBy("id")
    kept = _with_vid(corpus).withColumn("_rn", F.row_number().over(first_ids))
    return (
        kept.where(F.col("_rn") <= want)
        .groupBy("vid")
        .agg(
            F.first("g").alias("g"),
            F.first("v").alias("v"),
            F.array_sort(F.collect_list("id")).alias("ids"),
        )
    )


def _distinct_queries(queries: DataFrame) -> DataFrame:
    return (
        _with_vid(queries).groupBy("vid").agg(F.first("g").alias("g"), F.first("v").alias("v"))
    )


UNIT = ["unit", "sub", "chunk"]


def cuts(n: str, rows: int, dim: int) -> Column:
    """Into how many parts ``n`` rows are cut: as many as blocks of ``rows``, but ``CUTS`` at most while a part has ``PART_BYTES``.

    A row is sent to each part of the other side, so what is shuffled grows with the rows, and not with their square, up to
    ``CUTS`` times those bytes; beyond that a part is as large as a task should hold.
    """
    most = max(rows, PART_BYTES // (4 * dim))
    return F.least(F.ceil(F.col(n) / rows), F.greatest(F.lit(CUTS), F.ceil(F.col(n) / most))).cast("int")


def _by_unit(df: DataFrame, pairs: float) -> DataFrame:
    """Partition by unit, at about ``PAIRS_PER_TASK`` scores per task. Units are small in bytes and
    large in work: sized by bytes, adaptive execution would put most of them into one task."""
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(conf, min(math.ceil(pairs / PAIRS_PER_TASK), 100_000)), *UNIT)


def _score_units(queries: DataFrame, corpus: DataFrame, plan: _Plan, pairs: float) -> DataFrame:
    """Both sides carry ``unit, sub, chunk, g``; a unit is bounded on either side."""
    dim, want = plan.dim, plan.want
    schema = T.StructType(
        [
            T.StructField("vid", T.StringType()),
            T.StructField("neighbor_id", plan.id_type),
            T.StructField("score", T.DoubleType()),
        ]
    )
    arrow_id = pa.string() if isinstance(plan.id_type, T.StringType) else None

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            sides = [_positions(np.asarray(t.column("g").to_pylist())) for t in (left, right)]
            for g in sides[0].keys() & sides[1].keys():
                lt, rt = left.take(pa.array(sides[0][g])), right.take(pa.array(sides[1][g]))
                ids, copies = _flat_ids(rt)
                floor = lt.column("floor").to_numpy()
                parts = _block_topk(
                    _matrix(lt.column("v"), dim),
                    _matrix(rt.column("v"), dim),
                    copies,
                    _order_of(ids),
                    want,
                    floor,
                )
                for rows, flat, scores in parts:
                    vid = lt.column("vid").combine_chunks().take(pa.array(rows))
                    out.append(
                        pa.table(
                            {
                                "vid": vid.cast(pa.string()),
                                "neighbor_id": ids.take(pa.array(flat)),
                                "score": pa.array(scores),
                            }
                        )
                    )
        if not out:
            ids, _ = _flat_ids(right)
            return pa.table(
                {
                    "vid": pa.array([], pa.string()),
                    "neighbor_id": pa.array([], arrow_id or ids.type),
                    "score": pa.array([], pa.float64()),
                }
            )
        return pa.concat_tables(out)

    left, right = _by_unit(queries, pairs), _by_unit(corpus, pairs)
    return left.groupBy(*UNIT).cogroup(right.groupBy(*UNIT)).applyInArrow(score, schema)


def _flat_ids(table: pa.Table) -> tuple[pa.Array, np.ndarray]:
    lists = table.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    return lists.flatten(), np.diff(np.asarray(lists.offsets)).astype(np.int64)


def _finish(queries: DataFrame, scored: DataFrame, plan: _Plan) -> DataFrame:
    """Best ``want`` per vector, given back to every query that holds it, without itself."""
    best = Window.partitionBy("vid").orderBy(F.desc("score"), F.asc("neighbor_id"))
    kept = scored.withColumn("_rn", F.row_number().over(best)).where(F.col("_rn") <= plan.want)
    lists = kept.groupBy("vid").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "neighbor_id", "score"))).alias("hits")
    )
    return _answers(queries, lists, plan)


def _answers(queries: DataFrame, lists: DataFrame, plan: _Plan) -> DataFrame:
    """``lists`` has ``vid`` and its ordered ``hits``; every query that holds the vector gets them, without itself."""
    joined = _with_vid(queries).select("id", "vid").join(lists, "vid")
    hits = F.col("hits")
    if plan.exclude_self and plan.id_type == plan.query_type:
        hits = F.filter(hits, lambda h: h["neighbor_id"] != F.col("id"))
    exploded = joined.select(
        F.col("id").alias("query_id"), F.posexplode(F.slice(hits, 1, plan.k)).alias("rank", "hit")
    )
    return exploded.select("query_id", "hit.neighbor_id", "rank", "hit.score")


# ---- pairs restricted by a key


def _keyed(queries: DataFrame, corpus: DataFrame, plan: _Plan, n_rows: int) -> DataFrame:
    """Rows meet on the key. A key of more than one block is cut into ``cuts`` parts on either side, and every two of them
    meet; small keys share a unit, so a table of many tiny keys does not become many tiny calls."""
    rows = plan.block_rows
    c = _distinct_corpus(corpus, plan.want)
    q = _distinct_queries(queries)
    c_n = corpus.groupBy("g").agg(F.count(F.lit(1)).alias("c_n"))
    q_n = queries.groupBy("g").agg(F.count(F.lit(1)).alias("q_n"))
    counted = c_n.join(q_n, "g")
    sizes = counted.select("g", cuts("c_n", rows, plan.dim).alias("n_sub"), cuts("q_n", rows, plan.dim).alias("n_chunk"))
    packs = max(1, math.ceil(2 * n_rows / rows))
    small = (F.col("n_sub") == 1) & (F.col("n_chunk") == 1)
    unit = F.when(small, F.pmod(F.xxhash64("g"), F.lit(packs))).otherwise(
        F.xxhash64("g", F.lit("large"))
    )
    sides = []
    for df, mine, other in ((q, "n_chunk", "n_sub"), (c, "n_sub", "n_chunk")):
        own = F.pmod(F.xxhash64("vid"), F.col(mine)).cast("int")
        spread = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        names = {"n_chunk": "chunk", "n_sub": "sub"}
        sides.append(
            df.join(sizes, "g")
            .withColumn("unit", unit)
            .withColumn(names[mine], own)
            .withColumn(names[other], spread)
        )
    left = sides[0].select(
        "unit", "sub", "chunk", "g", "vid", "v", F.lit(float("-inf")).alias("floor")
    )
    right = sides[1].select("unit", "sub", "chunk", "g", "v", "ids")
    pairs = float(counted.agg(F.sum(F.col("c_n").cast("double") * F.col("q_n"))).first()[0] or 0)
    return _finish(queries, _score_units(left, right, plan, pairs), plan)


# ---- vectors by their nearest centre


def _nearest(df: DataFrame, centers: np.ndarray, dim: int) -> DataFrame:
    """Add the nearest pivot (``cell``) and the distance to it (``away``)."""
    shared = df.sparkSession.sparkContext.broadcast(centers)
    schema = T.StructType(
        [*df.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("away", T.DoubleType())]
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        half = (p * p).sum(axis=1) / 2
        # a batch against all centres would be as large as both together: a few rows at a time
        step = max(1, SCORE_CELLS // max(1, len(p)))
        for batch in batches:
            v = _matrix(batch.column("v"), dim)
            cell = np.zeros(len(v), dtype=np.int64)
            for lo in range(0, len(v), step):
                near = v[lo : lo + step] @ p.T
                near -= half
                cell[lo : lo + step] = near.argmax(axis=1)
            gap = v - p[cell]
            away = np.sqrt((gap * gap).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)],
                names=[*batch.schema.names, "cell", "away"],
            )

    return df.mapInArrow(assign, schema)


# ---------------------------------------------------------------- a short list against itself


def pairwise_similarity(
    items: DataFrame, *, id_col: str = "id", vector: str = "embedding", max_items: int = 100
) -> DataFrame:
    """The similarity matrix of a short list in long form, as one would print it.

    A list of more than ``max_items`` is an error; ``knn_join`` is the way for tables.
    """
    rows = items.select(F.col(id_col).alias("id"), F.col(vector).alias("v")).limit(max_items + 1)
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("l"))
    too_long = F.raise_error(F.lit(f"more than {max_items} items; use knn_join"))
    listed = listed.select(
        F.when(F.size("l") <= max_items, F.col("l")).otherwise(too_long.cast(listed.schema["l"].dataType)).alias("l")
    )
    pairs = listed.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b"))
    return pairs.select(
        F.col("a.id").alias("id_a"),
        F.col("b.id").alias("id_b"),
        V.dot(F.col("a.v"), F.col("b.v")).alias("score"),
    )
