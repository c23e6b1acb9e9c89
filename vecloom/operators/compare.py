"""Comparison of two embedding tables over the same ids, and collapse reports.

Everything that would need all pairs of rows is rewritten over D x D products: the sum over pairs of
(s_i.s_j - t_i.t_j)^2 is |S'S|^2 + |T'T|^2 - 2 |S'T|^2 minus its diagonal.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom import fixed_values as fixed
from vecloom.functions import vectors as V
from vecloom.operators import knn, metrics
from vecloom.operators.knn import _matrix
from vecloom.operators.quantiles import exact_quantiles
from vecloom.operators.rows import one_row
from vecloom.session import materialize


def pair_views(
    a: DataFrame, b: DataFrame, id_col: str = "id", vector: str = "embedding", keep: Sequence[str] = ()
) -> DataFrame:
    """Rows present in both tables: ``id, a, b`` and the kept columns of the first."""
    left = a.select(F.col(id_col).alias("id"), F.col(vector).alias("a"), *keep)
    right = b.select(F.col(id_col).alias("id"), F.col(vector).alias("b"))
    return left.join(right, "id").where(F.col("a").isNotNull() & F.col("b").isNotNull())


def _cosines(pairs: DataFrame, normalized: bool) -> DataFrame:
    """``c``: product or cosine of every pair of vectors, in Arrow batches."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dim = len(batch.column("a")[0])
            a, b = _matrix(batch.column("a"), dim), _matrix(batch.column("b"), dim)
            c = (a * b).sum(axis=1)
            if normalized:
                lengths = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
                c = c / np.maximum(lengths, V.TINY)
            yield pa.RecordBatch.from_arrays([pa.array(c)], names=["c"])

    return pairs.select("a", "b").mapInArrow(score, "c double")


def cosine_summary(pairs: DataFrame, normalized: bool = False) -> DataFrame:
    """Mean, minimum and quartiles (linear interpolation) of the row-wise products."""
    # one number per row is kept, so the vectors are joined and read once for mean and quartiles
    cos = materialize(_cosines(pairs, normalized), "cosines")
    ends = cos.agg(F.avg("c").alias("cosine_mean"), F.min("c").alias("cosine_min"))
    row = one_row(ends, exact_quantiles(cos, "c", (0.25, 0.5, 0.75)))
    return row.select(
        "cosine_mean",
        "cosine_min",
        *[F.col("q")[i].alias(name) for i, name in enumerate(("cosine_p25", "cosine_p50", "cosine_p75"))],
    )


def cosine_gate(pairs: DataFrame, threshold: float) -> DataFrame:
    """Normalized summary with a soft gate on the mean."""
    summary = cosine_summary(pairs, normalized=True)
    status = F.when(F.col("cosine_mean") >= threshold, "pass").otherwise("warn")
    return summary.withColumn("status", status)


def view_cosine(pairs: DataFrame) -> DataFrame:
    """Mean normalized cosine of the two views of a row."""
    return _cosines(pairs, normalized=True).agg(F.avg("c").alias("view_cosine"))


def cosine_loss(pairs: DataFrame) -> DataFrame:
    return _cosines(pairs, normalized=True).agg(F.avg(1.0 - F.col("c")).alias("cosine_loss"))


def distillation_loss(pairs: DataFrame, relational_weight: float = 0.25) -> DataFrame:
    """Cosine loss plus the weighted relational error, over all rows."""
    both = one_row(cosine_loss(pairs), relational_mse(pairs))
    total = F.col("cosine_loss") + relational_weight * F.col("relational_mse")
    return both.select("cosine_loss", "relational_mse", total.alias("loss"))


# ---------------------------------------------------------------- D x D products

_PRODUCT = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("what", T.StringType()),
        T.StructField("pos", T.IntegerType()),
        T.StructField("x", T.ArrayType(T.DoubleType())),
    ]
)


SMALL_KEY_ROWS = 4096


def _keyed_rows(pairs: DataFrame, key: Column | None) -> DataFrame:
    group = F.lit("") if key is None else key.cast("string")
    return pairs.select(
        group.alias("key"), V.doubles(F.col("a")).alias("a"), V.doubles(F.col("b")).alias("b")
    ).where(F.col("key").isNotNull())


def _by_key(rows: DataFrame, small, large) -> DataFrame:
    """Keys of few rows are worked whole, in one call each; larger ones by partial products."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    sized = rows.join(sizes, "key")
    few = sized.where(F.col("_n") <= SMALL_KEY_ROWS).drop("_n")
    many = sized.where(F.col("_n") > SMALL_KEY_ROWS).drop("_n")
    return small(few).unionByName(large(many))


def _per_group(rows: DataFrame, schema: str, work) -> DataFrame:
    """``work(a, b)`` gives the numbers of one key, or None to leave it out."""
    names = [part.split()[0] for part in schema.split(",")]
    types = {"bigint": pa.int64(), "double": pa.float64()}
    kinds = [types[part.split()[1]] for part in schema.split(",")]

    def call(table: pa.Table) -> pa.Table:
        dim = len(table.column("a")[0])
        got = work(_matrix(table.column("a"), dim), _matrix(table.column("b"), dim))
        some = [] if got is None else [table.column("key")[0].as_py()]
        columns = [pa.array(some, pa.string())]
        columns += [pa.array([] if got is None else [got[i]], kind) for i, kind in enumerate(kinds)]
        return pa.table(dict(zip(["key", *names], columns)))

    return rows.groupBy("key").applyInArrow(call, f"key string, {schema}")


def _group_mse(a: np.ndarray, b: np.ndarray) -> tuple[int, float]:
    n = len(a)
    if n < 2:
        return n, 0.0
    gap = (a @ a.T - b @ b.T) ** 2
    return n, float((gap.sum() - np.trace(gap)) / (n * (n - 1)))


def _products(rows: DataFrame) -> DataFrame:
    """Per key: the sums of x x', column sums and scalar sums, as rows of D numbers.

    Every task emits at most 3 D + 3 rows per key it has seen, whatever the number of its input rows, so
    the shuffle that adds them up is small.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], np.ndarray] = {}

        def add(key: str, what: str, value: np.ndarray) -> None:
            if (key, what) in sums:
                sums[key, what] += value
            else:
                sums[key, what] = value

        def flush() -> pa.RecordBatch:
            out = [
                (k, w, i, row.tolist()) for (k, w), m in sums.items() for i, row in enumerate(m)
            ]
            sums.clear()
            names = ["key", "what", "pos", "x"]
            types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float64())]
            columns = list(zip(*out)) if out else [[], [], [], []]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=names
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column("key").to_pylist(), dtype=object)
            dim = len(batch.column("a")[0])
            a_all, b_all = _matrix(batch.column("a"), dim), _matrix(batch.column("b"), dim)
            for k in set(keys):
                a, b = a_all[keys == k], b_all[keys == k]
                add(k, "aa", a.T @ a)
                add(k, "bb", b.T @ b)
                add(k, "ab", a.T @ b)
                add(k, "sum", np.stack([a.sum(axis=0), b.sum(axis=0)]))
                diagonal = ((a * a).sum(axis=1) - (b * b).sum(axis=1)) ** 2
                gap = ((a - b) ** 2).sum()
                add(k, "one", np.array([[float(len(a)), diagonal.sum(), gap]]))
            if len(sums) * dim * dim > 8_000_000:
                yield flush()
        yield flush()

    parts = rows.mapInArrow(partial, _PRODUCT)
    cells = parts.select("key", "what", "pos", F.posexplode("x").alias("col", "x"))
    return cells.groupBy("key", "what", "pos", "col").agg(F.sum("x").alias("x"))


def relational_mse(pairs: DataFrame, key: Column | None = None) -> DataFrame:
    """Mean over i != j of (a_i.a_j - b_i.b_j)^2, per key or over the whole table."""
    rows = _keyed_rows(pairs, key)
    if key is None:
        return _large_mse(rows).drop("key")
    small = lambda df: _per_group(df, "n_rows bigint, relational_mse double", _group_mse)
    return _by_key(rows, small, _large_mse)


def _large_mse(rows: DataFrame) -> DataFrame:
    sums = _products(rows).where(F.col("what") != "sum")
    is_one = F.col("what") == "one"
    sign = F.when(F.col("what") == "ab", -2.0).otherwise(1.0)
    per_key = sums.groupBy("key").agg(
        F.sum(F.when(~is_one, sign * F.col("x") ** 2)).alias("squares"),
        F.max(F.when(is_one & (F.col("col") == 0), F.col("x"))).alias("n"),
        F.max(F.when(is_one & (F.col("col") == 1), F.col("x"))).alias("diagonal"),
    )
    n = F.col("n")
    mse = F.when(n >= 2, F.greatest(F.col("squares") - F.col("diagonal"), F.lit(0.0)) / (n * (n - 1)))
    return per_key.select(
        "key", n.cast("bigint").alias("n_rows"), F.coalesce(mse, F.lit(0.0)).alias("relational_mse")
    )


def redundancy_report(
    pairs: DataFrame,
    key: Column | None = None,
    *,
    sim_coef: float = 25.0,
    std_coef: float = 25.0,
    cov_coef: float = 1.0,
    eps: float = 1e-4,
) -> DataFrame:
    """Invariance, variance and covariance of two views: is the table collapsed or redundant?

    Per key when one is given; keys of one row are left out. Otherwise fewer than two rows are an
    error.
    """

    def group(a: np.ndarray, b: np.ndarray) -> tuple[int, float, float, float] | None:
        n, d = a.shape
        if n < 2:
            return None
        std = cov = 0.0
        for side in (a, b):
            spread = side.var(axis=0, ddof=1)
            std += 0.5 * float(np.maximum(0.0, 1.0 - np.sqrt(spread + eps)).mean())
            centered = side - side.mean(axis=0)
            products = (centered.T @ centered / (n - 1)) ** 2
            cov += float((products.sum() - np.trace(products)) / d)
        return n, float(((a - b) ** 2).mean()), std, cov

    rows = _keyed_rows(pairs, key)
    if key is None:
        few = F.raise_error(F.lit("the report needs at least two rows")).cast("bigint")
        parts = _large_redundancy(rows, eps)
        n_rows = F.when(F.col("n_rows") >= 2, F.col("n_rows")).otherwise(few)
        parts = parts.withColumn("n_rows", n_rows)
    else:
        schema = "n_rows bigint, sim double, std double, cov double"
        parts = _by_key(
            rows, lambda df: _per_group(df, schema, group), lambda df: _large_redundancy(df, eps)
        )
    total = sim_coef * F.col("sim") + std_coef * F.col("std") + cov_coef * F.col("cov")
    out = parts.withColumn("total", total)
    return out if key is not None else out.drop("key")


def _large_redundancy(rows: DataFrame, eps: float) -> DataFrame:
    sums = _products(rows)
    totals = sums.where(F.col("what") == "sum").select(
        "key", F.when(F.col("pos") == 0, "aa").otherwise("bb").alias("what"), "col", F.col("x").alias("t")
    )
    ones = sums.where(F.col("what") == "one").groupBy("key").agg(
        F.max(F.when(F.col("col") == 0, F.col("x"))).alias("n"),
        F.max(F.when(F.col("col") == 2, F.col("x"))).alias("gap"),
    )
    row_total = totals.select("key", "what", F.col("col").alias("pos"), F.col("t").alias("ti"))
    moments = (
        sums.where(F.col("what").isin("aa", "bb"))
        .join(totals, ["key", "what", "col"])
        .join(row_total, ["key", "what", "pos"])
        .join(ones, "key")
    )
    n = F.col("n")
    cov = F.when(n > 1, (F.col("x") - F.col("ti") * F.col("t") / n) / (n - 1))
    on_diagonal = F.col("pos") == F.col("col")
    hinge = F.greatest(1.0 - F.sqrt(F.greatest(cov, F.lit(0.0)) + eps), F.lit(0.0))
    report = moments.groupBy("key").agg(
        F.first("n").alias("n"),
        F.first("gap").alias("gap"),
        (F.max("pos") + 1).alias("d"),
        F.sum(F.when(on_diagonal, hinge)).alias("hinge"),
        F.sum(F.when(~on_diagonal, cov * cov)).alias("off"),
    )
    return report.select(
        "key",
        F.col("n").cast("bigint").alias("n_rows"),
        (F.col("gap") / (F.col("n") * F.col("d"))).alias("sim"),
        (F.col("hinge") / F.col("d") * 0.5).alias("std"),
        (F.coalesce("off", F.lit(0.0)) / F.col("d")).alias("cov"),
    )


# ---------------------------------------------------------------- whole reports


def compare_report(
    a: DataFrame,
    b: DataFrame,
    *,
    id_col: str = "id",
    label: str = "label",
    vector: str = "embedding",
    k_values: Sequence[int] = fixed.OVERLAP_KS,
) -> DataFrame:
    """Cosine summary, neighbour overlap and label recall of either side, in one row.

    Overlap and recall appear when there is more than one label and more than two rows; k values
    are kept while they are below the row count.
    """
    pairs = pair_views(a, b, id_col, vector)
    summary = cosine_summary(pairs)
    sizes = a.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("labels")).first()
    n = sizes["n"]
    ks = [k for k in k_values if k < n]
    parts = [summary.select(F.lit(n).cast("bigint").alias("n_rows"), "*")]
    if ks and n > 2 and sizes["labels"] > 1:
        labels = a.select(F.col(id_col).alias("id"), F.col(label).alias("label"))
        # each side is used for overlap and for recall: its neighbours are computed once
        near = [
            materialize(
                knn.knn_join(
                    side, side, max(ks), query_id=id_col, corpus_id=id_col, vector=vector, exclude_self=True
                ),
                "near",
            )
            for side in (a, b)
        ]
        parts.append(metrics.neighbour_overlap(*near, n, ks))
        for name, side in zip(("a", "b"), near):
            recall = metrics.recall_at_k(side, labels, ks)
            parts.append(recall.select(*[F.col(c).alias(f"{name}_{c}") for c in recall.columns]))
    return one_row(*parts)
