"""Perplexity of track texts under an interpolated modified Kneser-Ney model of characters, and language-wise thresholds.

Trusted texts give the counts; joins of the count tables give the smoothed probabilities; scoring joins the n-grams of every text
with the model, one shard of the model at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import bytesets as B
from vecloom.session import materialize

ORDER = 5
#: model rows of a shard: a task holds one shard, 24 bytes a row in a table at most half full
SHARD_ROWS = 2_000_000
#: a text is an outlier above the upper quartile of its language by so many interquartile ranges of log-perplexity
FENCE = 3.0
#: rank error of the quantiles: 1 / ACCURACY
ACCURACY = 10_000

#: stands before a text ORDER - 1 times: the last code point, which is set aside for such uses
_START = 0x10FFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, ORDER - 1 start signs before each, and the len + 1 offsets."""
    texts = [t or "" for t in column.to_pylist()]
    sizes = np.array([len(t) + ORDER - 1 for t in texts], np.int64)
    joined = (chr(_START) * (ORDER - 1)).join(["", *texts])
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def _keys(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` code points; run k ends at code k + size - 1."""
    n = len(codes) - size + 1
    total = np.full(max(n, 0), np.uint64(size))
    for k in range(size if n > 0 else 0):
        total = (total + codes[k : k + n]) * _STEP
        total ^= total >> np.uint64(29)
    return total


def _slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    _, offsets = B.text_bytes(column)
    for lo, hi in B.row_slices(offsets):
        yield lo, hi, *_code_points(column.slice(lo, hi - lo))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of the highest order in a slice with their counts."""
    for batch in batches:
        for _, _, codes, offsets in _slices(batch.column(0)):
            if len(codes) < ORDER:
                continue
            row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(codes) - ORDER + 1]
            whole = np.flatnonzero(np.arange(len(row_end)) + ORDER <= row_end)
            _, first, n = np.unique(_keys(codes, ORDER)[whole], return_index=True, return_counts=True)
            at = whole[first]
            grams = codes[at[:, None] + np.arange(ORDER)].astype("<u4").tobytes().decode("utf-32-le")
            grams = [grams[k : k + ORDER] for k in range(0, len(grams), ORDER)]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(n, pa.int64())], names=["gram", "n"])


def count_tables(trusted: DataFrame) -> list[DataFrame]:
    """Counts by order 1 .. ORDER (``gram, n``): how often at the highest, after how many different signs below."""
    top = trusted.select("_text").mapInArrow(_count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    tables = [materialize(top, "grams")]
    while len(tables) < ORDER:
        shorter = F.expr("substring(gram, 2)")
        below = tables[0].groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))
        tables.insert(0, materialize(below, "grams"))
    return tables


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney from how many n-grams have a count of 1 to 4."""
    seen = counts.agg(*(F.count(F.when(F.col("n") == k, True)).alias(f"c{k}") for k in (1, 2, 3, 4))).first()
    c = [max(1, seen[f"c{k}"]) for k in (1, 2, 3, 4)]
    y = c[0] / (c[0] + 2 * c[1])
    return [min(k, max(0.0, k - (k + 1) * y * c[k] / c[k - 1])) for k in (1, 2, 3)]


def train(trusted: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The model of ``_text``: probabilities (``gram, p``: the last sign after the others), weights (``gram, back``: what a context
    leaves to shorter ones) and the size of the alphabet, one unseen sign included.
    """
    tables = count_tables(trusted)
    alphabet = tables[0].count() + 1
    lower = trusted.sparkSession.createDataFrame([("", 1.0 / alphabet)], "shorter string, q double")
    probabilities, weights = [], []
    for size, counts in enumerate(tables, 1):
        d = discounts(counts)
        n = F.col("n")
        cut = F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])
        counts = counts.withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)")).withColumn("shorter", F.expr("substring(gram, 2)"))
        contexts = counts.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
        contexts = materialize(contexts.withColumn("back", F.col("cut") / F.col("total")), f"contexts-{size}")
        joined = counts.join(contexts, "context").join(lower, "shorter")
        found = joined.select("gram", ((n - cut) / F.col("total") + F.col("back") * F.col("q")).alias("p"))
        probabilities.append(materialize(found, f"probabilities-{size}"))
        weights.append(contexts.select(F.col("context").alias("gram"), "back"))
        lower = probabilities[-1].select(F.col("gram").alias("shorter"), F.col("p").alias("q"))
    return _union(probabilities), _union(weights), alphabet


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column(0).to_pylist()
        sizes, keys = np.array([len(g) for g in grams]), np.zeros(len(grams), np.uint64)
        for size in np.unique(sizes[sizes > 0]):
            which = np.flatnonzero(sizes == size)
            codes = np.frombuffer("".join(grams[k] for k in which).encode("utf-32-le"), np.uint32)
            keys[which] = _keys(codes, int(size))[:: int(size)]
        values = np.log(B.integers(batch.column(1))).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(values)], names=["key", "value"])


class Shard:
    """An open hash table from n-gram keys to values, at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 2))))
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.float32)
        self.used = np.zeros(1 << self.bits, bool)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            _, first = np.unique(slot, return_index=True)
            won = first[~self.used[slot[first]]]
            self.used[slot[won]] = True
            self.keys[slot[won]], self.values[slot[won]] = keys[rest[won]], values[rest[won]]
            lost = np.ones(len(rest), bool)
            lost[won] = False
            rest, slot = rest[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (B.mix(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is there, and its value (0 if not)."""
        found, values = np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            used = self.used[slot]
            hit = used & (self.keys[slot] == keys[rest])
            found[rest[hit]], values[rest[hit]] = True, self.values[slot[hit]]
            on = used & ~hit
            rest, slot = rest[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return found, values


def log_probabilities(codes: np.ndarray, at: np.ndarray, probabilities: Shard, weights: Shard, alphabet: int) -> np.ndarray:
    """Natural log-probability of each sign ``codes[at]`` after the ORDER - 1 before it."""
    out = np.zeros(len(at))
    rest = np.arange(len(at))
    for size in range(ORDER, 0, -1):
        found, value = probabilities.find(_keys(codes, size)[at[rest] - size + 1])
        out[rest[found]] += value[found]
        rest = rest[~found]
        context = _keys(codes, size - 1)[at[rest] - size + 1] if size > 1 else np.zeros(len(rest), np.uint64)
        out[rest] += weights.find(context)[1]
    out[rest] -= np.log(alphabet)
    return out


def _shard_of(codes, n_shards: int):
    return (codes * np.uint32(0x9E3779B1) >> np.uint32(12)) % np.uint32(n_shards)


def score(tracks: DataFrame, trusted: DataFrame, shard_rows: int) -> DataFrame:
    """A row for each row of ``tracks``: its columns but the text, with ``n_signs`` and ``log_p`` (sum over the text)."""
    probabilities, weights, alphabet = train(trusted)
    n_shards = max(1, -(-probabilities.count() // shard_rows))
    if n_shards > 1:  # the numbers are written, so every shard sees the same ones
        tracks = materialize(tracks.withColumn("_row", F.monotonically_increasing_id()), "rows")
    others = [c for c in tracks.columns if c != "_text"]
    parts = []
    for shard in range(n_shards):
        # the sign before the predicted one names the shard; n-grams without it are in all
        before = F.expr("CASE WHEN length(gram) > 1 THEN ascii(substring(gram, -2, 1)) END")
        last = F.expr("CASE WHEN length(gram) > 0 THEN ascii(substring(gram, -1, 1)) END")
        p, w = (
            t.filter(sign.isNull() | (F.pmod(F.shiftrightunsigned((sign.cast("long") * 0x9E3779B1).bitwiseAND(0xFFFFFFFF), 12), F.lit(n_shards)) == shard))
            .mapInArrow(_keyed, "key long, value float").toArrow()
            for t, sign in ((probabilities, before), (weights, last))
        )
        held = [(B.integers(t.column(0).combine_chunks()).view(np.uint64), B.integers(t.column(1).combine_chunks())) for t in (p, w)]
        shared = tracks.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, shard=shard) -> Iterator[pa.RecordBatch]:
            p, w = (Shard(*t) for t in shared.value)
            for batch in batches:
                place = batch.schema.names.index("_text")
                sizes, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
                for lo, hi, codes, offsets in _slices(batch.column(place)):
                    at = np.arange(len(codes))
                    row = np.repeat(np.arange(hi - lo), np.diff(offsets))
                    real = at - offsets[row] >= ORDER - 1
                    if n_shards > 1:
                        real[1:] &= _shard_of(codes[:-1], n_shards) == shard
                    at = at[real]
                    sums.append(np.bincount(row[at], log_probabilities(codes, at, p, w, alphabet), minlength=hi - lo))
                    sizes.append(np.diff(offsets) - ORDER + 1)
                columns = [batch.column(batch.schema.names.index(c)) for c in others]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums))], names=[*others, "n_signs", "log_p"]
                )

        schema = T.StructType([tracks.schema[c] for c in others] + [T.StructField("n_signs", T.LongType()), T.StructField("log_p", T.DoubleType())])
        parts.append(tracks.mapInArrow(run, schema))
    if n_shards == 1:
        return parts[0]
    return _union(parts).groupBy(*others).agg(F.max("n_signs").alias("n_signs"), F.sum("log_p").alias("log_p")).drop("_row")


def judge_perplexity(
    tracks: DataFrame,
    trusted: DataFrame,
    id_col: str = "track_id",
    text_col: str = "title",
    lang_col: str = "lang",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """Perplexity per sign of each track's whole text under a model of all ``trusted`` tracks' texts, and who stands out.

    Returns the id, ``lang_col``, ``n_signs`` (code points), ``perplexity``, ``threshold`` and ``kept``. The threshold is a language's own:
    upper quartile and ``FENCE`` interquartile ranges above it, of log-perplexity over all its tracks (null is a language too).
    Track records have no language field; any column may group them.

    Null and empty texts have no perplexity, set no threshold and aren't kept. Rows are scored one by one, so repeated and null ids
    keep their rows (over several shards a row number keeps equal rows apart). Without trusted text every sign is equally likely. Other columns are not read. An empty table gives no rows.

    The count tables are grouped and joined by n-gram, which spreads hot ones by partial sums. Scoring takes the model in shards of
    about ``shard_rows`` n-grams; the tasks hold one shard, and each text meets every shard once. Over several shards the texts are
    written once with their row numbers.
    """
    source = tracks.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text"))
    scored = score(source, trusted.select(F.col(text_col).alias("_text")), shard_rows)
    scored = materialize(
        scored.select("_id", "_lang", "n_signs", F.when(F.col("n_signs") > 0, -F.col("log_p") / F.col("n_signs")).alias("_log")), "perplexities"
    )
    quartiles = scored.groupBy("_lang").agg(F.percentile_approx("_log", [0.25, 0.75], ACCURACY).alias("_q"))
    fences = quartiles.select(F.col("_lang").alias("_key"), (F.col("_q")[1] + FENCE * (F.col("_q")[1] - F.col("_q")[0])).alias("_fence"))
    joined = scored.join(fences, F.col("_lang").eqNullSafe(F.col("_key")), "left")
    return joined.select(
        F.col("_id").alias(id_col),
        F.col("_lang").alias(lang_col),
        "n_signs",
        F.exp("_log").alias("perplexity"),
        F.exp("_fence").alias("threshold"),
        F.coalesce(F.col("_log") <= F.col("_fence"), F.lit(False)).alias("kept"),
    )
