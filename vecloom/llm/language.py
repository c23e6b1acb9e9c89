"""Language of track texts by hierarchical discrimination.

A text's family is predicted first, then the language within the family; both steps vote over one-versus-one linear support
vector machines on hashed byte n-grams. Each machine is trained in a task of its own from a bounded sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import bytesets as B
from vecloom.session import materialize

# Families of ISO 639-1 codes; a language that isn't listed is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "semitic": ("ar", "he", "mt"),
    "indo-aryan": ("hi", "bn", "ur", "mr", "pa", "gu", "ne"),
    "iranian": ("fa", "ku", "ps"),
}
UNDETERMINED = "und"
#: labelled texts of a language that the machines learn from, at most
SAMPLE_PER_LANGUAGE = 500
#: hashed n-gram buckets
FEATURES = 4096
GRAMS = (2, 3)

_FOLD = B.LOWER.copy()
_FOLD[:128][~np.isin(np.arange(128), np.arange(ord("a"), ord("z") + 1)) & ~np.isin(np.arange(128), np.arange(ord("A"), ord("Z") + 1))] = 32


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of feature rows and the row each block starts at: square roots of the n-gram shares, over the whole text.

    Letters are lower-cased (A-Z) and every other ASCII byte is a blank; bytes above ASCII stay, so any script has features.
    """
    data, offsets = B.text_bytes(column)
    for lo, hi in B.row_slices(offsets):
        part = offsets[lo : hi + 1]
        symbols = _FOLD[data[part[0] : part[-1]]].astype(np.uint32)
        rows = np.repeat(np.arange(hi - lo, dtype=np.uint32) * np.uint32(FEATURES), np.diff(part))
        total = np.zeros((hi - lo) * FEATURES, np.int64)
        code = symbols.copy()
        for size in range(2, max(GRAMS) + 1):
            if len(symbols) < size:
                break
            code = code[:-1] * np.uint32(257) + symbols[size - 1 :]
            if size in GRAMS:
                place = (code * np.uint32(0x9E3779B1) + np.uint32(size)) >> np.uint32(20)
                whole = rows[: len(place)] == rows[size - 1 :]
                total += np.bincount((rows[: len(place)] + place)[whole], minlength=len(total))
        block = total.reshape(hi - lo, FEATURES).astype(np.float32)
        block /= np.maximum(block.sum(axis=1, keepdims=True), 1)
        yield lo, np.sqrt(block, out=block)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [v.astype(np.float16).tobytes() for _, block in features(batch.column(2)) for v in block]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors, pa.binary())], names=["_key", "_lang", "_x"])


def train_machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 100) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss and balanced classes; ``y`` holds -1 and 1.

    Accelerated gradient steps of a fixed length, so equal input gives equal weights.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    share = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype)
    w = np.zeros(x.shape[1], x.dtype)
    ahead, momentum = w.copy(), 1.0
    length = 1.0 / (2 * float((share[:, None] * x * x).sum()) + penalty)
    for _ in range(steps):
        short = np.maximum(0, 1 - y * (x @ ahead))
        step = ahead - length * (penalty * ahead - 2 * x.T @ (share * y * short))
        grown = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, w, momentum = step + (momentum - 1) / grown * (step - w), step, grown
    return w[:-1], float(w[-1])


def _fit(problem: pd.DataFrame) -> pd.DataFrame:
    problem = problem.sort_values(["_side", "_key"], kind="stable")
    x = np.stack([np.frombuffer(v, np.float16) for v in problem["_x"]]).astype(np.float32)
    weights, bias = train_machine(x, np.where(problem["_side"].to_numpy() == 0, 1, -1).astype(np.float32))
    first = problem.iloc[0]
    return pd.DataFrame({"_level": [first["_level"]], "_a": [first["_a"]], "_b": [first["_b"]], "_w": [weights.astype(np.float32).tobytes()], "_bias": [bias]})


def train(labelled: DataFrame, families: Mapping[str, tuple[str, ...]], sample: int) -> list:
    """One row for each machine: level (family or language), the two classes, weights and bias.

    ``labelled`` has ``_key`` (long), ``_lang`` and ``_text``. The machines number classes squared, each a few KB.
    """
    chosen = labelled.select("_key", "_lang").withColumn("_order", F.xxhash64("_key"))
    turn = Window.partitionBy("_lang").orderBy("_order", "_key")
    chosen = chosen.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= sample).select("_key", "_lang").distinct()
    # at most ``sample`` ids for each language
    rows = labelled.join(F.broadcast(chosen), ["_key", "_lang"], "left_semi").select("_key", "_lang", "_text")
    rows = materialize(rows.mapInArrow(_sampled, "_key long, _lang string, _x binary"), "language-sample")
    of_family = {lang: family for family, langs in families.items() for lang in langs}
    langs = sorted(r["_lang"] for r in rows.select("_lang").distinct().collect())
    pairs = []
    names = {lang: of_family.get(lang, lang) for lang in langs}
    kinds = sorted(set(names.values()))
    for lang in langs:
        own = names[lang]
        pairs += [(lang, "family", min(own, k), max(own, k), int(own > k)) for k in kinds if k != own]
        pairs += [(lang, "language", min(lang, k), max(lang, k), int(lang > k)) for k in langs if k != lang and names[k] == own]
    if not pairs:
        return [names, []]
    problems = labelled.sparkSession.createDataFrame(pairs, "_lang string, _level string, _a string, _b string, _side int")
    machines = (
        rows.join(F.broadcast(problems), "_lang")
        .groupBy("_level", "_a", "_b")
        .applyInPandas(_fit, "_level string, _a string, _b string, _w binary, _bias double")
        .collect()
    )
    return [names, [(m["_level"], m["_a"], m["_b"], m["_w"], m["_bias"]) for m in machines]]


def _sure(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-4 * np.clip(margin, -20, 20)))


def vote(x: np.ndarray, classes: list[str], machines: list) -> tuple[np.ndarray, np.ndarray]:
    """Index of the class with the largest summed confidence over its machines, and the mean of its confidences."""
    if len(classes) == 1:
        return np.zeros(len(x), np.int64), np.ones(len(x))
    place = {c: k for k, c in enumerate(classes)}
    total = np.zeros((len(x), len(classes)))
    for _, a, b, w, bias in machines:
        sure = _sure(x @ np.frombuffer(w, np.float32) + bias)
        total[:, place[a]] += sure
        total[:, place[b]] += 1 - sure
    best = total.argmax(axis=1)
    return best, total[np.arange(len(x)), best] / (len(classes) - 1)


def identify_language(
    tracks: DataFrame,
    labelled: DataFrame,
    id_col: str = "track_id",
    text_col: str = "title",
    lang_col: str = "lang",
    families: Mapping[str, tuple[str, ...]] = FAMILIES,
    sample: int = SAMPLE_PER_LANGUAGE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """The language of each track's text, learned from ``labelled`` tracks (same id and text columns, and ``lang_col``).

    Track records have no language field of their own, so the labels come in a column of the labelled table. Returns the id, the
    ``carry`` columns, ``lang_pred`` (a label that occurs in ``labelled``; ``und`` for a text that is null or has no letter, and
    for all texts when nothing was learned) and ``score`` (0 to 1, confidence in the family times that within it; 0 for
    ``und``). Only the text decides. Labelled rows without a label, an id or a letter teach nothing.

    The machines learn from at most ``sample`` texts of a label, chosen by a hash of the id; predictions read every whole text,
    in place, without a shuffle. Ids are passed on: null and repeated ids keep their rows. An empty table gives no rows.
    """
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    known = labelled.filter(letter & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.xxhash64(id_col).alias("_key"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text"))
    names, machines = train(known, families, sample)
    kinds = sorted(set(names.values()))
    of_kind = {k: [lang for lang in sorted(names) if names[lang] == k] for k in kinds}
    upper = [m for m in machines if m[0] == "family"]
    lower = {k: [m for m in machines if m[0] == "language" and m[1] in of_kind[k]] for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            has_letter = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, x in features(batch.column(0)) if kinds else ():
                kind, sure = vote(x, kinds, upper)
                for k, name in enumerate(kinds):
                    rows = np.flatnonzero((kind == k) & has_letter[lo : lo + len(x)])
                    if len(rows):
                        lang, within = vote(x[rows], of_kind[name], lower[name])
                        langs[lo + rows] = np.array(of_kind[name], object)[lang]
                        scores[lo + rows] = sure[rows] * within
            columns = [batch.column(k) for k in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=batch.schema.names[2:] + ["lang_pred", "score"]
            )

    source = tracks.select(F.col(text_col).alias("_text"), letter.alias("_letter"), F.col(id_col).alias("_id"), *(F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)))
    schema = T.StructType([*source.schema.fields[2:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    back = [F.col("_id").alias(id_col), *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry))]
    return source.mapInArrow(run, schema).select(*back, "lang_pred", "score")
