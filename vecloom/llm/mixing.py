"""Mixing tracks to target domain weights with soft membership, in DataFrame operations only.

A naive Bayes classifier, counted from a labelled table, gives each track a posterior over the domains. Nonnegative rates are
then fitted by Newton steps until the expected tokens of each domain match the targets. A step needs one row of sums over all
tracks; the rates never leave the executors.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.session import materialize

#: labelled tracks of a domain that the classifier counts, at most
SAMPLE_PER_DOMAIN = 5000
#: hashed words the classifier tells apart; its table has this many rows at most, so it is broadcast
BUCKETS = 1 << 14
#: words of evidence that a posterior rests on at most; longer texts count as this many average words
EVIDENCE = 100
#: Newton steps at most; a miss of this share of all tokens counts as met
STEPS, TOLERANCE = 100, 1e-5
#: what is added to the second moments in the first step, a tenth of it in each next one, and at least
DAMPING = (1e-3, 1e-13)


def words_of(text: Column) -> Column:
    """Words between white space of the text lower-cased for A-Z; null has none."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def word_weights(labelled: DataFrame, domains: list[str]) -> DataFrame:
    """``_bucket, _w0 .. _wK``: log-likelihood of a hashed word in each domain, less the mean over the domains.

    ``labelled`` has ``_text`` and ``_domain``. Counts get one added; a bucket that no labelled text has is not listed.
    """
    words = labelled.select("_domain", F.explode(words_of(F.col("_text"))).alias("_word"))
    words = words.select("_domain", _bucket(F.col("_word")).alias("_bucket"))
    counts = words.groupBy("_bucket").agg(
        *(F.count(F.when(F.col("_domain") == d, True)).alias(f"_n{k}") for k, d in enumerate(domains))
    )
    counts = materialize(counts, "word-counts")
    totals = counts.agg(*(F.sum(f"_n{k}").alias(f"_n{k}") for k in range(len(domains)))).first()
    logs = [F.log((F.col(f"_n{k}") + 1) / F.lit(float((totals[k] or 0) + BUCKETS))) for k in range(len(domains))]
    mean = sum(logs[1:], logs[0]) / len(domains)
    return counts.select("_bucket", *((log - mean).alias(f"_w{k}") for k, log in enumerate(logs)))


def posteriors(tracks: DataFrame, weights: DataFrame, n_domains: int) -> DataFrame:
    """``_id, n_tokens, _p0 .. _pK``; a track without words has the same posterior for every domain."""
    words = tracks.select("_id", F.explode_outer(words_of(F.col("_text"))).alias("_word"))
    scored = words.select("_id", "_word", _bucket(F.col("_word")).alias("_bucket")).join(F.broadcast(weights), "_bucket", "left")
    sums = scored.groupBy("_id").agg(
        F.count("_word").alias("n_tokens"), *(F.coalesce(F.sum(f"_w{k}"), F.lit(0.0)).alias(f"_s{k}") for k in range(n_domains))
    )
    share = F.least(F.lit(float(EVIDENCE)), F.col("n_tokens")) / F.greatest(F.lit(1.0), F.col("n_tokens"))
    logits = [F.col(f"_s{k}") * share for k in range(n_domains)]
    top = F.greatest(*logits) if n_domains > 1 else logits[0]
    raised = sums.select("_id", "n_tokens", *(F.exp(logit - top).alias(f"_e{k}") for k, logit in enumerate(logits)))
    total = sum((F.col(f"_e{k}") for k in range(1, n_domains)), F.col("_e0"))
    return raised.select("_id", "n_tokens", *((F.col(f"_e{k}") / total).alias(f"_p{k}") for k in range(n_domains)))


def fit_rates(table: DataFrame, targets: list[float]) -> Column:
    """The rate as a column of ``n_tokens, _p0 .. _pK``.

    Of all rates of 0 or more that meet the domain totals, those with the least token-weighted squared distance from 1 are
    ``max(0, 1 + posterior . lambda)``. Lambda is found by damped Newton steps on the dual: a step needs the totals and the second
    moments of the rows whose rate is above 0. Out of reach, the totals go to the nearest ones in the norm of the second moments of
    all rows. Totals that miss the targets by more than ``TOLERANCE`` of all tokens raise a warning that names the misses.
    """
    k = len(targets)
    p = [F.col(f"_p{i}") for i in range(k)]
    n = F.col("n_tokens")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    wanted = np.array(targets, float)

    def dot(by: np.ndarray) -> Column:
        return sum((p[i] * float(by[i]) for i in range(1, k)), p[0] * float(by[0]))

    def look(by: np.ndarray, toward: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        """Totals, second moments of rows in use, tokens by squared rate, least ``posterior . toward``."""
        rate = F.greatest(F.lit(0.0), dot(by) + 1.0)
        rows = table.filter(n > 0).select(n, *p, rate.alias("_rate"), dot(toward).alias("_toward"))
        used = F.when(F.col("_rate") > 0, n).otherwise(F.lit(0))
        found = rows.agg(
            *(F.sum(n * F.col("_rate") * p[i]).alias(f"t{i}") for i in range(k)),
            *(F.sum(used * p[i] * p[j]).alias(f"m{i}_{j}") for i, j in pairs),
            F.sum(n * F.col("_rate") * F.col("_rate")).alias("square"),
            F.min("_toward").alias("least"),
        ).first()
        gram = np.zeros((k, k))
        for i, j in pairs:
            gram[i, j] = gram[j, i] = float(found[f"m{i}_{j}"] or 0)
        return np.array([float(found[f"t{i}"] or 0) for i in range(k)]), gram, float(found["square"] or 0), float(found["least"] or 0)

    at = np.zeros(k)
    totals, gram, square, _ = look(at, at)
    scale = wanted.sum() or totals.sum() or 1.0
    values, vectors = np.linalg.eigh(gram / scale)
    apart = values > 1e-10 * values.max()
    # in these axes the second moments of all rows are 1; along the others no rate changes any total
    axes = vectors[:, apart] / np.sqrt(values[apart])
    goal, damping, before = wanted / scale, DAMPING[0], np.inf
    height = square / scale / 2
    for _ in range(STEPS):
        miss = totals / scale - goal
        slope = axes.T @ miss
        size = float(np.sqrt(slope @ slope))
        if np.abs(miss).max() <= TOLERANCE or size <= 1e-12:
            break
        step = axes @ -np.linalg.solve(axes.T @ gram @ axes / scale + damping * np.eye(len(slope)), slope)
        damping, toward, part = max(damping / 10, DAMPING[1]), axes @ slope, 1.0
        while True:
            totals, gram, square, least = look(at + part * step, toward)
            new = square / scale / 2 - goal @ (at + part * step)
            if new <= height + 1e-4 * part * (miss @ step) or part < 1e-6:
                break
            part /= 2
        at, height = at + part * step, new
        # met targets are a mean of posteriors, so none lies on the far side of them: if all do, the targets are out of reach
        if least > goal @ toward and abs(before - size) <= TOLERANCE * size:
            break
        before = size
    miss = totals - wanted
    if np.abs(miss).max() > TOLERANCE * scale:
        warnings.warn(f"rates miss the target tokens {wanted.tolist()} by {miss.tolist()}", stacklevel=2)
    return F.greatest(F.lit(0.0), dot(at) + 1.0)


def mix_to_targets(
    tracks: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float],
    id_col: str = "track_id",
    text_col: str = "title",
    domain_col: str = "genre_top",
    tokens: float | None = None,
    sample: int = SAMPLE_PER_DOMAIN,
) -> DataFrame:
    """Sampling rates of tracks so that the expected tokens of each domain (genre) match ``targets``.

    ``labels`` (id and ``domain_col``) names the domain of some tracks; ``targets`` gives each domain its share of ``tokens``
    (default: all tokens of the table, so rates average 1). Returns the id, ``n_tokens`` (words of the whole text),
    ``posterior`` (map of domain to probability) and ``rate``: how often to take the track in expectation, 0 or more. Expected
    totals are ``sum(rate * n_tokens * posterior)``; they match the targets unless no nonnegative rates can; a warning then names the misses.

    The classifier counts at most ``sample`` labelled tracks of a domain, chosen by a hash of the id; everything else covers all
    tracks. Labels that are null or not in ``targets``, and label rows with a null id, are ignored; without any label all
    posteriors are equal. Null and empty texts have no tokens, equal posteriors and a rate that changes no total. Rows that
    repeat an id are one track whose tokens add up; rows with a null id likewise share one rate. Other columns are not read. An
    empty table gives no rows.
    """
    domains = sorted(targets)
    if not domains or min(targets.values()) < 0 or sum(targets.values()) <= 0:
        raise ValueError("targets must name domains with nonnegative shares, some above 0")
    source = tracks.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = labels.select(F.col(id_col).alias("_id"), F.col(domain_col).alias("_domain")).filter(F.col("_domain").isin(domains)).dropna().distinct()
    turn = Window.partitionBy("_domain").orderBy(F.xxhash64("_id"), "_id")
    known = known.join(source.select("_id").distinct(), "_id", "left_semi")
    chosen = known.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= sample).drop("_turn")
    # at most ``sample`` ids for each domain
    weights = word_weights(source.join(F.broadcast(chosen), "_id"), domains)
    table = materialize(posteriors(source, weights, len(domains)), "posteriors")
    total = tokens if tokens is not None else float(table.agg(F.sum("n_tokens")).first()[0] or 0)
    scale = total / sum(targets.values())
    rate = fit_rates(table, [targets[d] * scale for d in domains])
    shares = F.create_map(*(c for k, d in enumerate(domains) for c in (F.lit(d), F.col(f"_p{k}"))))
    return table.select(F.col("_id").alias(id_col), "n_tokens", shares.alias("posterior"), rate.alias("rate"))
