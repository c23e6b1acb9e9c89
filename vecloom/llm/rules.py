"""Learned quality rules: a decision list of threshold conjunctions, in DataFrame operations only.

Sequential covering: a rule is grown on two thirds of the labelled tracks, one threshold at a time by information gain, pruned on
the rest, and the tracks it covers are set aside. Each step is one grouped count over binned statistics, so the driver sees
counts of (statistic, bin) and nothing else. The list becomes one CASE expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.session import materialize

#: labelled tracks the rules are learned from, at most (chosen by a hash of the id)
SAMPLE = 20_000
#: thresholds of a statistic
BINS = 24
MOST_RULES, MOST_CONDITIONS = 6, 3
#: a rule stays if, on the tracks it was pruned on, it is right so often, and surely (one-sided 95 percent) at least so often:
#: five tracks without an error are enough, whatever the number of labels
LEAST_PRECISION, LEAST_SURE, SURE_Z = 0.7, 0.64, 1.645

LEAST_WORDS = 50
SPACE = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: statistics that rules may test, made of the base ones
STATISTICS = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words")),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest(F.lit(1), F.col("n_words")),
    "n_dup_lines": lambda: F.col("n_dup_lines").cast("double"),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest(F.lit(1), F.col("n_words")),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: equal windows stand side by side once sorted with their places."""

    def of_sorted(s: Column) -> Column:
        both = F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1),
            F.slice(s, F.lit(2), F.size(s) - 1),
            lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return let(
            F.flatten(both),
            lambda at: F.size(F.array_distinct(F.concat(at, F.transform(at, lambda i: i + 1), F.transform(at, lambda i: i + 2)))),
        )

    return let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), of_sorted)


def repeated_words(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more in the text."""

    def of_windows(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_covered(windows))

    def joined(parts: list[Column]) -> Column:
        blank = F.lit(" ")
        return F.zip_with(F.zip_with(parts[0], parts[1], lambda a, b: F.concat(a, blank, b)), parts[2], lambda a, b: F.concat(a, blank, b))

    def of_words(w: Column) -> Column:
        parts = [F.slice(w, F.lit(k), F.size(w) - 2) for k in (1, 2, 3)]
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(joined(parts), of_windows))

    return let(words, of_words)


def statistics(text: Column) -> list[Column]:
    """The base statistics of a text as long columns."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(words, lambda w: F.struct(F.size(w).alias("n"), F.char_length(F.array_join(w, "")).alias("c"), repeated_words(w).alias("r")))
    return [
        counted.alias("_words"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
    ]


def with_statistics(tracks: DataFrame) -> DataFrame:
    """``tracks`` (with ``_text``) with the base statistics and ``base_failed`` instead of the text."""
    others = [c for c in tracks.columns if c != "_text"]
    found = tracks.select(*others, *statistics(F.col("_text"))).select(
        *others,
        F.col("_words")["n"].cast("long").alias("n_words"),
        F.col("_words")["c"].cast("long").alias("word_chars"),
        "n_symbols",
        "n_dup_lines",
        F.col("_words")["r"].cast("long").alias("n_repeat_words"),
    )
    return found.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, limit = STATISTICS[self.statistic](), F.lit(self.threshold)
        return value > limit if self.above else value <= limit

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:g}"


Rule = tuple[Condition, ...]


def _all(conditions: Rule) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's gain of going from p0 bad and n0 good tracks to p and n."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p > 0 and p0 > 0 else 0.0


def _grow(rows: DataFrame, limits: dict[str, list[float]]) -> Rule:
    names = list(limits)
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS:
        # bin b holds values above b of the statistic's thresholds
        bins = F.array(*(sum((STATISTICS[s]() > t).cast("int") for t in limits[s]) + F.lit(0) for s in names))
        counts = (
            rows.filter(_all(rule)).select("_bad", F.posexplode(bins).alias("_s", "_b")).groupBy("_s", "_b")
            .agg(F.sum("_bad").alias("p"), F.sum(1 - F.col("_bad")).alias("n")).collect()
        )
        p0 = sum(r["p"] for r in counts if r["_s"] == 0)
        n0 = sum(r["n"] for r in counts if r["_s"] == 0)
        best, chosen = 1e-9, None
        for k, name in enumerate(names):
            own = {r["_b"]: (r["p"], r["n"]) for r in counts if r["_s"] == k}
            p = n = 0
            for b, limit in enumerate(limits[name]):
                p, n = p + own.get(b, (0, 0))[0], n + own.get(b, (0, 0))[1]
                for above, bad, good in ((False, p, n), (True, p0 - p, n0 - n)):
                    gain = _gain(bad, good, p0, n0)
                    if gain > best:
                        best, chosen = gain, Condition(name, above, limit)
        if chosen is None or chosen in rule:
            break
        rule += (chosen,)
        if n0 == 0:
            break
    return rule


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule that does best on other tracks, with the bad and good ones it covers there."""
    counts = rows.agg(
        *(F.sum(F.when(_all(rule[:k]), F.col("_bad")).otherwise(0)).alias(f"p{k}") for k in range(1, len(rule) + 1)),
        *(F.sum(F.when(_all(rule[:k]), 1 - F.col("_bad")).otherwise(0)).alias(f"n{k}") for k in range(1, len(rule) + 1)),
    ).first()
    scored = [((counts[f"p{k}"] or 0), (counts[f"n{k}"] or 0), k) for k in range(1, len(rule) + 1)]
    p, n, k = max(scored, key=lambda s: ((s[0] - s[1]) / max(1, s[0] + s[1]), -s[2]))
    return rule[:k], p, n


def sure_precision(p: int, n: int) -> float:
    """Wilson's lower confidence bound of the precision of p right and n wrong verdicts."""
    total, z = p + n, SURE_Z**2
    if not total:
        return 0.0
    share = p / total
    return (share + z / (2 * total) - SURE_Z * math.sqrt(share * (1 - share) / total + z / (4 * total**2))) / (1 + z / total)


def learn_rules(labelled: DataFrame) -> list[Rule]:
    """The decision list for rows with the base statistics, ``_id`` and ``_bad`` (1: reject, 0: keep).

    ``labelled`` is bounded by the caller; it is written once and counted a few times for each condition. Rows that fail the base
    are left out, as no rule will judge their like.
    """
    rows = materialize(labelled.withColumn("_fold", F.pmod(F.xxhash64("_id"), F.lit(3))), "labelled-statistics")
    # only once the statistics are written: before, this would be pushed below the join and work them out for every track
    rows = every = rows.filter(~F.col("base_failed"))
    shares = [k / (BINS + 1) for k in range(1, BINS + 1)]
    quantiles = rows.agg(*(F.percentile_approx(STATISTICS[s](), shares, 10_000).alias(s) for s in STATISTICS)).first()
    limits = {s: sorted(set(quantiles[s] or [])) for s in STATISTICS}
    if not all(limits.values()):
        return []
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        grown = _grow(rows.filter("_fold <> 0"), limits)
        if not grown:
            break
        rule, p, n = _prune(rows.filter("_fold = 0"), grown)
        if p < LEAST_PRECISION * (p + n) or sure_precision(p, n) < LEAST_SURE:
            break
        rules.append(rule)
        rows = rows.filter(~_all(rule))
    return _with_margins(every, rules)


def _with_margins(rows: DataFrame, rules: list[Rule]) -> list[Rule]:
    """The same rules with each threshold halfway to the next value that some track has: no track changes sides."""
    conditions = sorted({c for rule in rules for c in rule}, key=str)
    if not conditions:
        return rules
    nexts = rows.agg(*(F.min(F.when(STATISTICS[c.statistic]() > c.threshold, STATISTICS[c.statistic]())).alias(f"c{k}") for k, c in enumerate(conditions)))
    found = dict(zip(conditions, nexts.first(), strict=True))
    return [tuple(replace(c, threshold=c.threshold if found[c] is None else (c.threshold + found[c]) / 2) for c in rule) for rule in rules]


def verdict(rules: list[Rule]) -> Column:
    """Text of the first rule that holds; null where none does."""
    chain = F.lit(None).cast("string")
    for rule in reversed(rules):
        chain = F.when(_all(rule), F.lit(" AND ".join(map(str, rule)))).otherwise(chain)
    return chain


def apply_quality_rules(
    tracks: DataFrame,
    labels: DataFrame,
    id_col: str = "track_id",
    text_col: str = "title",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> DataFrame:
    """Quality statistics of track texts and the verdict of rules learned from ``labels`` (id and 0/1 ``label_col``).

    Track records have no quality field, so the labels come as a table of their own. Returns the id, ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed`` (under 50 words, or over half of them in
    repeated three-word windows), ``rule`` (the learned rule that rejects, null if none) and ``kept``.

    A null text counts as empty: no words, so it fails the base. Labels that are null, or whose id is null or missing in
    ``tracks``, teach nothing; without labels no rule is learned and the base alone decides. Rows are judged one by one, so
    repeated and null ids keep their rows; other columns are not read. An empty table gives no rows. Texts of any length are
    read whole. A value equal to a threshold is not above it; of equally good conditions the first statistic, then the lowest
    threshold is taken.

    The rules see at most ``sample`` labelled tracks, chosen by a hash of the id; the verdict is a CASE expression over columns of
    the row, so the table is read once and never shuffled.
    """
    source = tracks.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    known = labels.select(F.col(id_col).alias("_id"), (1 - F.col(label_col).cast("int")).alias("_bad")).filter("_bad IN (0, 1) AND _id IS NOT NULL")
    chosen = known.distinct().orderBy(F.xxhash64("_id"), "_id", "_bad").limit(sample)
    # at most ``sample`` ids
    rules = learn_rules(with_statistics(source.join(F.broadcast(chosen), "_id")))
    judged = with_statistics(source).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return judged.select(
        F.col("_id").alias(id_col), *BASE, "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept")
    )
