"""A training corpus from ``documents``: language, near-copies, benchmark passages, personal data, mixture rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.language import UNDETERMINED, identify_language
from vecloom.llm.minhash import near_duplicates
from vecloom.llm.pii import personal_data
from vecloom.llm.queries import mixture
from vecloom.llm.winnow import mark_contamination
from vecloom.plans.registry import table
from vecloom.session import drop_table, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: confidence below which a language isn't taken
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; those without a label get the predicted one."""
    others = ("text", "lang", "source", "n_chars")
    found = identify_language(docs, docs, "doc_id", "text", "lang", carry=others)
    taken = found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return taken.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies; documents without an id all stay.

    Rows are judged, not ids: rows that repeat an id with different texts are documents of their own. The smallest id stays, of one
    id the smallest SHA-256 of the text, and of equal id and text the smallest other columns.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().filter("count > 1").isEmpty():
        first = near_duplicates(docs, "doc_id", "text").filter(F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id")
        chosen = docs.join(first, "doc_id", "left_semi").select(*COLUMNS)
    else:
        key = F.struct("doc_id", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("hash"))
        keyed = named.withColumn("_row", key)
        first = near_duplicates(keyed, "_row", "text").filter("kept").select("_row").distinct()
        single = keyed.groupBy("_row").agg(F.min(F.struct("lang", "source", "n_chars", "text", "doc_id")).alias("_doc"))
        chosen = single.join(first, "_row", "left_semi").select("_doc.*").select(*COLUMNS)
    return chosen.unionByName(docs.filter(F.col("doc_id").isNull()).select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't repeat the benchmark."""
    others = ("text", "lang", "source", "n_chars")
    marked = mark_contamination(docs, table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", carry=others)
    return marked.filter(~F.col("contaminated")).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by the kind it is."""
    found = personal_data(docs, "doc_id", "text", carry=("lang", "source", "n_chars"))
    masked = found.withColumn("n_chars", F.when(F.size("spans") > 0, F.char_length("masked").cast("long")).otherwise(F.col("n_chars")))
    return masked.withColumnRenamed("masked", "text").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rates that bring the corpus to the target mixture."""
    return mixture(docs, table(spark, sf_dir, "labels"))


STAGES = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", mask_personal_data),
    ("mixture", mix),
]

# learned models and near-copies over many stages are beyond SQL; the tests run each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Columns beyond the five of documents are dropped by the first; a stage's table goes once the next is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_table(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
