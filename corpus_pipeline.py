"""From raw documents to packed training bins, one written table per stage.

Every stage gets all rows that the stage before kept and, but for the last,
returns rows with the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsurvey.llm import exact_dedup, language_id, ngram_join, packing, toxicity
from gridsurvey.llm.common import fold, read, staged

#: A text this far from telling two languages apart counts as none.
LEAST_LANGUAGE_SCORE = 0.005


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a toxicity below one half, by a machine learned from the labels outside the held-out fold."""
    labels = read(spark, sf_dir, "labels").filter(fold(F.col("doc_id"), 5) != 0)
    machine = toxicity.learn_toxicity(docs, labels)
    return docs.filter(toxicity.score_toxicity(spark, F.col("text"), machine) < 0.5)


def drop_unknown_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and a language that its profile tells from the others."""
    profiles = language_id.learn_profiles(docs.filter(fold(F.col("doc_id"), 3) != 1))
    found = language_id.predict_language(spark, F.col("text"), profiles)
    known = docs.withColumn("__found", found)
    known = known.filter((F.col("__found.lang_pred") != language_id.UNDETERMINED) & (F.col("__found.score") >= LEAST_LANGUAGE_SCORE))
    return known.select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the largest id of every text."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id of every group of near duplicates."""
    return ngram_join.drop_near_duplicates(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document lies in bins that repeat no source and no text."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("packing", pack_bins),
]

#: SQL has neither the factorization machine nor the profiles, signatures and best fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
