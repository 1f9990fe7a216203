"""From raw documents to packed sequences: five stages of palimpsest.llm, each on all its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``.
No stage has SQL for its rows as a whole (language ID learns a classifier), so ``ORACLE_SQL`` is None. The tests look at
columns, falling counts and a few ids of the stages; no stage's kept rows are held against brute force yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.best_fit import pack
from palimpsest.llm.common import table
from palimpsest.llm.jaccard import keep_first
from palimpsest.llm.langid import keep_identified
from palimpsest.llm.line_dedup import dedup_lines
from palimpsest.llm.quality import keep_quality
from palimpsest.plans.lineage import cut


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can not be told go: no letters, or the margin is too narrow."""
    return keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie outside their group's thresholds go."""
    return keep_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 40 characters found in five documents stay in one; every document stays, and where it has
    a column n_chars, that follows its text."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("n_dropped") > 0, F.char_length("text").cast(kind)) if "n_dropped" not in docs.columns else F.lit(None)
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")).cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of 4,096 tokens."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", best_fit_packing),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Between stages the documents are written to the checkpoint folder, as every stage
    reads its documents more than once."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs)
    return docs
