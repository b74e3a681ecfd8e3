"""A training corpus from ``documents``: toxic texts and near copies go, repeated passages are cut out,
benchmark passages' documents go, and what is left is mixed to target weights.

Defined cases: a null or empty text is scored, grouped, cut and sized like any other empty text, so that one
of all empty ones stays; rows that repeat are near copies, and the one of least id stays, ids that are null
last; ties of ids go by the text's hash; texts of any length are taken whole; without labels no document is
toxic (the smoothed share is a half), and without a benchmark none is contaminated; an empty table passes
through all stages; columns beside those of ``documents`` are carried through all stages but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, mixing, near_copies, suffix_dedup, toxicity
from docloom.llm.shared import table, written

#: Documents with this score at least are toxic.
TOXIC = 0.7


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from all labelled documents and keeps those that score below ``TOXIC``."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.scored(docs, model).where(F.col("score") < TOXIC).select("doc.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each group of near copies."""
    return near_copies.deduplicated(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out all bytes that strings of 200 bytes cover which occur again; sizes follow."""
    kept = suffix_dedup.without_repeats(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that share no window of words with the benchmark."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target and taken of each document."""
    return mixing.mixed(docs).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", non_toxic),
    ("simhash_near_dedup", one_of_each),
    ("suffix_array_dedup", without_repeats),
    ("benchmark_decontamination", uncontaminated),
    ("mixing", mixed),
]
#: The classifier, the fingerprints' components and the suffix sort are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each stage's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
