"""The training-data pipeline: five stages over documents, each written and read again before the next one.

toxicity drops the documents that the machine rejects; near_duplicates keeps one document (the smallest doc_id) of each group of n-gram
Jaccard links; decontamination drops documents that hold a benchmark item; secrets masks secrets in the texts; tokens adds the
SentencePiece ids. Null and empty texts pass every stage, as do extra columns but ids, n_ids and round_trip, which the last stage sets. Rows with a null doc_id pass, and rows that
repeat a doc_id stay or go together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.llm.common import materialize, table
from parley.llm.decontaminate import clean
from parley.llm.ngram_join import ngram_components
from parley.llm.pieces import encode_table
from parley.llm.secret_scan import redact
from parley.llm.toxicity import reject


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the machine scores as toxic. Null and empty texts score as texts without an insult and stay; repeated rows go or stay alike."""
    return reject(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles at a similarity of 0.8; only the ids of rows that go are joined with the documents."""
    groups = ngram_components(docs, n=5, percent=80)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a window is like a benchmark item. Null, empty and blank texts are like none and stay."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets; all rows stay, null and empty texts as they are. n_chars follows the masked text."""
    return redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_ids, ids and round_trip; null and empty texts have no ids. A caller's own columns of these three names are replaced, all others pass."""
    return encode_table(docs, keep=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("tokens", tokens),
]

#: The first stage's machine can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs
