"""A training corpus from `documents`, in five stages: bad documents go, then exact and near copies, secrets are masked,
and what is left is packed into sequences.

A stage takes the rows that the one before it kept, and its decisions take effect: all but the last return the columns
of `documents`, extra ones of any name included. In every stage a null text counts as empty, very long texts are read
whole, and an empty table gives none. Rows with a null id are never near copies. Rows that repeat id and text are exact
copies, of which one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm import exact_dedup, near_dedup, packing, quality, secrets
from quarrylight.llm.common import new_path, remainder, removed, written
from quarrylight.llm.registry import BYTE_BPE, vocabulary
from quarrylight.session import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labels of a fifth of the ids are never learnt from."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    rows = docs.select(F.struct("*").alias("row"), "text")
    return quality.with_score(rows, model).where("predicted = 1").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest id."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the row with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets masked; `n_chars` follows the text where that changes."""
    rows = secrets.redact(docs.select(F.struct("*").alias("row"), "text"))
    n = F.when(F.col("text").eqNullSafe(F.col("row.text")), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    made = {"text": F.col("text"), "n_chars": n}
    return rows.select(*(made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: one row per piece, with its ids."""
    return packing.pack(docs, vocabulary(BYTE_BPE), end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("minhash_near_dedup", near_copies),
    ("secret_scan", secret_scan),
    ("packing", pack),
]

#: The first stage applies a trained model, which SQL can't express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each result written as Parquet and read again; a result goes when the next one is there."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
