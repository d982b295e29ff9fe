"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, personal data, mixing.

Each stage gets the documents its predecessor kept, decides over all of them and hands on the columns of documents;
the last returns the documents with the mix's copies. ``run`` writes each stage's result as Parquet in the shared folder and reads it again, so a
lost executor costs at most the stage that is running. Parts of the training-data subpackage do the work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenelake.llm import decontam_pigeonhole, entropy_mix, pii_boost, quality_ledger, simhash_wide
from scenelake.llm.common import discard, materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy v1 keeps."""
    return quality_ledger.apply_policy(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each component of texts similar by 0.8 in five-word shingles."""
    return simhash_wide.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its budget of edits."""
    return decontam_pigeonhole.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text."""
    out = pii_boost.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their size, their source's size and target, and how often and how many words the mix takes."""
    return entropy_mix.mix_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
]

#: SimHash, edit distances and boosted trees are not SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(docs)
        docs = done
    return docs
