"""Five stages from raw documents to a training order; each takes what its predecessor kept.

Each stage is (spark, docs, folder) -> DataFrame, written as Parquet and read again before the next.
All but the last return the columns of ``documents``; the last one adds where a document is due.
A stage's last query is run by its caller, so the stages set the session's Arrow portions for good.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallybook.llm.curriculum import curriculum
from tallybook.llm.decontamination import decontaminated
from tallybook.llm.minhash_forest import deduplicated
from tallybook.llm.passages import without_repeats
from tallybook.llm.quality import accepted
from tallybook.llm.shared import in_portions, scratch_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that the classifier rejects as poor or toxic."""
    in_portions(spark)
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id."""
    in_portions(spark)
    return deduplicated(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that another document keeps."""
    in_portions(spark)
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that contain a benchmark item."""
    in_portions(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each time that the mix takes words of a document."""
    in_portions(spark)
    return curriculum(docs)


STAGES = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing_to_weights", mix),
]

# The classifier, the signatures and the fingerprints are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, through tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{scratch_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
    return docs
