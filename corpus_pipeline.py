"""A corpus pipeline of five stages over ``documents``.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; only ``n_chars`` follows a text that the
personal-data stage has changed.

Defined cases, by stage. Quality rules: a null, empty or short text fails the
base rules and goes, whatever its id. Near-duplicates: rows without an id all
stay, repeated rows of one id are one document, of equal documents that with
the smallest id stays; texts without words are linked with nothing. Benchmark
decontamination: a null or empty item or text meets nothing. Personal data:
each row keeps its place, texts without spans stay as they are, null stays
null. Packing: every row is packed, equal ones each. An empty table passes all
stages; columns beyond those named (null ones, or ones that clash with names
used inside a stage) go through unread up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from topicloom.llm import decontaminate, packing, pii, quality, sketch
from topicloom.llm.common import bounded_batches, dropped, written

#: zstandard ratios, n-gram tables and sketches aren't SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a compression band reject go."""
    bounded_batches(spark)
    return quality.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays (five-word shingles, similarity 0.8 or more)."""
    bounded_batches(spark)
    return sketch.kept(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    bounded_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it are replaced in the texts."""
    bounded_batches(spark)
    return pii.sanitised(docs, length_col="n_chars", d=pii.EVERYWHERE)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    bounded_batches(spark)
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)  # no later stage reads it
        before = docs
    return docs
