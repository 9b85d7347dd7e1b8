"""Driver tables and the inputs the jobs derive from them.

Every derived input is a DataFrame expression over the driver tables, so
its size grows with them; nothing here is a fixed, made-up sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.text import clean_text
from topicloom.session import materialised

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. A file of one row group is one task whatever the split
    size; a session that reads such files (bench, tests) may ask for more by
    ``spark.topicloom.inputPartitions``. Unset, nothing is redistributed."""
    n = spark.conf.get("spark.topicloom.inputPartitions", None)
    if n:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").repartition(int(n))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def cleaned_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, text): the corpus after JOB-2a."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "lang", "source", clean_text(F.col("text")).alias("text"))


def stored_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cleaned_corpus`` as a table of its own, for queries that read it more than once."""
    return materialised(cleaned_corpus(spark, sf_dir), "corpus")


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as the reference pipeline sees it: JOB-2a over documents."""
    return cleaned_corpus(spark, sf_dir).select("doc_id", "text")
