"""The registered queries of the thirteen operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm.common import bounded_batches

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op6_compression_bands")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import quality

    docs = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", *(F.col(f"quality.{c}") for c in (
        *quality.BASE, "whole_ratio", "n_chunks", "n_bad_chunks", "base_failed", "band_failed", "kept")))


@query("op10_fast_similarity_sketch")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import sketch

    return sketch.classes(table(spark, sf_dir, "documents"), s=sketch.CONTRACT)


@query("op1_spaced_seeds")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import decontaminate

    return decontaminate.marked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_disclosure_sanitiser")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import pii

    found = pii.spans(table(spark, sf_dir, "documents"), d=pii.EVERYWHERE)
    kinds = F.transform("base", lambda s: s["kind"])
    # a lambda's second parameter would be the place in the array
    n = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return found.select("doc_id", *n, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"),
                        pii.spelled(F.col("base"), F.col("terms")).alias("spans"))


@query("op3_swap_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import packing

    return packing.packed(table(spark, sf_dir, "documents"))


@query("op7_weighted_hash_tree")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import sharding

    return sharding.sharded(table(spark, sf_dir, "documents"), sharding.tree(4, 2, 5))


@query("op2_segment_reassembly")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op5_chat_machine", """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '␛', '␛0'),
    '<</SYS>>', '␛A'), '</s>', '␛A'), '<<SYS>>', '␛A'), '<s>', '␛A'), '[/INST]', '␛A'), '[/ROLE]', '␛A'),
    '[INST]', '␛A'), '[OUT]', '␛A'), '[ROLE]', '␛A'), '[TEXT]', '␛A') AS safe,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 19 + length(role) END AS marks,
    CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END AS code FROM turns),
whole AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(length(safe) + marks))::BIGINT AS formatted_chars, string_agg(code, '' ORDER BY turn NULLS FIRST, role, text) AS codes
  FROM marked GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars,
  regexp_full_match(codes, 's?(u(au)*a?)?') AS valid, regexp_full_match(codes, 's?u(au)*a') AS complete FROM whole""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import chat

    words = "</s>[INST] ok [/INST]"
    seven = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(words).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(seven)
    out = chat.formatted(turns).withColumn("turns", chat.read_back(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("segments")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                      F.length("formatted").cast("bigint").alias("formatted_chars"), "valid", "complete")


@query("op9_subword_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import subword

    return subword.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality"))


@query("op4_site_style_tree")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import html_tree

    return html_tree.extracted(table(spark, sf_dir, "pages"), p=html_tree.ALL_HOSTS)


@query("op11_lyndon_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import periodic

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("given"))
    found = periodic.detected(docs.withColumn("text", periodic.looped(F.col("doc_id"), F.col("given"))))
    best = found.withColumn("best", periodic.longest(F.col("runs")))
    length, period = -F.col("best.minus"), F.col("best.period")
    return best.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
                       period.alias("period"), F.floor(1000 * length / period).alias("exponent_milli"),
                       F.sha2(periodic.told(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_branch_and_bound", """
WITH good AS (
  SELECT row_number() OVER () AS key, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.key, q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.key ORDER BY list_inner_product(q.x, c.x) DESC, c.vec_id NULLS LAST) AS rank
  FROM good q JOIN good c ON q.key <> c.key WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM met WHERE rank <= 20""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import topk

    return topk.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op13_bit_sliced_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from topicloom.llm import whitening

    rows = whitening.components(*whitening.whitened(table(spark, sf_dir, "embeddings")))
    return rows.withColumn("deviation", F.col("deviation").cast("bigint"))
