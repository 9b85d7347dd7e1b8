"""Writers (SNK-1..10): Parquet tables partitioned by run columns, and the
reference's text layouts as exports.

Text exports are built with ``concat_ws`` / ``format_string`` and written
by ``write.text``; ordered exports range-partition on the order key so the
part files read back in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, partition_by=None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def keyword_text(keywords: DataFrame) -> DataFrame:
    """SNK-1: one line per document, keywords space-joined in rank order."""
    g = keywords.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("kw"))
    return g.select("doc_id", F.array_join(F.transform("kw", lambda s: s["token"]), " ").alias("line"))


def write_ordered_text(df: DataFrame, line: str, order, path: str) -> None:
    """Text export in a global order (range partitioning keeps part files ordered)."""
    df.orderBy(*order).select(line).write.mode("overwrite").text(path)


def cluster_csv(clusters: DataFrame, keep=()) -> DataFrame:
    """SNK-2 clusters.csv layout: 'id, w1 w2 ...' (``keep`` columns pass through)."""
    return clusters.select(*keep, "cluster", F.concat_ws(", ", F.col("cluster").cast("string"),
                                                         F.array_join("words", " ")).alias("line"))


def cluster_errs_csv(errs: DataFrame) -> DataFrame:
    """SNK-2 cluster_errs.csv layout: 'id, error, w1 w2 ...'."""
    return errs.select("cluster", F.concat_ws(", ", F.col("cluster").cast("string"),
                                              F.col("err_mean").cast("string"),
                                              F.array_join("words", " ")).alias("line"))


def centroid_label_lines(labels: DataFrame) -> DataFrame:
    """SNK-2 centroid_labels.csv layout: (cluster, line) with 'id, nearest words in order'."""
    g = labels.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("w"))
    return g.select("cluster", F.concat(F.col("cluster").cast("string"), F.lit(", "), F.array_join(
        F.transform("w", lambda x: x["word"].cast("string")), " ")).alias("line"))


def counts_json_lines(counts: DataFrame, key: str, value: str = "n") -> DataFrame:
    """SNK-3 as JSON lines (one object per row; the reference wrote one big object)."""
    return counts.select(F.to_json(F.struct(F.col(key).alias("k"), F.col(value).alias("n"))).alias("value"))


def coherence_json(scores: DataFrame, keys=("run",)) -> DataFrame:
    """SNK-4: per run, {"cluster": {"mean": m, "median": d}} (NaN written as NaN)."""
    return scores.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.col("cluster").cast("string"), F.struct("mean", "median"))))).alias("value"))


def write_curves(curves: DataFrame, path: str, model_cols=("embed", "variant", "kind")) -> None:
    """SNK-5: one folder per model, rows 'k mean median' sorted by k."""
    told = [F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in ("k", "mean", "median")]
    out = curves.select(*model_cols, "k", F.concat_ws(" ", *told).alias("value"))
    # dealt by range: a large model is several part files, in order
    (out.repartitionByRange(*model_cols, "k").sortWithinPartitions(*model_cols, "k").drop("k")
     .write.mode("overwrite").partitionBy(*model_cols).text(path))


def write_per_speaker(speaker_text: DataFrame, path: str) -> None:
    """SNK-7: one folder per speaker. A speaker's texts go to one task, so there is a file
    per speaker and not one per task and speaker."""
    speaker_text.select("speaker", "text").repartition("speaker").write.mode("overwrite").partitionBy("speaker").text(path)


def timeseries_nested(ts: DataFrame, clusters: DataFrame, keys=("run", "cluster")) -> DataFrame:
    """SNK-8 / D17 nested form: keys + words + scores array<struct<date, score>> (date order)."""
    k = list(keys)
    s = ts.groupBy(*k).agg(F.array_sort(F.collect_list(F.struct("date", "score"))).alias("scores"))
    return clusters.select(*k, "words").join(s, k)


def vector_text(vectors: DataFrame) -> DataFrame:
    """SNK-9: 'word f f f' lines."""
    return vectors.select(F.concat_ws(" ", F.col("word").cast("string"),
                                      F.array_join(F.transform("features", lambda x: x.cast("string")), " "))
                          .alias("value"))


def write_ranked_series(series: DataFrame, path: str) -> None:
    """SNK-10: 'x score nwords run' lines, one folder per model, in rank order (without run names, 'x score nwords')."""
    parts = ["x", "score", "nwords", *(["run"] if "run" in series.columns else [])]
    out = series.select("model", "x", F.concat_ws(" ", *(F.col(c).cast("string") for c in parts)).alias("value"))
    (out.repartitionByRange("model", "x").sortWithinPartitions("model", "x").drop("x")
     .write.mode("overwrite").partitionBy("model").text(path))


def write_series_json(series: DataFrame, path: str, files: int = 64) -> None:
    """SNK-8 in the reference's layout: files of a log line and a line with the JSON
    array of (words, scores). The clusters are dealt over ``files`` files by their
    words, so an array stays small; Parquet is the format for anything large."""
    each = series.select(F.pmod(F.xxhash64("words"), F.lit(files)).alias("part"),
                         F.to_json(F.struct(F.col("words").alias("cluster"), "scores")).alias("_json"))
    arrays = each.groupBy("part").agg(F.concat(F.lit("clusters\n["), F.array_join(F.collect_list("_json"), ", "), F.lit("]")).alias("value"))
    arrays.write.mode("overwrite").partitionBy("part").text(path)
