"""Word-vector operators (JOB-4, ORD-2, AGG-11..13, JN-2/3/9/10, SET-1).

Nearest words per centroid (JN-10 + ORD-2) scores every word against every
centroid, which is V x k work. It runs as ``mapInPandas``: each Arrow batch
meets the centroid matrix in blocks of bounded size, one BLAS product per
block, and a task keeps only its running top-N per centroid over all its
batches. The exact top-N per centroid is then a window over at most
(tasks x N) rows per centroid. No V x k rows are ever materialised or
shuffled. The k x dim matrix of centroids is a model and goes to every task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions import vectors as V

RANK_DECIMALS = 9


def mean_vectors(vectors: DataFrame, key: str = "label", features: str = "features",
                 out: str = "centroid") -> DataFrame:
    """(key, centroid array<double>): the component-wise mean per key, one
    partial sum per task and key."""
    v = vectors.select(key, array_to_vector(V.as_double(F.col(features))).alias("_v"))
    return v.groupBy(key).agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias(out))


def _top(scores: np.ndarray, words: np.ndarray, n: int):
    """(row numbers, scores) of the n best per column: lowest rounded score, then word."""
    rounded = np.round(scores, RANK_DECIMALS)
    for j in range(scores.shape[1]):
        column = rounded[:, j]
        at = np.arange(len(column))
        if len(column) > n:  # all that reach the n-th score, then ties by word
            at = np.flatnonzero(column <= np.partition(column, n - 1)[n - 1])
        yield j, at[np.lexsort((words[at], column[at]))[:n]]


def nearest_words(vectors: DataFrame, centroids: DataFrame, word: str = "word",
                  features: str = "features", cluster: str = "cluster", centroid: str = "centroid",
                  top: int = 10, dist: str = "cosine", block: int = 512) -> DataFrame:
    """(cluster, rank, word, score): the ``top`` closest words of each centroid.

    cosine: highest cosine similarity first (0 for a zero vector);
    euclidean: smallest distance first (the reference took the farthest;
    fixed). Ties on the score at 1e-9 break by word ascending. ``block``
    centroids are worked on at a time.
    """
    if dist not in ("cosine", "euclidean"):
        raise ValueError("dist must be 'cosine' or 'euclidean'")
    rows = centroids.select(cluster, centroid).orderBy(cluster).collect()
    ids = [r[0] for r in rows]
    matrix = np.array([r[1] for r in rows], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))
    word_type = vectors.schema[word].dataType
    ctype = centroids.schema[cluster].dataType
    schema = T.StructType([T.StructField(cluster, ctype), T.StructField(word, word_type),
                           T.StructField("score", T.DoubleType())])
    cosine = dist == "cosine"
    N = int(top)

    def scored(x, c):
        if cosine:
            size = np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(c, axis=1))
            return -np.divide(x @ c.T, size, out=np.zeros_like(size), where=size > 0)
        # the product form loses digits where vectors are close, so differences are taken per centroid
        return np.stack([np.sqrt(((x - one) ** 2).sum(axis=1)) for one in c], axis=1)

    def part(batches):
        cids, cm = shared.value
        best: dict[int, tuple] = {}
        for pdf in batches:
            if not len(pdf) or not len(cids):
                continue
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[features].to_numpy()])
            words = pdf[word].to_numpy()
            for first in range(0, len(cids), block):
                s = scored(x, cm[first:first + block])
                for j, at in _top(s, words, N):
                    w, v = words[at], s[at, j]
                    if first + j in best:
                        w, v = np.concatenate([best[first + j][0], w]), np.concatenate([best[first + j][1], v])
                        keep = np.lexsort((w, np.round(v, RANK_DECIMALS)))[:N]
                        w, v = w[keep], v[keep]
                    best[first + j] = (w, v)
        for j, (w, v) in best.items():
            yield pd.DataFrame({cluster: [cids[j]] * len(w), word: w, "score": -v if cosine else v})

    partial = vectors.select(word, features).filter(F.col(features).isNotNull()).mapInPandas(part, schema)
    order = F.round("score", RANK_DECIMALS)
    w = Window.partitionBy(cluster).orderBy(order.desc() if cosine else order.asc(), F.col(word))
    return (partial.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= N)
            .select(cluster, "rank", word, "score"))


def point_errors(points: DataFrame, centroids: DataFrame, cluster: str = "cluster",
                 features: str = "features", centroid: str = "centroid",
                 error="euclidean") -> DataFrame:
    """JN-9: points + err, the error of each point against its own centroid;
    ``error`` is a name or a function of two vector columns (UDF-2)."""
    j = points.join(centroids.select(cluster, centroid), cluster)
    return j.withColumn("err", V.checked_error(j, error, features, centroid)).drop(centroid)


def cluster_errors(points: DataFrame, centroids: DataFrame, cluster: str = "cluster",
                   features: str = "features", centroid: str = "centroid",
                   error="euclidean") -> DataFrame:
    """AGG-12: (cluster, n, err_sum, err_mean); empty clusters give null, not a crash."""
    pe = point_errors(points, centroids, cluster, features, centroid, error)
    agg = pe.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"), F.sum("err").alias("err_sum"))
    return (centroids.select(cluster).join(agg, cluster, "left")
            .withColumn("err_mean", F.col("err_sum") / F.col("n")))


def total_error(points: DataFrame, centroids: DataFrame, cluster: str = "cluster",
                features: str = "features", centroid: str = "centroid",
                errors=("euclidean",)) -> DataFrame:
    """AGG-13: one row (n, total_<error> ...) summed over all points in one
    pass (not KMeans' squared cost). An error is a name or a function of two
    vector columns, whose own name the total then has."""
    j = points.join(centroids.select(cluster, centroid), cluster)
    return j.agg(F.count(F.lit(1)).alias("n"), *(F.sum(V.checked_error(j, e, features, centroid)).alias(f"total_{V.error_name(e)}")
                                                 for e in errors))


def cluster_sizes(assigned: DataFrame, cluster: str = "cluster", k: int | None = None) -> DataFrame:
    """(cluster, size); with ``k`` every id 0..k-1 appears."""
    g = assigned.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"))
    if k is None:
        return g
    ids = assigned.sparkSession.range(int(k)).select(F.col("id").cast(assigned.schema[cluster].dataType).alias(cluster))
    return ids.join(g, cluster, "left").select(cluster, F.coalesce("size", F.lit(0)).alias("size"))


def cluster_members(assigned: DataFrame, word: str = "word", cluster: str = "cluster",
                    k: int | None = None) -> DataFrame:
    """AGG-11 in the reference's layout, (cluster, size, words sorted): one list
    per cluster, for export. ``assigned`` itself is the flat form."""
    g = assigned.groupBy(cluster).agg(F.array_sort(F.collect_list(word)).alias("words"))
    return (cluster_sizes(assigned, cluster, k).join(g, cluster, "left")
            .select(cluster, "size", F.coalesce("words", F.array().cast(g.schema["words"].dataType)).alias("words")))


def keyword_vectors(keywords: DataFrame, vectors: DataFrame, word: str = "word",
                    distinct: bool = False) -> DataFrame:
    """JOB-4 / JN-2: keywords joined to their vectors (repeats kept); SET-1 with ``distinct``."""
    j = keywords.join(vectors, word)
    if distinct:
        return j.select(word, *[c for c in vectors.columns if c != word]).dropDuplicates([word])
    return j


def oov_keywords(keywords: DataFrame, vectors: DataFrame, word: str = "word") -> DataFrame:
    """JN-3: keywords without a vector (out-of-vocabulary report)."""
    return keywords.join(vectors.select(word), word, "left_anti")


def normalize_vectors(vectors: DataFrame, features: str = "features", out: str = "unit") -> DataFrame:
    """SCL-32: drop zero vectors, then divide by the L2 norm."""
    return (vectors.filter(V.norm(F.col(features)) > 0)
            .withColumn(out, V.l2_normalize(F.col(features))))
