"""Registered queries: vector distances, centroid labels, cluster errors, keyword vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators import vectors as vec
from topicloom.plans.registry import register
from topicloom.plans.tables import table
from topicloom.sources import sinks


def word_vectors(spark, sf_dir):
    """Word vectors from ``embeddings``: vec_id is the word, label a cluster."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("word"), F.col("embedding").alias("features"),
                    F.col("label").alias("cluster"))


def label_centroids(spark, sf_dir):
    return vec.mean_vectors(word_vectors(spark, sf_dir), key="cluster", features="features")


def keyword_rows(spark, sf_dir):
    """Keywords with repeats and misses: (l_orderkey, l_linenumber, word = l_partkey)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("word"))


CEN = """WITH
ev AS (SELECT vec_id AS word, label AS cluster, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
cen AS (SELECT cluster, list(m ORDER BY pos) AS c FROM (
          SELECT cluster, pos, avg(x) AS m FROM (
            SELECT cluster, unnest(e) AS x, unnest(range(len(e))) AS pos FROM ev) GROUP BY cluster, pos)
        GROUP BY cluster)
"""


def _nearest_sql(score: str, desc: bool) -> str:
    order = "DESC" if desc else "ASC"
    return CEN + f""",
sc AS (SELECT c.cluster, v.word, {score} AS score FROM ev v, cen c),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) {order}, word) AS rank FROM sc)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(rank AS BIGINT) AS rank, CAST(word AS BIGINT) AS word,
       round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10"""


def _nearest_out(df):
    return df.select(F.col("cluster").cast("bigint"), F.col("rank").cast("bigint"),
                     F.col("word").cast("bigint"), F.round("score", 6).alias("score"))


@register("nearest_words_cosine", sql=_nearest_sql("list_cosine_similarity(v.e, c.c)", True))
def q_nearest_words_cosine(spark, sf_dir):
    return _nearest_out(vec.nearest_words(word_vectors(spark, sf_dir), label_centroids(spark, sf_dir),
                                          top=10, dist="cosine"))


@register("nearest_words_euclid", sql=_nearest_sql("list_distance(v.e, c.c)", False))
def q_nearest_words_euclid(spark, sf_dir):
    return _nearest_out(vec.nearest_words(word_vectors(spark, sf_dir), label_centroids(spark, sf_dir),
                                          top=10, dist="euclidean"))


@register("nearest_words_zero", sql=CEN.replace("CAST(embedding AS DOUBLE[]) AS e", """CASE WHEN vec_id % 50 = 0
  THEN list_transform(CAST(embedding AS DOUBLE[]), lambda x: 0.0) ELSE CAST(embedding AS DOUBLE[]) END AS e""") + """,
sc AS (SELECT c.cluster, v.word, CASE WHEN list_dot_product(v.e, v.e) = 0 THEN 0.0 ELSE list_cosine_similarity(v.e, c.c) END AS score
       FROM ev v, cen c),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, word) AS rank FROM sc)
SELECT CAST(cluster AS BIGINT) AS cluster, CAST(rank AS BIGINT) AS rank, CAST(word AS BIGINT) AS word,
       round(score, 6) + 0.0 AS score FROM r WHERE rank <= 400""")
def q_nearest_words_zero(spark, sf_dir):
    """Vectors of no length score 0 (and come after all that point the centroid's way)."""
    zero = F.when(F.col("word") % 50 == 0, F.transform("features", lambda x: x * 0)).otherwise(F.col("features"))
    v = word_vectors(spark, sf_dir).withColumn("features", zero)
    return _nearest_out(vec.nearest_words(v, vec.mean_vectors(v, "cluster", "features"), top=400))


@register("cluster_error_mean", sql=CEN + """
SELECT CAST(v.cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n,
       round(sum(list_distance(v.e, c.c)), 6) AS err_sum, round(avg(list_distance(v.e, c.c)), 6) AS err_mean
FROM ev v JOIN cen c USING (cluster) GROUP BY v.cluster""")
def q_cluster_error_mean(spark, sf_dir):
    e = vec.cluster_errors(word_vectors(spark, sf_dir), label_centroids(spark, sf_dir))
    return e.select(F.col("cluster").cast("bigint"), F.col("n").cast("bigint"),
                    F.round("err_sum", 6).alias("err_sum"), F.round("err_mean", 6).alias("err_mean"))


@register("cluster_error_sum", sql=CEN + """
SELECT CAST(count(*) AS BIGINT) AS n, round(sum(list_distance(v.e, c.c)), 6) AS total_euclidean,
       round(sum(1 - list_cosine_similarity(v.e, c.c)), 6) AS total_cosine
FROM ev v JOIN cen c USING (cluster)""")
def q_cluster_error_sum(spark, sf_dir):
    pts, cen = word_vectors(spark, sf_dir), label_centroids(spark, sf_dir)
    e = vec.total_error(pts, cen, errors=("euclidean", "cosine"))
    return e.select(F.col("n").cast("bigint"), *(F.round(c, 6).alias(c) for c in ("total_euclidean", "total_cosine")))


@register("l2_normalize", sql="""
SELECT CAST(vec_id AS BIGINT) AS word, CAST(pos AS BIGINT) AS dim, round(x / nrm, 6) + 0.0 AS value FROM (
  SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS pos, sqrt(list_dot_product(e, e)) AS nrm
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) WHERE list_dot_product(e, e) > 0)""")
def q_l2_normalize(spark, sf_dir):
    n = vec.normalize_vectors(word_vectors(spark, sf_dir))
    return n.select(F.col("word").cast("bigint"), F.posexplode("unit").alias("dim", "value")).select(
        "word", F.col("dim").cast("bigint"), F.round("value", 6).alias("value"))


@register("cluster_members", sql="""
SELECT CAST(label AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS size,
       array_to_string(list_sort(list(vec_id)), ' ') AS words FROM embeddings GROUP BY label""")
def q_cluster_members(spark, sf_dir):
    m = vec.cluster_members(word_vectors(spark, sf_dir), k=None)
    return m.select(F.col("cluster").cast("bigint"), F.col("size").cast("bigint"),
                    F.array_join(F.transform("words", lambda w: w.cast("string")), " ").alias("words"))


@register("keyword_vectors", sql="""
SELECT CAST(l.l_orderkey AS BIGINT) AS l_orderkey, CAST(l.l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l.l_partkey AS BIGINT) AS word, CAST(e.label AS BIGINT) AS cluster,
       round(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS norm
FROM lineitem l JOIN embeddings e ON e.vec_id = l.l_partkey""")
def q_keyword_vectors(spark, sf_dir):
    j = vec.keyword_vectors(keyword_rows(spark, sf_dir), word_vectors(spark, sf_dir))
    return j.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"),
                    F.col("word").cast("bigint"), F.col("cluster").cast("bigint"),
                    F.round(V.norm(F.col("features")), 6).alias("norm"))


@register("oov_keywords", sql="""
SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CAST(l_partkey AS BIGINT) AS word FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = l.l_partkey)""")
def q_oov_keywords(spark, sf_dir):
    o = vec.oov_keywords(keyword_rows(spark, sf_dir), word_vectors(spark, sf_dir))
    return o.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("bigint"),
                    F.col("word").cast("bigint"))


@register("distinct_vectors", sql="""
SELECT DISTINCT CAST(e.vec_id AS BIGINT) AS word, CAST(e.label AS BIGINT) AS cluster,
       round(sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS norm
FROM lineitem l JOIN embeddings e ON e.vec_id = l.l_partkey""")
def q_distinct_vectors(spark, sf_dir):
    j = vec.keyword_vectors(keyword_rows(spark, sf_dir), word_vectors(spark, sf_dir), distinct=True)
    return j.select(F.col("word").cast("bigint"), F.col("cluster").cast("bigint"),
                    F.round(V.norm(F.col("features")), 6).alias("norm"))


@register("centroid_label_lines", sql=_nearest_sql("list_cosine_similarity(v.e, c.c)", True).replace(
    "SELECT CAST(cluster AS BIGINT) AS cluster, CAST(rank AS BIGINT) AS rank, CAST(word AS BIGINT) AS word,\n       round(score, 6) + 0.0 AS score FROM r WHERE rank <= 10",
    "SELECT CAST(cluster AS BIGINT) AS cluster, cluster || ', ' || string_agg(word, ' ' ORDER BY rank) AS line FROM r WHERE rank <= 10 GROUP BY cluster"))
def q_centroid_label_lines(spark, sf_dir):
    """SNK-2: the nearest words of each centroid in the reference's file layout."""
    labels = vec.nearest_words(word_vectors(spark, sf_dir), label_centroids(spark, sf_dir), top=10)
    return sinks.centroid_label_lines(labels).select(F.col("cluster").cast("bigint"), "line")


@register("own_error_and_parser", sql=CEN + """,
d AS (SELECT v.cluster, list_sum(list_transform(list_zip(v.e, c.c), lambda p: abs(p[1] - p[2]))) AS err FROM ev v JOIN cen c USING (cluster)),
e AS (SELECT cluster, round(sum(err), 4) AS total FROM d GROUP BY cluster)
SELECT CAST(cluster AS BIGINT) AS cluster, total + 0.0 AS total,
  (SELECT round(sum(err), 4) FROM d) + 0.0 AS all_clusters FROM e""")
def q_own_error_and_parser(spark, sf_dir):
    """UDF-1, UDF-2: city-block errors by a function of two columns, told as 'cluster=total' lines and read by an own parser."""
    from topicloom.sources import readers

    def city_block(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)

    def pair(line):
        part = F.split(line, "=")
        return F.struct(part[0].cast("bigint").alias("cluster"), part[1].cast("double").alias("total"))

    points, centroids = word_vectors(spark, sf_dir), label_centroids(spark, sf_dir)
    errs = vec.cluster_errors(points, centroids, error=city_block)
    lines = errs.select(F.concat_ws("=", "cluster", F.round("err_sum", 4)).alias("value"))
    total = vec.total_error(points, centroids, errors=(city_block,)).select(F.round("total_city_block", 4)).scalar()
    back = readers.parsed(lines, pair, "struct<cluster:bigint,total:double>")
    return back.select("parsed.*", total.alias("all_clusters"))


@register("cluster_abs_cosine", sql=CEN + """
SELECT CAST(v.cluster AS BIGINT) AS cluster, CAST(count(*) AS BIGINT) AS n, round(sum(abs(list_cosine_similarity(v.e, c.c))), 6) + 0.0 AS err_sum
FROM ev v JOIN cen c USING (cluster) GROUP BY v.cluster""")
def q_cluster_abs_cosine(spark, sf_dir):
    """SCL-30: the absolute cosine similarity summed per cluster."""
    e = vec.cluster_errors(word_vectors(spark, sf_dir), label_centroids(spark, sf_dir), error="abs_cosine")
    return e.select(F.col("cluster").cast("bigint"), F.col("n").cast("bigint"), F.round("err_sum", 6).alias("err_sum"))
