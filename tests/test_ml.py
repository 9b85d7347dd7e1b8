"""Invariants of the ML jobs."""

import math

from pyspark.sql import functions as F

from topicloom.functions import vectors as V
from topicloom.operators import clustering as ml
from topicloom.plans.q_vectors import word_vectors

SF = "/root/testdata/sf0.001"


def test_kmeans_invariants(spark):
    vec = word_vectors(spark, SF).drop("cluster")
    n = vec.count()
    a = ml.cluster_words(vec, 5, algorithm="spherical", distance="cosine")
    b = ml.cluster_words(vec, 5, algorithm="spherical", distance="cosine")
    ca = sorted((r["cluster"], r["size"]) for r in a[0].collect())
    cb = sorted((r["cluster"], r["size"]) for r in b[0].collect())
    assert ca == cb, "same seed, same result"
    assert len(ca) == 5 and sum(s for _, s in ca) == n
    model, data = ml.fit_kmeans(vec, 5, algorithm="spherical")
    for c in model.clusterCenters():
        assert math.isclose(float((c ** 2).sum()) ** 0.5, 1.0, rel_tol=1e-6)
    labels = a[1].groupBy("cluster").count().collect()
    assert len(labels) == 5 and all(r["count"] == 10 for r in labels)


def test_points_sit_at_nearest_centre(spark):
    vec = word_vectors(spark, SF).drop("cluster")
    model, data = ml.fit_kmeans(vec, 4, algorithm="kmeans")
    cen = ml.centers_frame(spark, model)
    pts = model.transform(data).select("word", "features", F.col("cluster").alias("own"))
    d = pts.crossJoin(cen.withColumnRenamed("cluster", "c")).withColumn("d", V.euclidean(F.col("features"), F.col("centroid")))
    best = d.groupBy("word").agg(F.min_by("c", "d").alias("best"), F.first("own").alias("own"))
    assert best.filter(F.col("best") != F.col("own")).count() == 0


def test_unknown_algorithm_raises(spark):
    vec = word_vectors(spark, SF)
    try:
        ml.fit_kmeans(vec, 3, algorithm="kmewans")
    except ValueError:
        return
    raise AssertionError("expected ValueError")


def test_wssse_curve_shape(spark):
    vec = word_vectors(spark, SF)
    c = {r["k"]: r for r in ml.wssse_curve(vec, [1, 2, 4, 8]).collect()}
    assert sorted(c) == [1, 2, 4, 8]
    assert c[8]["total_cosine"] <= c[1]["total_cosine"] * 1.05


def test_word2vec_and_lda(spark):
    from topicloom.plans.tables import cleaned_documents
    docs = cleaned_documents(spark, SF)
    v = ml.word2vec(docs, vector_size=16, min_count=5)
    assert v.count() > 0 and v.select(F.size("features")).distinct().collect()[0][0] == 16
    t = ml.lda_topics(docs, k=3, top=5, max_iter=3)
    assert t.count() == 15


def test_pca_layout_scaled(spark):
    p = ml.pca_layout(word_vectors(spark, SF))
    r = p.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).collect()[0]
    assert r[0] >= -1e-9 and r[1] <= 1 + 1e-9 and r[2] >= -1e-9 and r[3] <= 1 + 1e-9
