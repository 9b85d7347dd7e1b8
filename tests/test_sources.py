"""Write-then-read of sources and sinks."""

import json
import os

from pyspark.sql import functions as F

from topicloom.sources import readers as R
from topicloom.sources import sinks as K


def _write(path, name, text):
    p = os.path.join(path, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_line_numbers_and_corpus(spark, tmpdir_path):
    _write(tmpdir_path, "a.txt", "l0\nl1\n\nl3\n")
    _write(tmpdir_path, "b.txt", "m0\nm1\n")
    lines = R.read_lines(spark, tmpdir_path)
    got = sorted((os.path.basename(r["file"]), r["line_no"], r["value"]) for r in lines.collect())
    assert got == [("a.txt", 0, "l0"), ("a.txt", 1, "l1"), ("a.txt", 2, ""), ("a.txt", 3, "l3"),
                   ("b.txt", 0, "m0"), ("b.txt", 1, "m1")]
    corpus = sorted(tuple(r) for r in R.read_corpus(spark, tmpdir_path).collect())
    assert corpus[0] == (0, "l0") and corpus[4] == (4, "m0")


def test_srt_and_vectors_and_topics(spark, tmpdir_path):
    _write(tmpdir_path, "x.srt", "1\n00:00:01,000 --> 00:00:02,000\nhello\n")
    _write(tmpdir_path, "skip.txt", "nope\n")
    cap = R.read_caption_files(spark, tmpdir_path)
    assert cap.count() == 3
    v = R.parse_word_vector_lines(spark.createDataFrame([("2 3",), ("w 1 2 3",), ("u 4 5 6",)], "value string"))
    assert sorted(r["word"] for r in v.collect()) == ["u", "w"]
    lines = spark.createDataFrame([("0, a b", 0), ("1, c", 1), ("0, d", 2)], "value string, line_no long")
    t = {r["cluster"]: r["words"] for r in R.parse_topic_csv(lines).collect()}
    assert t == {"0": ["d"], "1": ["c"]}


def test_json_and_evaluations(spark, tmpdir_path):
    _write(tmpdir_path, "u.json", json.dumps({"a": 3, "b": 1}))
    u = {r["token"]: r["n"] for r in R.read_unigram_json(spark, os.path.join(tmpdir_path, "u.json")).collect()}
    assert u == {"a": 3, "b": 1}
    ev = os.path.join(tmpdir_path, "ev")
    os.makedirs(ev)
    _write(ev, "fulltext_word2vec_kmeans_100_clusters_evaluation.json", '{"0": {"mean": 1.5, "median": NaN}}')
    _write(ev, "fulltext_word2vec_kmeans_2000_clusters_evaluation.json", '{"0": {"mean": 1.0, "median": 1.0}}')
    _write(ev, "notes.txt", "x")
    e = R.read_evaluations(spark, ev).collect()
    assert len(e) == 1 and e[0]["k"] == 100 and e[0]["mean"] == 1.5


def test_parsers(spark):
    df = spark.createDataFrame([("0.5 (a, b) [r1 r2]",)], "value string")
    assert df.select(R.parse_ranked_cluster_line(F.col("value"))).collect()[0][0] == ["a", "b"]
    ts = spark.createDataFrame([('[{"cluster": ["a"], "scores": [{"date": "2016-01-01", "score": 2}]}, null]',)],
                               "value string")
    arr = ts.select(R.parse_timeseries_json(F.col("value"))).collect()[0][0]
    assert arr[0]["scores"][0]["score"] == 2 and arr[1] is None


def test_sinks_roundtrip(spark, tmpdir_path):
    kw = spark.createDataFrame([(0, 2, "b"), (0, 1, "a")], "doc_id long, rank int, token string")
    assert K.keyword_text(kw).collect()[0]["line"] == "a b"
    vec = spark.createDataFrame([("w", [1.0, 2.5])], "word string, features array<float>")
    txt = K.vector_text(vec)
    back = R.parse_word_vector_lines(txt).collect()[0]
    assert back["word"] == "w" and list(back["features"]) == [1.0, 2.5]
    st = spark.createDataFrame([(1, "A", "one two"), (1, "B", "three")], "file long, speaker string, text string")
    out = os.path.join(tmpdir_path, "spk")
    K.write_per_speaker(st, out)
    assert {"speaker=A", "speaker=B"} <= set(os.listdir(out))
    curves = spark.createDataFrame([("w2v", "sph", "clusters", 200, 0.2, 0.1), ("w2v", "sph", "clusters", 100, 0.1, 0.0)],
                                   "embed string, variant string, kind string, k int, mean double, median double")
    cdir = os.path.join(tmpdir_path, "curves")
    K.write_curves(curves, cdir)
    rows = spark.read.text(os.path.join(cdir, "embed=w2v", "variant=sph", "kind=clusters")).collect()
    assert [r[0].split()[0] for r in rows] == ["100", "200"]


def test_line_numbers_across_many_splits(spark, tmpdir_path):
    lines = [f"line {i} " + "x" * (i % 17) for i in range(5000)]
    _write(tmpdir_path, "big.txt", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = R.read_lines(spark, os.path.join(tmpdir_path, "big.txt"))
        assert spark.read.text(os.path.join(tmpdir_path, "big.txt")).rdd.getNumPartitions() > 10
        got = {r["line_no"]: r["value"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == dict(enumerate(lines))


def test_whole_inputs_take_part(spark):
    from topicloom.plans.catalog import QUERIES
    from topicloom.plans.derive import topic_runs

    sf = "/root/testdata/sf0.001"
    whole = QUERIES["json_map_counts_whole"](spark, sf)
    per = {r["lang"]: r["count"] for r in whole.groupBy("lang").count().collect()}
    assert min(per.values()) > 50 and whole.select("lang", "token").distinct().count() == sum(per.values())
    cut = QUERIES["json_map_counts"](spark, sf)
    assert cut.exceptAll(whole).count() == 0
    long = {r["run"] for r in topic_runs(spark, sf).filter("size(words) >= 10").collect()}
    assert long & {r["run"] for r in QUERIES["timeseries_repeated_words_whole"](spark, sf).select("run").distinct().collect()}


def test_more_sinks(spark, tmpdir_path):
    errs = spark.createDataFrame([(0, 0.25, ["a", "b"])], "cluster int, err_mean double, words array<string>")
    assert K.cluster_errs_csv(errs).collect()[0]["line"] == "0, 0.25, a b"
    scores = spark.createDataFrame([("r", 0, 1.5, float("nan")), ("r", 1, 0.5, 0.5)],
                                   "run string, cluster int, mean double, median double")
    js = K.coherence_json(scores).collect()[0]["value"]
    back = R.parse_json_map(F.lit(js), "struct<mean:double,median:double>")
    m = spark.range(1).select(back.alias("m")).collect()[0]["m"]
    assert m["0"]["mean"] == 1.5 and m["0"]["median"] != m["0"]["median"] and m["1"]["median"] == 0.5
    ts = spark.createDataFrame([("r", 0, "2016-01-02", 3), ("r", 0, "2016-01-01", 1)],
                               "run string, cluster int, date string, score long")
    cl = spark.createDataFrame([("r", 0, ["x", "y"])], "run string, cluster int, words array<string>")
    nested = K.timeseries_nested(ts, cl).collect()[0]
    assert [s["date"] for s in nested["scores"]] == ["2016-01-01", "2016-01-02"]
    series = spark.createDataFrame([("m1", 2, 0.5, 3), ("m1", 1, 0.1, 2), ("m2", 3, 0.7, 1)],
                                   "model string, x long, score double, nwords long")
    out = os.path.join(tmpdir_path, "series")
    K.write_ranked_series(series, out)
    rows = [r[0] for r in spark.read.text(os.path.join(out, "model=m1")).collect()]
    assert rows == ["1 0.1 2", "2 0.5 3"]
