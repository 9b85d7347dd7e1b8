"""Hand-written cases, one per quirk (FIXTURES.md section 3)."""

import math

from pyspark.sql import functions as F

from topicloom.functions import dates as D
from topicloom.functions.text import clean_text
from topicloom.operators import captions, coherence, keywords, ngrams, runs, speakers, timeseries


def test_clean_text_cases(spark):
    cases = [
        ("See http://a.b/c and then https://x.y/z ok", "see ok"),
        ("In 2016 we won 1,000 jobs abc123def", "in we won jobs abdef"),
        ("5 people", "5 people"),
        ("[APPLAUSE] thank you [MUSIC] all", "all"),
        ('re-elect--now "yes" a_b/c.', "re elect now yes a b c "),
        ("café été", "caf t"),
        ("$5.50 a 7 b", "a b"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    got = dict(df.select("id", clean_text(F.col("t")).alias("c")).collect())
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, (cases[i], got[i])


def _caption_lines(spark, raw):
    return spark.createDataFrame([("f", i, r) for i, r in enumerate(raw)], "file string, line_no long, raw string")


def test_caption_lookback(spark):
    raw = ["1", "00:00:01,000 --> 00:00:02,000", "hello", "", "2", "00:00:02,000 --> 00:00:03,000",
           "hello", "world", ""]
    out = captions.captions_to_documents(_caption_lines(spark, raw)).collect()
    assert out[0]["text"] == "hello  world "
    other = [f"w{i}" for i in range(19)]
    kept = captions.dedup_caption_lines(_caption_lines(spark, ["x"] + other + ["x"])).collect()
    assert [r["text"] for r in kept].count("x ") == 1
    kept = captions.dedup_caption_lines(_caption_lines(spark, ["x"] + other + ["w19", "x"])).collect()
    assert [r["text"] for r in kept].count("x ") == 2
    kept = captions.dedup_caption_lines(_caption_lines(spark, ["x\r", "x\r"])).collect()
    assert len(kept) == 2


def _transcript(spark, lines):
    return spark.createDataFrame([("f", i, s) for i, s in enumerate(lines)], "file string, line_no long, line string")


def test_speakers(spark):
    t = speakers.speaker_text(_transcript(spark, ["noise", "A: one", "two", "B: three", "A: four"]), sep="")
    assert dict((r["speaker"], r["text"]) for r in t.collect()) == {"A": "onetwofour", "B": "three"}
    t = speakers.speaker_text(_transcript(spark, ["A:", "one"]), sep="")
    assert dict((r["speaker"], r["text"]) for r in t.collect()) == {"A": "one"}
    t = speakers.speaker_text(_transcript(spark, ["A: x", "Mr Smith: hi"]), sep=" ")
    assert dict((r["speaker"], r["text"]) for r in t.collect()) == {"A": "x Mr Smith: hi"}


def test_prefix_join(spark):
    lines = spark.createDataFrame([("JOHN hello",), ("JOHNSON hi",), ("MARY x",)], "line string")
    labels = spark.createDataFrame([("JOHN",), ("MARY",)], "speaker string")
    got = sorted((r["speaker"], r["rest"]) for r in speakers.prefix_join(lines, labels).collect())
    assert got == [("JOHN", " hello"), ("JOHN", "SON hi"), ("MARY", " x")]


def test_title_dates(spark):
    cases = [("Rally (1-4-16) x", "2016-01-04", "2016-01-04"), ("R 14-3-2016", "2016-03-14", "2016-03-14"),
             ("10,000 Plus (1-4-16)", None, None), ("8.22.2013", None, None),
             ("2.30.2016", "2016-02-30", None), ("none", None, None),
             ("9" * 50 + ".1.2016", "2016-01-" + "9" * 50, None), ("1.2." + "0" * 40 + "13", None, None)]
    df = spark.createDataFrame([(c[0],) for c in cases], "t string")
    got = {r["t"]: (r["ymd"], r["d"]) for r in
           D.with_title_date(df, "t", "ymd", "date").select("t", "ymd", F.col("date").cast("string").alias("d")).collect()}
    for t, y, d in cases:
        assert got[t] == (y, d), (t, got[t])


def test_title_override(spark):
    from topicloom.operators.dates import date_titles
    t = spark.createDataFrame([("10,000 Plus (1-4-16)",)], "title string")
    ov = spark.createDataFrame([("10,000 Plus (1-4-16)", "4", "1", "2016", 0),
                                ("10,000 Plus (1-4-16)", "1", "4", "2016", 1)],
                               "title string, month string, day string, year string, seq int")
    r = date_titles(t, ov).collect()[0]
    assert r["ymd"] == "2016-01-04"


def test_ordinal_dates(spark):
    df = spark.createDataFrame([("January 1st, 2016",), ("March 2nd, 2016",), ("May 3rd, 2016",),
                                ("June 4th, 2016",)], "t string")
    got = [r[0] for r in df.select(D.ordinal_to_date(F.col("t")).cast("string")).collect()]
    assert got == ["2016-01-01", "2016-03-02", "2016-05-03", "2016-06-04"]


def test_tfidf_toy(spark):
    docs = spark.createDataFrame([(0, "a a b"), (1, "a c"), (2, "")], "doc_id long, text string")
    kw = keywords.tfidf_keywords(docs, pct=0.75)
    by_doc = {}
    for r in kw.orderBy("doc_id", "rank").collect():
        by_doc.setdefault(r["doc_id"], []).append(r["token"])
    assert len(by_doc[0]) == 3 and len(by_doc[1]) == 3 and by_doc[2] == [""]
    kw = keywords.tfidf_keywords(docs, pct=0.5)
    by_doc = {}
    for r in kw.orderBy("doc_id", "rank").collect():
        by_doc.setdefault(r["doc_id"], []).append(r["token"])
    assert by_doc[0] == ["b", "a"] and by_doc[1] == ["c", "a"]
    s = {(r["doc_id"], r["token"]): r["df"] for r in keywords.tfidf_scores(docs).collect()}
    assert s[(0, "a")] == 2 and s[(2, "")] == 3


def _counts(spark, text):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    uni = {r["token"]: r["n"] for r in ngrams.unigram_counts(docs).collect()}
    bi = {(r["w1"], r["w2"]): r["n"] for r in ngrams.bigram_counts(docs).collect()}
    return uni, bi


def test_window_ngrams(spark):
    uni, bi = _counts(spark, "a b a")
    assert uni == {"a": 2, "b": 1} and bi == {("a", "b"): 2}
    uni, bi = _counts(spark, " ".join(f"t{i}" for i in range(10)))
    assert set(uni.values()) == {1} and len(bi) == 45 and set(bi.values()) == {1}
    toks = [f"t{i:02d}" for i in range(11)]
    uni, bi = _counts(spark, " ".join(toks))
    assert uni["t00"] == 1 and uni["t10"] == 1 and all(uni[t] == 2 for t in toks[1:10])
    assert ("t00", "t10") not in bi and bi[("t00", "t09")] == 1 and bi[("t01", "t09")] == 2
    assert bi[("t01", "t10")] == 1


def test_coherence_toy(spark):
    uni = spark.createDataFrame([("a", 4), ("b", 2), ("c", 2)], "token string, n long")
    bi = spark.createDataFrame([("a", "b", 3), ("b", "c", 1)], "w1 string, w2 string, n long")
    topics = spark.createDataFrame([("r", 0, ["a", "b"]), ("r", 1, ["a", "c"]), ("r", 2, ["a", "zz"]),
                                    ("r", 3, ["b"])], "run string, cluster int, words array<string>")
    got = {r["cluster"]: (r["mean"], r["median"]) for r in coherence.topic_coherence(topics, uni, bi).collect()}
    assert math.isclose(got[0][0], math.log(6)) and math.isclose(got[0][1], math.log(6))
    assert got[1] == (0.0, 0.0) and got[2] == (0.0, 0.0)
    assert math.isnan(got[3][0]) and math.isnan(got[3][1])


def test_timeseries_fixture(spark):
    docs = spark.createDataFrame([(0, "x y z"), (1, "y z z"), (2, "x"),
                                  (3, "y " + " ".join(f"o{i}" for i in range(20)) + " z")],
                                 "doc_id long, text string")
    dates = docs.select("doc_id", F.date_add(F.lit("2016-01-01").cast("date"), F.col("doc_id").cast("int")).alias("date"))
    cl = spark.createDataFrame([("r", 0, ["x", "y", "z"])], "run string, cluster int, words array<string>")
    run = timeseries.cluster_timeseries(cl, docs, dates, mode="last_pair_running")
    assert sorted((r["doc_id"], r["score"]) for r in run.collect()) == [(0, 1), (1, 3), (3, 3)]
    tot = timeseries.cluster_doc_scores(cl, docs)
    assert sorted((r["doc_id"], r["score"]) for r in tot.collect()) == [(0, 3), (1, 2)]
    big = spark.createDataFrame([("r", 0, [f"w{i}" for i in range(16)]), ("r", 1, [f"w{i}" for i in range(15)])],
                                "run string, cluster int, words array<string>")
    assert [r["cluster"] for r in timeseries.cluster_words(big).select("cluster").distinct().collect()] == [1]


def test_distance_inclusive(spark):
    docs = spark.createDataFrame([(0, "a " + "o " * 9 + "b"), (1, "a " + "o " * 10 + "b")], "doc_id long, text string")
    cl = spark.createDataFrame([("r", 0, ["a", "b"])], "run string, cluster int, words array<string>")
    got = {r["doc_id"]: r["score"] for r in timeseries.cluster_doc_scores(cl, docs).collect()}
    assert got == {0: 1}


def test_ranges_and_grid(spark):
    one = spark.range(1)
    for text, want in (("100..130..10", [100, 110, 120]), ("5", [5]), ("3..3", []), (" 1..4 ", [1, 2, 3])):
        assert one.select(runs.range_column(text)).first()[0] == want
    grid = spark.createDataFrame([(k,) for k in (9, 10, 11, 12)], "k int")
    counts = spark.createDataFrame([(9, 9), (10, 10), (11, 11)], "k int, n long")
    inc = sorted(r["k"] for r in runs.incomplete_runs(grid, counts, ["k"]).collect())
    mis = sorted(r["k"] for r in runs.missing_runs(grid, counts, ["k"]).collect())
    assert inc == [9, 12] and mis == [9, 10, 12]


def test_rank_combined_merges_runs(spark):
    scores = spark.createDataFrame([("m-1", 0, 0.5, 0.5), ("m-2", 0, 0.5, 0.5), ("m-3", 0, float("nan"), 0.0)],
                                   "run string, cluster int, mean double, median double")
    clusters = spark.createDataFrame([("m-1", 0, ["a", "b"]), ("m-2", 0, ["a", "b"]), ("m-3", 0, ["c"])],
                                     "run string, cluster int, words array<string>")
    c = runs.rank_combined(scores, clusters).collect()
    assert len(c) == 1 and c[0]["runs"] == ["m-1", "m-2"]
    r = runs.rank_all(scores, clusters).orderBy("rank").collect()
    assert [x["rank"] for x in r] == [1, 2] and [x["run"] for x in r] == ["m-1", "m-2"]


def test_weekly_views(spark):
    ts = spark.createDataFrame([("r", 0, "2016-01-04", 2), ("r", 0, "2016-01-06", 1), ("r", 1, "2016-01-20", 5)],
                               "run string, cluster int, date string, score long") \
        .withColumn("date", F.col("date").cast("date"))
    wk = {(r["cluster"], str(r["week"])): r["score"] for r in timeseries.weekly(ts).collect()}
    assert wk == {(0, "2016-01-10"): 3, (1, "2016-01-24"): 5}
    wide = {str(r["week"]): (r["0"], r["1"]) for r in timeseries.weekly_wide(ts).collect()}
    assert wide == {"2016-01-10": (3, 0), "2016-01-17": (0, 0), "2016-01-24": (0, 5)}


def test_debate_list_dates(spark, tmpdir_path):
    import os
    from topicloom.sources import readers as R
    p = os.path.join(tmpdir_path, "list.txt")
    with open(p, "w") as f:
        f.write("August 6th, 2015|Cleveland, Ohio|http://x/1\nSeptember 22nd, 2015|Simi Valley|http://x/2\n")
    df = R.read_debate_list(spark, p)
    got = [str(r[0]) for r in df.select(D.ordinal_to_date(F.col("date"))).collect()]
    assert got == ["2015-08-06", "2015-09-22"] and df.columns == ["date", "location", "url"]
