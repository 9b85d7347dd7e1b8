"""Brute-force property checks on random small inputs."""

import random
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from topicloom.operators import captions, ngrams, timeseries
from topicloom.operators.scans import forward_fill, running_sum

VOCAB = ["a", "b", "c", "d", "e", "f"]


def brute_windows(words, size=10):
    """Every window start from 0 to max(n - size, 0): its words, and its pairs of unequal words."""
    uni, bi = Counter(), Counter()
    for start in range(max(len(words) - size, 0) + 1):
        seen = words[start:start + size]
        uni += Counter(seen)
        bi += Counter((min(p), max(p)) for p in combinations(seen, 2) if len(set(p)) == 2)
    return uni, bi


def test_closed_form_matches_windows(spark):
    rnd = random.Random(7)
    docs = [(i, " ".join(rnd.choice(VOCAB) for _ in range(n))) for i, n in enumerate(range(1, 26))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    uni = {r["token"]: r["n"] for r in ngrams.unigram_counts(df).collect()}
    bi = {(r["w1"], r["w2"]): r["n"] for r in ngrams.bigram_counts(df).collect()}
    bu, bb = Counter(), Counter()
    for _, t in docs:
        u, b = brute_windows(t.split())
        bu.update(u)
        bb.update(b)
    assert uni == dict(bu) and bi == dict(bb)
    totals = df.select(ngrams.unigram_total(df).alias("u"), ngrams.pair_total(df).alias("b")).first()
    assert (totals["u"], totals["b"]) == (sum(uni.values()), sum(bi.values()))


def test_lookback_matches_nested_loop(spark):
    rnd = random.Random(3)
    for trial in range(3):
        raw = [rnd.choice(["x", "y", " x", "", "z", "1", "00:01 --> 00:02"]) for _ in range(120)]
        df = spark.createDataFrame([("f", i, r) for i, r in enumerate(raw)], "file string, line_no long, raw string")
        got = [r["line_no"] for r in captions.dedup_caption_lines(df).orderBy("line_no").collect()]
        want = []
        for i, r in enumerate(raw):
            t = r.strip()
            if t.isdigit() or "-->" in t:
                continue
            if t in raw[max(0, i - 20):i]:
                continue
            want.append(i)
        assert got == want, trial


def test_band_counts_match_brute_force(spark):
    rnd = random.Random(11)
    docs = [(i, " ".join(rnd.choice(VOCAB + ["o"] * 6) for _ in range(rnd.randint(1, 60)))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    cl = spark.createDataFrame([("r", 0, ["a", "b", "c"]), ("r", 1, ["d", "e"])],
                               "run string, cluster int, words array<string>")
    got = {(r["cluster"], r["doc_id"]): r["score"] for r in timeseries.cluster_doc_scores(cl, df).collect()}
    want = {}
    for d, t in docs:
        w = t.split()
        for c, words in ((0, ["a", "b", "c"]), (1, ["d", "e"])):
            s = 0
            for w1, w2 in combinations(words, 2):
                s += sum(1 for i, x in enumerate(w) for j, y in enumerate(w)
                         if x == w1 and y == w2 and abs(i - j) <= 10)
            if s:
                want[(c, d)] = s
    assert got == want


def test_two_level_scans(spark):
    rnd = random.Random(5)
    rows = [("p", i, rnd.choice([None, None, None, "A", "B"]), rnd.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "p string, i long, v string, x long")
    ff = {r["i"]: r["f"] for r in forward_fill(df, ["p"], ["i"], F.floor(F.col("i") / 7), "v", "f").collect()}
    rs = {r["i"]: r["s"] for r in running_sum(df, ["p"], ["i"], F.floor(F.col("i") / 7), "x", "s").collect()}
    last, tot = None, 0
    for _, i, v, x in rows:
        last = v if v is not None else last
        tot += x
        assert ff[i] == last and rs[i] == tot


def test_two_level_concat(spark):
    from topicloom.operators.scans import ordered_concat
    rnd = random.Random(9)
    rows = [(rnd.choice(["f", "g"]), i, rnd.choice(VOCAB)) for i in range(200)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "file string, i long, t string")
    got = {r["file"]: r["out"] for r in
           ordered_concat(df, ["file"], ["i"], F.floor(F.col("i") / 3), "t", "|", "out").collect()}
    want = {}
    for f in ("f", "g"):
        want[f] = "|".join(t for ff, i, t in sorted(rows, key=lambda r: r[1]) if ff == f)
    assert got == want
