"""Cluster co-mention time series (JOB-9, JOB-10, AGG-17..19, WIN-4).

For every cluster (a word list of at most ``max_words`` words) and every
document, a pair of the cluster's words scores one hit per pair of
positions at most ``distance`` apart. Plan:

1. tokens are left-semi joined to the distinct cluster vocabulary first,
   which drops most of the corpus at the scan;
2. the words left of a document meet in one row and are paired there with
   the next ``distance`` ones, so no key is larger than a document;
3. hits are pre-aggregated per (doc, w1, w2) before meeting the cluster
   pair table on (w1, w2), then summed per (cluster, date).

``mode='last_pair_running'`` reproduces the reference's output literally:
only the cluster's last word pair, as a running total over documents in
order (two-level running sum, no single-task window).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import tokens
from topicloom.operators.ngrams import items
from topicloom.operators.scans import running_sum

MAX_WORDS = 15
DISTANCE = 10


def cluster_words(clusters: DataFrame, keys=("run", "cluster"), max_words: int = MAX_WORDS) -> DataFrame:
    """FLT-7 then one row per (cluster, distinct word)."""
    k = list(keys)
    return (clusters.filter(F.size("words") <= max_words)
            .select(*k, F.explode(F.array_distinct("words")).alias("word")))


def cluster_pairs(clusters: DataFrame, keys=("run", "cluster"), max_words: int = MAX_WORDS) -> DataFrame:
    """(keys, w1, w2, times), w1 <= w2: the unordered word pairs of each kept
    cluster and how often the list holds them (a repeated word repeats its
    pairs, and pairs with itself: JN-12)."""
    k = list(keys)
    c = clusters.filter(F.size("words") <= max_words).select(*k, F.array_sort("words").alias("w"))
    c = c.select(*k, "w", F.posexplode("w").alias("i", "w1"))
    p = c.select(*k, "w1", F.explode(F.slice("w", F.col("i") + 2, F.size("w"))).alias("w2"))
    return p.groupBy(*k, "w1", "w2").agg(F.count(F.lit(1)).alias("times"))


def vocab_tokens(docs: DataFrame, vocab: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, pos, word) for tokens that are cluster words (SCL-38)."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(tokens(F.col(text))).alias("pos", "word"))
    return t.join(vocab, "word", "left_semi")


def near_hits(toks: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """AGG-17 pre-aggregated: (doc_id, w1, w2, hits) for pairs of positions within
    ``distance``.

    Words of a document meet in one row (bounded by the document) and each is
    paired with those that follow it there. Unequal words count a pair of
    positions once. A word pairs with itself over all ordered position pairs,
    each position with itself included, as the reference compares the word's
    position list with itself.
    """
    D = int(distance)
    rows = toks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("t"))
    each = rows.select("doc_id", "t", F.posexplode(items("t")).alias("p", "x"))
    nxt = F.array(*[F.get("t", F.col("p") + k) for k in range(0, D + 1)])
    near = (each.select("doc_id", "x", F.explode(nxt).alias("y"))
            .filter(F.col("y").isNotNull() & (F.col("y.pos") <= F.col("x.pos") + D)))
    times = F.when((F.col("x.word") == F.col("y.word")) & (F.col("x.pos") != F.col("y.pos")), 2).otherwise(1)
    return (near.groupBy("doc_id", F.least("x.word", "y.word").alias("w1"), F.greatest("x.word", "y.word").alias("w2"))
            .agg(F.sum(times).alias("hits")))


def cluster_doc_scores(clusters: DataFrame, docs: DataFrame, keys=("run", "cluster"),
                       max_words: int = MAX_WORDS, distance: int = DISTANCE) -> DataFrame:
    """(keys, doc_id, score): near hits of all the cluster's pairs in each document."""
    k = list(keys)
    cw = cluster_words(clusters, keys, max_words)
    toks = vocab_tokens(docs, cw.select("word").distinct())
    hits = near_hits(toks, distance)
    cp = cluster_pairs(clusters, keys, max_words)
    j = hits.join(cp, ["w1", "w2"])
    return j.groupBy(*k, "doc_id").agg(F.sum(F.col("hits") * F.col("times")).alias("score"))


def cluster_timeseries(clusters: DataFrame, docs: DataFrame, dates: DataFrame, keys=("run", "cluster"),
                       max_words: int = MAX_WORDS, distance: int = DISTANCE,
                       mode: str = "total") -> DataFrame:
    """JOB-9. ``dates`` is (doc_id, date).

    total: (keys, date, score), summed per date, score > 0, undated dropped.
    last_pair_running: (keys, doc_id, date, score) for documents holding both
    words of the cluster's last pair, running total in doc_id order, > 0.
    """
    k = list(keys)
    if mode == "total":
        s = cluster_doc_scores(clusters, docs, keys, max_words, distance)
        s = s.join(dates, "doc_id").filter(F.col("date").isNotNull())
        return s.groupBy(*k, "date").agg(F.sum("score").alias("score")).filter(F.col("score") > 0)
    if mode != "last_pair_running":
        raise ValueError("mode must be 'total' or 'last_pair_running'")
    lp = (clusters.filter((F.size("words") <= max_words) & (F.size("words") >= 2))
          .select(*k, F.element_at("words", -2).alias("u"), F.element_at("words", -1).alias("v")))
    vocab = lp.select(F.col("u").alias("word")).union(lp.select(F.col("v").alias("word"))).distinct()
    toks = vocab_tokens(docs, vocab)
    present = toks.select("doc_id", "word").distinct()
    pu = present.select("doc_id", F.col("word").alias("u"))
    pv = present.select("doc_id", F.col("word").alias("v"))
    both = lp.join(pu, "u").join(pv, ["v", "doc_id"])
    hits = near_hits(toks, distance)
    h = both.join(hits.withColumnRenamed("w1", "hw1").withColumnRenamed("w2", "hw2"),
                  (both["doc_id"] == hits["doc_id"]) & (F.least(both["u"], both["v"]) == F.col("hw1"))
                  & (F.greatest(both["u"], both["v"]) == F.col("hw2")), "left") \
        .select(*[both[c] for c in k], both["doc_id"], F.coalesce(F.col("hits"), F.lit(0)).alias("hits"))
    # JN-6: documents beyond the titles are no documents; undated ones are
    h = h.join(dates, "doc_id")
    run = running_sum(h, k, ["doc_id"], F.floor(F.col("doc_id") / F.lit(4096)), "hits", "score")
    return run.filter(F.col("score") > 0).select(*k, "doc_id", "date", "score")


def query_timeseries(ts: DataFrame, clusters: DataFrame, words: list[str] | None,
                     keys=("run", "cluster")) -> DataFrame:
    """JOB-10: (keys, date, score) of clusters holding every query word (AND).

    No query words means no filter. Undated points are dropped (FLT-12).
    """
    k = list(keys)
    c = clusters.select(*k, "words")
    for w in [x.strip() for x in (words or []) if x.strip()]:
        c = c.filter(F.array_contains("words", w))
    return ts.join(c.select(*k), k, "left_semi").filter(F.col("date").isNotNull()).select(*k, "date", "score")


def week_ending_sunday(d):
    return F.date_add(F.to_date(F.date_trunc("week", d)), 6)


def weekly(ts: DataFrame, keys=("run", "cluster")) -> DataFrame:
    """AGG-19 long form: (keys, week, score), week ending on Sunday."""
    k = list(keys)
    return ts.groupBy(*k, week_ending_sunday(F.col("date")).alias("week")).agg(F.sum("score").alias("score"))


def weekly_wide(ts: DataFrame, label: str = "cluster") -> DataFrame:
    """AGG-19 as the reference shaped it: one column per cluster, every week
    between the first and the last present, gaps 0. Columns are cluster
    values (a pivot, so meant for the small ranked-cluster table)."""
    w = ts.groupBy(week_ending_sunday(F.col("date")).alias("week")).pivot(label).agg(F.sum("score"))
    bounds = ts.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    cal = bounds.select(F.explode(F.sequence(week_ending_sunday(F.col("lo")), week_ending_sunday(F.col("hi")),
                                             F.expr("INTERVAL 7 DAYS"))).alias("week"))
    return cal.join(w, "week", "left").fillna(0)


def weekly_table(ts: DataFrame, run=("run",), label: str = "cluster") -> DataFrame:
    """AGG-19 for every run at once: (run, week, scores map<cluster, score>).

    Each run has its own calendar, from its first to its last week, and every
    week has all clusters of the run, gaps 0, so the schema doesn't depend on
    the data. Undated points are dropped.
    """
    k = list(run)
    w = weekly(ts.filter(F.col("date").isNotNull()), (*k, label))
    kind = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(label), "score"))))
    weeks = w.groupBy(*k, "week").agg(kind.alias("_have"))
    own = w.groupBy(*k).agg(F.min("week").alias("_lo"), F.max("week").alias("_hi"), F.array_sort(F.collect_set(label)).alias("_all"))
    calendar = own.select(*k, "_all", F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 7 DAYS"))).alias("week"))
    have = lambda c: F.coalesce(F.try_element_at("_have", c), F.lit(0).cast(w.schema["score"].dataType))
    return (calendar.join(weeks, [*k, "week"], "left")
            .select(*k, "week", F.map_from_arrays("_all", F.transform("_all", have)).alias("scores")))


def date_score_lines(ts: DataFrame, keys=("run", "cluster")) -> DataFrame:
    """JOB-10 text form: (keys, date, line) with 'date score' lines; undated points are dropped."""
    d = ts.filter(F.col("date").isNotNull())
    return d.select(*keys, "date", F.concat_ws(" ", F.col("date").cast("string"), F.col("score").cast("string")).alias("line"))
