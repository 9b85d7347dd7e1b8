"""Registered queries: cluster time series (JOB-9, JOB-10, AGG-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import timeseries as ts
from topicloom.plans import sql as S
from topicloom.plans.derive import topic_runs
from topicloom.plans.registry import ORACLE, register
from topicloom.plans.tables import stored_corpus, table
from topicloom.session import materialised

QUERY_WORDS = ["the", "of"]


def _topics(spark, sf_dir):
    """(the derived runs, the cleaned documents), each a table of its own: the series read them several times."""
    corpus = stored_corpus(spark, sf_dir)
    return materialised(topic_runs(spark, sf_dir, corpus), "topics"), corpus.select("doc_id", "text")


def doc_dates(spark, sf_dir):
    """Document dates: 2016-01-01 plus doc_id mod 300 days."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.date_add(F.lit("2016-01-01").cast("date"),
                                         (F.col("doc_id") % 300).cast("int")).alias("date"))


TS_CTE = S.TOPICS_CTE + """,
dts AS (SELECT doc_id, DATE '2016-01-01' + CAST(doc_id % 300 AS INTEGER) AS date FROM docs),
ct AS (SELECT * FROM topics WHERE len(words) <= 15),
cw AS (SELECT DISTINCT unnest(words) AS word FROM ct),
tk AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs)),
vt AS (SELECT * FROM tk WHERE word IN (SELECT word FROM cw)),
hits AS (SELECT a.doc_id, least(a.word, b.word) AS w1, greatest(a.word, b.word) AS w2, count(*) AS hits
         FROM vt a, range(1, 11) o(d), vt b
         WHERE b.doc_id = a.doc_id AND b.pos = a.pos + o.d AND a.word <> b.word
         GROUP BY a.doc_id, least(a.word, b.word), greatest(a.word, b.word)),
cwl AS (SELECT run, cluster, list_sort(list_distinct(words)) AS w FROM ct),
cpi AS (SELECT run, cluster, w, unnest(range(len(w))) AS i FROM cwl),
cp AS (SELECT run, cluster, w[i + 1] AS w1, w[j + 1] AS w2
       FROM (SELECT run, cluster, w, i, unnest(range(i + 1, len(w))) AS j FROM cpi)),
tot AS (SELECT cp.run, cp.cluster, h.doc_id, sum(h.hits) AS score FROM hits h JOIN cp ON cp.w1 = h.w1 AND cp.w2 = h.w2
        GROUP BY cp.run, cp.cluster, h.doc_id),
tsd AS (SELECT t.run, t.cluster, d.date, sum(t.score) AS score FROM tot t JOIN dts d USING (doc_id)
        WHERE d.date IS NOT NULL GROUP BY t.run, t.cluster, d.date HAVING sum(t.score) > 0)
"""


@register("cluster_timeseries_total", sql=S.ctes(TS_CTE) + """
SELECT run, CAST(cluster AS BIGINT) AS cluster, CAST(date AS VARCHAR) AS date, CAST(score AS BIGINT) AS score FROM tsd""")
def q_cluster_timeseries_total(spark, sf_dir):
    clusters, docs = _topics(spark, sf_dir)
    out = ts.cluster_timeseries(clusters, docs, doc_dates(spark, sf_dir), mode="total")
    return out.select("run", F.col("cluster").cast("bigint"), F.col("date").cast("string"),
                      F.col("score").cast("bigint"))


@register("cluster_timeseries_running", sql=S.ctes(TS_CTE) + """,
lp AS (SELECT run, cluster, words[len(words) - 1] AS u, words[len(words)] AS v FROM ct WHERE len(words) >= 2),
pres AS (SELECT DISTINCT doc_id, word FROM tk),
bth AS (SELECT lp.run, lp.cluster, lp.u, lp.v, p1.doc_id FROM lp
        JOIN pres p1 ON p1.word = lp.u JOIN pres p2 ON p2.word = lp.v AND p2.doc_id = p1.doc_id),
hh AS (SELECT b.run, b.cluster, b.doc_id, coalesce(h.hits, 0) AS hits FROM bth b
       LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.w1 = least(b.u, b.v) AND h.w2 = greatest(b.u, b.v)),
rs AS (SELECT run, cluster, doc_id, sum(hits) OVER (PARTITION BY run, cluster ORDER BY doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score FROM hh)
SELECT rs.run, CAST(rs.cluster AS BIGINT) AS cluster, CAST(rs.doc_id AS BIGINT) AS doc_id,
       CAST(d.date AS VARCHAR) AS date, CAST(rs.score AS BIGINT) AS score
FROM rs LEFT JOIN dts d USING (doc_id) WHERE rs.score > 0""")
def q_cluster_timeseries_running(spark, sf_dir):
    clusters, docs = _topics(spark, sf_dir)
    out = ts.cluster_timeseries(clusters, docs, doc_dates(spark, sf_dir), mode="last_pair_running")
    return out.select("run", F.col("cluster").cast("bigint"), F.col("doc_id").cast("bigint"),
                      F.col("date").cast("string"), F.col("score").cast("bigint"))


def _query_filter_sql(words):
    return " AND ".join(f"list_contains(words, '{w}')" for w in words)


@register("timeseries_query", sql=S.ctes(TS_CTE) + f"""
SELECT t.run, CAST(t.cluster AS BIGINT) AS cluster, CAST(t.date AS VARCHAR) AS date, CAST(t.score AS BIGINT) AS score
FROM tsd t JOIN (SELECT run, cluster FROM topics WHERE {_query_filter_sql(QUERY_WORDS)}) q
  ON q.run = t.run AND q.cluster = t.cluster""")
def q_timeseries_query(spark, sf_dir):
    clusters, docs = _topics(spark, sf_dir)
    t = ts.cluster_timeseries(clusters, docs, doc_dates(spark, sf_dir))
    out = ts.query_timeseries(t, clusters, QUERY_WORDS)
    return out.select("run", F.col("cluster").cast("bigint"), F.col("date").cast("string"),
                      F.col("score").cast("bigint"))


@register("timeseries_weekly", sql=S.ctes(TS_CTE) + """
SELECT run, CAST(cluster AS BIGINT) AS cluster,
       CAST(CAST(date_trunc('week', date) AS DATE) + 6 AS VARCHAR) AS week, CAST(sum(score) AS BIGINT) AS score
FROM tsd GROUP BY run, cluster, CAST(date_trunc('week', date) AS DATE) + 6""")
def q_timeseries_weekly(spark, sf_dir):
    clusters, docs = _topics(spark, sf_dir)
    t = ts.cluster_timeseries(clusters, docs, doc_dates(spark, sf_dir))
    w = ts.weekly(t)
    return w.select("run", F.col("cluster").cast("bigint"), F.col("week").cast("string"),
                    F.col("score").cast("bigint"))


# Repeated words, documents without a date and documents beyond the dates.
GAPS_CTE = S.TOPICS_CTE + """,
dts AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE DATE '2016-01-01' + CAST(doc_id % 300 AS INTEGER) END AS date
        FROM docs WHERE doc_id % 7 <> 3),
ct AS (SELECT run, cluster, list_concat(words, words[1:1]) AS words FROM topics),
tk AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos
       FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs)),
vt AS (SELECT * FROM tk WHERE word IN (SELECT unnest(words) FROM ct)),
cpi AS (SELECT run, cluster, words, unnest(range(len(words))) AS i FROM ct),
cp AS (SELECT run, cluster, i, j, words[i + 1] AS a, words[j + 1] AS b
       FROM (SELECT run, cluster, words, i, unnest(range(i + 1, len(words))) AS j FROM cpi)),
ph AS (SELECT x.doc_id, x.word AS a, y.word AS b, count(*) AS hits FROM vt x, range(-10, 11) o(d), vt y
       WHERE y.doc_id = x.doc_id AND y.pos = x.pos + o.d GROUP BY x.doc_id, x.word, y.word)
"""


def _gap_dates(spark, sf_dir):
    return doc_dates(spark, sf_dir).filter("doc_id % 7 <> 3").withColumn("date", F.expr("CASE WHEN doc_id % 5 <> 0 THEN date END"))


def _gap_inputs(spark, sf_dir):
    topics, docs = _topics(spark, sf_dir)
    clusters = topics.select("run", "cluster", F.concat("words", F.slice("words", 1, 1)).alias("words"))
    return clusters, docs, _gap_dates(spark, sf_dir)


@register("timeseries_repeated_words", sql=S.ctes(GAPS_CTE) + """
SELECT cp.run, CAST(cp.cluster AS BIGINT) AS cluster, CAST(d.date AS VARCHAR) AS date, CAST(sum(ph.hits) AS BIGINT) AS score
FROM cp JOIN ph ON ph.a = cp.a AND ph.b = cp.b JOIN dts d ON d.doc_id = ph.doc_id
WHERE d.date IS NOT NULL GROUP BY cp.run, cp.cluster, d.date""")
def q_timeseries_repeated_words(spark, sf_dir):
    clusters, docs, dates = _gap_inputs(spark, sf_dir)
    out = ts.cluster_timeseries(clusters, docs, dates)
    return out.select("run", F.col("cluster").cast("bigint"), F.col("date").cast("string"), F.col("score").cast("bigint"))


@register("timeseries_running_gaps", sql=S.ctes(GAPS_CTE) + """,
lp AS (SELECT run, cluster, words[len(words) - 1] AS u, words[len(words)] AS v FROM ct WHERE len(words) >= 2),
pres AS (SELECT DISTINCT doc_id, word FROM tk),
hh AS (SELECT lp.run, lp.cluster, d.doc_id, d.date, coalesce(ph.hits, 0) AS hits FROM lp
       JOIN pres p1 ON p1.word = lp.u JOIN pres p2 ON p2.word = lp.v AND p2.doc_id = p1.doc_id
       JOIN dts d ON d.doc_id = p1.doc_id LEFT JOIN ph ON ph.doc_id = p1.doc_id AND ph.a = lp.u AND ph.b = lp.v),
rs AS (SELECT run, cluster, doc_id, date, sum(hits) OVER (PARTITION BY run, cluster ORDER BY doc_id
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS score FROM hh)
SELECT run, CAST(cluster AS BIGINT) AS cluster, CAST(doc_id AS BIGINT) AS doc_id, CAST(date AS VARCHAR) AS date,
       CAST(score AS BIGINT) AS score FROM rs WHERE score > 0""")
def q_timeseries_running_gaps(spark, sf_dir):
    clusters, docs, dates = _gap_inputs(spark, sf_dir)
    out = ts.cluster_timeseries(clusters, docs, dates, mode="last_pair_running")
    return out.select("run", F.col("cluster").cast("bigint"), F.col("doc_id").cast("bigint"),
                      F.col("date").cast("string"), F.col("score").cast("bigint"))


@register("date_score_lines", sql=S.ctes(GAPS_CTE) + """
SELECT cp.run, CAST(cp.cluster AS BIGINT) AS cluster, CAST(d.date AS VARCHAR) || ' ' || CAST(sum(ph.hits) AS BIGINT) AS line
FROM cp JOIN ph ON ph.a = cp.a AND ph.b = cp.b JOIN dts d ON d.doc_id = ph.doc_id
WHERE d.date IS NOT NULL GROUP BY cp.run, cp.cluster, d.date""")
def q_date_score_lines(spark, sf_dir):
    clusters, docs, dates = _gap_inputs(spark, sf_dir)
    lines = ts.date_score_lines(ts.cluster_timeseries(clusters, docs, dates))
    return lines.select("run", F.col("cluster").cast("bigint"), "line")


# Earlier names of the three, from when they stood beside forms over a part of the topics.
for _name, _fn in (("timeseries_repeated_words", q_timeseries_repeated_words), ("timeseries_running_gaps", q_timeseries_running_gaps),
                   ("date_score_lines", q_date_score_lines)):
    register(f"{_name}_whole", sql=ORACLE[_name])(_fn)


@register("timeseries_weekly_wide", sql=S.ctes(TS_CTE) + """,
wk AS (SELECT run, cluster, CAST(date_trunc('week', date) AS DATE) + 6 AS week, sum(score) AS score FROM tsd GROUP BY 1, 2, 3),
cal AS (SELECT run, CAST(unnest(generate_series(min(week), max(week), INTERVAL 7 DAY)) AS DATE) AS week FROM wk GROUP BY run),
cl AS (SELECT DISTINCT run, cluster FROM wk)
SELECT cal.run, CAST(cal.week AS VARCHAR) AS week,
       string_agg(cl.cluster || ':' || CAST(coalesce(wk.score, 0) AS BIGINT), ' ' ORDER BY cl.cluster) AS scores
FROM cal JOIN cl ON cl.run = cal.run LEFT JOIN wk ON wk.run = cal.run AND wk.week = cal.week AND wk.cluster = cl.cluster
GROUP BY cal.run, cal.week""")
def q_timeseries_weekly_wide(spark, sf_dir):
    """A row per run and week between the run's first and last, a score per cluster of the run, gaps 0."""
    topics, docs = _topics(spark, sf_dir)
    t = ts.cluster_timeseries(topics, docs, doc_dates(spark, sf_dir))
    told = F.transform(F.array_sort(F.map_entries("scores")), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return ts.weekly_table(t).select("run", F.col("week").cast("string"), F.array_join(told, " ").alias("scores"))


@register("timeseries_max_words", sql=S.ctes(GAPS_CTE).replace(
    "list_concat(words, words[1:1]) AS words FROM topics", "list_concat(words, words) AS words FROM topics WHERE 2 * len(words) <= 15") + """
SELECT cp.run, CAST(cp.cluster AS BIGINT) AS cluster, CAST(d.date AS VARCHAR) AS date, CAST(sum(ph.hits) AS BIGINT) AS score
FROM cp JOIN ph ON ph.a = cp.a AND ph.b = cp.b JOIN dts d ON d.doc_id = ph.doc_id
WHERE d.date IS NOT NULL GROUP BY cp.run, cp.cluster, d.date""")
def q_timeseries_max_words(spark, sf_dir):
    """FLT-7: lists written twice, of which those of more than 15 words have no series."""
    topics, docs = _topics(spark, sf_dir)
    twice = topics.select("run", "cluster", F.concat("words", "words").alias("words"))
    out = ts.cluster_timeseries(twice, docs, _gap_dates(spark, sf_dir))
    return out.select("run", F.col("cluster").cast("bigint"), F.col("date").cast("string"), F.col("score").cast("bigint"))
