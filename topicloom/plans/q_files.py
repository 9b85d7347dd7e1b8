"""Registered queries: text exports written to files and read back (SNK-5..8, 10,
SRC-1, 3, 8, 11, ORD-5, SET-5).

Each writes the layout under the shared folder, reads the files and returns
what they say, with line numbers where the layout promises an order.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions.text import clean_text
from topicloom.operators import runs as R
from topicloom.operators import speakers as spk
from topicloom.operators import timeseries as ts
from topicloom.plans import sql as S
from topicloom.plans.derive import transcript_lines
from topicloom.plans.q_ingest import SPEAKER_CTE, _html_text_sql, _turn_block
from topicloom.plans.q_runs import RUNS_CTE, scored
from topicloom.plans.q_timeseries import QUERY_WORDS, TS_CTE, _query_filter_sql, _topics, doc_dates
from topicloom.plans.registry import ORACLE, register
from topicloom.plans.tables import cleaned_documents, table
from topicloom.session import materialised, shared_path
from topicloom.sources import readers
from topicloom.sources import sinks


@register("corpus_file", sql=S.with_clean("""
SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS line_no, coalesce(text, '') AS text FROM docs"""))
def q_corpus_file(spark, sf_dir):
    """The corpus as one document per line in order (SNK-6), read with line numbers as ids (SRC-1)."""
    docs = cleaned_documents(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    path = shared_path(spark, "corpus")
    sinks.write_ordered_text(docs, "text", ["doc_id"], path)
    return materialised(readers.read_corpus(spark, path).select(F.col("doc_id").alias("line_no"), "text"), "lines")


@register("transcript_files", sql="""
WITH lines AS (SELECT conv_id, turn, upper(role) || ': ' || text AS t FROM conversations),
each AS (SELECT conv_id, turn, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS sub FROM lines)
SELECT CAST(conv_id % 16 AS BIGINT) AS tape, CAST(row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn, sub, line) - 1 AS BIGINT) AS line_no,
  line FROM each""")
def q_transcript_files(spark, sf_dir):
    """Transcripts on sixteen tapes, a folder each, read back in order (SRC-3)."""
    lines = transcript_lines(spark, sf_dir).withColumn("tape", F.col("file") % 16)
    path = shared_path(spark, "transcripts")
    (lines.repartitionByRange("tape", "file", "turn", "sub", "line").sortWithinPartitions("tape", "file", "turn", "sub", "line")
     .select("tape", F.col("line").alias("value")).write.partitionBy("tape").text(path))
    back = readers.read_export(spark, path)
    return materialised(back.select(readers.folder_key("tape").cast("bigint").alias("tape"), "line_no", F.col("value").alias("line")), "lines")


@register("speaker_files", sql=ORACLE["speaker_corpus"])
def q_speaker_files(spark, sf_dir):
    """One folder per speaker (SNK-7), read back by folder."""
    c = spk.speaker_corpus(transcript_lines(spark, sf_dir), order=("turn", "sub"), block=_turn_block())
    path = shared_path(spark, "speakers")
    sinks.write_per_speaker(c.select("speaker", clean_text(F.col("text")).alias("text")), path)
    return materialised(readers.read_export(spark, path).select(readers.folder_key("speaker").alias("speaker"), F.col("value").alias("text")), "speakers")


@register("curve_files", sql=RUNS_CTE + """,
c AS (SELECT model, k, round(avg(score), 6) + 0.0 AS mean, round(median(median), 6) + 0.0 AS median FROM sc WHERE k <= 1000 GROUP BY model, k)
SELECT model AS embed, CAST(row_number() OVER (PARTITION BY model ORDER BY k) - 1 AS BIGINT) AS line_no, CAST(k AS BIGINT) AS k, mean, median FROM c""")
def q_curve_files(spark, sf_dir):
    """Curves as 'k mean median' lines by k (SNK-5, ORD-5), a folder per model."""
    topics, scores = scored(spark, sf_dir)
    s = (scores.join(topics.select("run", "cluster", "model", "k"), ["run", "cluster"]).withColumnRenamed("model", "embed")
         .withColumns({"variant": F.lit("topk"), "kind": F.lit("clusters")}))
    curves = R.coherence_curves(s).withColumns({c: F.round(c, 6) for c in ("mean", "median")})
    path = shared_path(spark, "curves")
    sinks.write_curves(curves, path)
    part = F.split("value", " ")
    number = lambda i: F.nanvl(part[i].cast("double"), F.lit(None).cast("double"))
    back = readers.read_export(spark, path)
    return materialised(back.select(readers.folder_key("embed").alias("embed"), "line_no", part[0].cast("bigint").alias("k"),
                                    number(1).alias("mean"), number(2).alias("median")), "lines")


@register("ranked_series_files", sql=RUNS_CTE + """,
r AS (SELECT model, run, row_number() OVER (ORDER BY round(score, 6) + 0.0, run, label, cluster) AS x, round(score, 6) + 0.0 AS score, nwords FROM ok)
SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY x) - 1 AS BIGINT) AS line_no, CAST(x AS BIGINT) AS x, score,
  CAST(nwords AS BIGINT) AS nwords, run FROM r""")
def q_ranked_series_files(spark, sf_dir):
    """'x score nwords run' lines by rank (SNK-10), a folder per model."""
    topics, scores = scored(spark, sf_dir)
    series = R.ranked_series(R.rank_all(scores, topics), F.split("run", "_").getItem(0)).withColumn("score", F.round("score", 6))
    path = shared_path(spark, "ranked")
    sinks.write_ranked_series(series, path)
    part = F.split("value", " ")
    back = readers.read_export(spark, path)
    return materialised(back.select(readers.folder_key("model").alias("model"), "line_no", part[0].cast("bigint").alias("x"),
                                    part[1].cast("double").alias("score"), part[2].cast("bigint").alias("nwords"), part[3].alias("run")), "lines")


@register("series_files", sql=S.ctes(TS_CTE) + f"""
SELECT array_to_string(c.words, ' ') AS words, CAST(t.date AS VARCHAR) AS date, CAST(t.score AS BIGINT) AS score
FROM tsd t JOIN topics c ON c.run = t.run AND c.cluster = t.cluster WHERE {_query_filter_sql(QUERY_WORDS)}""")
def q_series_files(spark, sf_dir):
    """Series in the reference's JSON layout (SNK-8), read back element by element (SRC-11) and asked for words."""
    clusters, docs = _topics(spark, sf_dir)
    t = ts.cluster_timeseries(clusters, docs, doc_dates(spark, sf_dir))
    path = shared_path(spark, "series")
    sinks.write_series_json(sinks.timeseries_nested(t.withColumn("date", F.col("date").cast("string")), clusters), path)
    back = readers.read_series_json(spark, path)
    for w in QUERY_WORDS:
        back = back.filter(F.array_contains("words", w))
    return materialised(back.select(F.array_join("words", " ").alias("words"), "date", "score"), "series")


@register("article_documents", sql=f"""
WITH a AS (SELECT doc_id, text, CAST(DATE '2014-03-01' + CAST(doc_id % 600 AS INTEGER) AS DATE) AS day FROM documents)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(day AS VARCHAR) AS date, strftime(day, '%m-%d-%Y') AS mdy,
  {S.clean_sql(_html_text_sql("coalesce(text, '')"))} AS text, true AS own_line FROM a""")
def q_article_documents(spark, sf_dir):
    """Tab-separated articles whose fields hold quotes, tabs and line breaks (SRC-8, SET-5):
    title, date and text of a record stay together, and (file, line) names it."""
    day = F.date_add(F.lit("2014-03-01").cast("date"), (F.col("doc_id") % 600).cast("int"))
    given = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("title"), F.lit("a\tb \"c\"").alias("category"),
                                                     F.concat(day.cast("string"), F.lit(" 14:01:30")).alias("published"), F.col("text").alias("body"))
    path = shared_path(spark, "articles")
    given.repartition(4).write.csv(path, sep="\t", header=True, escape='"', quoteAll=True)
    rows = readers.read_articles(spark, path, multi_line=True)
    docs = materialised(readers.article_corpus(rows, "title", "published", "body").withColumn("_n", F.lit(1)), "articles")
    own = docs.groupBy(F.col("file").alias("_f"), F.col("line_no").alias("_l")).agg(F.sum("_n").alias("_same"))
    return (docs.join(own, (F.col("file") == F.col("_f")) & (F.col("line_no") == F.col("_l")))
            .select(F.col("title").cast("bigint").alias("doc_id"), F.col("date").cast("string").alias("date"), "mdy", "text",
                    (F.col("_same") == 1).alias("own_line")))
