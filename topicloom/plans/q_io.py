"""Registered queries: format round trips (SCL-39/40, SRC-4/5/6, SNK-1/2/9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions import dates as D
from topicloom.functions import vectors as V
from topicloom.operators import keywords as kw
from topicloom.plans import sql as S
from topicloom.plans.derive import topic_runs
from topicloom.plans.registry import register
from topicloom.plans.tables import cleaned_documents, table
from topicloom.session import materialised, shared_path
from topicloom.sources import readers as R
from topicloom.sources import sinks as K


@register("json_roundtrip", sql=f"""WITH docs AS ({S.CLEAN_DOCS}),
toks AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text || chr(10), '\\s')) AS token FROM docs),
dfs AS (SELECT token, count(*) AS df FROM toks GROUP BY token)
SELECT token, CAST(df AS BIGINT) AS n, '{{"k":"' || token || '","n":' || df || '}}' AS value FROM dfs""")
def q_json_roundtrip(spark, sf_dir):
    """Document frequencies written as JSON lines (SNK-3) and parsed back (SRC-6)."""
    dfs = kw.document_frequencies(kw.term_frequencies(cleaned_documents(spark, sf_dir)))
    js = K.counts_json_lines(dfs, "token", "df")
    back = js.select("value", F.from_json("value", "k string, n bigint").alias("r"))
    return back.select(F.col("r.k").alias("token"), F.col("r.n").alias("n"), "value")


@register("text_vectors_roundtrip", sql="""
SELECT CAST(vec_id AS VARCHAR) AS word, CAST(len(embedding) AS BIGINT) AS dim,
       round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm
FROM embeddings""")
def q_text_vectors_roundtrip(spark, sf_dir):
    """Embeddings exported as 'word f f f' lines (SNK-9) and read back (SRC-4)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("features"))
    back = R.parse_word_vector_lines(K.vector_text(e))
    return back.select("word", F.size("features").cast("bigint").alias("dim"),
                       F.round(V.norm(F.col("features")), 6).alias("norm"))


@register("topic_csv_roundtrip", sql=S.ctes(S.TOPICS_CTE) + """
SELECT run, CAST(cluster AS VARCHAR) AS cluster, array_to_string(words, ' ') AS words FROM topics""")
def q_topic_csv_roundtrip(spark, sf_dir):
    """Topic runs exported as 'id, w1 w2' lines (SNK-2) and parsed back (SRC-5), per run."""
    t = topic_runs(spark, sf_dir)
    lines = K.cluster_csv(t, keep=("run",)).select("run", F.col("line").alias("value"), F.lit(0).alias("line_no"))
    out = R.parse_topic_csv(lines, keys=("run",))
    return out.select("run", "cluster", F.array_join("words", " ").alias("words"))


@register("keyword_lines", sql=S.tfidf_keywords_sql(0.05).replace(
    "SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(rnk AS BIGINT) AS rank, token,\n       round(tfidf, 6) + 0.0 AS tfidf\nFROM ranked WHERE",
    "SELECT CAST(doc_id AS BIGINT) AS doc_id, string_agg(token, ' ' ORDER BY rnk) AS line\nFROM ranked WHERE")
    + " GROUP BY doc_id")
def q_keyword_lines(spark, sf_dir):
    """SNK-1: one line of keywords per document, in rank order."""
    k = kw.tfidf_keywords(cleaned_documents(spark, sf_dir), pct=0.05)
    return K.keyword_text(k).select(F.col("doc_id").cast("bigint"), "line")


@register("epoch_seconds", sql="""
SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CAST(epoch(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) AS BIGINT) AS epoch
FROM orders""")
def q_epoch_seconds(spark, sf_dir):
    """SCL-40: ISO date string -> epoch seconds (UTC session)."""
    o = table(spark, sf_dir, "orders")
    iso = F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd")
    return o.select(F.col("o_orderkey").cast("bigint"), D.iso_to_epoch(iso).cast("bigint").alias("epoch"))


WORDS_BY_LANG = f"""WITH docs AS ({S.CLEAN_DOCS}),
toks AS (SELECT lang, unnest(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS token FROM docs),
cnt AS (SELECT lang, token, count(*) AS n FROM toks GROUP BY lang, token),
top AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM cnt)"""


@register("json_map_counts", sql=WORDS_BY_LANG + """
SELECT lang, token, CAST(n AS BIGINT) AS n FROM cnt""")
def q_json_map_counts(spark, sf_dir):
    """SRC-6 from files: objects of counts per language (16 each), written as
    files of one object, split at commas and read entry by entry."""
    from topicloom.functions.text import tokens
    from topicloom.plans.tables import cleaned_corpus
    t = cleaned_corpus(spark, sf_dir).select("lang", F.explode(tokens(F.col("text"))).alias("token"))
    n = t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("token"), F.lit(16)).alias("block")
    objects = n.groupBy("lang", block).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "n")))).alias("value"))
    path = shared_path(spark, "count-files")
    objects.write.partitionBy("lang", "block").text(path)
    entries = R.read_json_entries(spark, path)
    lang = F.regexp_extract("file", "/lang=([^/]*)/", 1)
    return materialised(entries.select(lang.alias("lang"), F.col("key").alias("token"), F.col("value").alias("n")), "counts")


@register("json_map_counts_whole", sql=WORDS_BY_LANG + """
SELECT lang, token, CAST(n AS BIGINT) AS n FROM cnt""")
def q_json_map_counts_whole(spark, sf_dir):
    """SRC-6 over all counts: JSON objects per language and hash block (65,536), so objects stay small."""
    from topicloom.functions.text import tokens
    from topicloom.plans.tables import cleaned_corpus
    t = cleaned_corpus(spark, sf_dir).select("lang", F.explode(tokens(F.col("text"))).alias("token"))
    n = t.groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n"))
    block = F.pmod(F.xxhash64("token"), F.lit(1 << 16))
    js = n.groupBy("lang", block.alias("block")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("token", "n")))).alias("value"))
    return js.select("lang", F.explode(R.parse_json_map(F.col("value"), "bigint")).alias("token", "n"))


EVALUATIONS_SQL = S.ctes(S.TOPICS_CTE) + """
SELECT CASE WHEN model = 'lang' THEN 'vox_corpus' ELSE 'corpus' END AS corpus, model AS embed, 'spherical' AS variant,
       CAST(k AS BIGINT) AS k, 'clusters' AS kind, CAST(cluster AS VARCHAR) AS cluster, CAST(len(words) AS DOUBLE) AS mean,
       CASE WHEN k > 1 THEN CAST(0.5 AS DOUBLE) END AS median FROM topics"""


@register("evaluation_files", sql=EVALUATIONS_SQL)
def q_evaluation_files(spark, sf_dir):
    """SRC-7 over SNK-4: run files by name, corpus names with an underscore, a
    NaN median, a run beyond the largest k, a name and a text that don't parse."""
    t = topic_runs(spark, sf_dir)
    scores = t.select("run", "model", "k", "cluster", F.size("words").cast("double").alias("mean"),
                      F.when(F.col("k") > 1, 0.5).otherwise(F.lit(float("nan"))).alias("median"))
    files = K.coherence_json(scores, ("model", "k"))
    name = F.concat_ws("_", F.when(F.col("model") == "lang", "vox_corpus").otherwise("corpus"), "model", F.lit("spherical"),
                       F.col("k").cast("string"), F.lit("clusters"), F.lit("evaluation.json"))
    good = files.select(name.alias("name"), "value")
    large = files.select(F.regexp_replace(name, "_[0-9]+_clusters", "_1001_clusters").alias("name"), "value")
    bad = files.select(F.lit("notes.json").alias("name"), "value").unionByName(files.select(name.alias("name"), F.lit("{").alias("value")))
    e = R.parse_evaluations(good.unionByName(large).unionByName(bad))
    return e.select("corpus", "embed", "variant", F.col("k").cast("bigint"), "kind", "cluster", "mean",
                    F.when(~F.isnan("median"), F.col("median")).alias("median"))


@register("debate_lines", sql="""
SELECT CAST(page_id AS BIGINT) AS page_id, '1.2.2016' AS date, 'Town ' || page_id % 9 AS location, url FROM pages""")
def q_debate_lines(spark, sf_dir):
    """SRC-9: 'date|location|url' lines."""
    p = table(spark, sf_dir, "pages")
    line = F.concat_ws("|", F.lit("1.2.2016"), F.concat(F.lit("Town "), (F.col("page_id") % 9).cast("string")), "url")
    return p.select("page_id", R.parse_debate_line(line).alias("d")).select(F.col("page_id").cast("bigint"), "d.*")


@register("ranked_lines", sql=S.ctes(S.TOPICS_CTE) + """
SELECT run, CAST(cluster AS BIGINT) AS cluster, array_to_string(words, ' ') AS words FROM topics""")
def q_ranked_lines(spark, sf_dir):
    """SRC-10: the words of 'score (w1, w2) [runs]' lines."""
    t = topic_runs(spark, sf_dir)
    line = F.format_string("%s (%s) [%s]", F.lit("0.5"), F.array_join("words", ", "), "run")
    return t.select("run", F.col("cluster").cast("bigint"), F.array_join(R.parse_ranked_cluster_line(line), " ").alias("words"))


@register("first_tokens", sql="""
SELECT DISTINCT CAST(string_split(text, ' ')[1] AS VARCHAR) AS speaker FROM documents""")
def q_first_tokens(spark, sf_dir):
    """SCL-17 as the reference's make target did it: the first token of each line."""
    return R.speaker_keys(table(spark, sf_dir, "documents").select(F.col("text").alias("value")))
