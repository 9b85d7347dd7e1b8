"""Registered queries: cleaning, tokens, tf-idf (JOB-2a, JOB-3, AGG-1..3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.functions.text import clean_text, tokens
from topicloom.operators import keywords as kw
from topicloom.plans import sql as S
from topicloom.plans.registry import register
from topicloom.plans.tables import cleaned_documents, table


@register("clean_text", sql=f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {S.clean_sql('text')} AS text FROM documents")
def q_clean_text(spark, sf_dir):
    return cleaned_documents(spark, sf_dir).select(F.col("doc_id").cast("bigint"), "text")


@register("tokens_positions", sql=S.with_clean("""
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(pos AS BIGINT) AS pos, token FROM (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs))"""))
def q_tokens_positions(spark, sf_dir):
    d = cleaned_documents(spark, sf_dir)
    return d.select(F.col("doc_id").cast("bigint"),
                    F.posexplode(tokens(F.col("text"))).alias("pos", "token")) \
        .select("doc_id", F.col("pos").cast("bigint"), "token")


@register("term_doc_freq", sql=S.with_clean("""
, toks AS (SELECT doc_id, unnest(regexp_split_to_array(text || chr(10), '\\s')) AS token FROM docs),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY doc_id, token),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT CAST(tf.doc_id AS BIGINT) AS doc_id, tf.token, CAST(tf.tf AS BIGINT) AS tf, CAST(dfs.df AS BIGINT) AS df
FROM tf JOIN dfs USING (token)"""))
def q_term_doc_freq(spark, sf_dir):
    tf = kw.term_frequencies(cleaned_documents(spark, sf_dir))
    return tf.join(kw.document_frequencies(tf), "token").select(
        F.col("doc_id").cast("bigint"), "token", F.col("tf").cast("bigint"), F.col("df").cast("bigint"))


@register("max_df", sql=S.with_clean("""
, toks AS (SELECT doc_id, unnest(regexp_split_to_array(text || chr(10), '\\s')) AS token FROM docs),
tf AS (SELECT DISTINCT doc_id, token FROM toks),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token)
SELECT CAST(max(df) AS BIGINT) AS max_df, CAST((SELECT count(*) FROM documents) AS BIGINT) AS n_docs FROM dfs"""))
def q_max_df(spark, sf_dir):
    docs = cleaned_documents(spark, sf_dir)
    dfs = kw.document_frequencies(kw.term_frequencies(docs))
    return kw.max_document_frequency(dfs).select(
        F.col("max_df").cast("bigint"), docs.select(F.count(F.lit(1))).scalar().cast("bigint").alias("n_docs"))


@register("tfidf_scores", sql=f"""WITH docs AS ({S.CLEAN_DOCS}),
{S.TFIDF_SCORES_CTE.format(lo='0.0', hi='1.0').strip()}
SELECT CAST(doc_id AS BIGINT) AS doc_id, token, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df,
       round(idf, 6) + 0.0 AS idf, round(tfidf, 6) + 0.0 AS tfidf FROM sc""")
def q_tfidf_scores(spark, sf_dir):
    s = kw.tfidf_scores(cleaned_documents(spark, sf_dir))
    return s.select(F.col("doc_id").cast("bigint"), "token", F.col("tf").cast("bigint"),
                    F.col("df").cast("bigint"), F.round("idf", 6).alias("idf"),
                    F.round("tfidf", 6).alias("tfidf"))


def _keywords_out(df):
    return df.select(F.col("doc_id").cast("bigint"), F.col("rank").cast("bigint"), "token",
                     F.round("tfidf", 6).alias("tfidf"))


@register("tfidf_keywords", sql=S.tfidf_keywords_sql(0.05))
def q_tfidf_keywords(spark, sf_dir):
    return _keywords_out(kw.tfidf_keywords(cleaned_documents(spark, sf_dir), pct=0.05))


@register("tfidf_keywords_pipeline", sql=S.tfidf_keywords_sql(0.75))
def q_tfidf_keywords_pipeline(spark, sf_dir):
    """The pipeline setting: 75 % of each document's terms."""
    return _keywords_out(kw.tfidf_keywords(cleaned_documents(spark, sf_dir), pct=0.75))


@register("tfidf_band_max", sql=S.tfidf_keywords_sql(0.3, max_kws=12, min_kws=2, lo=0.002, hi=0.5))
def q_tfidf_band_max(spark, sf_dir):
    return _keywords_out(kw.tfidf_keywords(cleaned_documents(spark, sf_dir), pct=0.3, max_kws=12,
                                           min_kws=2, min_appear_pct=0.002, max_appear_pct=0.5))


@register("tfidf_variants", sql=f"""WITH docs AS ({S.CLEAN_DOCS}),
toks AS (SELECT doc_id, unnest(regexp_split_to_array(text || chr(10), '\\s')) AS token FROM docs),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY doc_id, token),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
mx AS (SELECT CAST(max(df) AS DOUBLE) AS m FROM dfs)
SELECT CAST(tf.doc_id AS BIGINT) AS doc_id, tf.token, round(ln(mx.m / (1 + dfs.df)), 6) + 0.0 AS idf,
       round((0.5 + 0.5 * tf.tf / max(tf.tf) OVER (PARTITION BY tf.doc_id)) * ln(mx.m / (1 + dfs.df)), 6) + 0.0 AS tfidf
FROM tf JOIN dfs USING (token) CROSS JOIN mx""")
def q_tfidf_variants(spark, sf_dir):
    """SCL-27: the max-df idf with double-normalised tf (the commented-out forms)."""
    s = kw.tfidf_scores(cleaned_documents(spark, sf_dir), idf="max", tf_form="double_normalized")
    return s.select(F.col("doc_id").cast("bigint"), "token", F.round("idf", 6).alias("idf"),
                    F.round("tfidf", 6).alias("tfidf"))


@register("positional_index", sql=S.with_clean("""
SELECT CAST(doc_id AS BIGINT) AS doc_id, token, array_to_string(list(pos ORDER BY pos), ' ') AS positions FROM (
  SELECT doc_id, unnest(w) AS token, unnest(range(len(w))) AS pos
  FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM docs))
GROUP BY doc_id, token"""))
def q_positional_index(spark, sf_dir):
    """SCL-38 / D16: word -> positions per document (the time series' index)."""
    d = cleaned_documents(spark, sf_dir)
    t = d.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("pos", "token"))
    g = t.groupBy("doc_id", "token").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    return g.select(F.col("doc_id").cast("bigint"), "token",
                    F.array_join(F.transform("p", lambda x: x.cast("string")), " ").alias("positions"))


# Pieces that the cleaning chain is for and the documents don't hold: an address, brackets, a written line end.
ODD_SQL = "'see http://site.example/a?b=1 now [note ' || doc_id || '] and c:\\\\n path-to/x_y ' || coalesce(text, '')"


@register("clean_text_odd", sql=f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {S.clean_sql(ODD_SQL)} AS text FROM documents")
def q_clean_text_odd(spark, sf_dir):
    """SCL-4, 5, 8: addresses, written line ends and brackets in front of every document."""
    odd = F.concat(F.lit("see http://site.example/a?b=1 now [note "), F.col("doc_id").cast("string"),
                   F.lit("] and c:\\\\n path-to/x_y "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint"), clean_text(odd).alias("text"))


@register("tfidf_probabilistic", sql=f"""WITH docs AS ({S.CLEAN_DOCS}),
toks AS (SELECT doc_id, unnest(regexp_split_to_array(text || chr(10), '\\s')) AS token FROM docs),
tf AS (SELECT doc_id, token, count(*) AS tf FROM toks GROUP BY doc_id, token),
dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
nn AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
sc AS (SELECT doc_id, token, tf, CASE WHEN df < n THEN ln((n - df) / df) END AS idf FROM tf JOIN dfs USING (token) CROSS JOIN nn)
SELECT CAST(doc_id AS BIGINT) AS doc_id, token, round(idf, 6) + 0.0 AS idf, round(tf * idf, 6) + 0.0 AS tfidf FROM sc""")
def q_tfidf_probabilistic(spark, sf_dir):
    """SCL-27: the probabilistic idf; null for a token of all documents."""
    s = kw.tfidf_scores(cleaned_documents(spark, sf_dir), idf="probabilistic")
    return s.select(F.col("doc_id").cast("bigint"), "token", F.round("idf", 6).alias("idf"), F.round("tfidf", 6).alias("tfidf"))
