"""Plan checks: no Python in the text jobs, no cartesian products, pushdown."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NO_PYTHON = ["clean_text", "tfidf_keywords", "ngram_bi", "topic_coherence", "caption_text",
             "speaker_text", "html_text", "title_dates", "cluster_timeseries_total"]
#: Fits start jobs of their own and read checkpoints; so does the global rank.
ML = {"word2vec", "kmeans", "spherical_kmeans", "kmeans_centroid_labels", "wssse_curve", "lda_topics", "pca_layout"}
RANKED = {"rank_all", "rank_combined", "rank_combined_repeats", "ranked_series", "ranked_series_times5"}
#: The centroid matrix is a model made on the driver.
MODELS = {"nearest_words_cosine", "nearest_words_euclid", "nearest_words_zero", "centroid_label_lines"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NO_PYTHON)
def test_no_python_udf(spark, name):
    p = _plan(E.queries()[name](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p and "PythonUDF" not in p


def test_whole_plans_without_cartesian_products(spark):
    """A query is not run while it is built, so its plan goes down to the tables."""
    for name, fn in E.QUERIES.items():
        if name in ML:
            continue
        p = _plan(fn(spark, SF))
        if name not in RANKED | MODELS:
            assert "ExistingRDD" not in p and "FileScan parquet" in p, name
        assert "CartesianProduct" not in p, name
        assert "BroadcastNestedLoopJoin" not in p, name


def test_pairs_are_made_without_a_shuffle(spark):
    p = _plan(E.QUERIES["ngram_bi"](spark, SF))
    assert p.count("Exchange ") == 1 and p.index("Exchange ") < p.index("Generate ")


def test_filter_and_projection_reach_the_scan(spark):
    from pyspark.sql import functions as F
    from topicloom.plans.tables import table
    df = table(spark, SF, "documents").filter(F.col("lang") == "en").select("doc_id", "text")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in p


def test_tfidf_reads_a_stored_table_of_terms(spark):
    """Counts per token and scores read one table: no branch cleans or tokenises the texts again."""
    for name in ("tfidf_scores", "tfidf_keywords", "tfidf_variants"):
        p = _plan(E.QUERIES[name](spark, SF))
        assert "split(" not in p and "regexp_replace(" not in p, name


@pytest.mark.parametrize("name", ["cluster_timeseries_total", "cluster_timeseries_running", "timeseries_running_gaps",
                                  "timeseries_max_words", "rank_combined", "document_topics"])
def test_the_corpus_is_cleaned_once(spark, name, monkeypatch):
    """Runs, scores, series and topics of documents read one table of cleaned texts."""
    from topicloom.plans import tables
    made, clean = [], tables.clean_text
    monkeypatch.setattr(tables, "clean_text", lambda c: made.append(c) or clean(c))
    p = _plan(E.QUERIES[name](spark, SF))
    assert len(made) == 1 and "regexp_replace(" not in p
