"""The driver contract: entry() and every registered query run on sf0.001,
and a sample of queries match their oracle SQL in DuckDB."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from topicloom.plans.tables import TABLES

SF = "/root/testdata/sf0.001"
SLOW = {"word2vec", "lda_topics"}


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["doc_id", "rank", "token", "tfidf"]


def test_every_query_has_an_oracle():
    assert set(E.ORACLE) == set(E.QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(set(E.QUERIES) - SLOW))
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    df.write.format("noop").mode("overwrite").save()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", ["tfidf_keywords", "ngram_uni", "caption_text", "speaker_text",
                                  "title_dates_override", "cluster_timeseries_running", "nearest_words_cosine",
                                  "rank_all", "missing_runs"])
def test_oracle_sample(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    sdf = E.queries()[name](spark, SF)
    assert sorted(sdf.columns) == sorted(dcols)
    order = sorted(dcols)
    di = [dcols.index(c) for c in order]
    si = [sdf.columns.index(c) for c in order]
    a = Counter(tuple(_norm(r[i]) for i in si) for r in sdf.collect())
    b = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    assert a == b
