"""Coherence over count tables: pairs are pruned before they are counted."""

import math

import pytest

import __spark_entry__ as E
from topicloom.operators import coherence as coh
from topicloom.operators import ngrams as ng

SF = "/root/testdata/sf0.001"


def _inputs(spark):
    docs = spark.createDataFrame([(1, "a b c a d"), (1, "b b x y a c"), (None, "c a"), (2, ""), (3, None), (4, "d x y z a b c d e f g a")],
                                 "doc_id long, text string")
    topics = spark.createDataFrame([("r", 0, ["a", "b", "a"]), ("r", 1, ["c", "unseen", "d"]), (None, 2, ["x"]), ("s", 3, [])],
                                   "run string, cluster int, words array<string>")
    return topics, docs


@pytest.mark.parametrize("small", [0, 100])
def test_known_totals_and_pruning_change_no_score(spark, small, monkeypatch):
    monkeypatch.setattr(coh, "SMALL", small)
    topics, docs = _inputs(spark)
    tables = ng.window_ngrams(docs)
    got = [coh.topic_coherence(topics, *tables, totals=t) for t in (None, ng.totals(docs))]
    got.append(coh.topic_coherence_from_docs(topics, docs))
    plain = [{(r.run, r.cluster): (r["mean"], r["median"]) for r in g.collect()} for g in got]
    assert len(plain[0]) == 4 and sum(math.isnan(m) for m, _ in plain[0].values()) == 2
    for other in plain[1:]:
        assert other == {k: pytest.approx(v, nan_ok=True) for k, v in plain[0].items()}


def test_only_pairs_of_topic_words_are_grouped(spark):
    plan = E.QUERIES["coherence_from_tables"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    grouped = [at for at in range(len(plan)) if plan.startswith("Aggregate [", at) and "greatest(" in plan[at:plan.index("\n", at)]]
    grouped += [at for at in range(len(plan)) if plan.startswith("Aggregate [_groupingexpression", at) and "w1#" in plan[at:plan.index("\n", at)]]
    assert grouped
    for at in grouped:
        # below the grouping of pairs: both prunings, then the pairs
        below = plan[at:plan.index("Generate inline", at)]
        assert below.count("LeftSemi") == 2
