"""Operator 9: features against a plain restatement, held-out accuracy, the defined cases."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import subword as sw

SCHEMA = "doc_id bigint, text string, score int, label string"


def plain(texts, fit):
    """Per text {bucket: share}, feature by feature."""
    out = []
    for text in texts:
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        known = {}
        for w in set(words):
            b, of, own = sw.word_buckets([w], fit)
            known[w] = (b, own)
            # a word's features: itself and every n-gram with its end marks
            assert len(b) == 1 + sum(max(len(w) + 2 - n + 1, 0) for n in fit.grams)
        share = Counter({sw.END: 1.0})
        for w in words:
            for b in known[w][0].tolist():
                share[b] += 1 / len(known[w][0])
        for a, b in zip(words, words[1:]):
            if a == b:
                share[sw.TWICE] += 1
            else:
                h = sw.mix(known[a][1] + sw.mix(known[b][1] + np.uint64(5)))
                share[int(h[0] % np.uint64(fit.buckets - 2)) + 2] += 1
        total = 1 + len(words) + max(len(words) - 1, 0)
        out.append({k: v / total for k, v in share.items()})
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bé", "日本語", "a", "word###", "x" * 30]), max_size=8).map(" ".join) | st.none(), max_size=5))
def test_features_and_scores(texts):
    fit = sw.Fit(buckets=5000)
    part = pa.array(texts, pa.string())
    table = np.random.default_rng(1).normal(size=fit.buckets)
    want = plain(texts, fit)
    for (at, share), w in zip(sw.sparse(part, fit), want, strict=True):
        assert dict(zip(at.tolist(), share.round(9).tolist())) == {k: round(v, 9) for k, v in w.items()}
    got = sw.scores(part, table, fit)
    assert np.allclose(got, [sum(table[k] * v for k, v in w.items()) for w in want])


def test_held_out_accuracy_and_cases(spark):
    rng = random.Random(7)
    voc = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(4000)]
    rows = []
    for k in range(1200):
        w = rng.choices(voc, k=rng.randint(15, 80))
        if k % 4 == 0:
            w = [x + "###" if rng.random() < 0.5 else x for x in w] if k % 8 else [x.upper() + "!!" for x in w]
        rows.append((k, " ".join(w), 0 if k % 4 == 0 else 1))
    docs = spark.createDataFrame([(k, t, 1, "l") for k, t, _ in rows] + [(None, "x", 1, "l"), (5000, None, 1, "l"), (5001, "", 1, "l"),
                                                                         (3, rows[3][1], 1, "l")], SCHEMA)
    labels = spark.createDataFrame([(k, y, "z") for k, _, y in rows] + [(None, 1, "z"), (7, None, "z"), (9, 0, "z")],
                                   "doc_id bigint, quality int, text string")
    fit = sw.Fit(buckets=1 << 14, epochs=6, sample=400)
    got = sw.scored(docs, labels, fit=fit).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r.score <= 1 for r in got)
    truth = {k: y for k, _, y in rows}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)
    unseen = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(unseen) > 200 and np.mean(unseen) > 0.95
    empty = {r.doc_id: r.score for r in got if r.doc_id in (5000, 5001)}
    assert empty[5000] == empty[5001]
    # held-out labels can't matter
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(doc_id AS string)) % 4 = 2 THEN 1 - quality ELSE quality END AS quality")
    again = {r.doc_id: r.score for r in sw.scored(docs, flipped, fit=fit).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in got)


def test_labels_of_one_kind_or_none(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "l"), (2, None, 1, "l")], SCHEMA)
    labels = spark.createDataFrame([(1, 1), (4, 1)], "doc_id bigint, quality int")
    assert {r.predicted for r in sw.scored(docs, labels).collect()} == {1}
    assert {r.score for r in sw.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert sw.scored(docs.limit(0), labels).collect() == []
