"""Operator 13 against whole numbers and numpy's covariance, and its defined cases."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import whitening
from topicloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, n string, component int"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda w: st.lists(st.lists(st.integers(0, 2**40), min_size=w, max_size=w), min_size=1, max_size=90)))
def test_cross_products(rows):
    x = np.array(rows, object)
    assert (whitening.cross_products(np.array(rows, np.int64)) == x.T.dot(x)).all()


def plain(rows, width):
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] + [100_000] * (width - len(v))) for i, v in rows
         if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    n = len(x)
    sums = [sum(v[d] for _, v in x) for d in range(width)]
    dev = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in x]
    m = np.array([[float(Fraction(c * n - s, n)) for c, s in zip(v, sums)] for _, v in x])
    e, v = np.linalg.eigh(m.T @ m / n)
    return n, dev, m, e[::-1], v[:, ::-1]


def test_query_and_defined_cases(spark, tables):
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0.1 * d, 0.05 * (d + 1)) for d in range(12)]) for k in range(900)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (950, rows[0][1][:5]), (951, [])]
    rows += [(960, None), (961, [None] * 12), (962, [float("nan")] * 12), (963, [float("-inf")] + [0.0] * 11), (964, [3e38] * 12)]
    df = spark.createDataFrame([(i, v, "x", 9) for i, v in rows], SCHEMA).repartition(7)
    n, dev, m, e, v = plain(rows[:-1], 12)
    got = QUERIES["op13_bit_sliced_whitening"](spark, tables(embeddings=df)).collect()
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    key = lambda i: (i is None, i)
    assert sorted(((r.vec_id, r.deviation) for r in got if r.component == 3), key=lambda r: (key(r[0]), r[1])) == \
        sorted(dev, key=lambda r: (key(r[0]), r[1]))
    white = m @ v[:, :8] / np.sqrt(e[:8])
    for c in range(8):
        own = {r.vec_id: r.whitened for r in got if r.component == c + 1}
        turn = np.sign(own[0] / white[0, c])
        assert all(own[i] == pytest.approx(turn * w, abs=1e-9) for (i, _), w in zip(dev, white[:, c]))
        assert all(r.explained == pytest.approx(e[c] / e.sum(), rel=1e-9) for r in got if r.component == c + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_no_rows_and_no_spread(spark, tables):
    q = QUERIES["op13_bit_sliced_whitening"]
    df = spark.createDataFrame([(1, [0.5, 1.0], "x", 9), (2, None, "x", 9)], SCHEMA)
    for rows in (df, df.limit(0), df.filter("vec_id = 2"), df.union(df)):
        assert q(spark, tables(embeddings=rows)).collect() == []
    two = spark.createDataFrame([(1, [0.5, 1.0], "x", 9), (2, [0.25, 1.0], "x", 9)], SCHEMA)
    assert sorted((r.vec_id, r.component, abs(r.whitened), r.explained) for r in q(spark, tables(embeddings=two)).collect()) == \
        [(1, 1, pytest.approx(1.0), 1.0), (2, 1, pytest.approx(1.0), 1.0)]
