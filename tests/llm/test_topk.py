"""Operator 12 against all pairs, and its defined cases."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from topicloom.llm import topk
from topicloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score int"


def plain(rows, k=20, scale=64):
    """rows (id, vector) -> the expected (query_id, rank, vec_id, score)."""
    good = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows
            if v is not None and not any(c is None or not math.isfinite(c) for c in v)]
    out = []
    for q, (i, x) in enumerate(good):
        if i is None or i % 20:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y)), j is None, j or 0, n) for n, (j, y) in enumerate(good) if n != q)
        out += [(i, r, None if none else j, -minus) for r, (minus, none, j, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(map(tuple, df.select("query_id", "rank", "vec_id", "score").collect()), key=repr)


def test_query_and_defined_cases(spark, tables):
    rng = random.Random(2)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(13)]) for k in range(700)]
    rows += [(700 + k, [1.0] * 13) for k in range(60)] + [(800 + k, rows[20 * k][1]) for k in range(9)]  # ties, copies
    rows += [(900, None), (920, [1.0, None]), (940, [float("nan")]), (960, [float("inf"), 1.0]), (980, []), (1000, [0.5]), (1020, [3e37] * 13)]
    rows += [(None, rows[3][1]), (None, [1.0] * 13), (40, rows[40][1]), (41, rows[41][1])]
    df = spark.createDataFrame([(i, v, "r", 3) for i, v in rows], SCHEMA).repartition(5)
    rows = [r for r in rows if r[0] != 1020]  # 64 * 3e37 is no long
    assert result(QUERIES["op12_branch_and_bound"](spark, tables(embeddings=df))) == plain(rows)
    assert result(QUERIES["op12_branch_and_bound"](spark, tables(embeddings=df.limit(0)))) == []
    few = df.filter("vec_id IN (0, 1, 2)")
    assert result(QUERIES["op12_branch_and_bound"](spark, tables(embeddings=few))) == plain([r for r in rows if r[0] in (0, 1, 2)])


def test_small_blocks_and_large_numbers(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(10)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(3)
    for scale in (4.0, 2.0**14, 2.0**28):  # float32, float64 and whole numbers of any size
        s = topk.Search(k=7, scale=scale, dims=3, rows=32, queries=8, cells=4, held=1)
        assert result(topk.nearest(df, F.col("vec_id") % 20 == 0, s=s)) == plain(rows, 7, scale)


def test_bounds_leave_candidates_out():
    """Rows whose masses differ: most values are never read, and the best are the same."""
    rng = np.random.default_rng(4)
    c = np.floor(rng.normal(0, 40, (5000, 64)) * (0.9 ** np.arange(64))).astype(np.int64)
    keys = np.arange(5000)
    block = topk.packed(keys, keys, c, 8, "float64")
    asks = topk.packed(keys[:30], keys[:30], c[:30], 8, "float64")
    shape = lambda b, n: (np.frombuffer(b["data"]).reshape(64, n), np.frombuffer(b["mass"]).reshape(-1, n))
    best = topk.Best(keys[:30], keys[:30], 20)
    read, there = topk.search(*shape(asks, 30), *shape(block, 5000), keys, keys, best, 8)
    assert read < 0.5 * there
    scores = c[:30] @ c.T
    for q in range(30):
        order = sorted((x for x in range(5000) if x != q), key=lambda x: (-scores[q, x], x))[:20]
        assert best.rows[q][1].tolist() == order and best.rows[q][0].tolist() == scores[q, order].tolist()


def test_copies_of_the_blocks_never_pass_the_driver(spark):
    """Stored, the blocks of queries are small; copied once a cell they are not: no join may broadcast them."""
    rng = random.Random(5)
    rows = [(k, [rng.gauss(0, 1) for _ in range(10)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    with topk.Tables() as tables:
        out = topk._nearest(df, F.col("vec_id") % 20 == 0, "vec_id", "embedding", topk.Search(k=5, rows=32, queries=8), tables.written)
        got = result(out)
        plan = out._jdf.queryExecution().executedPlan().toString()
    assert got == plain(rows, 5) and "SortMergeJoin" in plan and "Broadcast" not in plan
