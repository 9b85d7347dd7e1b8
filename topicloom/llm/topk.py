"""Operator 12: exact top-k search by columnar branch and bound.

Every query is compared with all rows by inner product of integer vectors.
Rows are packed into blocks in vertical layout: all values of a dimension
lie together, and each row has its remaining mass (the norm of what follows)
after each block of dimensions. A query adds up scores one block of
dimensions at a time. What the rest can still add or take away is at most
the product of the remaining masses (Cauchy-Schwarz), so after each block

* the k-th best lower bound raises the threshold of the query, and
* the candidates whose upper bound is below it are left out: the survivors
  are compacted, and only their values of the next block are read.

The threshold is carried from one block of rows to the next. Candidates that
could tie with the k-th score survive, so the result is exact.

Queries are dealt to blocks by a hash of their row number. Each block of
queries meets each block of rows in an equi-join of (query block, cell), in
which a block of queries is copied once a cell and a block of rows once a
query block: no task holds more than two blocks, whatever the table's size.

Defined cases: vectors that are null or hold null or non-finite components
(or values that leave a long) take no part; shorter vectors count as filled
up with zeros, an empty one as all zeros; a row is a candidate of every query
but itself, so a repeated row finds its copies; equal scores go to the
smaller vec_id, null last; a null vec_id is no query; an empty table gives
no rows; other columns are left alone.
"""

from __future__ import annotations

from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import Tables, written

BLOCK = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("data", pa.binary()), ("mass", pa.binary())])
BLOCK_DDL = "block bigint, keys binary, ids binary, data binary, mass binary"
HIT = pa.schema([("query_key", pa.int64()), ("query_id", pa.int64()), ("key", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
HIT_DDL = "query_key bigint, query_id bigint, key bigint, vec_id bigint, score bigint"
#: A null id, and a place that no row has: no vec_id of a table is as small.
NO_ID = np.iinfo(np.int64).min


@dataclass(frozen=True)
class Search:
    k: int = 20
    scale: float = 64.0
    dims: int = 8
    rows: int = 8192
    queries: int = 4096
    #: tasks that share the rows for one block of queries, at most
    cells: int = 256
    #: blocks of queries whose best rows a task remembers at a time; others are handed on and merged
    held: int = 4


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of each component, null where the vector takes no part."""
    x = F.transform(vector, lambda c: F.lit(scale) * c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= 2.0**62))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(False)), F.transform(x, lambda c: F.floor(c)))


def packed(keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, dims: int, exact: str) -> dict:
    """A block: rising keys, ids, values by dimension, and the masses that remain after each block of dimensions."""
    order = np.argsort(keys)
    keys, ids, rows = keys[order], ids[order], rows[order]
    squares = rows.astype(np.float64) ** 2
    after = [np.sqrt(squares[:, d:].sum(1)) for d in range(dims, rows.shape[1] + dims, dims)]
    return {"block": int(keys[0]), "keys": keys.tobytes(), "ids": ids.tobytes(),
            "data": np.ascontiguousarray(rows.T).astype(exact).tobytes(), "mass": np.array(after).tobytes()}


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one width, filled up with zeros."""
    n = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(values), width), np.int64)
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def _columns(batch: pa.RecordBatch, width: int):
    ids = batch.column("vec_id")
    known = ids.is_null().to_numpy(zero_copy_only=False)
    ids = np.where(known, NO_ID, ids.fill_null(0).to_numpy(zero_copy_only=False))
    return batch.column("key").to_numpy(zero_copy_only=False), ids, _matrix(batch.column("x"), width)


def packing(width: int, s: Search, exact: str):
    """Batches of (key, vec_id, x) -> blocks of up to ``s.rows`` rows."""
    def pack(batches):
        wait, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), s.rows):
                wait.append(_columns(batch.slice(at, s.rows), width))
                size += len(wait[-1][0])
                while size >= s.rows:
                    whole = [np.concatenate(c) for c in zip(*wait)]
                    yield pa.RecordBatch.from_pylist([packed(*(c[:s.rows] for c in whole), s.dims, exact)], BLOCK)
                    wait, size = [tuple(c[s.rows:].copy() for c in whole)], size - s.rows
        if size:
            yield pa.RecordBatch.from_pylist([packed(*(np.concatenate(c) for c in zip(*wait)), s.dims, exact)], BLOCK)
    return pack


def query_packing(width: int, s: Search, exact: str):
    """One block of queries -> one row."""
    def pack(group: pa.Table) -> pa.Table:
        row = packed(*_columns(group.combine_chunks().to_batches()[0], width), s.dims, exact)
        return pa.Table.from_pylist([row | {"block": group.column("qb")[0].as_py()}], BLOCK)
    return pack


class Best:
    """The best rows so far of a block of queries."""

    def __init__(self, keys, ids, k):
        self.keys, self.ids, self.k = keys, ids, k
        self.rows = [(np.zeros(0, np.int64),) * 3 for _ in keys]  # scores, ids, keys of rows
        self.least = np.full(len(keys), -np.inf)

    def add(self, q: int, scores, ids, keys) -> None:
        scores, ids, keys = (np.concatenate(c) for c in zip(self.rows[q], (scores, ids, keys)))
        order = np.lexsort((keys, ids, ids == NO_ID, -scores))[:self.k]
        self.rows[q] = scores[order], ids[order], keys[order]
        if len(order) == self.k:
            self.least[q] = max(self.least[q], float(scores[order[-1]]))

    def told(self):
        n = [len(r[0]) for r in self.rows]
        scores, ids, keys = (np.concatenate(c) for c in zip(*self.rows))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.keys, n)), pa.array(np.repeat(self.ids, n)), pa.array(keys),
                                           pa.array(ids, mask=ids == NO_ID), pa.array(scores)], schema=HIT)


def search(q: np.ndarray, q_mass: np.ndarray, c: np.ndarray, c_mass: np.ndarray, c_keys, c_ids, best: Best, dims: int) -> tuple[int, int]:
    """All queries of a block against a block of rows; (values read, values there)."""
    width, m = c.shape
    own = np.searchsorted(c_keys, best.keys)
    own = np.where((own < m) & (c_keys[np.minimum(own, m - 1)] == best.keys), own, -1)
    read = 0
    for lo in range(0, q.shape[1], 64):
        part = slice(lo, min(lo + 64, q.shape[1]))
        opening = q[:dims, part].T @ c[:dims]
        for j, score in enumerate(opening, lo):
            rest = slack(q_mass[0, j] * c_mass[0])
            live = None
            for d in range(dims, width + dims, dims):
                # bounds after the dimensions below d
                if len(score) > best.k + 1:
                    lower = score - rest
                    if live is None and own[j] >= 0:
                        lower[own[j]] = -np.inf
                    best.least[j] = max(best.least[j], float(np.partition(lower, len(lower) - best.k)[len(lower) - best.k]))
                good = np.flatnonzero(score + rest >= best.least[j])
                if live is None:
                    good = good[good != own[j]]
                live = good if live is None else live[good]
                score = score[good]
                if d >= width or not len(live):
                    break
                read += len(live) * min(dims, width - d)
                score = score + q[d:d + dims, j] @ c[d:d + dims].take(live, axis=1)
                rest = slack(q_mass[d // dims, j] * c_mass[d // dims][live])
            if len(live):
                best.add(j, np.array(score, np.int64), c_ids[live], c_keys[live])
    return read + min(dims, width) * m * q.shape[1], width * m * q.shape[1]


def slack(mass: np.ndarray) -> np.ndarray:
    """A bound that rounding can't bring below the true one; 0 where nothing remains."""
    return np.where(mass > 0, mass * (1 + 1e-9) + 1e-6, 0.0)


def searching(width: int, s: Search, exact: str):
    def meet(batches):
        held: OrderedDict[int, tuple] = OrderedDict()
        for batch in batches:
            for row in range(len(batch)):
                x = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                if x["qb"] not in held:
                    if len(held) >= s.held:
                        yield held.popitem(last=False)[1][2].told()
                    keys, ids = (np.frombuffer(x[f"q_{c}"], np.int64) for c in ("keys", "ids"))
                    held[x["qb"]] = (_values(x["q_data"], exact, width, len(keys)), np.frombuffer(x["q_mass"]).reshape(-1, len(keys)),
                                     Best(keys, ids, s.k))
                held.move_to_end(x["qb"])
                q, q_mass, best = held[x["qb"]]
                keys, ids = (np.frombuffer(x[c], np.int64) for c in ("keys", "ids"))
                search(q, q_mass, _values(x["data"], exact, width, len(keys)), np.frombuffer(x["mass"]).reshape(-1, len(keys)), keys, ids, best, s.dims)
        for _, _, best in held.values():
            yield best.told()
    return meet


def _values(data: bytes, exact: str, width: int, n: int) -> np.ndarray:
    values = np.frombuffer(data, exact).reshape(width, n)
    # sums beyond 2**53 are added as whole numbers of any size
    return values.astype(object) if exact == "int64" else values


def nearest(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", s: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``s.k`` best rows of each query among all others."""
    with Tables() as tables:
        return written(_nearest(rows, is_query, id_col, vector_col, s, tables.written), "nearest")


def _nearest(rows: DataFrame, is_query: Column, id_col: str, vector_col: str, s: Search, written) -> DataFrame:
    table = written(rows.select(F.col(id_col).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                                quantised(F.col(vector_col), s.scale).alias("x")).filter("x IS NOT NULL")
                    .withColumn("key", F.monotonically_increasing_id()), "vectors")
    size = F.coalesce(F.array_max(F.transform("x", lambda c: F.abs(c))), F.lit(0))
    known = table.agg(F.max(F.size("x")).alias("width"), F.max(size).alias("most"), F.count_if("asks").alias("asking"), F.count("*").alias("all")).first()
    width, asking = max(known["width"] or 0, 1), known["asking"]
    # numbers whose sums of products a float holds exactly
    sums = width * int(known["most"] or 0) ** 2
    exact = "float32" if sums < 2**24 else "float64" if sums < 2**53 else "int64"
    blocks = written(table.select("key", "vec_id", "x").mapInArrow(packing(width, s, exact), BLOCK_DDL), "blocks")
    n_queries = max(1, -(-asking // s.queries))
    asked = written(table.filter("asks").select("key", "vec_id", "x", F.pmod(F.xxhash64("key"), F.lit(n_queries)).alias("qb"))
                    .groupBy("qb").applyInArrow(query_packing(width, s, exact), BLOCK_DDL), "queries")
    cells = F.lit(max(1, min(s.cells, -(-known["all"] // s.rows))))
    left = asked.select(F.col("block").alias("qb"), *(F.col(c).alias(f"q_{c}") for c in ("keys", "ids", "data", "mass")),
                        F.explode(F.sequence(F.lit(0), cells - 1)).alias("cell"))
    right = blocks.select("keys", "ids", "data", "mass", F.pmod(F.xxhash64("block"), cells).cast("int").alias("cell"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_queries - 1).cast("bigint"))).alias("qb"))
    # both sides hold a block many times: as files they look small enough to be broadcast, by way of the driver
    found = left.hint("merge").join(right, ["qb", "cell"]).mapInArrow(searching(width, s, exact), HIT_DDL)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "key")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
