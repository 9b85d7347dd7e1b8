"""Operator 13: embedding whitening from a bit-sliced scatter matrix.

Components become integers, floor(scale * c) + offset. Slices of rows are
shifted by their least value per dimension, so values are small and not
negative; bit b of a dimension over 64 rows is one word. The cross-product of
two dimensions is then the sum over pairs of bit planes

    2^(a + b) * popcount(plane_a of one AND plane_b of the other)

and the shift is taken back out in integers. Tasks hand on dimensions^2 sums,
which Spark adds up as decimals; n * sum(xy) - sum(x) * sum(y) is centred as
integers too, and only then becomes a double for the eigenvectors.

Every row is projected on the components of greatest eigenvalue and divided
by its root.

Defined cases: vectors that are null or hold null or non-finite components
(or values that leave a long) take no part; shorter vectors are filled up
with zeros before scaling, an empty one is all zeros; components whose
eigenvalue is zero up to rounding (constant dimensions, fewer rows than
components) have no rows, so one row alone or equal rows give none; equal
rows, null and repeated ids each count; an empty table gives no rows; other
columns are left alone. Sums are exact up to 38 digits.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import written
from topicloom.llm.topk import _matrix, quantised

#: Rows whose planes are made at a time.
ROWS = 8192
EXACT = "decimal(38,0)"


@dataclass(frozen=True)
class Scaling:
    scale: float = 1024.0
    offset: int = 100_000
    components: int = 8


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: the number of rows, their sums, and the components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def planes(shifted: np.ndarray) -> np.ndarray:
    """Bit planes of rows of non-negative numbers: (bits, dimensions, words of 64 rows)."""
    bits = int(shifted.max(initial=0)).bit_length()
    n, width = shifted.shape
    columns = np.zeros((width, -(-n // 64) * 64), np.int64)
    columns[:, :n] = shifted.T
    out = [np.packbits((columns >> b).astype(np.uint8) & 1, axis=1).view(np.uint64) for b in range(bits)]
    return np.array(out, np.uint64).reshape(bits, width, columns.shape[1] // 64)


def cross_products(shifted: np.ndarray) -> np.ndarray:
    """sum(x_i * x_j) of all dimensions i, j as whole numbers of any size, by AND and popcount."""
    p = planes(shifted)
    bits, width = len(p), shifted.shape[1]
    # below 2**62 all sums fit the machine's integers
    kind = np.int64 if 2 * bits + len(shifted).bit_length() < 62 else object
    out = np.zeros((width, width), kind)
    for a in range(bits):
        for b in range(a, bits):
            both = np.empty((width, width), np.int64)
            for i in range(width):
                both[i] = np.bitwise_count(p[a, i] & p[b]).sum(1, dtype=np.int64)
            both = both.astype(kind) * (1 << (a + b))
            out += both if a == b else both + both.T
    return out.astype(object)


SUMS = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("total", pa.decimal128(38, 0))])


def scatter(width: int, offset: int):
    """Batches of x -> (i, j, total): cross-products for i <= j; i = -1: the sum of dimension j; i = j = -1: rows."""
    def add(batches):
        n, sums, cross = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS), width)
                least = x.min(0)
                shifted = x - least
                least = least.astype(object) + offset
                part, rows = shifted.astype(object).sum(0) if x.max() - x.min() >= 2**48 else shifted.sum(0).astype(object), len(x)
                n += rows
                sums += part + rows * least
                cross += cross_products(shifted) + np.outer(least, part) + np.outer(part, least) + rows * np.outer(least, least)
        if n:
            i, j = np.triu_indices(width)
            rows = [(-1, -1, n), *((-1, d, s) for d, s in enumerate(sums)), *zip(i.tolist(), j.tolist(), cross[i, j])]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], schema=SUMS)
    return add


def prepared(rows: DataFrame, id_col: str, vector_col: str, s: Scaling) -> DataFrame:
    """(vec_id, x) of the rows that take part; x without the offset."""
    return rows.select(F.col(id_col).alias("vec_id"), quantised(F.col(vector_col), s.scale).alias("x")).filter("x IS NOT NULL")


def fitted(table: DataFrame, width: int, s: Scaling) -> Whitening:
    """The components of a prepared table. dimensions^2 / 2 sums reach the driver, whatever the number of rows."""
    told = (table.select("x").mapInArrow(scatter(width, s.offset), f"i int, j int, total {EXACT}")
            .groupBy("i", "j").agg(F.sum("total").cast(EXACT).alias("total")).collect())
    total = {(r["i"], r["j"]): int(r["total"]) for r in told}
    n = total[-1, -1]
    sums = [total[-1, d] for d in range(width)]
    # n^2 times the covariance, in whole numbers
    centred = [[n * total[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(width)] for i in range(width)]
    values, vectors = np.linalg.eigh(np.array([[c / n**2 for c in row] for row in centred]))
    trace = sum(centred[d][d] for d in range(width)) / n**2
    order = [k for k in np.argsort(-values, kind="stable")[:s.components] if values[k] > trace * width * 1e-14]
    return Whitening(n, sums, values[order], vectors[:, order], trace)


ROW = pa.schema([("vec_id", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])


def projecting(shared, offset: int):
    def project(batches):
        w: Whitening = shared.value
        whole = np.array([s // w.n - offset for s in w.sums], object)  # of the means
        rest = np.array([s % w.n for s in w.sums], object)
        turn = w.vectors / np.sqrt(w.values)
        part = (rest / w.n).astype(float)
        for batch in batches:
            x = _matrix(batch.column("x"), len(w.sums))
            near = x.astype(object) - whole if max(map(abs, whole)) >= 2**61 else x - whole.astype(np.int64)
            white = (near.astype(float) - part) @ turn
            # sum over dimensions of (n * x - sum)^2
            most = w.n * (int(abs(near).max(initial=0)) + 1)
            if len(w.sums) * most**2 < 2**63:
                spread = pa.array(((w.n * near.astype(np.int64) - rest.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
            else:
                spread = pa.array([Decimal(int(v)) for v in ((w.n * near.astype(object) - rest) ** 2).sum(1)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), spread, pa.array(list(white), pa.list_(pa.float64()))], schema=ROW)
    return project


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", s: Scaling = Scaling()) -> tuple[DataFrame, Whitening | None]:
    """((vec_id, deviation, whitened) per row that takes part, the fit). Without such rows the fit is None."""
    table = prepared(rows.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, vector_col, s)
    width = max(table.agg(F.max(F.size("x"))).first()[0] or 0, 0)
    ddl = f"vec_id bigint, deviation {EXACT}, whitened array<double>"
    if not width:
        return rows.sparkSession.createDataFrame([], ddl), None
    fit = fitted(table, width, s)
    shared = rows.sparkSession.sparkContext.broadcast(fit)
    return written(table.mapInArrow(projecting(shared, s.offset), ddl), "whitened"), fit


def identity_error(white: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of (covariance of the whitened rows - identity)."""
    k = len(fit.values)
    at = [F.col("whitened")[c] for c in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    if not pairs:
        return 0.0
    got = white.agg(*(F.covar_pop(at[i], at[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(got[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def components(white: DataFrame, fit: Whitening | None) -> DataFrame:
    """A row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    error = identity_error(white, fit) if fit else 0.0
    explained = F.array(*(F.lit(float(v / fit.trace)) for v in fit.values)) if fit and len(fit.values) else F.array().cast("array<double>")
    return (white.select("vec_id", "deviation", F.posexplode("whitened").alias("_c", "whitened"))
            .select("vec_id", (F.col("_c") + 1).cast("int").alias("component"), F.lit(fit.n if fit else 0).cast("bigint").alias("n"),
                    "deviation", "whitened", F.get(explained, F.col("_c")).alias("explained"), F.lit(error).alias("identity_error")))
