"""Array-vector column expressions (SCL-29..32).

Spark has no built-in vector distance in ``functions``; these are written
with higher-order array functions so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    """SCL-29: the un-squared Euclidean norm of a - b."""
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double"))
                                  * (x.cast("double") - y.cast("double")))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """SCL-31; 0 when either vector is zero."""
    d = norm(a) * norm(b)
    return F.when(d > 0, dot(a, b) / d).when(d == 0, 0.0)


def cosine_error(a: Column, b: Column) -> Column:
    """1 - cos: a distance-like error for spherical clustering."""
    return F.lit(1.0) - cosine_similarity(a, b)


def abs_cosine_similarity(a: Column, b: Column) -> Column:
    """SCL-30 as the reference has it: |cos|, which is larger the closer two vectors are."""
    return F.abs(cosine_similarity(a, b))


def l2_normalize(a: Column) -> Column:
    """SCL-32: a / |a|; null for a zero vector (filter those first)."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


ERRORS = {"euclidean": euclidean, "cosine": cosine_error, "abs_cosine": abs_cosine_similarity}


def error_fn(error):
    """UDF-2/3: an error by name, or a function of two vector columns; others raise."""
    if callable(error):
        return error
    try:
        return ERRORS[error]
    except (KeyError, TypeError):
        raise ValueError(f"unknown error {error!r}; choose one of {sorted(ERRORS)} or pass a function of two columns") from None


def error_name(error) -> str:
    return getattr(error, "__name__", str(error)) if callable(error) else error


def checked_error(df, error, features: str, centroid: str) -> Column:
    """``error`` of two columns of ``df``; a function that gives anything but a number raises before a job is run."""
    out = error_fn(error)(F.col(features), F.col(centroid))
    if not isinstance(out, Column):
        raise TypeError(f"{error_name(error)} gives {type(out).__name__}, not a column")
    kind = df.select(out.alias("_e")).schema["_e"].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{error_name(error)} gives {kind.simpleString()}, not a number")
    return out.cast("double")
