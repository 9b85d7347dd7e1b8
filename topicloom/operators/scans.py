"""Order-dependent building blocks that stay parallel under skew.

A plain ``Window.partitionBy(file).orderBy(line)`` puts a whole file in one
task. These helpers bound every group instead:

* ``forward_fill`` and ``running_sum`` scan in two levels: inside fixed
  blocks of the order key, then over one summary row per block;
* ``band_pairs`` joins rows whose order keys lie within a band by
  bucketing the key and replicating one side into the neighbouring
  bucket, so the equi-join key includes the bucket and no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

UNB = Window.unboundedPreceding


def forward_fill(df: DataFrame, part: Sequence[str], order: Sequence[str], block: Column,
                 value: str, out: str) -> DataFrame:
    """``out`` = last non-null ``value`` at or before each row, per ``part``.

    ``block`` must be non-decreasing in ``order`` within a partition (for
    example ``floor(line_no / 4096)``). Level one fills inside each
    (part, block); level two carries the last value of earlier blocks using
    one row per block.
    """
    part, order = list(part), list(order)
    d = df.withColumn("_blk", block)
    w_in = Window.partitionBy(*part, "_blk").orderBy(*order).rowsBetween(UNB, 0)
    d = d.withColumn("_local", F.last(value, ignorenulls=True).over(w_in))
    order_key = F.struct(*order)
    # One row per block (blocks without a value included: max_by skips null
    # orderings) carries the last value of all earlier blocks.
    per_block = d.groupBy(*part, "_blk").agg(
        F.max_by(F.col(value), F.when(F.col(value).isNotNull(), order_key)).alias("_blast"))
    w_blk = Window.partitionBy(*part).orderBy("_blk").rowsBetween(UNB, -1)
    all_blocks = per_block.select(*part, "_blk", F.last("_blast", ignorenulls=True)
                                  .over(w_blk).alias("_carry"))
    return (d.join(all_blocks, part + ["_blk"], "left")
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry")))
            .drop("_blk", "_local", "_carry"))


def running_sum(df: DataFrame, part: Sequence[str], order: Sequence[str], block: Column,
                value: str, out: str) -> DataFrame:
    """``out`` = sum of ``value`` over rows at or before each row, per ``part``."""
    part, order = list(part), list(order)
    d = df.withColumn("_blk", block)
    w_in = Window.partitionBy(*part, "_blk").orderBy(*order).rowsBetween(UNB, 0)
    d = d.withColumn("_local", F.sum(value).over(w_in))
    per_block = d.groupBy(*part, "_blk").agg(F.sum(value).alias("_bsum"))
    w_blk = Window.partitionBy(*part).orderBy("_blk").rowsBetween(UNB, -1)
    carry = per_block.select(*part, "_blk", F.coalesce(F.sum("_bsum").over(w_blk), F.lit(0)).alias("_carry"))
    return (d.join(carry, part + ["_blk"], "left")
            .withColumn(out, F.col("_local") + F.col("_carry"))
            .drop("_blk", "_local", "_carry"))


def band_bucket(pos: Column, width: int) -> Column:
    return F.floor(pos / F.lit(int(width))).cast("long")


def replicate_to_next_bucket(pos: Column, width: int) -> Column:
    """Array of the row's own bucket and the following one."""
    b = band_bucket(pos, width)
    return F.array(b, b + 1)


def ordered_concat(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column,
                   text: str, sep: str, out: str) -> DataFrame:
    """keys + ``out``: the ``text`` of each group joined in ``order`` with ``sep``.

    Two levels: rows are joined per (keys, block) first, then the block
    strings per group, so no task collects or sorts a group's rows; only
    the finished string (the result itself) is one row.
    """
    keys, order = list(keys), list(order)
    part = (df.withColumn("_blk", block)
            .groupBy(*keys, "_blk")
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], F.col(text).alias("_t"))))
                 .alias("_rows"))
            .select(*keys, "_blk", F.array_join(F.transform("_rows", lambda s: s["_t"]), sep).alias("_part")))
    return (part.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct("_blk", "_part"))).alias("_parts"))
            .select(*keys, F.array_join(F.transform("_parts", lambda s: s["_part"]), sep).alias(out)))
