"""Dated titles (JOB-12: SCL-19, JN-8, FLT-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions import dates as D
from topicloom.functions.text import py_strip


def date_titles(titles: DataFrame, overrides: DataFrame | None = None, title: str = "title",
                min_year: int = D.MIN_YEAR) -> DataFrame:
    """Titles + (ymd string, date).

    ``overrides`` (title, month, day, year, seq) wins over the regex; the
    entry with the highest ``seq`` wins for a repeated title.
    """
    t = titles.withColumn("_key", py_strip(F.col(title)))
    t = D.with_title_date(t, title, "_parsed", "_pdate", min_year)
    if overrides is not None:
        ov = (overrides.groupBy(py_strip(F.col("title")).alias("_key"))
              .agg(F.max_by(F.struct("month", "day", "year"), F.col("seq")).alias("_ov")))
        t = t.join(ov, "_key", "left")
        ov_ymd = D.ymd_from_parts(F.col("_ov.month"), F.col("_ov.day"), F.col("_ov.year"), min_year)
        t = t.withColumn("ymd", F.when(F.col("_ov").isNotNull(), ov_ymd).otherwise(F.col("_parsed"))).drop("_ov")
    else:
        t = t.withColumn("ymd", F.col("_parsed"))
    return t.withColumn("date", D.ymd_to_date(F.col("ymd"))).drop("_key", "_parsed", "_pdate")
