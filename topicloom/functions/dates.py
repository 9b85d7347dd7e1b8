"""Date parsing column functions (SCL-19..22, SCL-40, FLT-15)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import py_strip

# The title date pattern (any one character between the three
# digit runs, month first) and the first year that counts as dated.
TITLE_DATE = r"([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)"
MIN_YEAR = 2014
# Date triple in a file name after the last "(" or blank (files2dates).
FILE_DATE = r"^[^\n]*[( ]([0-9]+)[^\n]([0-9]+)[^\n]([0-9]+)[^\n]*$"
ORDINAL = r"^(.*) ([0-9]+)(st|nd|rd|th), (.*)$"


def _zfill2(c: Column) -> Column:
    return F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)


def _over(digits: Column, least: int) -> Column:
    """Whether a run of digits of any length is ``least`` or more; null for other text."""
    plain = F.ltrim(digits, F.lit("0"))
    return F.when(digits.rlike("^[0-9]+$"), (F.length(plain) > 9) | (F.coalesce(plain.try_cast("int"), F.lit(0)) >= least))


def ymd_from_parts(month: Column, day: Column, year: Column, min_year: int = MIN_YEAR) -> Column:
    """SCL-19 rules on (month, day, year) strings -> 'YYYY-MM-DD' string or null.

    Two-digit years get "20"; years before ``min_year`` are undated; a month
    above 12 swaps month and day; parts shorter than two digits are padded.
    """
    y = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    swap = _over(month, 13)
    m2 = F.when(swap, day).otherwise(month)
    d2 = F.when(swap, month).otherwise(day)
    raw = F.concat(y, F.lit("-"), _zfill2(m2), F.lit("-"), _zfill2(d2))
    return F.when(_over(y, min_year), raw)


def ymd_to_date(ymd: Column) -> Column:
    """Calendar check: a real date for a four-digit year and valid month/day."""
    return F.when(ymd.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), ymd.try_cast("date"))


def ordinal_to_date(text: Column) -> Column:
    """SCL-20: 'Month Nth, YYYY' -> date (st, nd, rd and th suffixes)."""
    plain = F.regexp_replace(text, ORDINAL, "$1 $2 $4")
    return F.when(text.rlike(ORDINAL), F.try_to_date(plain, "MMMM d yyyy"))


def ymd_to_mdy(ymd: Column) -> Column:
    """SCL-21: 'Y-M-D' -> 'M-D-Y' (first token of the text)."""
    first = F.try_element_at(F.split(ymd, " ", -1), F.lit(1))
    parts = F.split(first, "-", -1)
    return F.concat(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")), F.lit("-"),
                    F.coalesce(F.try_element_at(parts, F.lit(3)), F.lit("")), F.lit("-"),
                    F.try_element_at(parts, F.lit(1)))


def file_name_date(name: Column) -> Column:
    """SCL-22: 'M D Y' from the part after the last '(' or blank; unchanged if absent."""
    return F.when(name.rlike(FILE_DATE), F.concat_ws(
        " ", *[F.regexp_extract(name, FILE_DATE, i) for i in (1, 2, 3)])).otherwise(name)


def iso_to_epoch(d: Column) -> Column:
    """SCL-40: ISO date -> epoch seconds (session time zone, UTC by default)."""
    return F.unix_timestamp(F.try_to_timestamp(d))


def with_title_date(df, title: str, ymd: str = "ymd", date: str = "date", min_year: int = MIN_YEAR):
    """Add ``ymd`` (SCL-19 string) and ``date`` columns to ``df``.

    Each regex runs once per row: the stripped title, the match flag and the
    three groups are separate projected columns (composing them as one
    Column would repeat the regex in every branch of the expression).
    """
    t = df.withColumn("_t", py_strip(F.col(title)))
    t = t.withColumn("_has", F.col("_t").rlike(TITLE_DATE))
    for i, name in enumerate(("_mo", "_da", "_yr"), start=1):
        t = t.withColumn(name, F.when(F.col("_has"), F.regexp_extract("_t", TITLE_DATE, i)))
    t = t.withColumn(ymd, ymd_from_parts(F.col("_mo"), F.col("_da"), F.col("_yr"), min_year))
    t = t.withColumn(date, ymd_to_date(F.col(ymd)))
    return t.drop("_t", "_has", "_mo", "_da", "_yr")
