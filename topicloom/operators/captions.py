"""Caption files to documents (JOB-1: SRC-2, FLT-1/2, WIN-1, AGG-15).

Input rows ``(file, line_no, raw)``, one per raw line of an SRT file.

Look-back de-duplication: a line is dropped when its trimmed text equals
one of the previous ``lookback`` *raw* lines of the same file (dropped
lines, indices and time codes all take up room). This is a band
anti-join: the history side is replicated into its own and the next
bucket of width ``lookback`` so the join key (file, bucket, text) never
grows with the file, and the band ``0 < i - h <= lookback`` is the
residual condition. Index and time-code lines are removed after it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import CAPTION_INDEX, CAPTION_TIMECODE, js_trim, replace_first
from topicloom.operators.scans import band_bucket, ordered_concat, replicate_to_next_bucket

LOOKBACK = 20


def dedup_caption_lines(lines: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """(file, line_no, text): kept caption text lines, one trailing space each."""
    B = int(lookback)
    t = lines.select("file", "line_no", "raw", js_trim(F.col("raw")).alias("trimmed"))
    cur = t.withColumn("bkt", band_bucket(F.col("line_no"), B))
    hist = (t.filter(F.col("raw") == F.col("trimmed"))
            .select(F.col("file").alias("h_file"), F.col("line_no").alias("h_no"),
                    F.col("raw").alias("h_text"),
                    F.explode(replicate_to_next_bucket(F.col("line_no"), B)).alias("h_bkt")))
    cond = ((cur["file"] == hist["h_file"]) & (cur["bkt"] == hist["h_bkt"])
            & (cur["trimmed"] == hist["h_text"])
            & (hist["h_no"] < cur["line_no"]) & (hist["h_no"] >= cur["line_no"] - B))
    kept = cur.join(hist, cond, "left_anti")
    kept = kept.filter(~F.col("trimmed").rlike(CAPTION_INDEX) & ~F.col("trimmed").rlike(CAPTION_TIMECODE))
    text = F.when(F.col("trimmed").endswith(" "), F.col("trimmed")).otherwise(F.concat("trimmed", F.lit(" ")))
    return kept.select("file", "line_no", replace_first(text, "\r").alias("text"))


def captions_to_documents(lines: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """JOB-1: (file, text), the kept lines of each file concatenated in order."""
    kept = dedup_caption_lines(lines, lookback)
    return ordered_concat(kept, ["file"], ["line_no"], F.floor(F.col("line_no") / F.lit(4096)),
                          "text", "", "text")
