"""Transcripts to per-speaker text (JOB-2b: SCL-15..18, WIN-2, FLT-4, AGG-16, SET-2, JN-7).

Input rows ``(file, line_no, line)`` (``line_no`` may be any sortable
columns). A line ``SPEAKER: words`` starts a speaker's turn; unlabelled
lines continue the current speaker (forward fill); text before the first
label is dropped. The fill is the two-level scan of ``scans.forward_fill``
so a long transcript is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import PY_WS, py_strip, said_of, speaker_of, strip_prefix
from topicloom.operators.scans import forward_fill, ordered_concat


def speaker_lines(lines: DataFrame, order: Sequence[str] = ("line_no",),
                  block: Column | None = None) -> DataFrame:
    """(file, *order, speaker, said) for every non-blank line after the first label."""
    order = list(order)
    if block is None:
        block = F.floor(F.col(order[0]) / F.lit(4096))
    s = (lines.select("file", *order, py_strip(F.col("line")).alias("line"))
         .filter(F.col("line") != ""))
    s = s.select("file", *order, speaker_of(F.col("line")).alias("label"), said_of(F.col("line")).alias("said"))
    filled = forward_fill(s, ["file"], order, block, "label", "speaker")
    return filled.filter(F.col("speaker").isNotNull()).select("file", *order, "speaker", "said")


def speaker_text(lines: DataFrame, order: Sequence[str] = ("line_no",), sep: str = " ",
                 block: Column | None = None) -> DataFrame:
    """(file, speaker, text): a speaker's lines joined in order, whitespace squeezed.

    ``sep`` defaults to a space; the reference joins with no separator
    (pass ``sep=""`` for that).
    """
    order = list(order)
    if block is None:
        block = F.floor(F.col(order[0]) / F.lit(4096))
    sl = speaker_lines(lines, order, block)
    joined = ordered_concat(sl, ["file", "speaker"], order, block, "said", sep, "_joined")
    return joined.select("file", "speaker", F.regexp_replace("_joined", f"{PY_WS}+", " ").alias("text"))


def speaker_corpus(lines: DataFrame, order: Sequence[str] = ("line_no",), sep: str = " ",
                   block: Column | None = None) -> DataFrame:
    """(speaker, text): one document per speaker over all files, lines in file and line order."""
    order = list(order)
    if block is None:
        block = F.floor(F.col(order[0]) / F.lit(4096))
    sl = speaker_lines(lines, order, block)
    joined = ordered_concat(sl, ["speaker"], ["file", *order], F.struct(F.col("file"), block.alias("block")), "said", sep,
                            "_joined")
    return joined.select("speaker", F.regexp_replace("_joined", f"{PY_WS}+", " ").alias("text"))


def speakers(speaker_rows: DataFrame) -> DataFrame:
    """SET-2: distinct speaker labels."""
    return speaker_rows.select("speaker").distinct()


def prefix_join(lines: DataFrame, labels: DataFrame, line: str = "line", label: str = "speaker") -> DataFrame:
    """JN-7: every (line, label) where the line starts with the label.

    Written as equi-joins, no nested loop: only the distinct line heads (the
    first ``max(length(label))`` characters, a scalar bound) propose their
    prefixes, which meet the labels on equality; the small (head, label)
    table then joins back to the lines on the head. Output: the lines'
    columns + label + rest (line with the label prefix removed, SCL-18).
    """
    max_len = labels.select(F.max(F.length(label))).scalar()
    with_head = lines.withColumn("_head", F.left(F.col(line), max_len))
    heads = with_head.select("_head").distinct()
    # only label lengths that exist propose prefixes
    lab = labels.select(F.col(label).alias("_pfx")).distinct()
    lengths = lab.select(F.array_sort(F.collect_set(F.length("_pfx")))).scalar()
    cand = (heads.withColumn("_len", F.explode(lengths)).filter(F.col("_len") <= F.length("_head"))
            .withColumn("_pfx", F.expr("substring(_head, 1, _len)")).drop("_len"))
    matches = cand.join(lab, "_pfx")
    j = with_head.join(matches, "_head")
    return j.withColumn(label, F.col("_pfx")).withColumn(
        "rest", strip_prefix(F.col(line), F.col("_pfx"))).drop("_pfx", "_head")
