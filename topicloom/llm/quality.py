"""Operator 6: quality rules with compression bands.

Every whole text gets base counts (words, symbols, repeated lines and
8-word windows) and zstandard ratios: compressed size over UTF-8 size, of
the whole text and of each fixed chunk of it. Repetitive text compresses too
well, noise hardly at all; limits depend on the length, since short texts
compress worse.

Defined cases: null text counts as empty; an empty or short text fails the
base rule (fewer than 20 words); every input row gives one row, so repeated
rows and null ids stay as they are; an empty table gives an empty result;
other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Words, slices, window_hashes

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Bands:
    """Limits by length. ``whole``: (least bytes, lowest, highest ratio) of
    the band that starts there; ``chunk``: lowest and highest ratio of a full
    chunk; a text with over ``bad_share`` of its full chunks outside is
    rejected even where its whole ratio passes."""

    whole: tuple = ((0, 0.0, 9.0), (128, 0.35, 1.30), (256, 0.30, 1.00), (1024, 0.25, 0.80),
                    (4096, 0.22, 0.72), (16384, 0.18, 0.70))
    chunk_bytes: int = 4096
    chunk: tuple = (0.22, 0.75)
    bad_share: float = 0.25
    level: int = 3


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "whole_ratio:double,n_chunks:bigint,n_bad_chunks:bigint,band_failed:boolean>")


def repeat_words(codes: np.ndarray, bounds: np.ndarray, n: int = 8) -> np.ndarray:
    """Per text, the words inside n-word windows that occur twice or more in it."""
    out = np.zeros(len(bounds) - 1, np.int64)
    owner = np.repeat(np.arange(len(out)), np.diff(bounds))
    if len(codes) < n:
        return out
    start = np.flatnonzero(owner[: len(codes) - n + 1] == owner[n - 1:])
    if not len(start):
        return out
    h = window_hashes(codes.astype(np.uint64), n)[start] ^ (owner[start].astype(np.uint64) << np.uint64(40))
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    # only windows whose hash recurs are compared word by word
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    start = start[again]
    if not len(start):
        return out
    rows = np.column_stack([owner[start], *(codes[start + k] for k in range(n))])
    rank = np.lexsort(rows.T[::-1])
    equal = (rows[rank][1:] == rows[rank][:-1]).all(axis=1)
    found = np.zeros(len(start), bool)
    found[rank[1:][equal]] = found[rank[:-1][equal]] = True
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, start[found], 1)
    np.add.at(step, start[found] + n, -1)
    covered = np.cumsum(step[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(out)).astype(np.int64)


def dup_lines(text: str) -> int:
    seen, found = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            found += line in seen
            seen.add(line)
    return found


def verdict(bands: Bands) -> Column:
    """A column function: text -> struct of base counts, ratios and the band verdict."""

    @arrow_udf(RESULT)
    def judge(texts: pa.Array) -> pa.Array:
        squeeze = zstandard.ZstdCompressor(level=bands.level).compress
        low, high = bands.chunk
        rows = []
        for _, part in slices(texts):
            words = Words(part)
            n_words = np.diff(words.bounds)
            repeats = repeat_words(words.codes, words.bounds)
            for i, text in enumerate(part.to_pylist()):
                text = text or ""
                data = text.encode()
                ratio = len(squeeze(data)) / len(data) if data else 0.0
                full = [data[k:k + bands.chunk_bytes] for k in
                        range(0, len(data) - bands.chunk_bytes + 1, bands.chunk_bytes)]
                bad = sum(not low <= len(squeeze(c)) / len(c) <= high for c in full)
                _, least, most = [b for b in bands.whole if b[0] <= len(data)][-1]
                failed = not least <= ratio <= most or bad > bands.bad_share * len(full)
                rows.append((int(n_words[i]), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)),
                             dup_lines(text), int(repeats[i]), ratio, len(full), bad, failed))
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        names = [*BASE, "whole_ratio", "n_chunks", "n_bad_chunks", "band_failed"]
        columns = list(zip(*rows)) if rows else [()] * 9
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return judge


def _beside(docs: DataFrame, text_col: str, bands: Bands) -> DataFrame:
    """(row, q): the whole input row and its verdict, so that no column name can clash."""
    q = F.col("v")
    base = (q.n_words < 20) | (100 * q.n_repeat_words > 30 * q.n_words)
    fields = [q[c].alias(c) for c in (*BASE, "whole_ratio", "n_chunks", "n_bad_chunks")]
    return (docs.select(F.struct("*").alias("row"), verdict(bands)(F.col(text_col)).alias("v"))
            .select("row", F.struct(*fields, base.alias("base_failed"), q.band_failed.alias("band_failed"),
                                    (~base & ~q.band_failed).alias("kept")).alias("q")))


def judged(docs: DataFrame, text_col: str = "text", out: str = "quality", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with one more struct column ``out``: base counts, ratios,
    base_failed, band_failed and kept. All rows stay; a column named ``out``
    is replaced."""
    others = [F.col("row")[c].alias(c) for c in docs.columns if c != out]
    return _beside(docs, text_col, bands).select(*others, F.col("q").alias(out))


def kept(docs: DataFrame, text_col: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with their own columns only."""
    return _beside(docs, text_col, bands).filter("q.kept").select("row.*")
