"""Windowed unigram and pair counts (JOB-5, WIN-3, AGG-4..6).

The reference slides a window of L tokens over each document with stride
one and counts every token and every unordered pair of unequal words once
per window. Materialising the windows costs L(L-1)/2 pairs per window; here
each position carries a closed-form weight instead:

* n < L: one short window, every token and pair weighs 1;
* token i weighs  least(i, n-L) - greatest(i-(L-1), 0) + 1;
* pair i < j <= i+L-1 weighs  least(i, n-L) - greatest(j-(L-1), 0) + 1.

So each token emits at most L-1 partner rows, inside its document's row (no
self-join, no shuffle). The weighted sums are plain hash aggregations with
map-side partial aggregation, which also absorbs the skew of very common
words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import tokens

WINDOW_SIZE = 10


def items(array: str) -> Column:
    """An array column to explode. Of a bare column the optimizer infers a filter on its
    size and pushes it down, where the array is then made a second time."""
    return F.coalesce(F.col(array), F.array())


def _words(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    # SCL-14 tokeniser. Blank documents (FLT-3) have no positions and weigh nothing: a filter on
    # the tokens would only make them a second time, below the scan's exchange.
    d = docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("w"))
    return d.withColumn("n", F.size("w"))


def token_weight(i: Column, n: Column, L: int) -> Column:
    return F.when(n < L, F.lit(1)).otherwise(
        F.least(i, n - L) - F.greatest(i - (L - 1), F.lit(0)) + 1)


def pair_weight(i: Column, j: Column, n: Column, L: int) -> Column:
    return F.when(n < L, F.lit(1)).otherwise(
        F.least(i, n - L) - F.greatest(j - (L - 1), F.lit(0)) + 1)


def unigram_counts(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """AGG-4: (token, n) windowed unigram counts."""
    rows = unigram_rows(docs, window, text, doc_id)
    return rows.groupBy("token").agg(F.sum(F.col("wt").cast("long")).alias("n"))


def pair_rows(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
              doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, i, j, a, b, wt): every position pair that shares a window, unequal words.

    A token meets its next L-1 tokens inside the document's own row, as
    generated code; nothing is shuffled.
    """
    L = int(window)
    d = _words(docs, text, doc_id)
    tk = d.select("doc_id", "n", "w", F.posexplode(items("w")).alias("i", "a"))
    nxt = F.array(*[F.struct(F.lit(k).alias("d"), F.get("w", F.col("i") + k).alias("b")) for k in range(1, L)])
    pairs = (tk.select("doc_id", "n", "i", "a", F.inline(nxt))
             .filter(F.col("b").isNotNull() & (F.col("a") != F.col("b")))
             .withColumn("j", F.col("i") + F.col("d")))
    return pairs.select("doc_id", "i", "j", "a", "b",
                        pair_weight(F.col("i"), F.col("j"), F.col("n"), L).alias("wt"))


def bigram_counts(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
                  doc_id: str = "doc_id") -> DataFrame:
    """AGG-5: (w1, w2, n) with w1 < w2, FLT-6 applied."""
    p = pair_rows(docs, window, text, doc_id)
    return p.groupBy(F.least("a", "b").alias("w1"), F.greatest("a", "b").alias("w2")).agg(
        F.sum(F.col("wt").cast("long")).alias("n"))


def pair_total(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text", doc_id: str = "doc_id") -> Column:
    """AGG-7 for pairs: the weight of all pairs of unequal words, one number per
    position and one sum over all; no pair becomes a row."""
    L = int(window)
    d = _words(docs, text, doc_id)
    tk = d.select("n", "w", F.posexplode(items("w")).alias("i", "a"))
    own = F.lit(0)
    for k in range(1, L):
        weight = pair_weight(F.col("i"), F.col("i") + k, F.col("n"), L)
        own = own + F.when(F.get("w", F.col("i") + k) != F.col("a"), weight).otherwise(0)
    return tk.select(own.cast("long").alias("wt")).select(F.sum("wt").cast("double")).scalar()


def totals(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text", doc_id: str = "doc_id") -> tuple[Column, Column]:
    """AGG-7: the weights of all tokens and of all pairs of unequal words, both from one pass over the texts."""
    L = int(window)
    tk = _words(docs, text, doc_id).select("n", "w", F.posexplode(items("w")).alias("i", "a"))
    own = F.lit(0)
    for k in range(1, L):
        weight = pair_weight(F.col("i"), F.col("i") + k, F.col("n"), L)
        own = own + F.when(F.get("w", F.col("i") + k) != F.col("a"), weight).otherwise(0)
    each = tk.select(token_weight(F.col("i"), F.col("n"), L).cast("long").alias("u"), own.cast("long").alias("p"))
    both = each.select(F.struct(F.sum("u").cast("double").alias("u"), F.sum("p").cast("double").alias("p"))).scalar()
    return both["u"], both["p"]


def window_ngrams(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
                  doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """JOB-5: (unigram table, bigram table)."""
    return unigram_counts(docs, window, text, doc_id), bigram_counts(docs, window, text, doc_id)


def window_list(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
                doc_id: str = "doc_id") -> DataFrame:
    """WIN-3 made explicit: (doc_id, start, words) for every window of every document."""
    L = int(window)
    d = _words(docs, text, doc_id)
    starts = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.greatest(F.col("n") - L, F.lit(0))))
    return d.select("doc_id", F.explode(F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.slice("w", s + 1, L).alias("words")))).alias("x")) \
        .select("doc_id", F.col("x.start").alias("start"), F.col("x.words").alias("words"))


def unigram_rows(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """(token, wt): one row per token position with its window weight."""
    L = int(window)
    d = _words(docs, text, doc_id)
    rows = d.select("n", F.posexplode(items("w")).alias("i", "token"))
    return rows.select("token", token_weight(F.col("i"), F.col("n"), L).alias("wt"))


def unigram_total(docs: DataFrame, window: int = WINDOW_SIZE, text: str = "text",
                  doc_id: str = "doc_id") -> Column:
    """AGG-7 for unigrams in closed form: sum over documents of (windows x tokens per window).

    n < L: one window of n tokens; otherwise n-L+1 windows of L tokens.
    """
    L = int(window)
    d = _words(docs, text, doc_id)
    per_doc = F.when(F.col("n") < L, F.col("n")).otherwise((F.col("n") - L + 1) * L).cast("long")
    return d.select(F.sum(per_doc).cast("double")).scalar()
