"""Operator 9: a quality classifier by supervised subword embeddings.

A word is the mean of the learned vectors of its hashed self and its hashed
character n-grams (with marks at both ends); a document is the mean of its
words, its hashed pairs of successive words (pairs of one word twice share a
vector) and one end token; a softmax layer scores it. Vectors and layer are trained together by stochastic
gradient descent in numpy.

The fit takes a bounded sample, ``Fit.sample`` labelled documents of each
label at most (in the order of a hash of the id), whole texts; it runs in
one task and returns ``buckets * dim`` numbers. The share of the labels in
all labelled training rows corrects the balance afterwards. Scoring covers
every whole text: the layer is applied to the vectors once, so a document's
score is a mean of looked-up numbers.

Labels are learnt only from rows whose crc32(id as text) mod 4 isn't 2.

Defined cases: null and empty texts have the end token only; ids with
labels that disagree aren't learnt from, null labels and ids neither; with
labels of one kind or none all documents score that share (0.5 for none);
one row per input row; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Words, mix, slices


@dataclass(frozen=True)
class Fit:
    buckets: int = 1 << 17
    dim: int = 16
    grams: tuple[int, ...] = (3, 4, 5)
    sample: int = 2000
    epochs: int = 12
    rate: float = 1.0
    seed: int = 1


END, TWICE = 0, 1  # the buckets of the end token and of a word twice in a row; hashed features take the others


def word_buckets(vocabulary: list[str], fit: Fit) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, word of each, hash of each word): its own bucket and those of its character n-grams."""
    text = "".join(f"\x02{w}\x03" for w in vocabulary)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter((len(w) + 2 for w in vocabulary), np.int64, len(vocabulary))
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(vocabulary)), sizes)
    # a word's own hash sums its characters, each mixed with its place
    place = np.arange(len(code), dtype=np.uint64) - first[owner].astype(np.uint64)
    own = np.add.reduceat(mix(code * np.uint64(0x9E3779B97F4A7C15) + mix(place + np.uint64(1))), first) if len(sizes) else code
    own = mix(own)
    found, words = [own], [np.arange(len(vocabulary))]
    for n in fit.grams:
        start = np.flatnonzero(owner[:len(code) - n + 1] == owner[n - 1:]) if len(code) >= n else np.zeros(0, np.int64)
        h = np.full(len(start), n, np.uint64)
        for k in range(n):
            h = mix(h + code[start + k]) + np.uint64(k)
        found.append(h)
        words.append(owner[start])
    buckets = (np.concatenate(found) % np.uint64(fit.buckets - 2)).astype(np.int64) + 2
    return buckets, np.concatenate(words), own


def pair_buckets(w: Words, own: np.ndarray, fit: Fit) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, text of each) of the pairs of successive words."""
    h, owner = own[w.codes] if len(own) else np.zeros(0, np.uint64), w.owners()
    inside = np.flatnonzero(owner[:-1] == owner[1:]) if len(h) else np.zeros(0, np.int64)
    pair = mix(h[inside] + mix(h[inside + 1] + np.uint64(5)) if len(inside) else np.zeros(0, np.uint64))
    bucket = (pair % np.uint64(fit.buckets - 2)).astype(np.int64) + 2
    return np.where(w.codes[inside] == w.codes[inside + 1], TWICE, bucket) if len(inside) else bucket, owner[inside]


def scores(part: pa.Array, table: np.ndarray, fit: Fit) -> np.ndarray:
    """Per text of a slice, the mean of ``table`` (a number per bucket) over its features."""
    w = Words(part)
    buckets, word, own = word_buckets(w.vocabulary.to_pylist(), fit)
    n_words = len(own)
    per_word = np.bincount(word, table[buckets], n_words) / np.maximum(np.bincount(word, minlength=n_words), 1)
    pairs, text = pair_buckets(w, own, fit)
    total = np.full(len(part), table[END])
    if n_words:
        total += np.bincount(w.owners(), per_word[w.codes], len(part))
        total += np.bincount(text, table[pairs], len(part))
    return total / (1 + np.diff(w.bounds) + np.bincount(text, minlength=len(part)))


def sparse(part: pa.Array, fit: Fit):
    """Per text of a slice: its buckets and their shares, which sum to 1."""
    w = Words(part)
    buckets, word, own = word_buckets(w.vocabulary.to_pylist(), fit)
    order = np.argsort(word, kind="stable")
    buckets, size = buckets[order], np.bincount(word, minlength=len(own))
    first = np.cumsum(size) - size
    pairs, text = pair_buckets(w, own, fit)
    ends = np.searchsorted(text, np.arange(len(part) + 1))
    for i, (a, b) in enumerate(zip(w.bounds[:-1], w.bounds[1:])):
        kinds, counts = np.unique(w.codes[a:b], return_counts=True)
        mine = pairs[ends[i]:ends[i + 1]]
        at = np.concatenate([[END], *(buckets[first[k]:first[k] + size[k]] for k in kinds), mine]).astype(np.int64)
        share = np.concatenate([[1.0], np.repeat(counts / np.maximum(size[kinds], 1), size[kinds]), np.ones(len(mine))])
        unique, back = np.unique(at, return_inverse=True)
        yield unique, np.bincount(back, share) / (1 + (b - a) + len(mine))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], fit: Fit, classes: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, layer, bias) by gradient descent, one document at a time."""
    rng = np.random.default_rng(fit.seed)
    vectors = rng.uniform(-1 / fit.dim, 1 / fit.dim, (fit.buckets, fit.dim)).astype(np.float32)
    layer = np.zeros((classes, fit.dim), np.float32)
    bias = np.zeros(classes, np.float32)
    steps, done = fit.epochs * max(len(rows), 1), 0
    for _ in range(fit.epochs):
        for k in rng.permutation(len(rows)):
            at, share, label = rows[k]
            rate = fit.rate * (1 - done / steps)
            done += 1
            hidden = share @ vectors[at]
            out = layer @ hidden + bias
            p = np.exp(out - out.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= rate * np.outer(p, hidden).astype(np.float32)
            bias -= np.float32(rate * 0.1) * p.astype(np.float32)
            # the mean hands every vector its share; scaled so that a document moves its vectors by the rate
            vectors[at] -= (rate * share / (share @ share) * 0.05)[:, None].astype(np.float32) * back.astype(np.float32)
    return vectors, layer, bias


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
           fit: Fit = Fit()) -> tuple[np.ndarray, float]:
    """(number per bucket, bias): the log odds of label 1 of a text are the mean of its features' numbers plus the bias."""
    label = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_most"))
             .filter("label = _most").select("_id", "label"))
    shares = {r["label"]: r["n"] for r in label.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        only = next(iter(shares), None)
        return np.zeros(fit.buckets), 0.0 if only is None else (30.0 if only else -30.0)
    order = F.xxhash64("_id", F.lit(fit.seed))
    chosen = None
    for k in (0, 1):
        top = label.filter(F.col("label") == k).orderBy(order, "_id").limit(fit.sample)
        chosen = top if chosen is None else chosen.unionByName(top)

    @arrow_udf("struct<at:array<bigint>,share:array<double>>")
    def features(texts: pa.Array) -> pa.Array:
        at, share = [], []
        for _, part in slices(texts):
            for a, s in sparse(part, fit):
                at.append(a)
                share.append(s)
        return pa.StructArray.from_arrays([pa.array(at, pa.list_(pa.int64())), pa.array(share, pa.list_(pa.float64()))], ["at", "share"])

    def learn(batches):
        rows = []
        for b in batches:
            for i in range(b.num_rows):
                rows.append((np.asarray(b["at"][i].values, np.int64), np.asarray(b["share"][i].values), b["label"][i].as_py()))
        # arrival order differs from run to run
        rows.sort(key=lambda r: (len(r[0]), r[2], r[0].tobytes()))
        vectors, layer, bias = train(rows, fit)
        table = (vectors @ (layer[1] - layer[0])).astype(np.float32)
        n = np.bincount([r[2] for r in rows], minlength=2)
        yield pa.RecordBatch.from_pydict({"table": [table.tobytes()], "bias": [float(bias[1] - bias[0])], "zeros": [int(n[0])],
                                          "ones": [int(n[1])]}, pa.schema([("table", pa.binary()), ("bias", pa.float64()),
                                                                           ("zeros", pa.int64()), ("ones", pa.int64())]))

    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("label", features("text").alias("f"))
    model = (sample.select("label", "f.at", "f.share").repartition(1)
             .mapInArrow(learn, "table binary, bias double, zeros bigint, ones bigint").first())
    if model is None or not model["zeros"] or not model["ones"]:
        return np.zeros(fit.buckets), float(np.log(shares[1] / shares[0]))
    prior = np.log(shares[1] / shares[0]) - np.log(model["ones"] / model["zeros"])
    return np.frombuffer(model["table"], np.float32).astype(np.float64), model["bias"] + float(prior)


def scored(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
           fit: Fit = Fit()) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label_col, id_col, text_col, fit))

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        table, bias = shared.value
        parts = [scores(part, table, fit) for _, part in slices(texts)]
        odds = np.concatenate(parts) + bias if parts else np.zeros(0)
        return pa.array(1 / (1 + np.exp(-np.clip(odds, -50, 50))))

    return (docs.select(F.col(id_col).alias("doc_id"), score(F.col(text_col)).alias("score"))
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                    F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted")))
