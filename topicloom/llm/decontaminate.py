"""Operator 1: benchmark decontamination by spaced-seed hashing.

Texts become lower-cased words (ASCII characters other than letters and
digits separate). A seed is the hash of the words under the 1s of a fixed
mask; the 0s are ignored, so a seed survives substitutions there. Seeds of
the benchmark and of the documents are joined; every hit names a diagonal
(how far the item is shifted against the document), and the whole item is
compared along it: the best run scores +1 for an equal word and -2 for a
substituted one. An item counts as found where that run has ``min(13,
max(6, half the item))`` equal words.

A document's seeds number five per word, so they first pass a filter of
fixed size (``filter_bits``, two bits per seed) made from the benchmark; a
larger benchmark lets more seeds through to the join, none is lost.

Texts that are equal are searched once (their digest is the key).

Defined cases: null text is empty; items under six words can't be told from
chance and find nothing; equal items count as one, under their smallest id
(null only if all are null); one row per document row, repeated or null ids
included; empty tables give clean documents or no rows; other columns are
left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Tables, Words, mix, slices, text_of, written

#: Weight 6 each: a run of six, one substitution in every five, four or three words, and an irregular one.
MASKS = ("111111", "1111011", "1110111", "11011011", "1101011001")
WEIGHT = 6
FILTER_BITS = 26
#: Bytes of text whose seeds a task holds at a time; they take many times as much.
SEED_BYTES = 1 << 19

_FACTORS = mix(np.arange(1, WEIGHT + 1, dtype=np.uint64)) | np.uint64(1)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 32


def plain_words(texts: pa.Array) -> Words:
    lower = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    lower = pa.concat_arrays([lower])  # an offset of 0
    _, offsets, data = lower.buffers()
    plain = _PLAIN[np.frombuffer(data, np.uint8)] if data is not None else np.zeros(0, np.uint8)
    return Words(pa.StringArray.from_buffers(len(lower), offsets, pa.py_buffer(plain)))


def seeds(h: np.ndarray) -> Iterator[np.ndarray]:
    """Per mask in turn, the seed at every position of the word hashes ``h`` where it fits."""
    parts = [h * f for f in _FACTORS]
    for m, mask in enumerate(MASKS):
        n = len(h) - len(mask) + 1
        total = np.full(max(n, 0), m, np.uint64)
        if n > 0:
            for part, at in zip(parts, [k for k, c in enumerate(mask) if c == "1"]):
                total += part[at:at + n]
        yield mix(total)


def _places(seed: np.ndarray, bits: int):
    room = np.uint64((1 << bits) - 1)
    return seed & room, (seed >> np.uint64(32)) & room


def _lists(counts, seed: list[np.ndarray], at: list[np.ndarray]) -> pa.Array:
    """array<struct<seed,at>> of so many entries each, without a Python object per seed."""
    none = [np.zeros(0, np.int64)]
    pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(seed or none).view(np.int64), pa.int64()),
                                        pa.array(np.concatenate(at or none).astype(np.int32), pa.int32())], ["seed", "at"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), pa.int32()), pairs)


def seeds_of_items(texts: pa.Array) -> pa.Array:
    """Per text: its number of words, their hashes and its seeds."""
    n, words, counts, seed, at = [], [], [], [], []
    for _, part in slices(texts, SEED_BYTES):
        w = plain_words(part)
        h = w.hashes()
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            own = list(seeds(h[a:b]))
            n.append(int(b - a))
            words.append(h[a:b].tobytes())
            counts.append(sum(map(len, own)))
            seed += own
            at += [np.arange(len(s)) for s in own]
    return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(words, pa.binary()), _lists(counts, seed, at)],
                                      ["n", "words", "seeds"])


def item_seeds(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, n, words, seeds) per distinct text of the benchmark."""
    make = arrow_udf("struct<n:int,words:binary,seeds:array<struct<seed:bigint,at:int>>>")(seeds_of_items)
    one = items.select(F.col(id_col).alias("item"), text_of(text_col).alias("text")).groupBy("text").agg(
        F.min("item").alias("item"))
    return one.select("item", F.md5(F.encode("text", "UTF-8")).alias("item_key"), make("text").alias("s")).select("item", "item_key", "s.*")


def seed_filter(item_table: DataFrame, bits: int) -> np.ndarray:
    """The filter as packed bits: 2**bits / 8 bytes at most, whatever the benchmark."""
    seed = item_table.select(F.explode("seeds").alias("s")).select(F.col("s.seed").alias("seed"))
    room = F.lit((1 << bits) - 1)
    spot = seed.select(F.explode(F.array(
        F.col("seed").bitwiseAND(room),
        F.shiftrightunsigned("seed", 32).bitwiseAND(room))).alias("spot"))
    cells = spot.groupBy(F.shiftright("spot", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, int(spot & 63))")).alias("set")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[cells["cell"].to_numpy(np.int64)] = cells["set"].to_numpy(np.int64).view(np.uint64)
    return out


def seeds_of_documents(texts: pa.Array, cells: np.ndarray, bits: int) -> pa.Array:
    """Per text: its word hashes and the seeds that pass the filter; null where none does."""
    six = np.uint64(6)
    low = np.uint64(63)
    words, empty, counts, seeds_of, places_of = [], [], [], [], []
    for _, part in slices(texts, SEED_BYTES):
        w = plain_words(part)
        h, owner = w.hashes(), w.owners()
        hit_text, hit_at, hit_seed = [], [], []
        for mask, seed in zip(MASKS, seeds(h)):
            one, two = _places(seed, bits)
            good = np.flatnonzero((cells[one >> six] >> (one & low)) & np.uint64(1))
            good = good[((cells[two[good] >> six] >> (two[good] & low)) & np.uint64(1)) > 0]
            good = good[owner[good] == owner[good + len(mask) - 1]]
            hit_text.append(owner[good])
            hit_at.append(good - w.bounds[owner[good]])
            hit_seed.append(seed[good].view(np.int64))
        text = np.concatenate(hit_text)
        order = np.argsort(text, kind="stable")
        seeds_of.append(np.concatenate(hit_seed)[order])
        places_of.append(np.concatenate(hit_at)[order])
        ends = np.searchsorted(text[order], np.arange(len(part) + 1))
        counts += np.diff(ends).tolist()
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            empty.append(a == b)
            words.append(None if a == b else h[w.bounds[i]:w.bounds[i + 1]].tobytes())
    return pa.StructArray.from_arrays([pa.array(words, pa.binary()), _lists(counts, seeds_of, places_of)], ["words", "seeds"],
                                      mask=pa.array(empty, pa.bool_()))


def document_seeds(shared, bits: int):
    """text -> its word hashes and the seeds that pass the filter; null where none does."""
    @arrow_udf("struct<words:binary,seeds:array<struct<seed:bigint,at:int>>>")
    def make(texts: pa.Array) -> pa.Array:
        return seeds_of_documents(texts, shared.value, bits)
    return make


def best_run(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, length, equal words) of the run with the best score, +1 and -2;
    of equal scores, the one with most equal words."""
    total = np.concatenate([[0], np.cumsum(np.where(equal, 1, -2))])
    same = np.concatenate([[0], np.cumsum(equal)])
    low = np.minimum.accumulate(total)
    score = total - low
    runs = []
    for end in np.flatnonzero(score == score.max()):
        start = int(np.argmax(total == low[end]))
        runs.append((int(same[end] - same[start]), -start, int(end) - start))
    matched, start, length = max(runs)
    return -start, length, matched


def compared():
    """(document words under the item, item, shift) -> the best run, in words of the document."""
    @arrow_udf("struct<start:int,length:int,matched:int>")
    def run(doc: pa.Array, item: pa.Array, shift: pa.Array) -> pa.Array:
        rows = []
        for d, i, s in zip(doc.to_pylist(), item.to_pylist(), shift.to_pylist()):
            d, i = np.frombuffer(d, np.uint64), np.frombuffer(i, np.uint64)[max(-s, 0):]
            n = min(len(d), len(i))
            start, length, matched = best_run(d[:n] == i[:n])
            rows.append((max(s, 0) + start, length, matched))
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in (list(zip(*rows)) or [()] * 3)],
                                          ["start", "length", "matched"])
    return run


def text_key(text_col: str = "text") -> Column:
    return F.md5(F.encode(text_of(text_col), "UTF-8"))


def overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
             item_text: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """Every found item: (key, item_key, item, start, length, matched,
    item_words), by the document's text key; start and length in its words."""
    with Tables() as tables:
        return written(_overlaps(docs, items, text_col, item_id, item_text, filter_bits, tables.written), "overlaps")


def _overlaps(docs, items, text_col, item_id, item_text, filter_bits, written) -> DataFrame:
    spark = docs.sparkSession
    item_table = written(item_seeds(items, item_id, item_text), "items")
    shared = spark.sparkContext.broadcast(seed_filter(item_table, filter_bits))
    texts = docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    passed = (texts.select("key", document_seeds(shared, filter_bits)("text").alias("s")).filter("s IS NOT NULL")
              .select("key", "s.words", "s.seeds"))
    passed = written(passed.dropDuplicates(["key"]), "seeded")

    inside = item_table.select("item_key", F.explode("seeds").alias("s")).select(
        "item_key", F.col("s.seed").alias("seed"), F.col("s.at").alias("item_at"))
    outside = passed.select("key", F.explode("seeds").alias("s")).select(
        "key", F.col("s.seed").alias("seed"), F.col("s.at").alias("at"))
    places = outside.join(inside, "seed").select("key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()

    own = item_table.select("item_key", "item", "n", F.col("words").alias("item_words"))
    under = F.substring(F.col("words"), F.greatest("shift", F.lit(0)) * 8 + 1, F.col("n") * 8)
    need = F.least(F.lit(13), F.greatest(F.lit(WEIGHT), F.ceil(F.col("n") / 2)))
    return (places.join(own, "item_key").join(passed.select("key", "words"), "key")
            .select("key", "item_key", "item", "n", compared()(under, F.col("item_words"), F.col("shift")).alias("r"))
            .filter(F.col("r.matched") >= need)
            .select("key", "item_key", "item", "r.*", F.col("n").alias("item_words")))


def verdicts(docs: DataFrame, items: DataFrame, text_col: str = "text", **columns) -> DataFrame:
    """(key, n_items, item, start, length, matched, item_words) per contaminated
    text; the columns after n_items are those of the item with most equal words."""
    best = F.max_by(F.struct("item", "start", "length", "matched", "item_words"),
                    F.struct("matched", F.col("item_key"), (-F.col("start")).alias("early")))
    found = overlaps(docs, items, text_col, **columns).groupBy("key").agg(
        F.count_distinct("item_key").alias("n_items"), best.alias("best"))
    return found.select("key", "n_items", "best.*")


def marked(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (doc_id, contaminated, n_items, item_id, start, length, matched, item_words)."""
    found = verdicts(docs, items, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("_key"))
    return (rows.join(found, F.col("_key") == F.col("key"), "left")
            .select("doc_id", F.col("key").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), F.col("item").alias("item_id"),
                    "start", "length", "matched", "item_words"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents in which no benchmark item was found, with their own columns only."""
    found = verdicts(docs, items, text_col).select(F.col("key").alias("found"))
    rows = docs.select(F.struct("*").alias("row"), text_key(text_col).alias("key"))
    return rows.join(found, F.col("key") == F.col("found"), "left_anti").select("row.*")
