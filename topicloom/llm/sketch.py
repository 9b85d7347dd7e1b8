"""Operator 10: near-duplicate classes by fast similarity sketching.

A document is its set of word shingles (64-bit hashes of the distinct runs
of n words, A-Z lower-cased). The sketch has t coordinates. Round i < t
throws every shingle into a hashed bin, round i >= t puts all of them into
bin i - t; a bin keeps its smallest (round, draw), and rounds end once every
bin is full, at round 2t at the latest. So each coordinate of any set that
isn't empty is filled, two sketches agree in a coordinate with a chance of
the Jaccard similarity, and their agreement is concentrated as for t
independent draws. Bands of the sketch propose candidates; every link is
confirmed on the full sets.

At the default t = 80 in 20 bands of 4, two sets at similarity 0.85 share no
band with a chance of 4e-7 (at 0.8: 3e-5; there 28 bands are used, 4e-7).

No task sees all pairs of a group:

1. Documents of equal sets become one node (counted map-side), so thousands
   of exact copies cost one row each.
2. Each band bucket links its members to one pivot, the member with the most
   company over all its buckets; those links are confirmed and contracted.
3. Nodes of buckets that still hold several components are compared through
   their rarest shingles: sets over the threshold must share one of the
   first n - ceil(threshold * n) + 1 shingles in any common order, rare ones
   first (prefix filtering), and most of them when sizes are alike. It is
   exact, so nothing is capped, and pairs inside a component aren't formed.

Defined cases: null text is empty; a text of fewer words than a shingle is
one shingle; a text without words has no shingle, links with nothing and is
its own component. Rows of one doc_id count as one document. A null doc_id
is linked with nothing: component null, kept true. One row per input row;
other columns are left alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Tables, Words, cells_of, maybe_in, mix, slices, window_hashes, written


@dataclass(frozen=True)
class Sketching:
    """``percent``: link at 100 * intersection >= percent * union."""

    shingle: int = 5
    percent: int = 80
    bands: int = 28
    rows: int = 4

    @property
    def size(self) -> int:
        return self.bands * self.rows


CONTRACT = Sketching(shingle=3, percent=85, bands=20)


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for _, part in slices(texts):
        words = Words(pc.ascii_lower(part.cast(pa.string())))
        h = words.hashes()
        for a, b in zip(words.bounds[:-1], words.bounds[1:]):
            own = h[a:b]
            out.append(np.unique(window_hashes(own, min(n, len(own)))) if len(own) else own)
    return out


def sketch(items: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a set that isn't empty, t coordinates."""
    bins = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    at = 0
    while at < 2 * t:
        # rounds are taken together while one alone could hardly fill the bins
        count = min(2 * t - at, max(1, -(-4 * t // len(items))))
        rounds = np.arange(at, at + count, dtype=np.uint64)[:, None]
        draw = mix(items[None, :] ^ mix(rounds + np.uint64(0x9E3779B97F4A7C15)))
        place = np.where(rounds < t, mix(draw) % np.uint64(t), rounds - np.uint64(t))
        value = (rounds << np.uint64(48)) | (draw >> np.uint64(16))
        np.minimum.at(bins, place.ravel().astype(np.int64), value.ravel())
        at += count
        if (bins >> np.uint64(48) < at).all():
            break
    return bins


def band_keys(bins: np.ndarray, s: Sketching) -> np.ndarray:
    key = np.arange(s.bands, dtype=np.uint64) + np.uint64(1)
    for column in bins.reshape(s.bands, s.rows).T:
        key = mix(key ^ column) + np.uint64(7)
    return key.view(np.int64)


def sketched(s: Sketching):
    @arrow_udf("struct<n:bigint,node:string,bands:array<bigint>>")
    def make(texts: pa.Array) -> pa.Array:
        n, node, bands = [], [], []
        for items in shingle_sets(texts, s.shingle):
            n.append(len(items))
            node.append(xxhash.xxh3_128_hexdigest(items.tobytes()) if len(items) else None)
            bands.append(band_keys(sketch(items, s.size), s) if len(items) else None)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(node, pa.string()),
                                           pa.array(bands, pa.list_(pa.int64()))], ["n", "node", "bands"])
    return make


def full_sets(s: Sketching):
    """text -> its sorted shingle hashes, 8 bytes each."""
    @arrow_udf("binary")
    def make(texts: pa.Array) -> pa.Array:
        return pa.array([x.tobytes() for x in shingle_sets(texts, s.shingle)], pa.binary())
    return make


def similar(percent: int):
    @arrow_udf("boolean")
    def confirm(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            out.append(100 * shared >= percent * (len(x) + len(y) - shared))
        return pa.array(out, pa.bool_())
    return confirm


def rare_first(percent: int):
    """(set, df as parallel arrays) -> the shingles of which a similar set must share one."""
    @arrow_udf("array<bigint>")
    def prefix(items: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for x, c in zip(items.to_pylist(), counts.to_pylist()):
            x, c = np.asarray(x, np.int64), np.asarray(c, np.int64)
            keep = len(x) - math.ceil(percent * len(x) / 100) + 1
            out.append(x[np.lexsort((x, c))[:keep]])
        return pa.array(out, pa.list_(pa.int64()))
    return prefix


def contracted(nodes: DataFrame, links: DataFrame, written) -> DataFrame:
    """(id, comp): the smallest id reachable, by the links (a, b).

    Every round each node takes the smallest label among its neighbours and
    itself, then the label of that label; rounds end when none changed, so
    they grow with the logarithm of the longest chain. Nodes without links
    keep their id.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id"))
                .agg(F.min("comp").alias("_near")))
        step = (labels.join(near, "id").select("id", F.col("comp").alias("_old"),
                                               F.least("comp", "_near").alias("comp")))
        jump = labels.select(F.col("id").alias("_at"), F.col("comp").alias("_far"))
        new = written(step.join(jump, step.comp == jump._at, "left")
                      .select("id", "_old", F.least("comp", "_far").alias("comp")), "labels")
        changed = new.filter(F.col("comp") != F.col("_old")).limit(1).count()
        labels = new.select("id", "comp")
        if not changed:
            break
    own = labels.select(F.col("id").alias("_id"), "comp")
    return nodes.join(own, nodes.id == own._id, "left").select("id", F.coalesce("comp", "id").alias("comp"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Sketching = Sketching()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row per row of ``docs``."""
    with Tables() as tables:
        return written(_classes(docs, id_col, text_col, s, tables.written), "classes")


def _classes(docs: DataFrame, id_col: str, text_col: str, s: Sketching, written) -> DataFrame:
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(base.select("doc_id", sketched(s)("text").alias("s")).select("doc_id", "s.*"), "sketches")
    known = rows.filter(F.col("doc_id").isNotNull() & F.col("node").isNotNull())

    # 1. equal sets are one node, named by its smallest doc_id
    nodes = written(known.groupBy("node").agg(F.min_by(F.struct("n", "bands"), "doc_id").alias("s"),
                                              F.min("doc_id").alias("id"))
                    .select("node", "id", "s.*"), "nodes")
    own = nodes.select(F.col("node").alias("_node"), "id")
    named = known.select("doc_id", "node").join(own, F.col("node") == F.col("_node")).select("doc_id", "id")
    ids = nodes.select("id").distinct()
    same_id = named.filter("doc_id != id").join(ids.withColumnRenamed("id", "_id"), F.col("doc_id") == F.col("_id")) \
        .select(F.col("id").alias("a"), F.col("doc_id").alias("b"))

    # 2. bucket members and their pivots
    spread = nodes.select("id", "n", F.explode("bands").alias("bucket"))
    size = spread.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1")
    member = written(spread.join(size, "bucket"), "members")
    company = member.groupBy("id").agg(F.sum("members").alias("company"))
    weighed = member.join(company, "id")
    pivots = weighed.groupBy("bucket").agg(F.max(F.struct("company", (-F.col("id")).alias("_minus"))).alias("p")) \
        .select("bucket", (-F.col("p._minus")).alias("pivot"))
    pairs = member.join(pivots, "bucket").filter("id != pivot").select("id", "pivot").distinct()
    pairs = written(pairs.select(F.col("id").alias("a"), F.col("pivot").alias("b")), "pairs")
    wanted = member.select("id").distinct()
    first = written(base.join(wanted, base.doc_id == wanted.id, "left_semi")
                    .select(F.col("doc_id").alias("id"), full_sets(s)("text").alias("items")).distinct(), "sets")
    linked = written(confirmed(pairs, first, s).unionByName(same_id), "linked")
    comps = written(contracted(ids, linked, written), "components")

    # 3. what several components of a bucket may still share
    open_ids = still_open(member, comps)
    left = written(first.join(open_ids, "id").select("id", "comp", "items"), "open")
    linked2 = written(confirmed(rare_pairs(left, s, written), first, s).unionByName(linked), "linked")
    comps2 = contracted(ids, linked2, written)

    final = named.distinct().join(comps2, "id").groupBy(F.col("doc_id").alias("_doc")).agg(
        F.min("comp").alias("component"))
    return (rows.select("doc_id", "n", "node").join(
        final, F.when(F.col("node").isNotNull(), F.col("doc_id")) == F.col("_doc"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"),
                F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def confirmed(pairs: DataFrame, sets: DataFrame, s: Sketching) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    size = F.length("items") / 8
    one = sets.select(F.col("id").alias("a"), F.col("items").alias("x"), size.alias("nx"))
    two = sets.select(F.col("id").alias("b"), F.col("items").alias("y"), size.alias("ny"))
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * s.percent
    return (pairs.join(one, "a").join(two, "b").filter(fits)
            .select("a", "b", similar(s.percent)("x", "y").alias("ok")).filter("ok").select("a", "b").distinct())


def still_open(member: DataFrame, comps: DataFrame) -> DataFrame:
    """(id, comp) of nodes that share a bucket with another component."""
    in_bucket = member.select("bucket", "id").join(comps, "id")
    mixed = in_bucket.groupBy("bucket").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b")).filter("_a != _b")
    return in_bucket.join(mixed.select("bucket"), "bucket", "left_semi").select("id", "comp").distinct()


def rare_pairs(left: DataFrame, s: Sketching, written) -> DataFrame:
    """Pairs (a, b) of different components that share one of their rarest
    shingles, and may share enough of them: 512 bits of each prefix bound what
    two sets have in common from above, so no pair over the threshold is lost."""
    @arrow_udf("array<bigint>")
    def unpacked(items: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x, np.int64) for x in items.to_pylist()], pa.list_(pa.int64()))

    each = left.select("id", "comp", F.length("items").alias("_size"), F.xxhash64("items").alias("_set"), F.explode(unpacked("items")).alias("shingle"))
    # a shingle that one node alone has can't be shared; it only takes its place in the order
    df = each.groupBy("shingle").agg(F.count_distinct("id").alias("df"), F.min("comp").alias("_a"),
                                     F.max("comp").alias("_b")).filter("df > 1")
    useful = (each.join(df, "shingle").groupBy("id", "comp", "_size", "_set")
              .agg(F.sort_array(F.collect_list(F.struct("df", "shingle", (F.col("_a") != F.col("_b")).alias("mixed"))))
                   .alias("common")))
    n = F.col("_size") / 8
    prefix = n - F.ceil(n * s.percent / 100) + 1
    room = (prefix - (n - F.size("common"))).cast("int")
    own = (useful.filter(room > 0).withColumn("head", F.slice("common", F.lit(1), room))
           .select("id", "comp", n.alias("n"), (n - prefix).alias("beyond"), F.element_at("head", -1).alias("last"),
                   F.filter("head", lambda c: c["mixed"]).alias("head"))
           .withColumn("bits", marks()(F.transform("head", lambda c: c["shingle"]))))
    heads = written(own.select("id", "comp", "n", "beyond", F.struct("last.df", "last.shingle").alias("last"), "bits",
                               F.explode(F.transform("head", lambda c: c["shingle"])).alias("shingle")), "heads")
    a, b = heads.alias("a"), heads.alias("b")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    # sets over the threshold share at least this many
    least = (x("n") + y("n")) * s.percent / (100 + s.percent) - 1e-6
    close = (F.least(x("n"), y("n")) * 100 >= F.greatest(x("n"), y("n")) * s.percent) & (x("comp") < y("comp"))
    shared = sum(F.bit_count(x(f"bits.b{k}").bitwiseAND(y(f"bits.b{k}"))) for k in range(CELLS))
    # the set whose prefix ends first shares nothing with the other outside both prefixes but what lies beyond its own
    bound = F.when(x("last") <= y("last"), shared + x("bits.twice") + x("beyond")).otherwise(
        shared + y("bits.twice") + y("beyond"))
    return (a.join(b, "shingle").filter(close & (bound >= least))
            .select(x("id").alias("a"), y("id").alias("b")).distinct())


CELLS = 8


def marks():
    """shingles -> 512 bits with one set by each (b0 to b7), and how many shingles met a bit already set."""
    @arrow_udf("struct<" + ",".join(f"b{k}:bigint" for k in range(CELLS)) + ",twice:int>")
    def make(heads: pa.Array) -> pa.Array:
        rows, twice = [], []
        for own in heads.to_pylist():
            spot = np.unique(mix(np.asarray(own, np.int64).view(np.uint64)) % np.uint64(64 * CELLS))
            cells = np.zeros(CELLS, np.uint64)
            np.bitwise_or.at(cells, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
            rows.append(cells.view(np.int64))
            twice.append(len(own) - len(spot))
        table = np.array(rows, np.int64).reshape(-1, CELLS)
        return pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(CELLS)] + [pa.array(twice, pa.int32())],
                                          [f"b{k}" for k in range(CELLS)] + ["twice"])
    return make


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", s: Sketching = Sketching()) -> DataFrame:
    """One row of each class: the document with the smallest id (of repeated
    rows of one id, one). Rows without an id all stay.

    Only ids are joined to the verdicts of most rows: a filter of fixed size
    knows the ids that may go or repeat, and the rows that pass it are the
    only ones to be shuffled; all others are read and handed on."""
    found = classes(docs, id_col, text_col, s)
    special = written(found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("kept").alias("_stays"), F.count("*").alias("_rows"))
                      .filter("NOT _stays OR _rows > 1").select("_id", "_stays"), "verdicts")
    shared = docs.sparkSession.sparkContext.broadcast(cells_of(special.select(F.xxhash64("_id").alias("_h"))))
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("bigint").alias("id"))
    rows = rows.withColumn("maybe", maybe_in(shared)(F.when(F.col("id").isNotNull(), F.xxhash64("id"))))
    judged = rows.filter("maybe").join(special, F.col("id") == F.col("_id"), "left")
    repeated = judged.filter("_stays").dropDuplicates(["id"])
    return (rows.filter("NOT maybe").select("row.*").unionByName(judged.filter("_id IS NULL").select("row.*"))
            .unionByName(repeated.select("row.*")))
