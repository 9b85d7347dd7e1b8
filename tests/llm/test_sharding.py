"""Operator 7: shares, movement, slots, against a plain descent."""

import math
import random
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

from pyspark.sql import functions as F

from topicloom.llm import sharding as sh

SCHEMA = "doc_id bigint, text string, shard int, slot string"


def plain(key_hash, t):
    """The shard of one row; key_hash(name) is the 64-bit hash of key and name."""
    children = t.regions
    while True:
        best = max((c for c in children if c.weight > 0), key=lambda c: math.log(
            (((key_hash[c.name] % 2**64) >> 12) + 0.5) / 2**52) / c.weight)
        if not best.children:
            return best.shard
        children = best.children


def names(t):
    todo = list(t.regions)
    while todo:
        node = todo.pop()
        yield node.name
        todo += node.children


def test_descent_and_slots(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["", None, "é", "abc", "x" * 50_000])) for k in range(3000)] + [(5, "twin")] * 40 + [(None, "a")] * 3
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], SCHEMA)
    t = sh.tree()
    assert t.shards == 40 and sh.grown(t).shards == 41
    got = sh.sharded(df, t).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter(
        (d, len((x or "").encode()) + 16, zlib.crc32((x or "").encode())) for d, x in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) == set(range(40))
    sizes = sorted(len(s) for s in slots.values())
    assert sizes[0] > 30 and sizes[-1] < 160
    assert 30 < sum(r.grown_shard == 40 for r in got) < 130
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    hashes = df.filter("doc_id < 300 OR doc_id IS NULL").select("doc_id", *(
        F.xxhash64(key, F.lit(n)).alias(n) for n in names(sh.grown(t)))).distinct().collect()
    shard = {r.doc_id: (r.shard, r.grown_shard) for r in got}
    for h in hashes:
        assert shard[h.doc_id] == (plain(h.asDict(), t), plain(h.asDict(), sh.grown(t)))


def test_movement_stays_in_subtrees_whose_weights_change(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id")
    t = sh.tree(3, 2, 3)
    heavier = replace(t.regions[1].children[0].children[2], own_weight=4.0)
    rack = replace(t.regions[1].children[0], children=(*t.regions[1].children[0].children[:2], heavier))
    region = replace(t.regions[1], children=(rack, t.regions[1].children[1]))
    u = sh.Tree((t.regions[0], region, t.regions[2]))
    moved = ids.select(sh.shard_of(F.col("doc_id"), t).alias("a"), sh.shard_of(F.col("doc_id"), u).alias("b")).filter("a != b").collect()
    inside = set(range(6, 12))
    assert moved and all(r.b in inside for r in moved)
    # inside the region, only the rack that grew gains; inside that rack, only the shard that did
    assert all(r.b in (6, 7, 8) for r in moved if r.a in inside)
    assert all(r.b == 8 for r in moved if r.a in (6, 7))
    share = Counter(r.b for r in ids.select(sh.shard_of(F.col("doc_id"), u).alias("b")).collect())
    assert abs(share[8] / 20000 - 4 / 21) < 0.015


def test_no_rows(spark):
    assert sh.sharded(spark.createDataFrame([], SCHEMA), sh.tree()).collect() == []
