"""Operator 7: shards by a hierarchical weighted hash tree.

A document's key descends region, rack and shard. At each level every child
draws a number from the key and the child's own name, ln(u) / weight, and
the largest draw wins (weighted rendezvous), so a child wins in proportion
to its weight. A draw depends on nothing but key, child and its weight:
where weights change, keys move only into or out of the children whose
weights did, and elsewhere every subtree keeps what it had.

``grown`` adds a shard as a region of its own, with the weight of one
shard: no other weight changes, so the new shard takes rows only into
itself. ``law`` is ``key``: the id and the number of shards decide.

Slots number the rows of each shard gapless from 0; shards are dealt over
hashed blocks for it, so no task holds a whole shard.

Defined cases: a null id is drawn for like a value of its own; null text has
no bytes (crc 0, size 16); repeated rows get slots of their own; an empty
table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import numbered


@dataclass(frozen=True)
class Node:
    """A shard (number set) or the children of a region or rack."""

    name: str
    children: tuple["Node", ...] = ()
    shard: int = -1
    own_weight: float = 1.0

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


@dataclass(frozen=True)
class Tree:
    regions: tuple[Node, ...] = field(default_factory=tuple)

    @property
    def shards(self) -> int:
        return sum(len(rack.children) for region in self.regions for rack in region.children)


def tree(regions: int = 4, racks: int = 2, shards: int = 5) -> Tree:
    """Regions of racks of shards, numbered in that order, all shards of weight 1."""
    def rack(r, k):
        first = (r * racks + k) * shards
        return Node(f"region{r}/rack{k}", tuple(Node(f"shard{n}", shard=n) for n in range(first, first + shards)))

    return Tree(tuple(Node(f"region{r}", tuple(rack(r, k) for k in range(racks))) for r in range(regions)))


def grown(t: Tree) -> Tree:
    """One more shard, in a region and rack of its own."""
    n, r = t.shards, len(t.regions)
    return Tree((*t.regions, Node(f"region{r}", (Node(f"region{r}/rack0", (Node(f"shard{n}", shard=n),)),))))


def draw(key: Column, name: Column, weight: Column) -> Column:
    """ln(u) / weight with u in (0, 1) from 52 bits of the hash of key and name."""
    bits = F.shiftrightunsigned(F.xxhash64(key, name), 12)
    return F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def shard_of(key: Column, t: Tree) -> Column:
    """The shard where the descent ends; children of weight 0 take no part.

    The tree is a constant table from node to children. Each level looks up
    the children of the node that it has come to and takes one maximum over
    their draws, so a row costs the draws on its path, and the expression
    grows with the tree, not with its square."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    nodes, deep = [Node("", t.regions)], [0]
    children: list[list[int]] = []
    for number, node in enumerate(nodes):  # grows as it goes
        live = [c for c in node.children if c.weight > 0]
        children.append(list(range(len(nodes), len(nodes) + len(live))) or [number])
        nodes += live
        deep += [deep[number] + 1] * len(live)
    entry = lambda k: F.struct(F.lit(nodes[k].name).alias("name"), F.lit(float(nodes[k].weight)).alias("weight"), F.lit(k).alias("node"))
    table = F.array(*(F.array(*map(entry, own)) for own in children))
    at = F.lit(0)
    for _ in range(max(deep)):
        draws = F.transform(F.element_at(table, at + 1), lambda c: F.struct(draw(key, c["name"], c["weight"]).alias("draw"), (-c["node"]).alias("minus")))
        at = -F.array_max(draws)["minus"]
    return F.element_at(F.array(*(F.lit(n.shard) for n in nodes)), at + 1)


def sharded(docs: DataFrame, t: Tree, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    data = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = (docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + 16).cast("bigint").alias("size"),
                        F.crc32(data).alias("text_crc32"))
            .withColumn("shard", shard_of(F.col("doc_id"), t)))
    return (numbered(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
                    shard_of(F.col("doc_id"), grown(t)).alias("grown_shard")))
