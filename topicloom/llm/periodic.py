"""Operator 11: periodic runs of words by suffix trees and Lyndon roots.

A run is a stretch of consecutive words with smallest period q that no
neighbouring word extends. Per document:

1. Words that no run can hold are passed over: in a run of at least
   ``min_length`` words and ``min_exponent`` periods each trigram recurs,
   so a word is left only where a trigram that covers it occurs often enough
   in its stretch. The test repeats on the stretches that remain; it loses no run.
2. Ukkonen's algorithm builds the suffix tree of each remaining stretch and
   of its reversal. An Euler tour of a tree and range minima over the tour's
   string depths (blocks, so memory stays linear) give the lowest common
   ancestor of two leaves, hence the longest common extension of two places,
   in constant time, forwards and backwards.
3. The leaf order gives for each place, under an order of the words and its
   opposite, the longest Lyndon word that begins there. One of these is a
   root of each run: a candidate period, extended in both directions.

A word is dropped from the collapsed text if a run holds it after the run's
first period.

Defined cases: null text has no words, runs none, an empty collapsed text;
one row per row of ``docs``, null and repeated ids included; a text of one
repeated word is one run of period 1; an empty table gives no rows; other
columns are left alone. A task works on one text, or a slice of texts, at a
time; texts are never cut.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import mix, slices

WORDS = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Periodicity:
    min_length: int = 6
    min_exponent: int = 4

    def __post_init__(self):
        if self.min_exponent < 2 or self.min_length < 2:
            raise ValueError("a run has two periods and two words at least")

    @property
    def recurrence(self) -> int:
        """How often each trigram of a run occurs in it, at least: a run of
        L >= max(min_length, e * q) words holds (L - 2) // q of each."""
        return min(max(self.min_length, self.min_exponent) - 2, self.min_exponent - 1) if self.min_length >= 3 else 0


class SuffixTree:
    """Ukkonen's suffix tree of symbols 1, 2, ...; symbol 0 ends the text.

    ``edge`` maps node * symbols + first symbol to the child; the edge into a
    node is text[start:end]; ``suffix`` is a leaf's place, -1 inside."""

    def __init__(self, symbols: list[int]):
        text = symbols + [0]
        n, width = len(text), max(text) + 1
        start, end, link, suffix, edge = [0], [0], [0], [-1], {}
        node, first, length, open_ = 0, 0, 0, 0
        for i, symbol in enumerate(text):
            open_ += 1
            waiting = 0
            while open_:
                if not length:
                    first = i
                key = node * width + text[first]
                child = edge.get(key)
                if child is None:
                    edge[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    suffix.append(i - open_ + 1)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        node, length, first = child, length - span, first + span
                        continue
                    if text[start[child] + length] == symbol:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    inner = len(start)
                    edge[key] = inner
                    start += [start[child], i]
                    end += [start[child] + length, n]
                    link += [0, 0]
                    suffix += [-1, i - open_ + 1]
                    start[child] += length
                    edge[inner * width + symbol] = inner + 1
                    edge[inner * width + text[start[child]]] = child
                    if waiting:
                        link[waiting] = inner
                    waiting = inner
                open_ -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    first = i - open_ + 1
        self.width, self.start, self.end, self.suffix = width, start, end, np.array(suffix)
        self.keys = np.fromiter(edge.keys(), np.int64, len(edge))
        self.nodes = np.fromiter(edge.values(), np.int64, len(edge))

    def children(self, falling: bool) -> tuple[list[int], list[int]]:
        """Children of all nodes by their first symbol (rising, or falling after the end symbol), and where each node's begin."""
        parent, symbol = np.divmod(self.keys, self.width)
        order = np.lexsort((np.where(symbol > 0, self.width - symbol, 0) if falling else symbol, parent))
        bounds = np.searchsorted(parent[order], np.arange(len(self.start) + 1))
        return self.nodes[order].tolist(), bounds.tolist()

    def leaves(self, falling: bool) -> np.ndarray:
        """Rank of every suffix."""
        kids, at = self.children(falling)
        suffix, order, stack = self.suffix.tolist(), [], [0]
        while stack:
            v = stack.pop()
            if suffix[v] >= 0:
                order.append(suffix[v])
            else:
                stack += kids[at[v]:at[v + 1]][::-1]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        return rank

    def tour(self) -> tuple[np.ndarray, np.ndarray]:
        """The Euler tour's string depths, and the first visit of each suffix's leaf."""
        kids, at = self.children(False)
        start, end = self.start, self.end
        next_, depth, visits, path = at[:-1], [0] * len(start), [], [0]
        while path:
            v = path[-1]
            visits.append(v)
            k = next_[v]
            if k < at[v + 1]:
                next_[v] = k + 1
                child = kids[k]
                depth[child] = depth[v] + end[child] - start[child]
                path.append(child)
            else:
                path.pop()
        visits = np.array(visits)
        seen = np.empty(len(start), np.int64)
        seen[visits[::-1]] = np.arange(len(visits))[::-1]
        leaf = np.flatnonzero(self.suffix >= 0)
        first = np.empty(len(leaf), np.int64)
        first[self.suffix[leaf]] = seen[leaf]
        return np.array(depth)[visits], first


class Extensions:
    """Longest common extensions of pairs of places: the string depth of the
    lowest common ancestor of their leaves.

    Range minima come from windows of up to 32 visits and a sparse table over
    blocks of 32: a fixed number of lookups each, and linear memory."""

    BLOCK = 32

    def __init__(self, tree: SuffixTree):
        depths, self.first = tree.tour()
        self.short = self._levels(depths.astype(np.int32), 6)
        blocks = np.minimum.reduceat(depths, np.arange(0, len(depths), self.BLOCK)).astype(np.int32)
        self.long = self._levels(blocks, max(1, len(blocks).bit_length()))

    @staticmethod
    def _levels(values: np.ndarray, count: int) -> list[np.ndarray]:
        levels = [values]
        while len(levels) < count and len(values) > 1 << (len(levels) - 1):
            half = 1 << (len(levels) - 1)
            last = levels[-1]
            more = last.copy()
            np.minimum(last[:-half], last[half:], out=more[:-half])
            levels.append(more)
        return levels

    @staticmethod
    def _least(levels: list[np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minima of lo..hi, both included."""
        out = np.empty(len(lo), np.int32)
        level = np.frexp((hi - lo + 1).astype(float))[1] - 1
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(levels[k][lo[at]], levels[k][hi[at] - (1 << int(k)) + 1])
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.first[i], self.first[j]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        out = np.empty(len(lo), np.int64)
        near = hi - lo < self.BLOCK
        out[near] = self._least(self.short, lo[near], hi[near])
        lo, hi = lo[~near], hi[~near]
        ends = np.minimum(self._least(self.short, lo, lo + self.BLOCK - 1), self._least(self.short, hi - self.BLOCK + 1, hi))
        first, last = -(-lo // self.BLOCK), (hi + 1) // self.BLOCK - 1
        some = last >= first
        ends[some] = np.minimum(ends[some], self._least(self.long, first[some], last[some]))
        out[~near] = ends
        return out


def lyndon_ends(rank: np.ndarray) -> np.ndarray:
    """Where the longest Lyndon word from each place ends: at the next smaller suffix."""
    rank = rank.tolist()
    n = len(rank) - 1  # the last suffix is the end symbol, the smallest
    out = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        j, own = i + 1, rank[i]
        while rank[j] > own:
            j = out[j]
        out[i] = j
    return np.array(out[:n], np.int64)


def runs_of(symbols: np.ndarray, p: Periodicity = Periodicity()) -> np.ndarray:
    """Rows (start, length, period) of the runs of a word sequence, by start and period."""
    n = len(symbols)
    if n < max(p.min_length, p.min_exponent):
        return np.zeros((0, 3), np.int64)
    symbols = (np.unique(symbols, return_inverse=True)[1] + 1).tolist()
    tree = SuffixTree(symbols)
    place = np.arange(n)
    found = np.concatenate([np.stack([place, lyndon_ends(tree.leaves(falling)) - place], 1) for falling in (False, True)])
    forward = Extensions(tree)
    del tree
    backward = Extensions(SuffixTree(symbols[::-1]))
    i, q = np.unique(found, axis=0).T
    right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    inside = i + q < n
    right[inside] = forward(i[inside], (i + q)[inside])
    before = i > 0
    left[before] = backward(n - i[before], n - (i + q)[before])
    length = left + q + right
    good = length >= np.maximum(p.min_length, p.min_exponent * q)
    return np.unique(np.stack([i - left, length, q], 1)[good], axis=0)[:, [0, 1, 2]]


def stretches(codes: np.ndarray, owners: np.ndarray, p: Periodicity) -> list[np.ndarray]:
    """Consecutive positions, each stretch in one text, outside of which no run has a word."""
    at, part = np.arange(len(codes)), owners
    while len(at):
        joined = (np.diff(at) == 1) & (np.diff(part) == 0)
        if p.recurrence > 1:
            whole = np.flatnonzero(joined[:-1] & joined[1:])
            w = codes[at].astype(np.uint64)
            key = mix(mix(mix(part[whole].astype(np.uint64) + np.uint64(1)) ^ w[whole]) ^ (w[whole + 1] << np.uint64(1)))
            key = mix(key ^ w[whole + 2])
            # keys that happen to be equal only raise a count: nothing is lost
            _, number, count = np.unique(key, return_inverse=True, return_counts=True)
            good = whole[count[number] >= p.recurrence]
            keep = np.zeros(len(at), bool)
            for k in range(3):
                keep[good + k] = True
        else:
            keep = np.ones(len(at), bool)
        kept, before = np.flatnonzero(keep), len(at)
        cut = np.flatnonzero((np.diff(kept) != 1) | ~joined[kept[:-1]]) + 1
        bounds = np.concatenate([[0], cut, [len(kept)]])
        size = np.diff(bounds)
        long_ = size >= p.min_length
        part = np.repeat(np.cumsum(long_), size * long_) if len(kept) else kept
        at = at[kept[np.repeat(long_, size)]] if len(kept) else kept
        # another pass pays only while the passes still remove a good part
        if len(at) > 0.9 * before:
            break
    if not len(at):
        return []
    return np.split(at, np.flatnonzero((np.diff(at) != 1) | (np.diff(part) != 0)) + 1)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic(p: Periodicity = Periodicity()):
    """text -> its number of words, runs by start and period, and collapsed text."""
    @arrow_udf(f"struct<n_words:bigint,runs:{RUN_TYPE},collapsed:string>")
    def find(texts: pa.Array) -> pa.Array:
        counts, runs, collapsed = [], [], []
        for _, part in slices(texts):
            lists = pc.ascii_split_whitespace(pc.fill_null(part.cast(pa.string()), ""))
            flat = lists.flatten()
            real = pc.not_equal(flat, "")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[ends].astype(np.int64)
            flat = flat.filter(real)
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            owners = np.repeat(np.arange(len(part)), np.diff(bounds))
            own = [[] for _ in range(len(part))]
            dropped = np.zeros(len(codes) + 1, np.int64)
            for stretch in stretches(codes, owners, p):
                text = int(owners[stretch[0]])
                offset = int(stretch[0] - bounds[text])
                for start, length, q in runs_of(codes[stretch], p).tolist():
                    own[text].append({"start": start + offset, "length": length, "period": q})
                    dropped[stretch[0] + start + q] += 1
                    dropped[stretch[0] + start + length] -= 1
            kept = np.cumsum(dropped)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(kept)])[bounds]
            words = pa.ListArray.from_arrays(pa.array(left, pa.int32()), flat.filter(pa.array(kept)))
            counts.append(pa.array(np.diff(bounds), pa.int64()))
            runs.append(pa.array(own, pa.list_(_RUN)))
            collapsed.append(pc.binary_join(words, " "))
        if not counts:
            return pa.array([], pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())]))
        return pa.StructArray.from_arrays([pa.concat_arrays(x) for x in (counts, runs, collapsed)],
                                          ["n_words", "runs", "collapsed"])
    return find


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str | Column = "text", p: Periodicity = Periodicity()) -> DataFrame:
    """(doc_id, n_words, runs, collapsed), a row per row of ``docs``."""
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    return docs.select(F.col(id_col).alias("doc_id"), periodic(p)(text).alias("_found")).select("doc_id", "_found.*")


def longest(runs: Column) -> Column:
    """The longest run (ties: smallest start, then period), null if there is none."""
    keys = F.transform(runs, lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    return F.array_min(keys)


def told(runs: Column) -> Column:
    """``start,length,period`` and a line feed for each run."""
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return F.array_join(lines, "")


def looped(id_col: Column, text: Column) -> Column:
    """The text, in which one document in ten (by the crc32 of its id) repeats a part of its words up to its end."""
    words = F.filter(F.split(text, WORDS), lambda w: w != "")
    h = F.crc32(id_col.cast("string"))
    g = F.floor(h / 10)
    n = F.size(words).cast("bigint")
    a = g % n
    q = 1 + F.floor((n - a) / (3 + g % 8))
    part = F.slice(words, (a + 1).cast("int"), q.cast("int"))
    loops = F.flatten(F.array_repeat(part, F.ceil((n - a) / q).cast("int")))
    new = F.concat(F.slice(words, F.lit(1), a.cast("int")), F.slice(loops, F.lit(1), (n - a).cast("int")))
    return F.when(h % 10 == 0, F.when(n > 0, F.array_join(new, " ")).otherwise(text)).otherwise(text)
