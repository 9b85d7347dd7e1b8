"""Operator 3: best-fit packing with swap-based local search.

Documents become token ids (an id 0 closes each), longer ones are cut into
pieces of the sequence length. The packing problem is solved on the counts
of the piece lengths, which are at most as many as the sequence length
however large the corpus is: best fit in decreasing length opens groups of
bins of one content; local search then exchanges one piece for one, two for
one, or moves one, between two underfull bins whenever that raises the sum
of squared fills, until bins empty or none is left to gain. Every step works
on whole groups at a time.

The plan is a table of runs (length, first rank) -> (first bin, bins,
offset). Pieces of a length are numbered gapless on the cluster, and the
number alone gives the place, so no task sees more than its own rows.

Defined cases: null text is empty; an empty document is one piece of one id
(0); repeated rows are packed each; null ids stay; an empty table gives no
rows; other columns are left alone.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Tables, Words, mix, numbered, slices, written

LENGTH = 2048
#: Bytes of text turned into ids at a time.
SLICE = 2 << 20
# What the vectorised split below doesn't cover: the vocabulary's two special strings, letters beyond the Latin blocks
# (their case and composition rules depend on neighbours), and the stand-in for an apostrophe.
_HARD = r"<\|startoftext\|>|<\|endoftext\|>|[^\x{00}-\x{24F}]|\x{130}|\x02"
# fixed values: the vocabulary file's own rule for the pieces of a word ('s 't 're 've 'm 'll 'd, letters, a digit, other marks)
_ENDING = r"(^|[\s\p{L}\p{N}])'(s|t|re|ve|m|ll|d)"
_DIGIT = r"(\p{N})"
_MARKS = r"([^\s\p{L}\p{N}\x02]+)"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


#: Longer words are rare, and hashed one by one.
LONG = 64


def fingerprints(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64 and 32 hash bits of each word, eight bytes at a time over all words."""
    words = words.cast(pa.binary())
    ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
    start, size = ends[:-1], np.diff(ends)
    data = np.zeros((int(ends[-1]) if len(words) else 0) + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(words.buffers()[2], np.uint8, len(data) - 8)
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    key, check = mix(size.astype(np.uint64) + np.uint64(1)), mix(size.astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15))
    for k in range(0, LONG, 8):
        live = np.flatnonzero((size > k) & (size <= LONG))
        if not len(live):
            break
        left = np.minimum(size[live] - k, 8).astype(np.uint64)
        eight = eights[start[live] + k] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))
        key[live] = mix(key[live] ^ eight) + np.uint64(2 * k + 1)
        check[live] = mix(check[live] + eight * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > LONG).tolist():
        whole = xxhash.xxh3_128_intdigest(words[k].as_py())
        key[k], check[k] = whole & (2**64 - 1), whole >> 64
    return key, (check >> np.uint64(32)).astype(np.uint32)


class Ids:
    """Token ids of whole texts. Texts are split into the vocabulary's pieces
    (white space always ends one), and each distinct piece is tokenized once:
    known pieces are kept as sorted hashes with their ids, so the table stays
    small and a slice is looked up at once."""

    kept: dict[str, "Ids"] = {}
    ROOM = 800_000

    def __init__(self, path: str):
        # one task, one thread: Spark spreads the work, and every thread would keep memory of its own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.closes[i] = token.endswith("</w>")
        self.forget()

    def forget(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    @classmethod
    def of(cls, path: str) -> "Ids":
        """The worker's own, kept between batches."""
        if path not in cls.kept:
            cls.kept[path] = cls(path)
        return cls.kept[path]

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of single pieces: many in one text, the closing token of each shows where it ends."""
        flat, size = [], []
        groups = [pieces[k:k + 512] for k in range(0, len(pieces), 512)]
        for own, ids in zip(groups, self._encode([" ".join(g) for g in groups])):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(own):
                each = self._encode(own)
                ids, ends = np.concatenate(each), np.cumsum([len(e) for e in each])
            flat.append(ids)
            size.append(np.diff(ends, prepend=0))
        return np.concatenate(flat), np.concatenate(size).astype(np.int32)

    def _known(self, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in ``flat`` of every piece, learning those that are new."""
        key, check = fingerprints(vocabulary)
        if len(self.size) > self.ROOM:
            self.forget()
        at = np.searchsorted(self.key, key)
        near = np.minimum(at, max(len(self.key) - 1, 0))
        new = np.flatnonzero((self.key[near] != key) | (self.check[near] != check)) if len(self.key) else np.arange(len(key))
        if len(new):
            new = new[np.argsort(key[new])]
            ids, size = self._pieces(vocabulary.take(pa.array(new)).to_pylist())
            first = (len(self.flat) + np.cumsum(size) - size).astype(np.int32)
            self.flat = np.concatenate([self.flat, ids])
            for name, more in (("key", key[new]), ("check", check[new]), ("first", first), ("size", size)):
                setattr(self, name, np.insert(getattr(self, name), at[new], more))
            at = np.searchsorted(self.key, key)
        return self.first[at], self.size[at]

    def _easy(self, part: pa.Array) -> list[np.ndarray]:
        low = pc.utf8_lower(pc.replace_substring_regex(part, "[\\x{0B}\\x{85}\\x{A0}]", " "))
        if pc.any(pc.match_substring(low, "'")).as_py():
            for _ in range(2):  # neighbouring ones share the character between them
                low = pc.replace_substring_regex(low, _ENDING, "\\1 \x02\\2 ")
        low = pc.replace_substring_regex(low, _DIGIT, " \\1 ")
        low = pc.replace_substring(pc.replace_substring_regex(low, _MARKS, " \\1 "), "\x02", "'")
        w = Words(low)
        if not len(w.codes):
            return [np.zeros(0, np.uint32)] * len(part)
        first, size = self._known(w.vocabulary)
        per = size[w.codes]
        ends = np.concatenate([[0], np.cumsum(per)])
        take = np.repeat(first[w.codes] - ends[:-1], per)
        take += np.arange(ends[-1])
        ids = self.flat[take]
        return np.split(ids, ends[w.bounds[1:-1]])

    def _whole(self, text: str) -> np.ndarray:
        """A text word by word, equal words once."""
        if "<|startoftext|>" in text or "<|endoftext|>" in text:
            return self._encode([text])[0]
        words = text.encode().split()
        own = sorted(set(words))
        ids = dict(zip(own, self._encode([w.decode() for w in own])))
        return np.concatenate([ids[w] for w in words]) if words else np.zeros(0, np.uint32)

    def texts(self, part: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a slice."""
        part = pc.fill_null(part.cast(pa.string()), "")
        hard = pc.match_substring_regex(part, _HARD)
        easy = iter(self._easy(part.filter(pc.invert(hard))))
        return [self._whole(t.as_py()) if h else next(easy) for h, t in zip(hard.to_pylist(), part)]


def cut(path: str, length: int, with_ids: bool = False):
    """text -> its pieces: start, length, ids_crc32 (and the ids)."""
    kind = "start:bigint,length:int,ids_crc32:bigint" + ",ids:array<int>" * with_ids

    @arrow_udf(f"array<struct<{kind}>>")
    def pieces(texts: pa.Array) -> pa.Array:
        source = Ids.of(path)
        rows = [0]
        starts, lengths, crcs, ids = [], [], [], []
        for _, part in slices(texts, SLICE):
            for own in source.texts(part):
                own = np.append(own, np.uint32(0)).astype("<u4", copy=False)
                for k in range(0, len(own), length):
                    piece = own[k:k + length]
                    starts.append(k)
                    lengths.append(len(piece))
                    crcs.append(zlib.crc32(piece.tobytes()))
                    if with_ids:
                        ids.append(piece.astype(np.int32))
                rows.append(len(starts))
        columns = [pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64())]
        names = ["start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays(columns, names))
    return pieces


# --- the plan: groups of bins of one content ---------------------------------

def best_fit(counts: dict[int, int], size: int) -> list[list]:
    """Groups [content (length -> pieces), bins] by best fit in decreasing length."""
    by_room: dict[int, list[list]] = {}

    def put(content: Counter, bins: int):
        by_room.setdefault(size - sum(k * v for k, v in content.items()), []).append([content, bins])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r, g in by_room.items() if r >= length and g), default=None)
            if room is None:
                each = size // length
                if left >= each:
                    put(Counter({length: each}), left // each)
                if left % each:
                    put(Counter({length: left % each}), 1)
                break
            content, bins = by_room[room].pop()
            # a bin takes as many of this length as fit before the next bin does
            each = min(room // length, left)
            used = min(bins, left // each)
            put(content + Counter({length: each}), used)
            if bins > used:
                by_room[room].append([content, bins - used])
            left -= used * each
    return [g for groups in by_room.values() for g in groups]


def exchange(full: Counter, low: Counter, room: int) -> tuple[Counter, Counter] | None:
    """What a fuller bin gives and takes so that it gains most, at most ``room``:
    moves of one, one for one, two for one, one for two."""
    ones = lambda c: {k: Counter({k: 1}) for k in c}

    def twos(c):
        keys = sorted(c)
        return {a + b: Counter([a, b]) for i, a in enumerate(keys) for b in keys[i:] if a != b or c[a] > 1}

    best, choice = 0, None
    gives = {0: Counter(), **twos(full), **ones(full)}
    for two, takes in ((False, ones(low)), (True, twos(low))):
        order = sorted(takes)
        for given, out in gives.items():
            if two and sum(out.values()) != 1:
                continue  # two are taken for one only
            at = np.searchsorted(order, given + room, side="right") - 1
            if at >= 0 and order[at] - given > best:
                best, choice = order[at] - given, (out, takes[order[at]])
    return choice


class Loose:
    """The underfull groups by what a bin of theirs can give: for each length,
    and each sum of two, the groups that hold it, least filled first."""

    def __init__(self, size: int):
        self.size, self.bins = size, {}
        self.heaps: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.there = [0, 0]  # which lengths and sums have a heap, as bits

    def shift(self, key: tuple, n: int) -> None:
        before = self.bins.get(key, 0)
        if before + n:
            self.bins[key] = before + n
        else:
            del self.bins[key]
        if before or filled(key) >= self.size:
            return
        lengths = [k for k, _ in key]
        twos = {a + b for i, a in enumerate(lengths) for b in lengths[i:]
                if a != b or dict(key)[a] > 1}
        for kind, sums in enumerate((lengths, twos)):
            for s in sums:
                heappush(self.heaps[kind].setdefault(s, []), (filled(key), key))
                self.there[kind] |= 1 << s

    def least(self, kind: int, s: int, besides: tuple) -> tuple | None:
        """(fill, group) of the least filled group that can give ``s``; ``besides`` only if it has two bins."""
        heap, aside = self.heaps[kind][s], None
        while heap:
            fill, key = heap[0]
            if key not in self.bins or (aside and key == aside[1]):
                heappop(heap)
            elif key == besides and self.bins[key] < 2:
                aside = heappop(heap)
            else:
                break
        found = heap[0] if heap else None
        if aside:
            heappush(heap, aside)
        if not heap:
            self.there[kind] &= ~(1 << s)
        return found

    def partner(self, full: tuple) -> tuple | None:
        """The group whose exchange raises the fill of ``full`` most (ties: the least filled)."""
        own, room = filled(full), self.size - filled(full)
        lengths = [k for k, _ in full]
        gives = {0: 0} | {a + b: 2 for i, a in enumerate(lengths) for b in lengths[i:] if a != b or dict(full)[a] > 1} | {k: 1 for k in lengths}
        best = None
        for given, count in gives.items():
            for kind in (0, 1) if count == 1 else (0,):  # two are taken for one only
                open_ = self.there[kind] & ((1 << (given + room + 1)) - 1)
                while open_:
                    s = open_.bit_length() - 1
                    if s <= given or (best and s - given < best[0]):
                        break
                    found = self.least(kind, s, full)
                    if found and found[0] <= own:
                        rank = (s - given, -found[0])
                        if not best or rank > best[:2]:
                            best = (*rank, found[1])
                        break
                    open_ ^= 1 << s
        return best[2] if best else None


def filled(key: tuple) -> int:
    return sum(k * v for k, v in key)


def improved(groups: list[list], size: int) -> list[list]:
    """Local search between underfull bins until no exchange of any two gains.

    Every exchange raises the sum of squared fills, a whole number, so it
    ends. Groups are tried from the fullest on; those that an exchange has
    made or changed are tried again, in turns, until a turn changes nothing
    or the bins are as few as their content allows."""
    loose = Loose(size)
    for content, bins in groups:
        loose.shift(tuple(sorted(content.items())), bins)
    count = sum(loose.bins.values())
    least = -(-sum(filled(k) * n for k, n in loose.bins.items()) // size)
    changed = True
    while changed and count > least:
        changed = False
        for full in sorted((k for k in loose.bins if filled(k) < size), key=lambda k: (-filled(k), k)):
            while full in loose.bins and count > least and (low := loose.partner(full)):
                out, into = exchange(Counter(dict(full)), Counter(dict(low)), size - filled(full))
                times = loose.bins[low] // 2 if full == low else min(loose.bins[full], loose.bins[low])
                new_full = Counter(dict(full)) - out + into
                new_low = Counter(dict(low)) - into + out
                loose.shift(full, -times)
                loose.shift(low, -times)
                loose.shift(tuple(sorted(new_full.items())), times)
                if new_low:
                    loose.shift(tuple(sorted(new_low.items())), times)
                else:
                    count -= times
                changed = True
    return [[Counter(dict(k)), n] for k, n in sorted(loose.bins.items())]


def plan(counts: dict[int, int], size: int) -> np.ndarray:
    """Runs as rows: key (length << 40 | first rank), first rank, bins, first bin, offset, length."""
    whole = counts.get(size, 0)
    rows = [(size, 0, whole, 0, 0)] if whole else []
    taken: dict[int, int] = {}
    first = whole
    for content, bins in improved(best_fit({k: n for k, n in counts.items() if k < size}, size), size):
        offset = 0
        for length in sorted(content, reverse=True):
            rows.append((length, taken.get(length, 0), bins, first, offset))
            taken[length] = taken.get(length, 0) + bins * content[length]
            offset += length * content[length]
        first += bins
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 5)
    return np.column_stack([(table[:, 0] << 40) | table[:, 1], table[:, 1:], table[:, 0]])


def placed(shared):
    """(length, rank) -> sequence_id, offset."""
    @arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        table = shared.value
        length, rank = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (length, rank))
        run = table[np.searchsorted(table[:, 0], (length << 40) | rank, side="right") - 1] if len(rank) else table[:0]
        at = rank - run[:, 1]
        return pa.StructArray.from_arrays([pa.array(run[:, 3] + at % np.maximum(run[:, 2], 1)),
                                           pa.array(run[:, 4] + at // np.maximum(run[:, 2], 1) * run[:, 5])],
                                          ["sequence_id", "offset"])
    return place


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH,
           vocabulary: str | None = None) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    path = vocabulary or vocabulary_path()
    with Tables() as tables:
        pieces = tables.written(
            docs.select(F.col(id_col).alias("doc_id"), cut(path, size)(F.col(text_col)).alias("p"))
            .select("doc_id", F.posexplode("p").alias("piece", "p"))
            .select("doc_id", "piece", "p.*"), "pieces")
        counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
        shared = docs.sparkSession.sparkContext.broadcast(plan(counts, size))
        ranked = numbered(pieces, "length", ["doc_id", "piece", "start", "ids_crc32"], "rank")
        return written(ranked.withColumn("at", placed(shared)("length", "rank"))
                       .select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32",
                               "at.*"), "packed")


def sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = LENGTH,
              vocabulary: str | None = None) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves; a sequence holds at most ``size`` ids."""
    path = vocabulary or vocabulary_path()
    at = packed(docs, id_col, text_col, size, path)
    same = ["piece", "start", "ids_crc32"]
    ids = (docs.select(F.col(id_col).alias("doc_id"), cut(path, size, True)(F.col(text_col)).alias("p"))
           .select("doc_id", F.posexplode("p").alias("piece", "p")).select("doc_id", "piece", "p.*")
           .drop("length").dropDuplicates(["doc_id", *same]).withColumnRenamed("doc_id", "_doc"))
    both = at.join(ids, same).filter(F.col("doc_id").eqNullSafe(F.col("_doc")))
    return both.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda s: s["ids"])).alias("ids"))
