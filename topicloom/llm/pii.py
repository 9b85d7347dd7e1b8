"""Operator 8: personal data by patterns, and information-theoretic sanitisation.

Four patterns give the base spans (email, ip, card, phone). Each distinct
value found is a protected entity, and so is the domain of an address. A
term near it (a word within ``reach`` words) may give it away even when the
value itself is gone, so the corpus is asked how much it reveals: with
counts over the N documents,

    disclosure(term, entity) = PMI(term; entity) / IC(entity)
                             = ln(N * n_both / (n_term * n_entity)) / ln(N / n_entity)

which is 1 where the term occurs nowhere but near the entity and 0 where
they are independent. n_both counts documents with the term near the entity,
n_term those with the term anywhere.

Rare words surround any value by chance, so few meetings are weak evidence.
A pair that met in fewer than ``support`` different texts is judged by the
lower confidence limit (Wilson, ``confidence`` standard errors) of the share
n_both / n_term, estimated without its first text: one meeting alone tells
nothing. A term that is written as a name wherever it met the entity (a
capital inside a sentence) counts as one meeting more. At ``generalise_at``
the term becomes a span wherever it stands in a document that holds the
entity, and is replaced by its kind of word; at ``remove_at`` it is removed,
and with ``everywhere`` from all documents.

All counts are over whole texts of the whole corpus. A pair can only reach
the threshold while n_term <= n_both * (N / n_entity)^(1 - generalise_at), and
n_term is at least the number of documents with the term near any entity: most
words near a value are too common by this bound, which drops no pair that could
reach it. n_term is counted for the terms that are left; these pass a filter of
fixed size, a task sums what it has read, and the sums are joined exactly.

Defined cases: null text is empty and has no spans; offsets are code points,
ends exclusive; spans of different kinds may overlap, overlapping ones are
replaced together, by the label of the first; a row per input row, repeated
or null ids included; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from topicloom.llm.common import Tables, Words, cells_of, maybe_in, slices, text_of, written

KINDS = ("email", "ip", "card", "phone")
WORD = re.compile("[^\x20\x09-\x0D]+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can only begin where its run of digits does, so nothing is tried twice inside a run
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


@dataclass(frozen=True)
class Disclosure:
    reach: int = 10
    support: int = 3
    confidence: float = 1.0
    generalise_at: float = 0.85
    remove_at: float = 0.95
    filter_bits: int = 24
    everywhere: bool = False


#: Terms to remove go from documents without the value too.
EVERYWHERE = Disclosure(everywhere=True)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value), by kind and start."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((0, start, m.end(), text[start:m.end()].lower()))
            done = m.end()
        else:
            # the run before this @ can't belong to a later match
            done = at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end(), m[0]))
    for kind, pattern, least, most in ((2, _CARD, 13, 19), (3, _PHONE, 9, 15)):
        for m in pattern.finditer(text) if kind == 2 or "+" in text else ():
            digits = "".join(_DIGIT.findall(m[0]))
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, m.start(), m.end(), digits))
    return out


def term_of(word: str) -> str:
    """The word in lower case without marks at its ends; '' if of one character."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while b > a and not word[b - 1].isalnum():
        b -= 1
    return word[a:b].lower() if b - a >= 2 else ""


def words_of(text: str, spans: list) -> tuple[list[int], list[int], np.ndarray]:
    """(starts, ends, covered by a span) of the words."""
    words = [m.span() for m in WORD.finditer(text)]
    starts, ends = [w[0] for w in words], [w[1] for w in words]
    covered = np.zeros(len(words), bool)
    for _, a, b, _ in spans:
        covered[bisect_right(ends, a):bisect_left(starts, b)] = True
    return starts, ends, covered


def near_terms(text: str, spans: list, reach: int):
    """(entity, term, start, end) of the words within reach of each span, outside all spans."""
    if not spans:
        return []
    starts, ends, covered = words_of(text, spans)
    out = set()
    for kind, a, b, value in spans:
        lo, hi = max(0, bisect_right(ends, a) - reach), min(len(starts), bisect_left(starts, b) + reach)
        entities = [f"{KINDS[kind]}:{value}"] + ([f"domain:{value.partition('@')[2]}"] if kind == 0 else [])
        for k in range(lo, hi):
            if not covered[k] and (term := term_of(text[starts[k]:ends[k]])):
                out.update((entity, term, starts[k], ends[k]) for entity in entities)
    return sorted(out)


def names_at(text: str, spans: list) -> set[int]:
    """Starts of the words written as a name: a capital and small letters, after a word that ends no sentence or line."""
    starts, ends, covered = words_of(text, spans)
    out, last = set(), -1
    for k in np.flatnonzero(~covered).tolist():
        word = text[starts[k]:ends[k]].lstrip("([{\"'«“‘")
        if last >= 0 and word[:1].isupper() and word[1:2].islower() and text[ends[last] - 1] not in ".!?:;…\"”»" \
                and "\n" not in text[ends[last]:starts[k]]:
            out.add(starts[k])
        last = k
    return out


BASE_TYPE = "array<struct<kind:int,start:int,end:int>>"
_SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.bool_())])


def scanned(reach: int):
    @arrow_udf(f"struct<base:{BASE_TYPE},near:array<struct<entity:string,term:string,start:int,end:int,name:boolean>>>")
    def scan(texts: pa.Array) -> pa.Array:
        base, near = [], []
        for text in texts:
            text = text.as_py() or ""
            spans = base_spans(text)
            base.append([{"kind": k, "start": a, "end": b} for k, a, b, _ in spans])
            places, named = near_terms(text, spans, reach), {}
            names = names_at(text, spans) if places else ()
            for e, t, a, _ in places:
                named[e, t] = named.get((e, t), True) and a in names
            near.append([{"entity": e, "term": t, "start": a, "end": b, "name": named[e, t]} for e, t, a, b in places])
        return pa.StructArray.from_arrays([pa.array(base, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR))],
                                          ["base", "near"])
    return scan


def term_counts(shared, bits: int):
    """Batches of texts -> (term, documents with it) of terms whose hash is in the filter, summed per task."""
    def count(batches):
        cells, total = shared.value, Counter()

        def told():
            return pa.RecordBatch.from_pydict({"term": list(total), "n": list(total.values())},
                                              pa.schema([("term", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for _, part in slices(batch.column(0)):
                w = Words(part)
                if not len(w.codes):
                    continue
                terms = [term_of(x) for x in w.vocabulary.to_pylist()]
                spot = np.fromiter((xxhash.xxh3_64_intdigest(t) & ((1 << bits) - 1) for t in terms), np.int64, len(terms))
                good = ((cells[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)
                good &= np.fromiter(map(bool, terms), bool, len(terms))
                # several words may be one term (case, marks); a text counts once for it
                number = {t: k for k, t in enumerate(dict.fromkeys(t for t, g in zip(terms, good) if g))}
                code = np.fromiter((number[t] if g else -1 for t, g in zip(terms, good)), np.int64, len(terms))[w.codes]
                here = np.flatnonzero(code >= 0)
                once = np.unique(w.owners()[here] * max(len(number), 1) + code[here]) % max(len(number), 1)
                n = np.bincount(once, minlength=len(number))
                total.update(dict(zip(number, n.tolist())))
            if len(total) > 300_000:
                yield told()
                total.clear()
        yield told()
    return count


PLACE = pa.schema([("key", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])


def term_places(shared, bits: int):
    """Batches of (key, text) -> (key, term, start, end) of the words outside base spans whose term's hash is in the filter."""
    def place(batches):
        cells = shared.value
        for batch in batches:
            for start, part in slices(batch.column(1)):
                w = Words(part)
                if not len(w.codes):
                    continue
                terms = [term_of(x) for x in w.vocabulary.to_pylist()]
                spot = np.fromiter((xxhash.xxh3_64_intdigest(t) & ((1 << bits) - 1) for t in terms), np.int64, len(terms))
                good = ((cells[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1).astype(bool)
                good &= np.fromiter(map(bool, terms), bool, len(terms))
                wanted = {t for t, g in zip(terms, good) if g}
                out = []
                for k in np.unique(w.owners()[good[w.codes]]).tolist():
                    text, key = part[k].as_py(), batch.column(0)[start + k].as_py()
                    starts, ends, covered = words_of(text, base_spans(text))
                    out += [(key, t, a, b) for a, b, c in zip(starts, ends, covered) if not c and (t := term_of(text[a:b])) in wanted]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), PLACE.types)], schema=PLACE)
    return place


def term_filter(terms: DataFrame, bits: int) -> np.ndarray:
    """Packed bits of the terms' hashes."""
    @arrow_udf("bigint")
    def spot(t: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_64_intdigest(x) & ((1 << bits) - 1) for x in t.to_pylist()], pa.int64())

    return cells_of(terms.select(spot("term").alias("spot")), bits)


def text_key(text_col: str = "text") -> Column:
    return F.md5(F.encode(text_of(text_col), "UTF-8"))


def lower_limit(hits: Column, trials: Column, z: float) -> Column:
    """Wilson's lower confidence limit of a share."""
    p, zz = hits / trials, z * z
    middle = p + zz / (2 * trials)
    return (middle - z * F.sqrt(p * (1 - p) / trials + zz / (4 * trials * trials))) / (1 + zz / trials)


def disclosing(found: DataFrame, docs: DataFrame, text_col: str, d: Disclosure, written) -> DataFrame:
    """(entity, term, disclosure) at or over the lower threshold.

    ``found``: (key, near) of all documents."""
    spark = docs.sparkSession
    pairs = F.array_distinct(F.transform("near", lambda m: F.struct(*(m[c].alias(c) for c in ("entity", "term", "name")))))
    having = found.filter("size(near) > 0")
    near = written(having.select("key", F.explode(pairs).alias("m")).groupBy("key", "m.entity", "m.term", "m.name")
                   .agg(F.count("*").alias("n")), "near")
    both = near.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"), F.bool_and("name").alias("name"))
    entities = (having.select(F.explode(F.array_distinct(F.transform("near", lambda m: m["entity"]))).alias("entity"))
                .groupBy("entity").agg(F.count("*").alias("n_entity")))
    # at least so many documents hold the term
    least = (near.groupBy("key", "term").agg(F.max("n").alias("n")).groupBy("term").agg(F.sum("n").alias("least")))
    n = F.lit(float(found.count()))
    ic = F.log(n / F.col("n_entity"))
    meetings = F.col("texts") - 1 + F.col("name").cast("int")
    limit = F.col("n_both") * F.pow(n / F.col("n_entity"), F.lit(1 - d.generalise_at)) * (1 + 1e-9)
    both = (both.join(entities, "entity").filter((ic > 0) & ((F.col("texts") >= d.support) | (meetings > 0)))
            .join(least, "term").filter(F.col("least") <= limit))
    both = written(both, "both")
    terms = both.select("term").distinct()
    shared = spark.sparkContext.broadcast(term_filter(terms, d.filter_bits))
    counts = (docs.select(F.col(text_col).alias("text")).mapInArrow(term_counts(shared, d.filter_bits), "term string, n bigint")
              .groupBy("term").agg(F.sum("n").alias("n_term")))
    share = F.col("n_both") / F.col("n_term")
    # in texts, so that copies add no evidence, and without the first
    trials = F.col("texts") / share - 1 + F.col("name").cast("int")
    share = F.when(F.col("texts") >= d.support, share).otherwise(lower_limit(meetings.cast("double"), trials, d.confidence))
    return (both.join(counts, "term").select("entity", "term", (F.log(n * share / F.col("n_entity")) / ic).alias("disclosure"))
            .filter(F.col("disclosure") >= d.generalise_at))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", d: Disclosure = Disclosure()) -> DataFrame:
    """(doc_id, key, base, terms) per row: base spans by kind and start; terms:
    spans (start, end, disclosure) that the method adds."""
    with Tables() as tables:
        return written(_spans(docs, id_col, text_col, d, tables.written), "spans")


def _spans(docs: DataFrame, id_col: str, text_col: str, d: Disclosure, written) -> DataFrame:
    found = written(docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("key"),
                                scanned(d.reach)(F.col(text_col)).alias("s")).select("doc_id", "key", "s.*"), "found")
    telling = written(disclosing(found.select("key", "near"), docs, text_col, d, written), "disclosing")
    entities = F.array_distinct(F.transform("near", lambda m: m["entity"]))
    holding = found.filter("size(near) > 0").select("key", F.explode(entities).alias("entity")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(telling.select("term").distinct(), d.filter_bits))
    places = written(docs.select(text_key(text_col).alias("key"), F.col(text_col).alias("text"))
                     .mapInArrow(term_places(shared, d.filter_bits), "key string, term string, start int, end int"), "places")
    hits = places.join(holding.join(telling, "entity").groupBy("key", "term").agg(F.max("disclosure").alias("disclosure")), ["key", "term"])
    if d.everywhere:
        gone = telling.filter(F.col("disclosure") >= d.remove_at).groupBy("term").agg(F.max("disclosure").alias("disclosure"))
        hits = hits.unionByName(places.join(gone, "term").select(hits.columns))
    added = (hits.groupBy("key", "start", "end").agg(F.max("disclosure").alias("disclosure")).groupBy(F.col("key").alias("_key"))
             .agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")))
    return (found.select("doc_id", "key", "base").join(added, F.col("key") == F.col("_key"), "left")
            .select("doc_id", "key", "base", "terms"))


def spelled(base: Column, terms: Column | None = None) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    out = F.transform(base, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"]))
    if terms is not None:
        more = F.transform(terms, lambda s: F.concat_ws(":", F.lit("term"), s["start"], s["end"]))
        out = F.concat(out, F.coalesce(more, F.array().cast("array<string>")))
    return F.array_join(out, ",")


def sanitised_text(remove_at: float):
    @arrow_udf("string")
    def clean(texts: pa.Array, terms: pa.Array) -> pa.Array:
        out = []
        for text, more in zip(texts, terms.to_pylist()):
            text = text.as_py()
            found = [(a, b, f"[{KINDS[k].upper()}]") for k, a, b, _ in base_spans(text or "")]
            for s in more or ():
                word = text[s["start"]:s["end"]]
                kind = "[Word]" if word[:1].isupper() else "[word]"
                found.append((s["start"], s["end"], "" if s["disclosure"] >= remove_at else kind))
            parts, at = [], 0
            for a, b, label in sorted(found):
                if a >= at:
                    parts += [text[at:a], label]
                at = max(at, b)
            out.append("".join(parts) + text[at:] if found else text)
        return pa.array(out, pa.string())
    return clean


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None,
              d: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with the spans of each text replaced; ``length_col``, if given, gets the new length.

    A filter of fixed size knows the texts that hold terms; only rows that
    pass it are shuffled to meet them, the others need their patterns alone."""
    more = (spans(docs, id_col, text_col, d).filter("terms IS NOT NULL").groupBy(F.col("key").alias("_key"))
            .agg(F.first("terms").alias("terms")))
    more = written(more, "terms")
    shared = docs.sparkSession.sparkContext.broadcast(cells_of(more.select(F.xxhash64("_key").alias("_h"))))
    rows = docs.select(F.struct("*").alias("row"), text_key(text_col).alias("key"))
    rows = rows.withColumn("maybe", maybe_in(shared)(F.xxhash64("key")))
    none = F.lit(None).cast(more.schema["terms"].dataType)
    met = (rows.filter("maybe").join(more, F.col("key") == F.col("_key"), "left").select("row", "terms")
           .unionByName(rows.filter("NOT maybe").select("row", none.alias("terms"))))
    new = met.select("row", sanitised_text(d.remove_at)(F.col("row")[text_col], F.col("terms")).alias("clean"))
    columns = {text_col: F.col("clean")}
    if length_col:
        columns[length_col] = F.length("clean").cast(docs.schema[length_col].dataType)
    return new.select(*(columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
