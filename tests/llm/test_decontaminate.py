"""Operator 1 against a search of every item along every diagonal."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa

from topicloom.llm import decontaminate as dc

DOCS = "doc_id bigint, text string, item bigint, key string, n int"
ITEMS = "item_id bigint, text string, seeds int"


def words(text):
    return "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower()).split()


def run(equal):
    """Best (score, equal words) by trying every start and end."""
    best = (0, 0)
    for a in range(len(equal)):
        score = n = 0
        for e in equal[a:]:
            n += e
            score += 1 if e else -2
            best = max(best, (score, n))
    return best


def brute(doc, item):
    d, i = words(doc), words(item)
    need = min(13, max(6, math.ceil(len(i) / 2)))
    for shift in range(-len(i) + 1, len(d)):
        equal = [d[shift + k] == i[k] for k in range(len(i)) if 0 <= shift + k < len(d)]
        if sum(equal) >= need and run(equal)[1] >= need:
            return True
    return False


def test_best_run_is_optimal():
    rng = np.random.default_rng(3)
    for _ in range(200):
        equal = rng.random(rng.integers(0, 25)) < 0.7
        start, length, matched = dc.best_run(equal)
        score = matched - 2 * (length - matched)
        assert score == run(equal.tolist())[0] and matched == equal[start:start + length].sum()


def test_against_brute_force(spark):
    rng = random.Random(4)
    voc = ["".join(rng.choices("abcdefghij", k=4)) for _ in range(80)] + ["the", "of", "é", "ÉTÉ"]
    items = [" ".join(rng.choices(voc, k=n)) for n in (6, 9, 15, 20, 31, 60, 200)] + ["", None, "the of the", "The, of! the?"]
    rows = [(k, t) for k, t in enumerate(items)] + [(99, items[3]), (None, items[4]), (None, None)]
    texts = ["", None, "the of the", "x " * 30_000]
    for t in items[:7]:
        w = t.split()
        for every in (3, 4, 5, 9, 10**6):
            changed = [c if k % every else "zzz" for k, c in enumerate(w, 1)]
            pad = [rng.choices(voc, k=rng.randint(0, 60)) for _ in range(2)]
            texts.append(" ".join(pad[0] + changed + pad[1]))
            texts.append(" ".join(pad[0]) + ", " + "\n".join(w).upper() + "!! " + " ".join(pad[1]))
        for cut in (0.3, 0.6):
            texts.append(" ".join(w[int(len(w) * cut):] + rng.choices(voc, k=20)))
    texts += [" ".join(rng.choices(voc, k=rng.randint(1, 200))) for _ in range(40)] + [texts[4]] * 5
    docs = spark.createDataFrame([(None if k % 9 == 8 else k // 2, t, 1, "k", 2) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(a, b, 1) for a, b in rows], ITEMS)
    want = {t: any(brute(t, i) for i in items) for t in set(texts)}
    got = dc.marked(docs, bench).collect()
    assert len(got) == len(texts)
    assert sorted((r.doc_id or -1, r.contaminated) for r in got) == sorted(
        (-1 if k % 9 == 8 else (k // 2 or -1), want[t]) for k, t in enumerate(texts))
    for r in got:
        if r.contaminated:
            assert r.n_items >= 1 and r.matched <= r.length <= r.item_words
    stay = dc.clean(docs, bench)
    assert stay.columns == docs.columns
    assert sorted(r.text or "" for r in stay.collect()) == sorted(t or "" for t in texts if not want[t])
    # a crowded filter lets more seeds through and changes nothing
    few = dc.overlaps(docs, bench, filter_bits=8).select("key", "item_key").distinct().count()
    assert few == dc.overlaps(docs, bench).select("key", "item_key").distinct().count()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, "k", 2)], DOCS)
    bench = spark.createDataFrame([], ITEMS)
    assert [r.contaminated for r in dc.marked(docs, bench).collect()] == [False]
    assert dc.marked(docs.limit(0), bench).collect() == []


def test_seeds_are_made_in_small_parts():
    """Seeds of a batch are held for a part of its texts at a time, as numbers, not as Python objects."""
    pick = random.Random(5)
    vocabulary = [f"word{i}" for i in range(400)]
    texts = [" ".join(pick.choices(vocabulary, k=300)) for _ in range(1000)] + ["", None, "one two"]
    batch, cells = pa.array(texts), np.zeros(1 << 20, np.uint64)
    tracemalloc.start()
    assert dc.seeds_of_documents(batch, cells, 26).null_count == len(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 << 20

    cells[:] = np.iinfo(np.uint64).max  # all seeds pass
    some = batch.slice(990)
    found = dc.seeds_of_documents(some, cells, 26).to_pylist()
    items = dc.seeds_of_items(some).to_pylist()
    assert len(found) == len(items) == len(some)
    for text, doc, item in zip(some.to_pylist(), found, items):
        h = dc.plain_words(pa.array([text])).hashes()
        want = [{"seed": int(v), "at": p} for s in dc.seeds(h) for p, v in enumerate(s.view(np.int64))]
        assert item == {"n": len(h), "words": h.tobytes(), "seeds": want}
        assert doc == ({"words": h.tobytes(), "seeds": want} if want else None)
