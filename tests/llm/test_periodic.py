"""Operator 11 against all periods of all stretches by brute force, and its defined cases."""

import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import periodic
from topicloom.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(w, p=periodic.Periodicity()):
    """Every maximal stretch equal to itself q words on, of smallest period q."""
    n, out = len(w), []
    for q in range(1, n // p.min_exponent + 1):
        same = [w[i] == w[i + q] for i in range(n - q)] + [False]
        start = 0
        for i, ok in enumerate(same):
            if not ok:
                length = i - start + q
                own = w[start:start + length]
                if length >= max(p.min_length, p.min_exponent * q) and not any(own[r:] == own[:-r] for r in range(1, q)):
                    out.append((start, length, q))
                start = i + 1
    return sorted(out)


def plain(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % q] for i in range(n)]
    runs = brute(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 6)), max_size=8),
       st.sampled_from([(6, 4), (2, 2), (4, 3), (7, 2)]))
def test_all_runs(parts, limits):
    w = [x for part, times in parts for x in part * times]
    p = periodic.Periodicity(*limits)
    assert list(map(tuple, periodic.runs_of(np.array(w, np.int64), p).tolist())) == brute(w, p)
    codes = np.array(w + w[::-1], np.int64)
    owners = np.repeat([0, 1], len(w))
    found = [[], []]
    for stretch in periodic.stretches(codes, owners, p):
        own = int(owners[stretch[0]])
        found[own] += [(int(stretch[0]) - own * len(w) + s, n, q) for s, n, q in periodic.runs_of(codes[stretch], p).tolist()]
    assert [sorted(f) for f in found] == [brute(w, p), brute(w[::-1], p)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 2), min_size=2, max_size=120), st.data())
def test_extensions_are_common_prefixes(w, data):
    longest = periodic.Extensions(periodic.SuffixTree(w))
    pairs = [data.draw(st.lists(st.integers(0, len(w) - 1), min_size=2, max_size=2, unique=True)) for _ in range(10)]
    for (i, j), got in zip(pairs, longest(*np.array(pairs).T)):
        want = 0
        while max(i, j) + want < len(w) and w[i + want] == w[j + want]:
            want += 1
        assert got == want


def test_query_and_defined_cases(spark, tables):
    rng = random.Random(1)
    words = ["w%d" % k for k in range(40)] + ["é", "x\x85y", "あ"]
    texts = [None, "", " \n\t ", "one", "a " * 50_000, "a b c " * 7 + "d" + " e f" * 9, "x" * 300_000,
             " ".join(rng.choices(words, k=12_000)), "\n".join(["same line of words here"] * 30)]
    texts += [" ".join(rng.choices(words[:rng.randint(1, 43)], k=rng.randint(1, 120))) for _ in range(400)]
    rows = [(k, t, 1, None) for k, t in enumerate(texts)] + [(None, "b " * 9, 1, "z")] * 3 + [(7, texts[7], 2, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, runs int, start string")
    got = QUERIES["op11_lyndon_runs"](spark, tables(documents=docs))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain(i, t) for i, t, *_ in rows), key=repr)
    assert sum(plain(i, t)[1] > 0 for i, t, *_ in rows if (i or 0) > 8) > 30
    assert QUERIES["op11_lyndon_runs"](spark, tables(documents=docs.limit(0))).collect() == []


def test_collapsed_text(spark):
    text = "go " + "la di da " * 5 + "end " + "ha " * 6
    row = periodic.detected(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert [tuple(r) for r in row.runs] == [(1, 15, 3), (17, 6, 1)]
    assert row.collapsed == "go la di da end ha" and row.n_words == 23
