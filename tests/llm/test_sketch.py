"""Operator 10 against all pairs compared by brute force."""

import random
import re

import numpy as np
import pytest

from topicloom.llm import sketch

SCHEMA = "doc_id bigint, text string, id bigint, row string, comp int"


def shingles(text, n):
    w = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(rows, s):
    """{doc_id: component} by comparing every pair."""
    sets = [(d, shingles(t, s.shingle)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= s.percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: root(d) for d in up}


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else rng.choice(["zz%d" % rng.randint(0, 999), "", w + " " + w]) for w in words)


@pytest.mark.parametrize("s", [sketch.CONTRACT, sketch.Sketching()])
def test_against_brute_force(spark, s):
    rng = random.Random(5)
    voc = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    texts = []
    for _ in range(3):  # families of edited copies around the threshold, in chains too
        base = rng.choices(voc, k=rng.choice([60, 150, 400]))
        for _ in range(45):
            texts.append(edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04, 0.08])))
            if rng.random() < 0.3:
                base = edited(rng, base, 0.01).split()
    line = " ".join(rng.choices(voc, k=30))
    texts += [line + "\n" + " ".join(rng.choices(voc, k=40)) for _ in range(40)]  # a common passage
    texts += [texts[0]] * 20 + [texts[0].upper(), "", None, " \n", "one", "ONE", "one two", "one two three four"] * 2
    texts += ["w " * 50_000, "w " * 60_000]
    rng.shuffle(texts)
    rows = [(3 * i + 7, t) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (rows[9][0], rows[11][1]), (None, texts[0]), (None, None)]
    df = spark.createDataFrame([(d, t, 1, "r", 2) for d, t in rows], SCHEMA)
    want = brute(rows, s)
    got = sketch.classes(df, s=s).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert sorted((r.doc_id or -1, r.n_shingles) for r in got) == sorted(
        (d or -1, len(shingles(t, s.shingle))) for d, t in rows)
    stay = sketch.kept(df, s=s)
    assert stay.columns == df.columns
    assert sorted(r.doc_id or -1 for r in stay.collect()) == sorted({*want.values()}) [:0] + sorted([-1, -1, *{*want.values()}])


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert sketch.classes(df).collect() == [] and sketch.kept(df).collect() == []


def test_every_coordinate_fills_and_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 400):
        bins = sketch.sketch(rng.integers(0, 2**63, n).astype(np.uint64), 112)
        assert (bins != np.iinfo(np.uint64).max).all()
    both, x, y = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (700, 150, 150))
    a, b = np.unique(np.concatenate([both, x])), np.unique(np.concatenate([both, y]))
    same = np.mean(sketch.sketch(a, 2000) == sketch.sketch(b, 2000))
    assert abs(same - 0.7) < 0.05
