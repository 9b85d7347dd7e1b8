"""Operator 6 against a plain restatement, and its defined cases."""

import random
import re
from collections import Counter

import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import quality
from topicloom.llm.common import Words

WORD = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, row string, v string, quality int"


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i:i + 8])] > 1 for k in range(8)}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    data = text.encode()
    z = len(zstandard.ZstdCompressor(level=3).compress(data)) / len(data) if data else 0.0
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), sum(v - 1 for v in lines.values()),
            len(hit), z, len(w) < 20 or 100 * len(hit) > 30 * len(w))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40).map(" ".join), max_size=6))
def test_repeat_words(texts):
    import pyarrow as pa
    w = Words(pa.array(texts, pa.string()))
    assert quality.repeat_words(w.codes, w.bounds).tolist() == [brute(t)[4] for t in texts]


def test_query_and_defined_cases(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghéß", k=rng.randint(2, 9))) for _ in range(400)]
    clean = " ".join(rng.choices(words, k=300))
    noise = "".join(chr(rng.randint(0x4E00, 0x9FFF)) + " " * (rng.random() < 0.2) for _ in range(4000))
    texts = [clean, clean, "", None, "spam and eggs\n" * 200, "a b\x85c\x1cd\xa0e\n\na b\x85c\x1cd\xa0e", noise, clean * 40,
             " \n\t", "x" * 300_000]
    df = spark.createDataFrame([(None if i == 1 else i, t, None, "x", 5) for i, t in enumerate(texts)], SCHEMA)
    rows = quality.judged(df).collect()
    assert len(rows) == len(texts) and rows[0].v == "x"
    by_text = {}
    for r in rows:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words,
                q.whole_ratio, q.base_failed) == brute(r.text)
        by_text[r.text] = q
    assert by_text[clean].kept and not by_text[noise].base_failed and by_text[noise].band_failed
    assert by_text["spam and eggs\n" * 200].band_failed
    assert not quality.kept(df.limit(0)).collect()
    assert {r.text for r in quality.kept(df).collect()} == {clean}
    assert quality.kept(df).columns == [c for c in df.columns]
