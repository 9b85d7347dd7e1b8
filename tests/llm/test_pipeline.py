"""The pipeline against a brute-force version of its stages, and its registration."""

import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import test_decontaminate
import test_packing
import test_pii
import test_quality
import test_sketch

import __spark_entry__ as E
from topicloom.llm import pii, quality, sketch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rng = random.Random(11)
    voc = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    words = lambda n: rng.choices(voc, k=n)
    items = [" ".join(words(n)) for n in (20, 40)]
    texts = [" ".join(words(rng.randint(30, 200))) for _ in range(60)]
    texts += [test_sketch.edited(rng, texts[0].split(), 0.01) for _ in range(8)] + [texts[1]] * 5
    texts += [" ".join(words(30)) + " " + items[0] + " " + " ".join(words(30)), " ".join(words(9) + items[1].split()[:30])]
    texts += ["spam and eggs\n" * 90, "short", "", None, " ".join(words(2500))]
    for k in range(8):
        w = words(40)
        w[10:10] = ["Quuxley", "q@mail.example.org", "+1 555 010 99 99"]
        texts.append(" ".join(w))
    return [(k, t) for k, t in enumerate(texts)], items


def brute(rows, items):
    """Documents that reach packing, as {doc_id: text}."""
    good = [(d, t) for d, t in rows if not test_quality.brute(t)[6] and not band_failed(t)]
    comp = test_sketch.brute(good, sketch.Sketching())
    good = [(d, t) for d, t in good if comp[d] == d]
    good = [(d, t) for d, t in good if not any(test_decontaminate.brute(t, i) for i in items)]
    spans = test_pii.brute(good, pii.Disclosure())
    return {d: (t, spans[t]) for d, t in good}


def band_failed(text, b=quality.Bands()):
    import zstandard
    z = zstandard.ZstdCompressor(level=b.level)
    data = (text or "").encode()
    ratio = lambda x: len(z.compress(x)) / len(x) if x else 0.0
    full = [data[k:k + b.chunk_bytes] for k in range(0, len(data), b.chunk_bytes) if len(data) - k >= b.chunk_bytes]
    bad = [c for c in full if not b.chunk[0] <= ratio(c) <= b.chunk[1]]
    low, high = [x[1:] for x in b.whole if x[0] <= len(data)][-1]
    return not low <= ratio(data) <= high or len(bad) > b.bad_share * len(full)


def test_against_brute_force(spark, tables):
    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)
    where = tables(documents=docs, benchmark=spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string"))
    want = brute(rows, items)
    assert 55 < len(want) < 75 and any(s for _, s in want.values())
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, where)
        assert now.columns == docs.columns, name
    clean = {r.doc_id: (r.text, r.n_chars) for r in now.collect()}
    assert clean.keys() == want.keys()
    for d, (text, added) in want.items():
        spans = test_pii.plain_spans(text)
        if not spans and not added:
            assert clean[d] == (text, len(text))
        else:
            assert not pii.base_spans(clean[d][0]) and len(clean[d][0]) == clean[d][1]
            assert not added or "Quuxley" not in clean[d][0]
            # what lies outside all spans stays, in order
            outside = re.sub(r"\[[A-Za-z]+\]", " ", clean[d][0]).split()
            cover = sorted([(a, b) for _, a, b in spans] + added)
            left = "".join(" " if any(a <= k < b for a, b in cover) else c for k, c in enumerate(text)).split()
            assert outside == left
    pieces = corpus_pipeline.run(spark, where).collect()
    bins = defaultdict(list)
    for r in pieces:
        bins[r.sequence_id].append((r.offset, r.length))
    found = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces)
    expect = Counter()
    for d, (text, _) in clean.items():
        ids = [*test_packing.ids_of(text), 0]
        for k in range(0, len(ids), 2048):
            own = np.asarray(ids[k:k + 2048], "<u4")
            expect[d, k // 2048, k, len(own), zlib.crc32(own.tobytes())] += 1
    assert found == expect
    for own in bins.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_empty_tables(spark, tables):
    docs = spark.createDataFrame([], SCHEMA)
    where = tables(documents=docs, benchmark=spark.createDataFrame([], "item_id bigint, text string"))
    assert corpus_pipeline.run(spark, where).collect() == []


def test_registered():
    names = E.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if re.match(r"op\d", n)}
    assert "pipeline" in names and [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules"


def test_stages_with_clashing_columns_nulls_and_repeats(spark, tables):
    rows, items = corpus()
    rows = [(None if d % 9 == 8 else d, t) for d, t in rows] + rows[:3] * 2 + [(None, None), (3, None), (5000, "x" * 300_000)]
    extra = "row string, id int, maybe boolean, key string, terms string, clean string, quality int, kept boolean, gone int, _id int, _stays int"
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "r", k, None, "k", "t", "c", 1, True, 2, 3, 4) for k, (d, t) in enumerate(rows)],
                                 SCHEMA + ", " + extra)
    where = tables(documents=docs, benchmark=spark.createDataFrame([(0, items[0]), (1, None), (None, "")], "item_id bigint, text string"))
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, where)
        assert now.columns == docs.columns, name
    left = now.collect()
    assert left and all((r.row, r.key, r.terms, r.clean, r.quality, r.gone, r._id) == ("r", "k", "t", "c", 1, 2, 3) for r in left)
    numbers = [r.doc_id for r in left if r.doc_id is not None]
    assert len(numbers) == len(set(numbers)) and any(r.doc_id is None for r in left)
    # what the stages keep is what they were given, but for spans
    given = {k: t for k, (_, t) in enumerate(rows)}
    assert all(r.text == given[r.id] or "[" in r.text for r in left)
    packed = corpus_pipeline.run(spark, where)
    assert packed.select("doc_id").exceptAll(now.select("doc_id")).count() >= 0 and packed.count() >= len(left)
