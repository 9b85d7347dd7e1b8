"""Operator 8: patterns against the plain regular expressions, disclosure against its definition."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import pii

SCHEMA = "doc_id bigint, text string, key string, near int, clean string, n_chars bigint"
PLAIN = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "[0-9]([\x20-]?[0-9])+", "\\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    out = []
    for kind, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and sum(
                    sum(map(int, str(int(c) * (1 + k % 2)))) for k, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", ".", "x", "_-", "1", "25", "256", "1.2.3.4", "4111 1111 1111 1111", "-", " ",
                                 "+1 (555) 010-9999", "+", "é", "\n", "4", "00", "d.e", "b@", "٣"]), max_size=25).map("".join))
def test_base_spans(text):
    assert [s[:3] for s in pii.base_spans(text)] == plain_spans(text)


def brute(rows, d):
    """Spans that the method adds per text, from the definition."""
    texts = [t or "" for _, t in rows]
    near, having, entity, different = Counter(), Counter(), Counter(), defaultdict(set)
    for t in texts:
        having.update({pii.term_of(w) for w in re.findall("[^\x20\x09-\x0D]+", t)})
        found = {(e, term) for e, term, _, _ in pii.near_terms(t, pii.base_spans(t), d.reach)}
        near.update(found)
        entity.update({e for e, _ in found})
        for pair in found:
            different[pair].add(t)
    n = len(texts)
    score = {}
    for (e, term), seen in near.items():
        ic = math.log(n / entity[e])
        if len(different[e, term]) >= d.support and ic > 0:
            v = math.log(n * seen / having[term] / entity[e]) / ic
            if v >= d.generalise_at:
                score[e, term] = v
    return {t: sorted({(a, b) for e, term, a, b in pii.near_terms(t, pii.base_spans(t), d.reach) if (e, term) in score})
            for t in set(texts)}


def test_corpus(spark):
    rng = random.Random(2)
    voc = ["word%s" % "".join(rng.choices("abcdef", k=3)) for _ in range(60)]
    texts = ["", None, "no data at all here", "x " * 20_000 + "a@b.co", "1.2.3.4 9.9.9.9"]
    for k in range(80):
        w = rng.choices(voc, k=40)
        if k % 4 == 0:
            w[20:20] = ["(Zorblatt),", "jo@mail.example.org", "the", "Head"]
        if k % 7 == 0:
            w[30:30] = ["+1 555 010 9999", "halfway" if k % 3 else "words"]
        if k % 5 == 0:
            w += ["halfway", "zorblatt"] if k == 25 else ["halfway"]
        texts.append(" ".join(w))
    texts += [texts[5]] * 30
    rows = [(None if k % 10 == 9 else k // 2, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(d, t, "k", 1, "c", len(t or "")) for d, t in rows], SCHEMA)
    for d in (pii.Disclosure(), pii.Disclosure(reach=3, support=2, generalise_at=0.5, filter_bits=8)):
        want = brute(rows, d)
        assert any(want.values())
        got = pii.spans(df, d=d).collect()
        keys = {hashlib.md5((t or "").encode()).hexdigest(): t or "" for t in texts}
        assert sorted((r.doc_id or -1, keys[r.key]) for r in got) == sorted((d or -1, t or "") for d, t in rows)
        for r in got:
            t = keys[r.key]
            assert [(s.kind, s.start, s.end) for s in r.base] == plain_spans(t)
            assert [(s.start, s.end) for s in r.terms or ()] == want[t]
    clean = pii.sanitised(df, length_col="n_chars")
    assert clean.columns == df.columns
    out = clean.collect()
    assert len(out) == len(rows) and {None, ""} <= {r.text for r in out}
    for r in out:
        assert not pii.base_spans(r.text or "") and len(r.text or "") == (r.n_chars or 0)
        assert "zorblatt" not in (r.text or "").lower().replace("words halfway zorblatt", "") or "[EMAIL]" not in r.text


def test_digest_and_empty_table(spark):
    from topicloom.llm.queries import F

    df = spark.createDataFrame([(1, "a@b.c 1.2.3.4", "k", 1, "c", 1), (2, None, "k", 1, "c", 1)], SCHEMA)
    rows = pii.spans(df).select("doc_id", pii.spelled(F.col("base")).alias("s"), F.sha2(pii.spelled(F.col("base")), 256).alias("h")).collect()
    assert {r.doc_id: r.s for r in rows} == {1: "email:0:5,ip:6:13", 2: ""}
    assert all(r.h == hashlib.sha256(r.s.encode()).hexdigest() for r in rows)
    assert pii.spans(df.limit(0)).collect() == [] and pii.sanitised(df.limit(0)).collect() == []


def test_rare_entities(spark, tables):
    from topicloom.llm.queries import QUERIES

    rng = random.Random(5)
    voc = ["word%s" % "".join(rng.choices("abcdef", k=2)) for _ in range(36)]
    texts = [" ".join(rng.choices(voc, k=30)) for _ in range(500)]
    texts[3] += " ask Zorblatt at zo@one.example today"
    texts[5] += " ask Quimby at qu@two.example"
    texts[7] += " Quimby is qu@two.example today"
    texts.append(texts[3])
    for k in range(10, 20):
        texts[k] += f" Wexcorp u{k}@wex.example"
    where = tables(documents=spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"))
    found = defaultdict(set)
    for r in QUERIES["op8_disclosure_sanitiser"](spark, where).collect():
        found[r.doc_id] = {texts[r.doc_id][int(a):int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind == "term"}
    assert all("Zorblatt" in found[k] for k in (3, 500)) and all("Quimby" in found[k] for k in (5, 7))
    assert all("Wexcorp" in found[k] for k in range(10, 20))
    # words of many documents tell nothing
    assert not any(w.startswith("word") for f in found.values() for w in f)


def test_terms_far_from_the_value_and_without_it(spark, tables):
    from topicloom.llm.queries import QUERIES

    rng = random.Random(6)
    voc = ["word%s" % "".join(rng.choices("abcdef", k=2)) for _ in range(36)]
    texts = [" ".join(rng.choices(voc, k=40)) for _ in range(300)]
    for k in range(5):
        texts[k] = f"Zorblatt Wu jo@mail.example {texts[k]} (Zorblatt) and Wu"
    texts[9] += " zorblatt"
    where = tables(documents=spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"))
    found = {r.doc_id: [texts[r.doc_id][int(a):int(b)] for kind, a, b in (s.split(":") for s in r.spans.split(",") if s) if kind == "term"]
             for r in QUERIES["op8_disclosure_sanitiser"](spark, where).collect()}
    assert all(found[k][:2] == ["Zorblatt", "Wu"] and {"(Zorblatt)", "Wu"} <= set(found[k][2:]) for k in range(5))
    assert found[9] == ["zorblatt"] and not any(found[k] for k in range(10, 300))


def test_rare_words_beside_a_value_by_chance(spark):
    """Invented words of one document each surround values of one document each: only what is written as a name tells."""
    rng = random.Random(8)
    new = lambda: "".join(rng.choices("abcdefghijklmnop", k=9))
    texts = [" ".join(new() for _ in range(40)) for _ in range(400)]
    for k in range(0, 400, 4):
        w = texts[k].split()
        w[20:20] = [f"p{k}@host{k}.example"]
        w[12] = w[12].title() if k % 8 else w[12] + ". " + new().title()  # a name, or a sentence's first word
        texts[k] = " ".join(w)
    df = spark.createDataFrame([(k, t, "k", 1, "c", 1) for k, t in enumerate(texts)], SCHEMA)
    for r in pii.spans(df).collect():
        found = [texts[r.doc_id][s.start:s.end] for s in r.terms or ()]
        assert found == ([texts[r.doc_id].split()[12]] if r.doc_id % 4 == 0 and r.doc_id % 8 else [])
    # the same words in three texts are evidence, and in three copies of one text are not
    pair = "called Smallname abcword near v@one.example".lower()
    three = [f"{new()} {pair} {new()}" for _ in range(3)] + [f"{new()} xyzword near w@two.example"] * 3
    df = spark.createDataFrame([(k, t, "k", 1, "c", 1) for k, t in enumerate(three + texts[1::4])], SCHEMA)
    told = {r.doc_id: {three[r.doc_id][s.start:s.end] for s in r.terms or ()} for r in pii.spans(df).collect() if r.doc_id < 6}
    assert all({"smallname", "abcword"} <= told[k] for k in range(3)) and not any(told[k] for k in range(3, 6))


def test_names():
    text = "Ask Quimby or (Zorblatt), said Mrs. Hale.\nNext THE end a@b.co Old."
    spans = pii.base_spans(text)
    starts = pii.names_at(text, spans)
    assert {text[a:].split()[0] for a in starts} == {"Quimby", "(Zorblatt),", "Mrs.", "Old."}


def test_counts_by_kind(spark, tables):
    """A count is of the spans of one kind, whatever their places in the row's list."""
    from topicloom.llm.queries import QUERIES

    card, phone = "4111 1111 1111 1111", "+1 (555) 010-9999"
    texts = ["", None, f"{card} a", f"a@b.c {card} d@e.f 1.2.3.4 {phone} g@h.i", f"{phone} x {phone}", "1.2.3.4 5.6.7.8 9.9.9.9"]
    where = tables(documents=spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string"))
    for r in QUERIES["op8_disclosure_sanitiser"](spark, where).collect():
        plain = plain_spans(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in plain) for k in range(4)]
        told = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in plain)
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
