"""Operator 2: exact round trips, damaged archives, the choice of the response."""

import gzip
import hashlib
import random
import tempfile
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import warc

SCHEMA = "page_id bigint, url string, html string, record_id string, digest int"


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunked_framing(payload, size):
    assert warc.unchunked(warc.chunked(payload, size)) == payload


def test_broken_framing():
    for body in (b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"zz\r\n", b""):
        with pytest.raises(ValueError):
            warc.unchunked(body)
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"


def test_archive_of_many_gzip_members():
    a, b = warc.record({"WARC-Type": "response"}, b"x\r\n\r\nWARC/1.1\r\n"), warc.record({"WARC-Type": "revisit"}, b"")
    data = gzip.compress(a + warc.END) + gzip.compress(b + warc.END)
    assert [(h["warc-type"], block) for h, block in warc.parsed(data)] == [("response", b"x\r\n\r\nWARC/1.1\r\n"), ("revisit", b"")]


def make(spark, rows):
    return spark.createDataFrame([(p, u, h, "r", 1) for p, u, h in rows], SCHEMA)


def test_round_trip(spark):
    rng = random.Random(3)
    big = "".join(rng.choice("abc é\r\n") for _ in range(90_000))
    twin = "<p>" + "twin " * 400
    tricky = "WARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n" * 60
    rows = [(1, "http://a/1", "<p>one"), (2, "http://a/2", None), (3, None, ""), (4, "http://a/\r\n4", tricky), (5, "u", big),
            (6, "u", big), (7, "é://x%0Ay", "ünïcode \x00 text"), (None, "n", "nobody"), (8, "short", "<p>one")]
    rows += [(20 + k, f"t{k}", twin) for k in range(30)] + [(None, "t", twin), (49, "t29", twin), (49, "t0", twin)]
    rows += [(5, "u", big)] * 2 + [(1, "http://a/1", "<p>one")]
    got = warc.round_trip(make(spark, rows), segment_bytes=700, chunk_bytes=333, records_per_file=9).collect()
    want = Counter()
    largest = {}
    for p, _, h in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if p is None else p)
    for p, u, h in rows:
        data = (h or "").encode()
        top = largest[h or ""]
        again = len(data) >= 1000 and (p != top or (p == 49 and u != "t29"))
        want[p, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert {r.status for r in got} == {"ok"} and max(r.segments for r in got) > 100
    assert {r.url for r in got if r.page_id == 7} == {"é://x%0Ay"}
    assert warc.round_trip(make(spark, [])).collect() == []


def test_damage_is_reported(spark):
    page = ["x" * 3000, "y" * 3000, "z" * 3000, "w" * 3000, "v" * 10]
    made = {k: warc.records(k, "u", h.encode(), hashlib.sha1(h.encode()).hexdigest(), f"id{k}", None, 1000, 500, "d")
            for k, h in enumerate(page)}
    assert len(made[0]) == 4
    parts = made[0][:2] + made[0][3:]  # a segment is missing
    parts += made[1][:-1]  # the last one is
    parts += [r.replace(b"zzz", b"zzq", 1) for r in made[2]]  # the payload differs from its digest
    parts += [made[3][0].replace(b"1f4\r\n", b"1f5\r\n", 1), *made[3][1:]]  # a chunk has another length
    parts += made[4] + warc.records(9, "u", b"", "d", "id9", "nowhere", 1000, 500, "d")
    random.Random(1).shuffle(parts)
    folder = tempfile.mkdtemp()
    with open(f"{folder}/part-0.warc", "wb") as f:
        f.write(b"".join(p + warc.END for p in parts))
    got = {r.page_id: r.status for r in warc.read_pages(spark, folder).collect()}
    assert got == {0: "incomplete", 1: "incomplete", 2: "digest", 3: "framing", 4: "ok", 9: "missing"}


def test_archives_are_parsed_once_and_blocks_dealt_once(spark):
    rows = [(k, f"u{k}", "<p>%d " % k * 900) for k in range(6)] + [(9, "v", "<p>0 " * 900)]
    pages = warc.round_trip(make(spark, rows), segment_bytes=700, chunk_bytes=333)
    assert {r.page_id: (r.record_type, r.status) for r in pages.collect()} == {k: ("revisit" if k == 0 else "response", "ok") for k in (*range(6), 9)}
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Scan binaryFile" not in plan(pages)
    records = spark.createDataFrame([], warc.SCHEMA)
    assert plan(warc.reassembled(records)).count("Exchange ") == 1
