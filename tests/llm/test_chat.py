"""Operator 5: read back exactly, the machine against a plain walk, the query against its SQL."""

import random

import duckdb
import pytest

from pyspark.sql import functions as F

from topicloom.llm import chat, queries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, segments int, block string"


def walk(roles, t):
    state = t.start
    for r in roles:
        state = dict(((a, b), c) for a, b, c in t.moves).get((state, r), "error")
    return state


def test_round_trip(spark):
    rng = random.Random(6)
    t = chat.Template()
    bits = [*t.controls, chat.ESCAPE, chat.ESCAPE + "A", "0", "<", "[", "]", "/", ">", "s", "SYS>>", "é", "\n", " ", "OUT", "$1", "\\E"]
    rows = []
    for c in range(60):
        for n in range(rng.choice([1, 2, 3, 4, 9, 300 if c == 7 else 5])):
            role = rng.choice(["user", "assistant"]) if c % 5 else ["user", "assistant"][n % 2]
            if c % 11 == 3:
                role = rng.choice([None, "", "tool", "[ROLE]x", "system"])
            rows.append((None if c == 59 else c, n if c != 20 else None, role, "".join(rng.choices(bits, k=rng.randint(0, 9))) or None))
    rows += [rows[0], rows[0], (1000, 0, "assistant", "y" * 400_000), (1000, 1, "user", "")]
    df = spark.createDataFrame([(*r, 1, "b") for r in rows], SCHEMA)
    want = {}
    for c, n, r, x in sorted(rows, key=lambda r: (r[0] or -1, -1 if r[1] is None else r[1], (r[2] or "").encode(), (r[3] or "").encode())):
        want.setdefault(c, []).append((r or "", x or ""))
    out = chat.formatted(df, block=16)
    got = out.select("*", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        assert [tuple(x) for x in r.turns] == turns
        assert r.loss == "".join(x for role, x in turns if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted
        state = walk([role for role, _ in turns], t)
        assert (r.valid, r.complete) == (state != "error", state == "answered")
    assert chat.formatted(df.limit(0)).collect() == []


def test_templates_that_could_be_misread_are_refused():
    for pair in (("<a>", ">b"), ("[x]", "[x]y"), ("", "b")):
        with pytest.raises(ValueError):
            chat.Template(roles=(chat.Role("user", *pair),))


def test_query_against_sql(spark, tables):
    df = spark.createDataFrame([(1, 0, "user", "a[INST]␛ü", 1, "b"), (1, 1, "assistant", None, 1, "b"), (2, 0, None, "x", 1, "b"),
                                (2, 3, "tool", "</s>", 1, "b"), (3, 0, "system", "s", 1, "b")], SCHEMA)
    where = tables(conversations=df)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{where}/conversations.parquet/*.parquet')")
    res = con.execute(queries.ORACLE["op5_chat_machine"])
    columns = [d[0] for d in res.description]
    want = sorted(dict(zip(columns, r)).items().__repr__() for r in res.fetchall())
    got = queries.QUERIES["op5_chat_machine"](spark, where).select(*columns).collect()
    assert sorted(r.asDict().items().__repr__() for r in got) == want
