"""Count files of one JSON object, read by many tasks."""

import json
import os
import random

from topicloom.sources import readers as R


def test_equal_to_json_loads(spark, tmpdir_path):
    rng = random.Random(2)
    odd = ['a,b', ',', ',,,', 'say "hi", she', 'back\\', 'back\\,slash\\"', '{"x": 1}', '}', '{', 'é,ü', '日本,語', 'tab\t,', 'line\n,break', '', ' ',
           ': 3, "x', '":1', '\\",\\"', 'end, ', ', start', "{,}", '": 5, "']
    whole = {w: k for k, w in enumerate(odd)} | {"w%d" % k: rng.randint(-5, 10**12) for k in range(20_000)}
    items = list(whole.items())
    rng.shuffle(items)
    files = {"plain.json": json.dumps(dict(items)), "tight.json": json.dumps(dict(items), separators=(",", ":")),
             "real.json": json.dumps(dict(items), ensure_ascii=False) + "\n", "pretty.json": json.dumps(dict(items), indent=2),
             "empty.json": "{}", "one.json": '{"a, b": 7}', "blank.json": ""}
    for name, text in files.items():
        with open(os.path.join(tmpdir_path, name), "w", encoding="utf-8") as f:
            f.write(text)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        read = R.read_json_entries(spark, tmpdir_path)
        assert read.select("file").rdd.getNumPartitions() > 50
        got = {}
        for r in read.collect():
            own = got.setdefault(os.path.basename(r.file), {})
            assert r.key not in own
            own[r.key] = r.value
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    for name, text in files.items():
        assert got.get(name, {}) == json.loads(text or "{}"), name


def test_doubles_and_nan(spark, tmpdir_path):
    values = {"a": 1.5, "b,c": float("nan"), "d": float("inf"), "e": float("-inf"), "f": -2e-9}
    with open(os.path.join(tmpdir_path, "x.json"), "w") as f:
        f.write(json.dumps(values))
    got = {r.key: r.value for r in R.read_json_entries(spark, tmpdir_path, "double").collect()}
    assert got.pop("b,c") != values.pop("b,c") and got == values


def test_bigram_keys(spark, tmpdir_path):
    with open(os.path.join(tmpdir_path, "b.json"), "w") as f:
        f.write(json.dumps({"of the": 3, "a, b": 2}))
    assert {tuple(r) for r in R.read_bigram_json(spark, tmpdir_path).collect()} == {("of", "the", 3), ("a,", "b", 2)}
