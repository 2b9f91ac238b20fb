"""JSON texts compared as values: spelling, order and escapes do not matter, values do."""

from __future__ import annotations

import json
import random
from decimal import Decimal

from pyspark.sql import functions as F

from rowkeel.functions.rows import canonical_json
from rowkeel.operators import history


def canonical(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.c for r in df.select("i", canonical_json("t").alias("c")).orderBy("i").collect()]


def test_spellings_of_one_value(spark):
    same = [
        ['{"a":1,"b":[1,2]}', ' {"b" : [1, 2.0],\n"a":1.00}', '{"b":[10e-1,0.2e1],"a":100E-2}'],
        ["1e400", "10e399", "1" + "0" * 400],
        ["0", "-0", "0.000", "0e7", "-0.0e-3"],
        ["12345678901234567890123456789012345678901234567890.5", "123456789012345678901234567890123456789012345678905e-1"],
        ['"A\\u00e9\\n"', '"\\u0041é\\u000a"'],
        ["null", " null "],
        ["{}", "{ }"],
        ['{"z":{"y":1,"x":[{"b":1,"a":2}]}}', '{"z":{"x":[{"a":2,"b":1}],"y":1}}'],
    ]
    got = canonical(spark, [t for group in same for t in group])
    at = 0
    for group in same:
        assert len(set(got[at : at + len(group)])) == 1, group
        at += len(group)
    assert len(set(got)) == len(same)


def test_different_values_stay_apart(spark):
    texts = ["1", '"1"', '"n1e0"', '"s1"', "true", '"true"', "[1,2]", "[2,1]", "[]", "{}", '{"a":1}', '{"a":"1"}', '{"A":1}', "1e-400", "0", "not json", '{"a":1', "", '{"a":1,"a":2}', "-1", "1.0000000000000000000000000000000000000000001"]
    got = canonical(spark, texts)
    assert len(set(got)) == len(texts) and None not in got
    assert canonical(spark, [None]) == [None]


def test_random_values(spark):
    rng = random.Random(4)

    def value(depth=0):
        kind = rng.randrange(7 if depth < 3 else 5)
        if kind < 2:
            return Decimal(rng.randrange(-500, 500)).scaleb(rng.randrange(-3, 4))
        if kind < 5:
            return rng.choice([None, True, False, 'te"xt\\', "é😀", "12", "", " a:1,{}[]"])
        return [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else {rng.choice("abcdé") + str(i): value(depth + 1) for i in range(rng.randrange(4))}

    def spelled(v):
        blank = lambda: rng.choice(["", " ", "\n", "\t "])
        if isinstance(v, Decimal):
            out = rng.choice([f"{v:f}", f"{v:E}", f"{v:f}" + (".00" if "." not in f"{v:f}" else "0")])
        elif isinstance(v, list):
            out = "[" + ",".join(map(spelled, v)) + blank() + "]"
        elif isinstance(v, dict):
            items = list(v.items())
            rng.shuffle(items)
            out = "{" + ",".join(json.dumps(k, ensure_ascii=rng.random() < 0.5) + blank() + ":" + spelled(x) for k, x in items) + "}"
        else:
            out = json.dumps(v, ensure_ascii=rng.random() < 0.5)
        return blank() + out + blank()

    values = [value() for _ in range(150)]
    first, second = canonical(spark, [spelled(v) for v in values]), canonical(spark, [spelled(v) for v in values])
    assert first == second
    key = lambda v: json.dumps(v, sort_keys=True, default=lambda d: f"number {d.normalize() + 0}")
    for i, a in enumerate(values):
        for j in range(i):
            assert (first[i] == first[j]) == (key(a) == key(values[j]))


def test_long_texts(spark):
    text = json.dumps({"t": 'a"b\\' * 20000, "l": list(range(3000))})
    assert len(set(canonical(spark, [text, text.replace(", ", ",")]))) == 1


def test_diffs_and_hashes(spark):
    schema = "id int, p string, q string"
    before = spark.createDataFrame([(1, '{"a":1,"b":2}', "x"), (2, "[1]", "x"), (3, None, "x"), (4, "bad", "x")], schema)
    after = spark.createDataFrame([(1, '{"b":2.0, "a":1}', "x"), (2, "[1, 1]", "x"), (3, "null", "y"), (4, "bad", "x")], schema)
    got = history.diff_snapshots(before, after, ["id"], json=["p"], carry=["p"])
    assert {r.id: (r.op, r.changed, r.new.p) for r in got.collect()} == {2: ("UPDATE", ["p"], "[1, 1]"), 3: ("UPDATE", ["p", "q"], "null")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "sha2" in plan
    assert history.diff_snapshots(before, after, ["id"], ["p"]).where(F.col("id") == 1).count() == 1
