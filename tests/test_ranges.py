"""Range audits against a plain sweep, on odd ranges and on one key with very many of them."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from rowkeel.operators import ranges
from rowkeel.sources.staging import stage

SCHEMA = "k string, f int, t int"
OPEN = 10**9


def plain(rows):
    """(key, kind, start, end, rows) by looking at the ranges one after another."""
    out = Counter()
    by_key = {}
    for k, f, t in rows:
        if k is None:
            continue
        if f is None or (t is not None and f >= t):
            out[(k, "empty", f, t)] += 1
        else:
            by_key.setdefault(k, Counter())[(f, OPEN if t is None else t)] += 1
    closed = lambda t: None if t == OPEN else t
    for k, found in by_key.items():
        reach = None
        for (f, t), n in sorted(found.items()):
            if reach is not None and f < reach:
                out[(k, "overlap", f, closed(min(t, reach)))] += n
            elif n > 1:
                out[(k, "overlap", f, closed(t))] += n - 1
            if reach is not None and reach < f:
                out[(k, "gap", reach, f)] += 0
            reach = t if reach is None else max(reach, t)
    return out


def plain_cover(rows):
    out = []
    by_key = {}
    for k, f, t in rows:
        if k is not None and f is not None and (t is None or f < t):
            by_key.setdefault(k, []).append((f, OPEN if t is None else t))
    for k, found in by_key.items():
        runs = []
        for f, t in sorted(found):
            if runs and f <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(runs[-1][1], t), runs[-1][2] + 1)
            else:
                runs.append((f, t, 1))
        out += [(k, f, None if t == OPEN else t, n) for f, t, n in runs]
    return sorted(out, key=str)


def found_rows(rows):
    out = Counter()
    for r in rows:
        out[(r.k, r.kind, r.starts_at, r.ends_at)] += r.ranges
    return out


def found(df):
    rows = df.collect()
    return rows, found_rows(rows)


ODD = [("a", 1, 5), ("a", 1, 5), ("a", 5, 7), ("a", 9, None), ("a", 12, 13), ("b", 3, 3), ("b", 4, 2), ("b", None, 3), ("b", None, None), (None, 1, 9), (None, 2, 3), ("c", 1, None), ("c", 1, None), ("d", 5, 6)]


def test_odd_ranges(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    rows, got = found(ranges.audit_ranges(df, ["k"], "f", "t"))
    assert dict(got) == dict(plain(ODD)) and len(rows) == len(plain(ODD))
    assert got[("a", "overlap", 12, 13)] == 1 and ("a", "gap", 7, 9) in got and got[("c", "overlap", 1, None)] == 1
    assert {r.kind for r in ranges.audit_ranges(df, ["k"], "f", "t", ("gap",)).collect()} == {"gap"}
    assert sorted(map(tuple, ranges.covered(df, ["k"], "f", "t").collect()), key=str) == plain_cover(ODD)
    assert ranges.audit_ranges(df.limit(0), ["k"], "f", "t").count() == 0
    assert ranges.covered(df.limit(0), ["k"], "f", "t").count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_random_ranges(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(1500):
        f = rng.choice([None, *range(0, 3000)]) if rng.random() < 0.02 else rng.randrange(3000)
        t = None if rng.random() < 0.01 * seed else (f or 0) + rng.randrange(-1, 8)
        # two thirds of all rows have one key, some of them one range
        rows.append((rng.choice(["hot", "hot", f"k{rng.randrange(40)}"]), *((700, 720) if rng.random() < 0.1 else (f, t))))
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert dict(found(ranges.audit_ranges(df, ["k"], "f", "t"))[1]) == dict(plain(rows))
    assert sorted(map(tuple, ranges.covered(df, ["k"], "f", "t").collect()), key=str) == plain_cover(rows)


def test_a_hot_key_is_split_by_time(spark, monkeypatch):
    dealt = []
    monkeypatch.setattr(ranges, "stage", lambda df, label: dealt.append(stage(df, label)) or dealt[-1])
    n = 40000
    # a third of all rows repeat one range; one range spans everything that follows
    df = spark.range(n).selectExpr("'hot' AS k", "CAST(CASE WHEN id % 3 = 0 THEN 50 ELSE id END AS int) AS f")
    df = df.selectExpr("k", "f", "CAST(CASE WHEN f = 10 THEN 1000000 ELSE f + 1 END AS int) AS t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranges.audit_ranges(df, ["k"], "f", "t", ("overlap",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in dealt[0].groupBy("_task").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 2 * sum(sizes) / len(sizes)
    own = [("hot", r.f, r.t) for r in df.collect()]
    assert dict(found_rows(out)) == {x: c for x, c in plain(own).items() if x[1] == "overlap"}
