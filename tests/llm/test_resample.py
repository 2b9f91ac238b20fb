"""The radix sort against a plain sort, the weights against plain counts, and the query on odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import compare
import numpy as np
import pytest
import tables

from rowkeel.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text: str) -> list[int]:
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return [zlib.crc32(r.encode()) % resample.BUCKETS for r in runs]


def test_buckets_are_those_of_whole_runs():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice("aZ9é日 ,\n") for _ in range(rng.randrange(60)))
        assert sorted(resample.feature_buckets(text.encode())[1].tolist()) == sorted(plain_features(text))


def test_gains_round_down():
    source, target = np.array([5, 0, 3, 0]), np.array([1, 2, 0, 0])
    want = [math.floor(1000 * math.log((t + 1) * 12 / ((s + 1) * 7))) for s, t in zip(source, target, strict=True)]
    assert resample.gains(source, target).tolist() == want
    assert min(want) < 0 < max(want)


@pytest.mark.parametrize(("block", "bits"), [(64, 3), (97, 7), (1 << 15, 13)])
def test_radix_sort_equals_a_plain_sort(spark, block, bits):
    rng = random.Random(block)
    # a third of all rows under one key, ties, negatives, nulls
    rows = [(rng.choice([7, rng.randrange(-5000, 5000)]), rng.choice([None, 3, 3, rng.randrange(-(10**6), 10**6)]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "a long, b long, i long").repartition(7)
    a, b = [r[0] for r in rows], [r[1] for r in rows if r[1] is not None]
    fields = [resample.descending("a", min(a), max(a)), resample.ascending("b", min(b), max(b)), resample.ascending("i", 0, 1499)]
    got = sorted(resample.radix_sorted(df, fields, block, bits).collect(), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(1500))
    want = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    assert [(r.a, r.b, r.i) for r in got] == want


def test_passes_are_stable(spark):
    df = resample.assign_ids(spark.range(5000).selectExpr("id % 3 AS a", "id"), "place", 0, ["id"])
    df = resample.stage(df.withColumn("block", resample.F.floor(resample.F.col("place") / 128).cast("long")))
    got = sorted(resample.counting_pass(df, resample.F.col("a").cast("int"), 128).collect(), key=lambda r: r.place)
    assert [r.id for r in got] == sorted(range(5000), key=lambda i: i % 3)
    assert max(Counter(r.block for r in got).values()) == 128


def test_ids_that_span_all_numbers(spark):
    ids = [-(2**63), 2**63 - 1, 0, None, -1, 5]
    rows = [(i, 30, 87, 1, 1) for i in ids] + [(1, 19, 3, 9, 9), (1, None, 3, 9, 9)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, n_features long, weight long, score long")
    got = {r.doc_id: r.rank for r in resample.ranked(scored, 100).collect() if r.n_words == 30}
    assert got == {-(2**63): 1, -1: 2, 0: 3, 5: 4, 2**63 - 1: 5, None: 6}
    assert [r.rank for r in resample.ranked(scored, 100).where("n_words IS NULL OR n_words < 20").collect()] == [None, None]


def test_counts_and_weights_of_whole_tables(spark):
    docs = spark.createDataFrame(tables.ROWS, "doc_id long, text string")
    items = spark.createDataFrame(tables.ITEMS, "item_id long, text string")
    s = Counter(b for _, t in tables.ROWS for b in plain_features(t or ""))
    assert {i: int(n) for i, n in enumerate(resample.bucket_counts(docs)) if n} == dict(s)
    got = resample.scored(docs, items).collect()
    t = Counter(b for _, x in tables.ITEMS for b in plain_features(x or ""))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    want = Counter((i, len(f), sum(gain[b] for b in f)) for i, x in tables.ROWS for f in [plain_features(x or "")])
    assert Counter((r.doc_id, r.n_features, r.weight) for r in got) == want


def test_drawn_rows_keep_all_columns(spark, tmp_path):
    folder = tables.write(str(tmp_path))
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    out = resample.resampled(docs, items, percent=50)
    assert out.columns == docs.columns
    ranks = resample.ranked(resample.scored(docs, items), 50).where("rank IS NOT NULL")
    ids = {r.doc_id for r in ranks.collect()}
    assert {r.doc_id for r in out.collect()} == ids


@pytest.mark.parametrize("documents", [tables.ROWS, []], ids=["odd", "empty"])
@pytest.mark.parametrize("items", [tables.ITEMS, []], ids=["odd", "empty"])
def test_query_on_odd_tables(spark, tmp_path, documents, items):
    folder = tables.write(str(tmp_path), documents, items)
    assert compare.differences(resample.op13_resample(spark, folder), tables.connect(folder), resample.ORACLE) is None
