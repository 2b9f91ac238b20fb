"""Digest trees: differences equal the full comparison, equal buckets are not read, damage is found."""

from __future__ import annotations

import glob
import random

import pytest
from pyspark.sql import functions as F

from rowkeel.operators import audit, digests, history


@pytest.fixture
def held(spark, tmp_path):
    return digests.DigestedTable(spark, f"{tmp_path}/held")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def base(spark, n=3000):
    return spark.range(n).selectExpr("id AS k", "CASE WHEN id % 7 = 0 THEN NULL ELSE concat('v', id % 50) END AS v", "id * 2 AS w")


def rows_read(df) -> int:
    """Rows that the scans of an executed plan gave out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if name == "FileSourceScanExec":
                total += node.metrics().apply("numOutputRows").value()
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("seed", range(1))
def test_differences_equal_the_full_comparison(spark, held, seed):
    rng = random.Random(seed)
    df = base(spark, 1200)
    held.write(df, ["k"], buckets=64, fanout=4)
    ids = rng.sample(range(1200), 60)
    changed = df.where(F.col("k").isin(ids[:25])).withColumn("v", F.lit("new"))
    added = spark.createDataFrame([(5000 + i, None, i) for i in range(5)], "k long, v string, w long")
    removed = df.where(F.col("k").isin(ids[20:40])).select("k")
    held.apply(changed.unionByName(added), removed)
    held.apply(None, spark.createDataFrame([(ids[50],), (99999,)], "k long"))
    want = df.where(~F.col("k").isin(ids[:40] + [ids[50]])).unionByName(changed).unionByName(added)
    assert rows(held.read()) == rows(want)
    assert rows(held.read(1)) == rows(df)
    for a, b in ((1, 3), (3, 2)):
        got = digests.diff_by_digest(held, held, a, b).select("k", "op", "changed")
        assert rows(got) == rows(history.diff_snapshots(held.read(a), held.read(b), ["k"]).select("k", "op", "changed"))
        assert rows(digests.reconcile_by_digest(held, held, a, b)) == rows(audit.reconcile(held.read(a), held.read(b)))
    assert digests.differing_buckets(held, held, 3, 3) == []
    assert held.damaged() == []


def test_equal_buckets_are_not_read(spark, held):
    df = base(spark)
    held.write(df, ["k"], buckets=256)
    held.apply(df.where("k IN (5, 6)").withColumn("w", F.lit(0).cast("long")))
    found = digests.differing_buckets(held, held, 1, 2)
    assert len(found) == 2
    diff = digests.diff_by_digest(held, held, 1, 2)
    assert {r.k for r in diff.collect()} == {5, 6}
    inside = df.where(digests._bucket(["k"], 256).isin(found)).count()
    assert rows_read(diff) == 2 * inside < 100
    # the change itself wrote those buckets only
    assert len(glob.glob(f"{held.root}/parts/*/_bucket=*")) == held.leaves(1).count() + 2
    same = digests.diff_by_digest(held, held, 2, 2)
    assert rows_read(same) == 0


def test_levels_add_up(spark, held):
    held.write(base(spark), ["k"], buckets=100, fanout=10)
    leaves = held.leaves()
    top = digests.level_of(leaves, 100).collect()
    assert [(r.node, r.rows) for r in top] == [(0, 3000)]
    assert {r.node for r in digests.level_of(leaves, 10).collect()} == set(range(10))


def test_repeated_rows_nulls_and_empty_tables(spark, held, tmp_path):
    odd = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n"), (None, None), (2, "b")], "k long, v string")
    held.write(odd, ["k"], buckets=8, fanout=2)
    other = digests.DigestedTable(spark, f"{tmp_path}/other")
    other.write(odd.distinct(), ["k"], buckets=8, fanout=2)
    # a repeated row counts: sums tell what exclusive-or alone would not
    assert len(digests.differing_buckets(held, other)) == 1
    assert rows(digests.reconcile_by_digest(held, other, distinct=False)) == [("MISSING", 1, "a", 1)]
    held.apply(spark.createDataFrame([(None, "x")], "k long, v string"))
    assert rows(held.read()) == sorted([(1, "a"), (1, "a"), (2, "b"), (None, "x")], key=str)
    none = digests.DigestedTable(spark, f"{tmp_path}/none")
    none.write(odd.limit(0), ["k"], buckets=8, fanout=2)
    assert none.read().count() == 0 and none.damaged() == []
    assert {r.op for r in digests.diff_by_digest(none, other).where("k IS NOT NULL").collect()} == {"INSERT"}
    assert rows(none.read(none.apply(odd).number)) == rows(odd)
    with pytest.raises(ValueError, match="different keys"):
        wide = digests.DigestedTable(spark, f"{tmp_path}/wide")
        wide.write(odd, ["k"], buckets=16)
        digests.differing_buckets(wide, other)
    with pytest.raises(FileExistsError):
        wide.write(odd, ["k"])
    with pytest.raises(RuntimeError, match="another writer"):
        held.apply(odd, base=1)


def test_damaged_buckets_are_named(spark, held):
    held.write(base(spark, 500), ["k"], buckets=16)
    assert held.damaged() == []
    part = held.leaves().first()["part"]
    folder = f"{held.root}/parts/{part}/_bucket=3"
    gone = spark.read.parquet(folder).limit(2)
    gone.cache().count()
    gone.write.mode("append").parquet(folder)
    gone.unpersist()
    assert held.damaged() == [3]
