"""A key held by a third of all rows must not end up in one task."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from rowkeel.operators import audit, change, history
from rowkeel.operators.referential import delete_where
from rowkeel.spec import CASCADE, SET_NULL, Column, ForeignKey, Spec, Table

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
}


@pytest.fixture
def small_thresholds(spark):
    """Thresholds of adaptive execution scaled down to the size of the test."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def frames(spark):
    key = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000)
    child = spark.range(0, 200_000, numPartitions=16).select("id", key.alias("pid"), F.md5(F.col("id").cast("string")).alias("note"))
    return {"s.child": child, "s.parent": spark.range(6000).select("id")}


SPEC = Spec.of(
    [
        Table("s.child", (Column("id", "bigint"), Column("pid", "bigint"), Column("note", "string"))),
        Table("s.parent", (Column("id", "bigint"),), ("id",)),
    ],
    [ForeignKey("s.child", ("pid",), "s.parent", ("id",), CASCADE)],
)


def test_hot_orphans_are_split(spark, frames, small_thresholds):
    lost = audit.orphans(frames["s.child"], frames["s.parent"].where("id <> 7"), ["pid"], ["id"])
    plan = final_plan(lost)
    assert "skew=true" in plan
    assert lost.count() == frames["s.child"].where("pid = 7").count()


def test_hot_parents_of_a_delete_are_split(spark, frames, small_thresholds):
    left = delete_where(frames, "s.parent", "id % 2 = 0", SPEC).frames["s.child"]
    assert "skew=true" in final_plan(left)
    assert left.count() == frames["s.child"].where("pid % 2 = 1").count()


@pytest.mark.parametrize("hot", [7, None])
def test_hot_keys_of_a_set_null_are_split(spark, frames, small_thresholds, hot):
    """A third of the rows under one key, then a third of them NULL; in the rows and in the report."""
    to_null = Spec.of(SPEC.tables.values(), [replace(SPEC.foreign_keys[0], on_delete=SET_NULL)])
    key = F.when(F.col("pid") == 7, F.lit(hot).cast("bigint")).otherwise(F.col("pid"))
    child = frames["s.child"].withColumn("pid", key)
    done = delete_where({**frames, "s.child": child}, "s.parent", "id % 2 = 1", to_null)
    for df in (done.frames["s.child"], done.report):
        assert "skew=true" in final_plan(df)
    assert done.frames["s.child"].where("pid % 2 = 0").count() == child.where("pid % 2 = 0").count()
    assert done.frames["s.child"].where("pid is null").count() == child.where("pid is null or pid % 2 = 1").count()
    counts = {r.action: r.rows for r in done.report.where("table_name = 's.child'").collect()}
    assert counts == {"nulled": child.where("pid % 2 = 1").count()}


def test_plans_do_not_grow_with_the_rounds_of_a_delete(spark):
    chain = Spec.of(
        [Table("s.link", (Column("id", "bigint"), Column("up", "bigint")), ("id",))],
        [ForeignKey("s.link", ("up",), "s.link", ("id",), CASCADE)],
    )
    links = spark.range(1, 21).select("id", F.when(F.col("id") > 1, F.col("id") - 1).alias("up"))
    done = delete_where({"s.link": links}, "s.link", "id = 8", chain)
    assert sorted(r.id for r in done.frames["s.link"].collect()) == list(range(1, 8))
    assert done.frames["s.link"]._jdf.queryExecution().analyzed().collectLeaves().size() <= 4


def test_hot_keys_of_a_backfill_are_split(spark, frames, small_thresholds):
    target = frames["s.child"].withColumn("owner", F.lit(None).cast("bigint"))
    out = change.backfill(target, frames["s.parent"].withColumn("v", F.col("id") * 2), {"pid": "id"}, {"owner": "v"})
    assert "skew=true" in final_plan(out)
    assert out.where("owner = pid * 2").count() == 200_000


def test_hot_parents_of_a_scrub_are_split(spark, frames, small_thresholds):
    left = change.scrub_family(frames, "s.parent", "id % 2 = 0", SPEC.foreign_keys)["s.child"]
    assert "skew=true" in final_plan(left)


def test_hot_times_are_spread_over_slots(spark):
    facts = spark.range(30_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") * 100).alias("ts"))
    dim = spark.range(3000).select(F.lit(7).cast("bigint").alias("k"), (F.col("id") * 1000).alias("vf"), (F.col("id") * 1000 + 700).alias("vt"))
    found = history.resolve_asof(facts, dim, ["k"], "ts", "vf", "vt", hot_rows=1000)
    assert found.count() == facts.where("k = 7 and ts % 1000 < 700").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the time slot is part of the join key, so the hot key spreads over partitions
    assert "_slot" in plan.split("hashpartitioning(")[1].split(")")[0]


def test_hot_values_collapse_before_the_audit_shuffles(spark, frames):
    broken = {**frames, "s.parent": frames["s.parent"].where("id <> 7")}
    report = audit.audit_fks(broken, SPEC)
    assert [r.orphan_rows for r in report.collect()] == [frames["s.child"].where("pid = 7").count()]
    plan = report._jdf.queryExecution().executedPlan().toString()
    # the value is aggregated in each task before the exchange
    assert "partial_count" in plan.split("Exchange")[-1]
