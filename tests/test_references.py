"""Polymorphic keys beside foreign keys: odd types, key kinds, many types, one scan, skew."""

from __future__ import annotations

import re

import pytest

from rowkeel.operators import audit
from rowkeel.spec import Column, ForeignKey, PolymorphicKey, Spec, Table

AREA, CODE, NOTE = "a.area", "a.code", "a.note"


def spec_of(parents, **more):
    tables = [
        Table(AREA, (Column("id", "int"),)),
        Table(CODE, (Column("code", "string"),)),
        Table(NOTE, (Column("kind", "string"), Column("ref", "bigint"), Column("area", "int"))),
    ]
    return Spec.of(tables, more.get("fks", [ForeignKey(NOTE, ("area",), AREA, ("id",), name="note_area")]), [PolymorphicKey(NOTE, "kind", "ref", parents, "note_ref")])


@pytest.fixture
def frames(spark):
    notes = [("area", 1, 1), ("area", 9, 9), ("area", None, None), (None, 9, 1), ("code", 7, 1), ("code", 8, 1), ("AREA", 1, 1), ("", 3, 1), ("", None, 1), ("lost", 1, 2), ("lost", 2, 2)]
    return {
        AREA: spark.createDataFrame([(1,), (2,), (None,)], "id int"),
        CODE: spark.createDataFrame([("7",), ("x",)], "code string"),
        NOTE: spark.createDataFrame(notes, "kind string, ref bigint, area int"),
    }


BOTH = (("area", AREA, "id"), ("code", CODE, "code"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_every_type_goes_to_its_parent(frames):
    got = rows(audit.audit_references(frames, spec_of(BOTH)))
    assert got == sorted(
        [
            ("note_area", NOTE, "area", AREA, None, 1),
            ("note_ref", NOTE, "kind,ref", AREA, "area", 1),
            ("note_ref", NOTE, "kind,ref", CODE, "code", 1),
            ("note_ref", NOTE, "kind,ref", None, "AREA", 1),
            ("note_ref", NOTE, "kind,ref", None, "", 1),
            ("note_ref", NOTE, "kind,ref", None, "lost", 2),
        ],
        key=str,
    )
    # foreign keys alone give what they gave before
    assert rows(audit.audit_fks(frames, spec_of(BOTH))) == [(NOTE, "area", AREA, 1)]
    assert rows(audit.audit_references(frames, spec_of(BOTH), [AREA])) == []


def test_two_types_of_one_parent_and_missing_parents(frames):
    parents = (("area", AREA, "id"), ("lost", AREA, "id"), ("code", CODE, "code"))
    got = rows(audit.audit_references({k: v for k, v in frames.items() if k != CODE}, spec_of(parents, fks=[])))
    # a known type whose table is absent is neither checked nor unknown
    assert {(r[3], r[4], r[5]) for r in got} == {(AREA, "area", 1), (None, "AREA", 1), (None, "", 1)}
    empty = {k: v.limit(0) for k, v in frames.items()}
    assert rows(audit.audit_references(empty, spec_of(BOTH))) == []
    assert rows(audit.audit_references({**empty, NOTE: frames[NOTE]}, spec_of((("area", AREA, "id"),), fks=[])))[-1][3:] == (None, "lost", 2)


def test_twenty_types_cost_one_row_each(spark):
    names = [f"t.p{i}" for i in range(20)]
    tables = [Table(n, (Column("id", "bigint"),)) for n in names]
    spec = Spec.of([*tables, Table("t.c", (Column("kind", "string"), Column("ref", "bigint")))], [], [PolymorphicKey("t.c", "kind", "ref", tuple((n[2:], n, "id") for n in names))])
    frames = {n: spark.range(i, 100) for i, n in enumerate(names)}
    # a third of all rows share one reference
    child = spark.range(30000).selectExpr("concat('p', id % 20) AS kind", "CASE WHEN id % 3 = 0 THEN -1 ELSE id % 100 END AS ref")
    frames["t.c"] = child
    df = audit.audit_references(frames, spec)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan
    got = {r.parent_type: r.orphan_rows for r in df.collect()}
    want = {f"p{i}": child.where(f"kind = 'p{i}' AND (ref < {i} OR ref >= 100)").count() for i in range(20)}
    assert got == want


def test_each_table_is_scanned_once(spark, tmp_path, frames):
    for n, df in frames.items():
        df.write.parquet(f"{tmp_path}/{n}")
    read = {n: spark.read.parquet(f"{tmp_path}/{n}") for n in frames}
    parents = (("area", AREA, "id"), ("lost", AREA, "id"))
    plan = audit.audit_references(read, spec_of(parents))._jdf.queryExecution().executedPlan().toString()
    # paths are cut in a plan, columns are not
    scans = sorted(re.sub(r"#\d+L?", "", c) for c in re.findall(r"FileScan parquet \[([^\]]*)\]", plan))
    assert scans == ["id", "kind,ref,area"]


def test_contradictions_are_refused():
    with pytest.raises(ValueError, match="two parents"):
        spec_of((("area", AREA, "id"), ("area", CODE, "code")))
    with pytest.raises(ValueError, match="unknown table"):
        spec_of((("area", "a.none", "id"),))
