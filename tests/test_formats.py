"""UUIDs, times of day and unbounded numbers: what is understood, how it is kept, what is refused; skipped tables as a setting."""

from __future__ import annotations

import pytest

from rowkeel.operators import conform
from rowkeel.operators.referential import delete_where
from rowkeel.sources.catalog import ACTIONS, CONSTRAINTS_QUERY, spark_kind
from rowkeel.sources.manifest import also_skipped, export_copy
from rowkeel.spec import SET_DEFAULT, Column, ForeignKey, Spec, Table

ID = "0a1b2c3d-4e5f-6071-8293-a4b5c6d7e8f9"


def fitted(spark, column, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [(r.v, r[conform.REASONS]) for r in conform.annotate(df, Table("t", (column,))).collect()]


def test_uuids(spark):
    good = [ID, ID.upper(), f"{{{ID}}}", ID.replace("-", ""), "0a1b-2c3d-4e5f-6071-8293-a4b5-c6d7-e8f9", "0a1b2c3d4e5f-60718293a4b5c6d7e8f9"]
    assert fitted(spark, Column("v", "string", format="uuid"), [*good, None]) == [(ID, [])] * len(good) + [(None, [])]
    bad = ["not-a-uuid", ID[:-1], ID + "0", f"{{{ID}", f"{ID}}}", ID.replace("0a1b", "0a1g"), "0a-1b2c3d4e5f60718293a4b5c6d7e8f9", "", f" {ID}"]
    assert fitted(spark, Column("v", "string", format="uuid"), bad) == [(None, ["format:v"])] * len(bad)


def test_times_of_day(spark):
    good = {"09:30": "09:30:00", "00:00:00": "00:00:00", "23:59:59.250000": "23:59:59.25", "10:00:00.000": "10:00:00", "10:10:10": "10:10:10", "24:00": "24:00:00", "24:00:00.0": "24:00:00"}
    assert fitted(spark, Column("v", "string", format="time"), list(good)) == [(v, []) for v in good.values()]
    bad = ["99:99", "24:00:01", "9:30", "12:60:00", "12:00:60", "12:00:00.1234567", "12:00:00+02", "noon", "", "24:00:00.1", "12:00."]
    assert fitted(spark, Column("v", "string", format="time"), bad) == [(None, ["format:v"])] * len(bad)
    zones = {"09:30+02": "09:30:00+02", "23:59:59.5-03:30": "23:59:59.5-03:30", "12:00:00Z": "12:00:00Z"}
    assert fitted(spark, Column("v", "string", format="time zone"), [*zones, "12:00:00+99", "12:00:00"]) == [*((v, []) for v in zones.values()), *[(None, ["format:v"])] * 2]


def test_unbounded_numbers(spark):
    exact = Column("v", "decimal(38,10)", exact=True)
    good = ["1", "-1.5", "1.1234567890", "0.10000000000000000000", "12345678901234567890.5", "25e-1", "1E3", None, "+7"]
    assert [r for _, r in fitted(spark, exact, good)] == [[]] * len(good)
    bad = ["1.1234567890123456", "-0.00000000001", "1e-11", "123.45678901234e0"]
    assert [r for _, r in fitted(spark, exact, bad)] == [["scale:v"]] * len(bad)
    assert [r for _, r in fitted(spark, exact, ["NaN", "x", "1" * 30])] == [["type:v"]] * 3
    # a declared scale is rounded to, as the database does
    assert [(str(v), r) for v, r in fitted(spark, Column("v", "decimal(18,2)"), ["1.239"])] == [("1.24", [])]
    typed = spark.sql("SELECT CAST('1.12345678901' AS decimal(20,11)) AS v UNION ALL SELECT CAST('1.50000000000' AS decimal(20,11))")
    assert sorted(r[conform.REASONS] for r in conform.annotate(typed, Table("t", (exact,))).collect()) == [[], ["scale:v"]]


def test_types_of_the_catalog():
    assert spark_kind("uuid") == ("string", {"format": "uuid"})
    assert spark_kind("time without time zone") == ("string", {"format": "time"})
    assert spark_kind("time(3) with time zone") == ("string", {"format": "time zone"})
    assert spark_kind("numeric") == ("decimal(38,10)", {"exact": True})
    assert spark_kind("numeric(18,4)") == ("decimal(18,4)", {})
    assert ACTIONS["d"] == SET_DEFAULT
    # columns that an index only includes are no part of its key
    assert "n <= x.indnkeyatts" in CONSTRAINTS_QUERY


def test_skipped_tables_are_a_setting(spark, tmp_path):
    frames = {f"{s}.t": spark.range(2) for s in ("app", "jobs", "pg_catalog", "track")}
    spark.conf.set("spark.rowkeel.alsoSkip", "jobs.*, none")
    try:
        assert also_skipped(spark) == ["jobs.*", "none"]
        made = export_copy(frames, f"{tmp_path}/dump", also_skip=["track.t"])
    finally:
        spark.conf.unset("spark.rowkeel.alsoSkip")
    # the database's own schemas stay out whatever is added
    assert [t.name for t in made.tables] == ["app.t"]
    assert also_skipped(spark) == []


@pytest.mark.parametrize(("default", "blocked"), [(9, False), (None, True)])
def test_set_default(spark, default, blocked):
    spec = Spec.of(
        [Table("p", (Column("id", "int"),), ("id",)), Table("c", (Column("id", "int"), Column("p_id", "int", nullable=False, default=default)), ("id",))],
        [ForeignKey("c", ("p_id",), "p", ("id",), SET_DEFAULT)],
    )
    frames = {"p": spark.createDataFrame([(1,), (2,), (9,)], "id int"), "c": spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "id int, p_id int")}
    done = delete_where(frames, "p", "id = 1", spec)
    assert done.blocked is blocked
    if not blocked:
        assert sorted(map(tuple, done.frames["c"].collect())) == [(1, 9), (2, 2), (3, 9)]
        assert ("c", "defaulted", 2) in {tuple(r) for r in done.report.collect()}
