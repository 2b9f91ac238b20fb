from __future__ import annotations

from decimal import Decimal

import pytest

from rowkeel.functions import rows as fn
from rowkeel.operators import audit, conform
from rowkeel.plans.check import audit_all
from rowkeel.spec import Check, Column, ForeignKey, Spec, Table, Unique


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def table(name, schema, key=(), **more):
    return Table(name, tuple(Column(*c.split(" ")) for c in schema.split(", ")), key, **more)


def test_orphans_skip_partly_null_keys(spark):
    child = frame(spark, "id int, a int, b string", [(1, 1, "x"), (2, 1, None), (3, None, "x"), (4, 2, "x"), (5, 1, "x")])
    parent = frame(spark, "pa int, pb string", [(1, "x")])
    got = audit.orphans(child, parent, ["a", "b"], ["pa", "pb"])
    assert [r["id"] for r in got.collect()] == [4]


def test_fk_audit_over_many_keys_widths_and_types(spark):
    """Twenty keys into one parent (several slots), a two-column key, mixed types, a self reference."""
    names = [f"r{i}" for i in range(20)]
    tables = [
        table("s.hub", "id bigint, parent_id int, code string, n int"),
        table("s.wide", "id int, " + ", ".join(f"{n} int" for n in names)),
        table("s.pair", "a string, b bigint"),
        table("s.text", "hub_id string"),
    ]
    fks = [ForeignKey("s.wide", (n,), "s.hub", ("id",)) for n in names]
    fks.append(ForeignKey("s.hub", ("parent_id",), "s.hub", ("id",)))
    fks.append(ForeignKey("s.pair", ("a", "b"), "s.hub", ("code", "n")))
    fks.append(ForeignKey("s.text", ("hub_id",), "s.hub", ("id",)))
    spec = Spec.of(tables, fks)
    frames = {
        "s.hub": frame(spark, "id bigint, parent_id int, code string, n int", [(1, None, "x", 1), (2, 1, "y", 2), (3, 9, None, 3)]),
        # column r_i points past the hub's ids in rows above i
        "s.wide": frame(
            spark,
            "id int, " + ", ".join(f"{n} int" for n in names),
            [(k, *[(100 if k > i else 1) for i in range(20)]) for k in range(1, 11)],
        ),
        "s.pair": frame(spark, "a string, b bigint", [("x", 1), ("x", 2), ("y", 2), (None, 7), ("q", None)]),
        "s.text": frame(spark, "hub_id string", [("1",), ("8",), (None,)]),
    }
    got = {(r.child, r.child_columns): r.orphan_rows for r in audit.audit_fks(frames, spec).collect()}
    want = {("s.wide", f"r{i}"): sum(1 for k in range(1, 11) if k > i) for i in range(10)}
    want = {k: v for k, v in want.items() if v}
    want |= {("s.hub", "parent_id"): 1, ("s.pair", "a,b"): 1, ("s.text", "hub_id"): 1}
    assert got == want
    only = audit.audit_fks(frames, spec, ["s.pair"]).collect()
    assert [(r.child, r.orphan_rows) for r in only] == [("s.pair", 1)]
    assert audit.audit_fks(frames, spec, []).count() == 0


def test_unique_keys_and_null(spark):
    df = frame(spark, "a int, b int, live boolean", [(1, 1, True), (1, 1, True), (1, None, True), (1, None, True), (2, 2, False), (2, 2, False)])
    assert sorted(map(tuple, audit.audit_unique(df, ["a", "b"]).collect())) == [(1, 1, 2), (2, 2, 2)]
    assert list(map(tuple, audit.audit_unique(df, ["a", "b"], "live").collect())) == [(1, 1, 2)]
    primary = {tuple(r) for r in audit.audit_unique(df, ["a", "b"], primary=True).collect()}
    assert primary == {(1, 1, 2), (2, 2, 2), (1, None, 2)}


def test_cardinality_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "is_default boolean")
    assert audit.audit_cardinality(empty, [], "is_default").first()["n"] == 0
    one = frame(spark, "is_default boolean", [(True,), (False,), (None,)])
    assert audit.audit_cardinality(one, [], "is_default").count() == 0


def test_high_water(spark):
    frames = {"a": frame(spark, "id bigint", [(5,), (2,)]), "b": spark.createDataFrame([], "id bigint"),
              "c": frame(spark, "id bigint", [(-4,)])}
    got = {r.table_name: r.next_id for r in audit.high_water(frames, {n: ["id"] for n in frames}).collect()}
    assert got == {"a": 6, "b": 1, "c": 2}


def test_reconcile(spark):
    a = frame(spark, "x int, s string", [(1, "a"), (1, "a"), (2, None), (3, "c")])
    b = frame(spark, "s string, x int", [("a", 1), (None, 2), ("d", 4)])
    assert audit.reconcile(a, a).count() == 0
    assert {tuple(r) for r in audit.reconcile(a, b).collect()} == {("MISSING", 3, "c"), ("EXTRA", 4, "d")}
    bags = {tuple(r) for r in audit.reconcile(a, b, distinct=False).collect()}
    assert bags == {("MISSING", 1, "a", 1), ("MISSING", 3, "c", 1), ("EXTRA", 4, "d", 1)}


def test_audit_all_is_empty_on_clean_tables(spark):
    spec = Spec.of([table("s.a", "id bigint", ("id",), uniques=(Unique(("id",)),), checks=(Check("pos", "id > 0"),))])
    assert audit_all({"s.a": frame(spark, "id bigint", [(1,), (2,)])}, spec).count() == 0
    found = audit_all({"s.a": frame(spark, "id bigint", [(-1,), (2,), (2,)])}, spec).collect()
    assert sorted((r.kind, r.detail, r.rows) for r in found) == [("key", "id", 2), ("key", "id", 2), ("row", "check:pos", 1)]


def test_conform_types_and_reasons(spark):
    spec = Table(
        "s.t",
        (
            Column("id", "int", False),
            Column("amount", "decimal(5,2)"),
            Column("name", "string", max_chars=3),
            Column("doc", "string", json=True),
            Column("days", "array<int>"),
            Column("vec", "array<float>", dims=2),
            Column("at", "timestamp"),
            Column("ok", "boolean"),
            Column("double_id", "bigint", generated="id * 2"),
        ),
        ("id",),
        checks=(Check("positive", "amount > 0"),),
    )
    cols = "id string, amount string, name string, doc string, days string, vec string, at string, ok string"
    rows = [
        ("1", "2.345", "abc  ", '{"a":1}', "{1,2}", "[1,2]", "2020-01-01 00:00:00+00", "t"),
        ("2", None, None, None, None, None, None, None),
        (None, "1", "a", "null", "{}", "[0,1]", None, "f"),
        ("x", "1000", "abcd", "{", "{a}", "[1]", "yesterday", "yes"),
        ("5", "-1", "éöü", "[]", "{3}", "[1,x]", None, None),
    ]
    good, bad = conform.conform(frame(spark, cols, rows), spec)
    assert [c for c, _ in good.dtypes][-1] == "double_id"
    kept = {r.id: r for r in good.collect()}
    assert set(kept) == {1, 2}
    assert kept[1].amount == Decimal("2.35") and kept[1].name == "abc" and kept[1].days == [1, 2]
    assert kept[1].double_id == 2 and kept[1].ok is True
    reasons = {r.id: set(r.reasons) for r in bad.where("id is not null").collect()}
    assert reasons == {5: {"check:positive", "type:vec"}}
    others = {frozenset(r.reasons) for r in bad.where("id is null").collect()}
    assert others == {
        frozenset({"null:id"}),
        frozenset({"type:id", "type:amount", "length:name", "json:doc", "type:days", "dims:vec", "type:at", "type:ok"}),
    }


def test_align_without_common_columns(spark):
    out, dropped = conform.align(frame(spark, "a int", [(1,)]), table("s.t", "b int"))
    assert out is None and dropped == ["a"]


def test_rename_twice_is_once(spark):
    frames = {"public.old": frame(spark, "user_id int, x int", [(1, 2)])}
    names, columns = {"public.old": "public.new"}, {"public.new": {"user_id": "handled_by"}}
    once = conform.rename(frames, names, columns)
    again = conform.rename(once, names, columns)
    assert list(again) == ["public.new"] and again["public.new"].columns == ["handled_by", "x"]


def test_resolve_default_needs_one_default(spark):
    df = frame(spark, "id int, channel int", [(1, None), (2, 7)])
    parent = frame(spark, "cid int, is_default boolean", [(4, True), (7, False)])
    got = conform.resolve_default(df, "channel", parent, "cid", "is_default").collect()
    assert sorted(map(tuple, got)) == [(1, 4), (2, 7)]
    two = frame(spark, "cid int, is_default boolean", [(4, True), (7, True)])
    with pytest.raises(Exception, match="(?i)scalar"):
        conform.resolve_default(df, "channel", two, "cid", "is_default").collect()


def test_content_key_ignores_newline_style(spark):
    df = frame(spark, "t string", [("INSERT 1;\n",), ("INSERT 1;\r\n",), ("INSERT 2;\n",)])
    keys = [r.k for r in df.select(fn.content_key("t").alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_row_functions_work_on_a_stream(spark, tmp_path):
    frame(spark, "id bigint, name string, deleted_at date", [(1, "audit_a", None), (2, "b", None)]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id bigint, name string, deleted_at date").parquet(f"{tmp_path}/in")
    marked = conform.annotate(fn.live(stream), table("s.t", "id bigint, name string, deleted_at date"))
    hits = marked.where(fn.glob_match("name", ["audit_*"])).select("id", fn.content_key("name").alias("k"))
    q = hits.writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [r.id for r in spark.table("hits").collect()] == [1]


def test_spec_rejects_unknown_tables():
    with pytest.raises(ValueError, match="unknown table"):
        Spec.of([table("s.a", "id int")], [ForeignKey("s.a", ("id",), "s.b", ("id",))])


def test_closure_follows_several_levels():
    spec = Spec.of(
        [table(n, "id int") for n in ("a", "b", "c", "d")],
        [ForeignKey("b", ("id",), "a", ("id",)), ForeignKey("c", ("id",), "b", ("id",)), ForeignKey("a", ("id",), "a", ("id",))],
    )
    assert spec.referencing_closure(["a"]) == {"b", "c"} and spec.referencing_closure(["d"]) == set()


def test_reconcile_sends_only_rows_with_odd_hashes(spark, monkeypatch):
    """Rows in ever other places of NULL and of array borders are told apart; zeros of both signs and all NaN are not."""
    kind = "i int, x array<int>, y array<int>, d double"
    same = [(i, [i], None, 1.0) for i in range(50)] + [(1, [1], None, 1.0), (60, None, None, float("nan")), (61, [], [1], -0.0)]
    a = spark.createDataFrame([*same, (70, [1, None], [2], 0.0), (71, [1], [2, 3], 0.0), (2, [2], None, 1.0)], kind)
    b = spark.createDataFrame([*same[:-1], (61, [], [1], 0.0), (70, [None, 1], [2], 0.0), (71, [1, 2], [3], 0.0)], kind)
    staged, stage = [], audit.stage
    monkeypatch.setattr(audit, "stage", lambda *p, **o: staged.append(stage(*p, **o)) or staged[-1])
    found = sorted((r.side, r.i, r.copies) for r in audit.reconcile(a, b, distinct=False).collect())
    assert found == [("EXTRA", 70, 1), ("EXTRA", 71, 1), ("MISSING", 2, 1), ("MISSING", 70, 1), ("MISSING", 71, 1)]
    assert sorted((r.side, r.i) for r in audit.reconcile(a, b).collect()) == [(s, i) for s in ("EXTRA", "MISSING") for i in (70, 71)]
    assert [s.columns for s in staged] == [["_hash"]] * 2 and [s.count() for s in staged] == [5, 4]
