from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rowkeel.functions.rows import content_key
from rowkeel.operators import change
from rowkeel.operators.audit import audit_cardinality, audit_fks
from rowkeel.operators.referential import delete_where
from rowkeel.spec import CASCADE, NO_ACTION, RESTRICT, SET_NULL, Column, ForeignKey, Spec, Table


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_insert_absent_keeps_one_per_key_and_all_null_keys(spark):
    target = frame(spark, "code string, label string, n int", [("r1", "Reed", 1), (None, "none", 2)])
    source = frame(spark, "code string, label string", [("r1", "x"), ("B", "z"), ("B", "y"), (None, "p"), (None, "q")])
    got = change.insert_absent(target, source, ["code"], {"n": 50})
    assert rows(got) == rows(frame(spark, "code string, label string, n int",
                                   [("r1", "Reed", 1), (None, "none", 2), ("B", "y", 50), (None, "p", 50), (None, "q", 50)]))
    twice = change.insert_absent(got.where("code is not null"), source.where("code is not null"), ["code"], {"n": 50})
    assert twice.count() == 2


def test_a_batch_is_applied_once_and_edits_are_reported(spark):
    batch = frame(spark, "kind string, name string, body string", [("rates", "2031-spring", "5 of 100\r\n")])
    ledger = spark.createDataFrame([], "kind string, name string, checksum string")
    key = ["kind", "name"]
    held = change.apply_increment(batch, ledger, key, "body", allow=False)
    assert held.blocked and held.rows.count() == 0 and held.ledger.count() == 0
    first = change.apply_increment(batch, ledger, key, "body")
    assert first.rows.count() == 1 and not first.blocked
    ledger = ledger.unionByName(first.ledger)
    second = change.apply_increment(batch, ledger, key, "body", allow=False)
    assert second.rows.count() == 0 and not second.blocked
    assert rows(change.classify_increment(batch, ledger, key, "body").select("state")) == [("SAME",)]
    edited = batch.withColumn("body", F.lit("B"))
    assert rows(change.apply_increment(edited, ledger, key, "body").changed.select("name")) == [("2031-spring",)]


def test_repeated_keys_of_a_batch_are_applied_once(spark):
    held = frame(spark, "kind string, name string, body string", [("k", "old", "1"), ("k", "edited", "1")])
    ledger = held.select("kind", "name", content_key("body").alias("checksum"))
    lines = [("k", "old", "1"), ("k", "old", "1"), ("k", "edited", "2"), ("k", "same", "3"), ("k", "same", "3"),
             ("k", "two", "4"), ("k", "two", "5"), (None, "free", "6"), (None, "free", "6")]
    batch = frame(spark, held.schema, lines)
    got = change.apply_increment(batch, ledger, ["kind", "name"], "body")
    assert sorted(r.name for r in got.rows.collect()) == ["free", "free", "same", "two"]
    assert got.rows.columns == batch.columns and rows(got.ledger) == rows(got.rows.select("kind", "name", content_key("body")))
    assert sorted(r.name for r in got.changed.collect()) == ["edited", "two"]


def test_affected_rows_without_a_key(spark):
    df = frame(spark, "a string, b string", [("x", None), ("y", "1"), ("y", "1"), ("z", "2")])

    def affected(f):
        return [o.affected for o in change.run_scrubs({"t": df}, [change.ScrubRule("r", lambda fs: {"t": f(fs["t"])})])[1]]

    assert affected(lambda t: t.withColumn("b", F.when(F.col("a") == "y", "masked").otherwise(F.col("b")))) == [2]
    assert affected(lambda t: t.where("a <> 'y'")) == [2]
    assert affected(lambda t: t.unionByName(t.where("a = 'z'"))) == [1]
    # a value that changes places with a null is a change
    assert affected(lambda t: t.select(F.expr("if(a = 'x', b, a)").alias("a"), F.expr("if(a = 'x', a, b)").alias("b"))) == [1]
    assert affected(lambda t: t.where("true")) == [0]


def test_pending_keeps_what_is_not_in_the_ledger(spark):
    batch = frame(spark, "kind string, name string, body string", [("data", n, n) for n in "abc"] + [("seed", "a", "a")])
    ledger = batch.where("kind = 'data' and name in ('a', 'c')").select("kind", "name", content_key("body").alias("checksum"))
    got = change.classify_increment(batch, ledger, ["kind", "name"], "body").where("state = 'NEW'")
    # the same name under two kinds is two records
    assert rows(got.select("kind", "name")) == [("data", "b"), ("seed", "a")]


def test_backfill_only_where_null(spark):
    target = frame(spark, "id int, channel int, v string", [(1, None, "a"), (2, 5, "b"), (3, None, "c"), (None, None, "d")])
    source = frame(spark, "k int, sc int", [(1, 9), (1, 8), (2, 7), (None, 1)])
    got = change.backfill(target, source, {"id": "k"}, {"channel": "sc"})
    assert rows(got) == rows(frame(spark, target.schema, [(1, 8, "a"), (2, 5, "b"), (3, None, "c"), (None, None, "d")]))
    guarded = change.backfill(target, source, {"id": "k"}, {"channel": "sc"}, guard="v = 'b'")
    assert (2, 7, "b") in rows(guarded) and (1, None, "a") in rows(guarded)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_assign_ids_has_no_gaps(spark, n):
    df = spark.range(n).select((F.col("id") * 7 % 1009).alias("v")).repartition(5)
    assert [r.new for r in sorted(change.assign_ids(df, "new", 11).collect())] == list(range(11, 11 + n))
    ordered = change.assign_ids(df, "new", 1, ["v"]).orderBy("v").collect()
    assert [r.new for r in ordered] == list(range(1, n + 1))


def _spec(actions, not_null=()):
    tables = {
        "a": ["id"], "b": ["id", "a_id"], "c": ["id", "a_id", "b_id"], "d": ["id", "d_id", "c_id"],
    }
    made = [
        Table(n, tuple(Column(c, "int", nullable=f"{n}.{c}" not in not_null) for c in cols), ("id",))
        for n, cols in tables.items()
    ]
    keys = [("b", "a_id", "a"), ("c", "a_id", "a"), ("c", "b_id", "b"), ("d", "d_id", "d"), ("d", "c_id", "c")]
    return Spec.of(made, [ForeignKey(c, (col,), p, ("id",), act) for (c, col, p), act in zip(keys, actions)])


def _simulate(data, spec, root, doomed_ids):
    """Row by row: what is deleted and what is nulled, or what blocks."""
    gone = {t: set() for t in data}
    wave = {root: set(doomed_ids)}
    blocked = False
    while any(wave.values()):
        before = {t: set(s) for t, s in gone.items()}
        for t, ids in wave.items():
            gone[t] |= ids
        following = {}
        doomed_now = {t: set(s) for t, s in gone.items()}
        for fk in spec.foreign_keys:
            hit = {r["id"] for r in data[fk.child] if r[fk.columns[0]] in wave.get(fk.parent, set())}
            if fk.on_delete == CASCADE:
                following.setdefault(fk.child, set()).update(hit - gone[fk.child])
        for fk in spec.foreign_keys:
            if fk.on_delete == RESTRICT:
                for r in data[fk.child]:
                    if r[fk.columns[0]] in wave.get(fk.parent, set()) and r["id"] not in doomed_now[fk.child]:
                        blocked = True
        del before
        wave = following
    nulled = {}
    for fk in spec.foreign_keys:
        for r in data[fk.child]:
            if r[fk.columns[0]] in gone[fk.parent] and r["id"] not in gone[fk.child]:
                if fk.on_delete == NO_ACTION:
                    blocked = True
                if fk.on_delete == SET_NULL:
                    nulled.setdefault(fk.child, set()).add((r["id"], fk.columns[0]))
    return gone, nulled, blocked


@pytest.mark.parametrize("seed", range(8))
def test_delete_matches_a_row_by_row_simulation(spark, seed):
    rng = random.Random(seed)
    n = 30
    pick = lambda: rng.choice([None] + list(range(n)))
    data = {
        "a": [{"id": i} for i in range(n)],
        "b": [{"id": i, "a_id": pick()} for i in range(n)],
        "c": [{"id": i, "a_id": pick(), "b_id": pick()} for i in range(n)],
        # self references, with cycles
        "d": [{"id": i, "d_id": pick(), "c_id": pick()} for i in range(n)],
    }
    menu = [CASCADE, CASCADE, SET_NULL] if seed < 6 else [CASCADE, SET_NULL, RESTRICT, NO_ACTION]
    spec = _spec([rng.choice(menu) for _ in range(5)])
    frames = {t: frame(spark, ", ".join(f"{c} int" for c in data[t][0]), [tuple(r.values()) for r in data[t]]) for t in data}
    doomed = {1, 2, 3}
    result = delete_where(frames, "a", "id in (1, 2, 3)", spec)
    gone, nulled, blocked = _simulate(data, spec, "a", doomed)
    assert result.blocked is blocked
    if blocked:
        assert result.frames is frames and result.report.count() > 0
        return
    for t in data:
        want = []
        for r in data[t]:
            if r["id"] not in gone[t]:
                want.append(tuple(None if (r["id"], c) in nulled.get(t, set()) else v for c, v in r.items()))
        assert rows(result.frames[t]) == sorted(want, key=str), t
    counts = {(r.table_name, r.action): r.rows for r in result.report.collect()}
    want = {(t, "deleted"): len(s) for t, s in gone.items() if s}
    want |= {(t, "nulled"): len({i for i, _ in s}) for t, s in nulled.items() if s}
    assert counts == want
    # no new orphans
    assert audit_fks(result.frames, spec).count() == 0


def test_set_null_on_a_required_column_blocks(spark):
    spec = _spec([SET_NULL, CASCADE, CASCADE, CASCADE, CASCADE], not_null=("b.a_id",))
    frames = {
        "a": frame(spark, "id int", [(1,)]), "b": frame(spark, "id int, a_id int", [(1, 1)]),
        "c": spark.createDataFrame([], "id int, a_id int, b_id int"),
        "d": spark.createDataFrame([], "id int, d_id int, c_id int"),
    }
    result = delete_where(frames, "a", "id = 1", spec)
    assert result.blocked and "NOT NULL" in result.report.first()["action"]


def test_a_delete_that_matches_nothing(spark):
    spec = _spec([CASCADE] * 5)
    frames = {
        "a": frame(spark, "id int", [(1,)]), "b": frame(spark, "id int, a_id int", [(1, 1)]),
        "c": frame(spark, "id int, a_id int, b_id int", [(1, 1, 1)]),
        "d": frame(spark, "id int, d_id int, c_id int", [(1, None, 1)]),
    }
    result = delete_where(frames, "a", "id is null", spec)
    assert not result.blocked and result.report.count() == 0
    assert {t: df.count() for t, df in result.frames.items()} == {"a": 1, "b": 1, "c": 1, "d": 1}


def test_seed_rows_with_computed_key_and_random_stamp(spark):
    """Stations are added by their upper-cased name; existing ones keep their stamp."""
    have = frame(spark, "name string, upper_name string, stamp string", [("Quay", "QUAY", "first")])
    wanted = frame(spark, "name string", [("quay",), ("East Lock",)]).withColumn("upper_name", F.upper("name"))
    got = change.insert_absent(have, wanted, ["upper_name"], {"stamp": F.expr("uuid()")})
    found = {r.upper_name: (r.name, r.stamp) for r in got.collect()}
    assert found["QUAY"] == ("Quay", "first")
    assert found["EAST LOCK"][0] == "East Lock" and len(found["EAST LOCK"][1]) == 36
    again = change.insert_absent(got, wanted, ["upper_name"], {"stamp": F.expr("uuid()")})
    assert again.count() == 2


def test_a_default_row_is_added_and_backfilled(spark):
    """The default row is guaranteed, then rows without a depot point at it."""
    depots = spark.createDataFrame([], "id bigint, code string, name string, is_default boolean")
    assert audit_cardinality(depots, [], "is_default").first()["n"] == 0
    seed = frame(spark, "id bigint, code string", [(1, "main-depot")])
    depots = change.insert_absent(depots, seed, ["code"], {"name": "Main depot", "is_default": True})
    assert audit_cardinality(depots, [], "is_default").count() == 0
    parcels = frame(spark, "id bigint, depot_id bigint", [(1, None), (2, 7)])
    filled = parcels.withColumn("_code", F.lit("main-depot"))
    filled = change.backfill(filled, depots, {"_code": "code"}, {"depot_id": "id"}).drop("_code")
    assert rows(filled) == [(1, 1), (2, 7)]
    assert rows(change.backfill(filled.withColumn("_code", F.lit("main-depot")), depots, {"_code": "code"}, {"depot_id": "id"}).drop("_code")) == rows(filled)


def _tree_spec(*extra, on_delete=CASCADE):
    tables = [Table("t", tuple(Column(c, "int") for c in ("id", "up", "also", "o_id")), ("id",)), Table("o", (Column("id", "int"), Column("t_id", "int")), ("id",)), Table("x", (Column("id", "int"), Column("t_id", "int")), ("id",))]
    return Spec.of(tables, [ForeignKey("t", ("up",), "t", ("id",), on_delete), *extra])


def _tree(spark, rows, others=(), leaves=()):
    return {
        "t": spark.createDataFrame(rows, "id int, up int, also int, o_id int"),
        "o": spark.createDataFrame(list(others), "id int, t_id int"),
        "x": spark.createDataFrame(list(leaves), "id int, t_id int"),
    }


def test_a_chain_of_a_thousand_rows_takes_few_rounds(spark):
    n = 1000
    # two chains of that depth, of which one goes; a third of all rows hang on one row
    rows = [(i, i - 1 if i % n else None, None, None) for i in range(2 * n)] + [(5000 + i, n - 1, None, None) for i in range(n)]
    result = delete_where(_tree(spark, rows), "t", "id = 0", _tree_spec())
    assert not result.blocked and result.rounds["t"] <= 12
    assert {r.id for r in result.frames["t"].collect()} == set(range(n, 2 * n))
    assert [tuple(r) for r in result.report.collect()] == [("t", "deleted", 2 * n)]


def test_circles_of_rows_end(spark):
    rows = [(1, 3, None, None), (2, 1, None, None), (3, 2, None, None), (4, 4, None, None), (5, 4, None, None), (6, 2, None, None), (7, None, None, None)]
    result = delete_where(_tree(spark, rows), "t", "id = 2", _tree_spec())
    assert {r.id for r in result.frames["t"].collect()} == {4, 5, 7}
    result = delete_where(_tree(spark, rows), "t", "id = 4", _tree_spec())
    assert {r.id for r in result.frames["t"].collect()} == {1, 2, 3, 6, 7}
    assert delete_where(_tree(spark, rows), "t", "id = 99", _tree_spec()).report.count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_two_keys_of_a_table_and_a_circle_of_tables(spark, seed):
    rng = random.Random(seed)
    n = 60
    pick = lambda: rng.choice([None, None, *range(n)])
    data = {
        "t": [{"id": i, "up": pick(), "also": pick(), "o_id": pick()} for i in range(n)],
        "o": [{"id": i, "t_id": pick()} for i in range(n)],
        "x": [{"id": i, "t_id": pick()} for i in range(n)],
    }
    keys = [
        ForeignKey("t", ("also",), "t", ("id",), CASCADE),
        ForeignKey("o", ("t_id",), "t", ("id",), CASCADE),
        ForeignKey("t", ("o_id",), "o", ("id",), CASCADE),
        ForeignKey("x", ("t_id",), "t", ("id",), [CASCADE, SET_NULL, RESTRICT][seed % 3]),
    ]
    spec = _tree_spec(*keys)
    frames = _tree(spark, *[[tuple(r.values()) for r in data[t]] for t in ("t", "o", "x")])
    result = delete_where(frames, "t", "id < 2", spec)
    gone, nulled, blocked = _simulate(data, spec, "t", {0, 1})
    assert result.blocked is blocked
    if not blocked:
        assert {t: {r.id for r in result.frames[t].collect()} for t in data} == {t: {r["id"] for r in data[t]} - gone[t] for t in data}
        assert {r.id for r in result.frames["x"].where("t_id IS NULL").collect()} == {r["id"] for r in data["x"] if r["id"] not in gone["x"] and (r["t_id"] is None or (r["id"], "t_id") in nulled.get("x", set()))}


def test_restrict_looks_at_the_level_of_the_parent(spark):
    rows = [(1, None, None, None), (2, 1, None, None), (3, 2, None, None)]
    keys = [ForeignKey("o", ("t_id",), "t", ("id",), CASCADE), ForeignKey("x", ("id",), "o", ("id",), CASCADE), ForeignKey("x", ("t_id",), "t", ("id",), RESTRICT)]
    spec = _tree_spec(*keys)
    # row 7 of x goes at level 2 by way of o; its parent in t goes at level 2 or at level 1
    late = _tree(spark, rows, [(7, 1)], [(7, 3)])
    assert not delete_where(late, "t", "id = 1", spec).blocked
    early = _tree(spark, rows, [(7, 1)], [(7, 2)])
    result = delete_where(early, "t", "id = 1", spec)
    assert result.blocked and [tuple(r) for r in result.report.collect()] == [("x", RESTRICT, 1)]


def test_all_blocking_keys_are_counted_in_one_job(spark):
    keys = [ForeignKey("o", ("t_id",), "t", ("id",), "NO ACTION"), ForeignKey("x", ("t_id",), "t", ("id",), RESTRICT)]
    frames = _tree(spark, [(1, None, None, None)], [(1, 1), (2, 1)], [(1, 1)])
    result = delete_where(frames, "t", "id = 1", _tree_spec(*keys))
    assert sorted(map(tuple, result.report.collect())) == [("o", "NO ACTION", 2), ("x", RESTRICT, 1)]
    assert result.frames is frames
