from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest

from rowkeel.operators import history
from rowkeel.plans import star

HEADER = "id bigint, status string, book_id int, memo string, amount double, reversed_by bigint"


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def books(spark):
    return frame(spark, "id int, code string", [(1, "MAIN"), (2, "TRAINING")])


def test_diff_is_null_safe(spark):
    before = frame(spark, "id int, a string, b int", [(1, None, 1), (2, None, 1), (3, "x", None), (4, "x", 2), (5, "q", 1)])
    after = frame(spark, "id int, a string, b int", [(1, None, 1), (2, "y", 1), (3, "x", 3), (5, "r", 2), (6, "n", 1)])
    for digest in ([], ["a"]):
        got = history.diff_snapshots(before, after, ["id"], carry=["b"], digest=digest).collect()
        found = {r.id: (r.op, r.changed, r.old and r.old.b, r.new and r.new.b) for r in got}
        assert found == {
            2: ("UPDATE", ["a"], 1, 1),
            3: ("UPDATE", ["b"], None, 3),
            4: ("DELETE", None, 2, None),
            5: ("UPDATE", ["a", "b"], 1, 2),
            6: ("INSERT", None, None, 1),
        }
    assert history.diff_snapshots(before, before, ["id"]).count() == 0


# one row per rule: (before, after, reason or None)
HEADER_CASES = [
    ("draft may change", ("Draft", 1, "m", 1.0, None), ("Posted", 1, "n", 2.0, None), None),
    ("approved may go", ("Approved", 1, "m", 1.0, None), None, None),
    ("a status of NULL is free", (None, 1, "m", 1.0, None), None, None),
    ("posted may reverse", ("Posted", 1, "m", 1.0, None), ("Reversed", 1, "m", 1.0, 9), None),
    ("reverse without link", ("Posted", 1, "m", 1.0, None), ("Reversed", 1, "m", 1.0, None), None),
    ("reverse and edit", ("Posted", 1, "m", 1.0, None), ("Reversed", 1, "m", 2.0, 9), "posted is append-only"),
    ("NULL to value counts", ("Posted", 1, None, 1.0, None), ("Reversed", 1, "m", 1.0, 9), "posted is append-only"),
    ("link without reverse", ("Posted", 1, "m", 1.0, None), ("Posted", 1, "m", 1.0, 9), "posted is append-only"),
    ("back to draft", ("Posted", 1, "m", 1.0, None), ("Draft", 1, "m", 1.0, None), "posted is append-only"),
    ("status to NULL", ("Posted", 1, "m", 1.0, None), (None, 1, "m", 1.0, None), "posted is append-only"),
    ("reversed is locked", ("Reversed", 1, "m", 1.0, None), ("Reversed", 1, "m", 1.0, 9), "reversed is locked"),
    ("posted delete", ("Posted", 1, "m", 1.0, None), None, "deleted"),
    ("reversed delete", ("Reversed", 1, "m", 1.0, None), None, "deleted"),
    ("book unknown", ("Posted", 7, "m", 1.0, None), None, "deleted"),
    ("book NULL", ("Posted", None, "m", 1.0, None), None, "deleted"),
    ("sandbox delete", ("Posted", 2, "m", 1.0, None), None, None),
    ("sandbox update is not exempt", ("Posted", 2, "m", 1.0, None), ("Posted", 2, "z", 1.0, None), "posted is append-only"),
    ("leaving the sandbox", ("Posted", 2, "m", 1.0, None), ("Reversed", 1, "m", 1.0, None), "posted is append-only"),
    ("untouched", ("Posted", 1, "m", 1.0, None), ("Posted", 1, "m", 1.0, None), None),
    ("insert is free", None, ("Posted", 1, "m", 1.0, None), None),
]


def test_header_rules(spark, books):
    before = frame(spark, HEADER, [(i, *b) for i, (_, b, _, _) in enumerate(HEADER_CASES) if b])
    after = frame(spark, HEADER, [(i, *a) for i, (_, _, a, _) in enumerate(HEADER_CASES) if a])
    got = {r.id: r.reason for r in history.audit_header_changes(before, after, books, ["id"], free=["reversed_by"]).collect()}
    for i, (what, _, _, reason) in enumerate(HEADER_CASES):
        assert got.get(i) == reason, what


LINE_CASES = [
    ("draft line changes", (1, 1, 5), (1, 1, 6), None, None),
    ("posted line changes", (2, 1, 5), (2, 1, 6), "UPDATE", "UPDATE"),
    ("reversed line goes", (3, 1, 5), None, "DELETE", "DELETE"),
    ("missing parent", (99, 1, 5), None, None, None),
    ("parent NULL", (None, 1, 5), None, None, None),
    ("sandbox line goes", (2, 2, 5), None, None, None),
    ("sandbox line changes", (2, 2, 5), (2, 2, 6), "UPDATE", "UPDATE"),
    ("moved under posted", (1, 1, 5), (2, 1, 5), None, "UPDATE"),
    ("moved away from posted", (2, 1, 5), (1, 1, 5), "UPDATE", "UPDATE"),
    ("added to posted", None, (2, 1, 5), None, "INSERT"),
    ("added to draft", None, (1, 1, 5), None, None),
]


@pytest.mark.parametrize("strict", [False, True])
def test_line_rules(spark, books, strict):
    schema = "id bigint, entry bigint, book_id int, qty int"
    before = frame(spark, schema, [(i, *c[1]) for i, c in enumerate(LINE_CASES) if c[1]])
    after = frame(spark, schema, [(i, *c[2]) for i, c in enumerate(LINE_CASES) if c[2]])
    headers = frame(spark, "eid bigint, status string", [(1, "Draft"), (2, "Posted"), (3, "Reversed")])
    found = history.audit_line_changes(before, after, headers, books, ["id"], ["entry"], ["eid"], strict=strict)
    got = {r.id: r.op for r in found.collect()}
    for i, case in enumerate(LINE_CASES):
        assert got.get(i) == case[4 if strict else 3], case[0]


def test_write_once_and_locked(spark):
    before = frame(spark, "id int, state string, t string", [(1, "Published", "a"), (2, "Draft", "a"), (3, "Published", "a"), (4, None, "a")])
    after = frame(spark, "id int, state string, t string", [(1, "Published", "b"), (2, "Draft", "b"), (5, "Published", "n")])
    once = {r.id: r.op for r in history.audit_write_once(before, after, ["id"], digest=["t"]).collect()}
    assert once == {1: "UPDATE", 2: "UPDATE", 3: "DELETE", 4: "DELETE"}
    locked = {r.id: r.op for r in history.audit_locked(before, after, ["id"], "state", ["Published"]).collect()}
    assert locked == {1: "UPDATE", 3: "DELETE"}


def _brute(facts, dim):
    return sorted((f[0], d[3]) for f in facts for d in dim
                  if f[1] is not None and f[1] == d[0] and d[1] <= f[2] and (d[2] is None or f[2] < d[2]))


@pytest.mark.parametrize("hot_rows", [None, 10, 60, 100_000])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "bigint"])
def test_asof_matches_brute_force(spark, hot_rows, kind):
    rng = random.Random(5)
    origin = datetime(2024, 3, 1)

    def at(x):
        if kind == "bigint":
            return x - 5000
        t = origin + timedelta(seconds=x * 977)
        return t.date() if kind == "date" else t

    facts, dim = [], []
    for i in range(400):
        # one key holds most of the facts
        key = rng.choice(["hot"] * 6 + ["a", "b", "c", "none", None])
        facts.append((i, key, at(rng.randrange(9000))))
    for j in range(150):
        start = rng.randrange(9000)
        length = rng.choice([0, 1, 3, 40, 600, 9000])
        end = None if rng.random() < 0.1 else at(start + length)
        dim.append((rng.choice(["hot", "hot", "a", "b", "c"]), at(start), end, j))
    f = frame(spark, f"fid int, key string, ts {kind}", facts)
    d = frame(spark, f"key string, vf {kind}, vt {kind}, owner int", dim)
    got = history.resolve_asof(f, d, ["key"], "ts", "vf", "vt", hot_rows, hot_pairs=5000 if hot_rows == 60 else 10**8)
    assert got.columns == ["fid", "key", "ts", "vf", "vt", "owner"]
    assert sorted((r.fid, r.owner) for r in got.collect()) == _brute(facts, dim)


def test_asof_successive_identifiers(spark):
    """Each number of a rename chain resolves to its owner at the time; half open."""
    dim = frame(spark, "num string, vf date, vt date, owner int",
                [("P-1", date(2024, 1, 1), date(2024, 2, 1), 1), ("P-1", date(2024, 2, 1), None, 2)])
    facts = frame(spark, "f int, num string, ts date",
                  [(1, "P-1", date(2023, 12, 31)), (2, "P-1", date(2024, 1, 1)), (3, "P-1", date(2024, 2, 1)), (4, "P-9", date(2024, 2, 1))])
    got = history.resolve_asof(facts, dim, ["num"], "ts", "vf", "vt")
    assert sorted((r.f, r.owner) for r in got.collect()) == [(2, 1), (3, 2)]


def test_every_line_enters_the_audit(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    before = star.lines_before(lines, spark.read.parquet(f"{sf}/orders.parquet"))
    assert before.count() == lines.count() == before.select("l_orderkey", "l_linenumber", "copy").distinct().count()
    assert set(lines.columns) < set(before.columns)


def test_line_audit_ships_hashes_and_writes_changes_only(spark, monkeypatch):
    """Of a line only its key, header, book and a hash travel; the strict audit compares the snapshots once."""
    n = 300
    before = spark.range(n).selectExpr("id AS line", "id % 10 AS head", "1 AS book_id", "repeat('x', 500) AS memo", "array(if(id % 2 = 0, null, 1), id) AS marks")
    after = before.where("line <> 7").selectExpr("line", "if(line = 8, 3L, head) AS head", "book_id", "if(line = 9, 'y', memo) AS memo", "if(line = 10, array(line, null), marks) AS marks")
    headers = spark.createDataFrame([(h, "Posted" if h < 9 else "Draft") for h in range(10)], "id long, status string")
    books = spark.createDataFrame([(1, "MAIN")], "id int, code string")
    staged, compared, stage, diff = [], [], history.stage, history.diff_snapshots
    monkeypatch.setattr(history, "stage", lambda *a, **b: staged.append(stage(*a, **b)) or staged[-1])
    monkeypatch.setattr(history, "diff_snapshots", lambda *a, **b: compared.append(a[3] if len(a) > 3 else None) or diff(*a, **b))
    found = history.audit_line_changes(before, after, headers, books, ["line"], ["head"], ["id"], strict=True)
    assert sorted(map(tuple, found.collect())) == [
        (7, "DELETE", "line of a Posted header"),
        (8, "UPDATE", "line of a Posted header"),
        (8, "UPDATE", "line put under a Posted header"),
        (10, "UPDATE", "line of a Posted header"),
    ]
    assert compared == [["_hash"]] and [s.count() for s in staged] == [4]
