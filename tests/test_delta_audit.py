"""Kept key counts against the full audits after random changes."""

from __future__ import annotations

import random

import pytest

from rowkeel.operators import audit
from rowkeel.operators.delta_audit import KeyCounts
from rowkeel.spec import Column, ForeignKey, Spec, Table, Unique

P, C = "d.parent", "d.child"
SPEC = Spec.of(
    [
        Table(P, (Column("id", "int"), Column("part", "string"), Column("up", "bigint")), ("id", "part"), (Unique(("part",), "id > 3"),)),
        Table(C, (Column("id", "bigint"), Column("p_id", "bigint"), Column("p_part", "string")), ("id",)),
    ],
    [ForeignKey(C, ("p_id", "p_part"), P, ("id", "part")), ForeignKey(P, ("up",), C, ("id",)), ForeignKey(C, ("p_id",), C, ("id",))],
)
SHAPES = {P: "id int, part string, up bigint", C: "id bigint, p_id bigint, p_part string"}


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_rows(rng, n):
    small = lambda: rng.choice([None, *range(9)])
    return {P: [(small(), rng.choice([None, "a", "b"]), small()) for _ in range(n)], C: [(small(), small(), rng.choice([None, "a", "b", "c"])) for _ in range(n)]}


@pytest.mark.parametrize("seed", range(2))
def test_counts_follow_random_changes(spark, tmp_path, seed):
    rng = random.Random(seed)
    frames = lambda data: {n: spark.createDataFrame(data[n], SHAPES[n]) for n in data}
    now = random_rows(rng, 20)
    kept = KeyCounts(spark, f"{tmp_path}/counts", SPEC)
    kept.create(frames(now), buckets=4)
    for step in range(3):
        added = random_rows(rng, 6)
        gone = {n: rng.sample(now[n], 8) for n in now}
        kept.apply(frames(added), frames(gone))
        for n in now:
            for r in gone[n]:
                now[n].remove(r)
            now[n] += added[n]
        if step == 1:
            kept.compact()
        full = frames(now)
        assert rows(kept.orphans()) == rows(audit.audit_fks(full, SPEC))
        assert rows(kept.bad_keys()) == rows(audit.audit_keys(full, SPEC))
    # everything goes
    kept.apply(deleted=frames(now))
    assert rows(kept.orphans()) == rows(kept.bad_keys()) == []
    kept.compact()
    assert kept._read(kept._state()[1].parts).count() == 0


def test_a_change_reads_only_counts_of_its_buckets(spark, tmp_path):
    kept = KeyCounts(spark, f"{tmp_path}/counts", SPEC)
    kept.create({P: spark.range(5000).selectExpr("cast(id AS int) AS id", "'a' AS part", "NULL AS up"), C: spark.createDataFrame([], SHAPES[C])}, buckets=128)
    seen = []
    read = KeyCounts._read

    def watched(self, paths):
        seen.append(read(self, paths))
        return seen[-1]

    KeyCounts._read = watched
    try:
        kept.apply({C: spark.createDataFrame([(1, 7, "a"), (2, 9999, "a")], SHAPES[C])})
    finally:
        KeyCounts._read = read
    assert len(seen) == 1
    # the base is not among the inputs, and of the counts some buckets of 128 are
    assert all("/counts/parts/" in f for f in seen[0].inputFiles())
    assert {(r.child_columns, r.orphan_rows) for r in kept.orphans().collect()} == {("p_id,p_part", 1), ("p_id", 2)}
    number, state = kept._state()
    assert number == 2 and len(state.parts) == 2


def test_writers_side_by_side_and_missing_counts(spark, tmp_path):
    kept = KeyCounts(spark, f"{tmp_path}/counts", SPEC)
    with pytest.raises(ValueError, match="no counts"):
        kept.orphans()
    none = {n: spark.createDataFrame([], s) for n, s in SHAPES.items()}
    kept.create(none)
    with pytest.raises(RuntimeError, match="another writer"):
        kept.create(none)
    kept.apply(none, {})
    kept.apply({"d.other": none[P]}, {})
    assert rows(kept.orphans()) == []
