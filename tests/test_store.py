"""The commit log: writers side by side, conflicts, older versions, clean-up."""

from __future__ import annotations

import json
import os
from concurrent.futures import ThreadPoolExecutor
from threading import Barrier

import pytest

from rowkeel.plans.restore import EXIT_CONFLICT, restore
from rowkeel.plans.store import Conflict, Store
from rowkeel.sources.manifest import export_copy
from rowkeel.sources.staging import write_if_absent
from rowkeel.spec import Column, ForeignKey, Spec, Table

TABLES = [f"farm.t{i}" for i in range(6)]
SPEC = Spec.of(
    [Table(t, (Column("id", "bigint", False, identity=True), Column("up", "bigint")), ("id",)) for t in TABLES],
    [ForeignKey(TABLES[1], ("up",), TABLES[0], ("id",))],
)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store", SPEC)


def rows(spark, n):
    return spark.range(n).selectExpr("id", "id AS up")


def test_a_file_is_created_once(spark, tmp_path):
    path = f"{tmp_path}/new/one.json"
    with ThreadPoolExecutor(12) as pool:
        made = list(pool.map(lambda i: write_if_absent(spark, path, f"writer {i} " * 500), range(12)))
    assert sorted(made) == [False] * 11 + [True]
    assert open(path).read() == f"writer {made.index(True)} " * 500
    assert [n for n in os.listdir(f"{tmp_path}/new") if not n.startswith(".")] == ["one.json"]


def test_writers_side_by_side_lose_nothing(spark, store):
    start = Barrier(6)

    def write(i):
        start.wait()
        for n in (1, 2, 3):
            store.put(TABLES[i], rows(spark, 10 * i + n), {"id": 100 * i + n})

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(6)))
    assert store.numbers() == list(range(1, 19))
    assert {t: df.count() for t, df in store.frames().items()} == {TABLES[i]: 10 * i + 3 for i in range(6)}
    assert store.next_ids() == {TABLES[i]: {"id": 100 * i + 3} for i in range(6)}
    # every version holds what the one before held and its own change
    for n in range(2, 19):
        before, now = store.version(n - 1), store.version(n)
        assert {t for t in TABLES if before.tables.get(t) != now.tables.get(t)} == set(now.changed)
        assert before.at <= now.at


def test_of_two_writers_of_one_table_the_second_is_refused(spark, store):
    base = store.put(TABLES[0], rows(spark, 3)).number
    store.put(TABLES[0], rows(spark, 4), base=base)
    with pytest.raises(Conflict) as refused:
        store.put(TABLES[0], rows(spark, 5), base=base)
    assert (refused.value.tables, refused.value.versions) == ([TABLES[0]], [2])
    assert store.frames()[TABLES[0]].count() == 4
    # another table goes on from the same base, unless it was made from the changed one
    path = store.new_path(TABLES[1])
    rows(spark, 7).write.parquet(path)
    with pytest.raises(Conflict):
        store.publish({TABLES[1]: path}, base=base, reads=[TABLES[0]])
    store.publish({TABLES[1]: path}, base=base)
    assert {t: store.frames()[t].count() for t in TABLES[:2]} == {TABLES[0]: 4, TABLES[1]: 7}


def test_a_restore_notices_other_writers(spark, store, tmp_path):
    export_copy({TABLES[1]: rows(spark, 3)}, f"{tmp_path}/dump", SPEC)
    store.put(TABLES[0], rows(spark, 9))

    class Late(Store):
        def new_path(self, name):
            # the parent table changes while the dump is read
            if not self.spark.conf.get("late", ""):
                self.spark.conf.set("late", "yes")
                self.put(TABLES[0], rows(self.spark, 1))
            return super().new_path(name)

    try:
        report = restore(spark, f"{tmp_path}/dump", Late(spark, store.root, SPEC))
    finally:
        spark.conf.unset("late")
    assert report.exit_code == EXIT_CONFLICT and not report.published
    assert report.conflicts == [TABLES[0]]
    assert store.frames()[TABLES[1]].count() == 0
    report = restore(spark, f"{tmp_path}/dump", store, allow_orphans=True)
    assert report.published and store.frames()[TABLES[1]].count() == 3


def test_older_versions(spark, store):
    for n in (1, 2, 3):
        store.put(TABLES[0], rows(spark, n), {"id": n})
    store.publish({}, [TABLES[0]], note="emptied")
    assert [store.frames(v)[TABLES[0]].count() for v in range(5)] == [0, 1, 2, 3, 0]
    assert store.next_ids(2) == {TABLES[0]: {"id": 2}}
    assert store.version_at(store.version(2).at).tables[TABLES[0]] in {store.version(v).tables[TABLES[0]] for v in (2, 3)}
    assert store.version_at(0).number == 0
    back = store.roll_back(2)
    assert (back.number, back.changed) == (5, [TABLES[0]])
    assert store.frames()[TABLES[0]].count() == 2 and store.next_ids() == {TABLES[0]: {"id": 2}}
    assert store.roll_back(0).tables == {}
    with pytest.raises(ValueError, match="not kept"):
        store.frames(99)


def test_clean_up_removes_what_no_kept_version_names(spark, store):
    for n in (1, 2, 3):
        store.put(TABLES[0], rows(spark, n))
    store.put(TABLES[1], rows(spark, 5))
    unfinished = store.new_path(TABLES[2])
    rows(spark, 1).write.parquet(unfinished)
    # young folders stay: a writer may be about to name them
    assert store.clean(2, dry_run=True) == ([1, 2], [])
    old, folders = store.clean(2, older_than_seconds=-5, dry_run=True)
    assert old == [1, 2] and len(folders) == 3 and unfinished in folders
    assert store.numbers() == [1, 2, 3, 4]
    assert store.clean(2, older_than_seconds=-5) == (old, folders)
    assert store.numbers() == [3, 4]
    assert not any(os.path.exists(f) for f in folders)
    assert [store.frames(v)[TABLES[0]].count() for v in (3, 4)] == [3, 3]
    assert store.frames()[TABLES[1]].count() == 5
    # a writer who started from a forgotten version cannot know what changed
    with pytest.raises(Conflict):
        store.put(TABLES[3], rows(spark, 1), base=1)
    assert store.put(TABLES[3], rows(spark, 1), base=3).number == 5
    with pytest.raises(ValueError, match="latest"):
        store.clean(0)


def test_commits_are_plain_text(spark, store):
    v = store.put(TABLES[0], rows(spark, 2))
    text = json.loads(open(f"{store.root}/log/{v.number:020d}.json").read())
    assert text["changed"] == [TABLES[0]] and set(text["tables"]) == {TABLES[0]}
