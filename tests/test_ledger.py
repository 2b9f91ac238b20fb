"""The filtered ledger against the plain one, and the folders it opens."""

from __future__ import annotations

import pytest

from rowkeel.operators import change, ledger

KEY = ["kind", "name"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def known(spark, first, last):
    return spark.range(first, last).selectExpr("concat('k', id % 3) AS kind", "id AS name", "sha2(concat('text ', id), 256) AS checksum")


@pytest.fixture
def held(spark, tmp_path):
    out = ledger.FilteredLedger(spark, f"{tmp_path}/ledger")
    with pytest.raises(ValueError, match="no ledger"):
        out.rows()
    out.create(known(spark, 0, 600), KEY, buckets=8)
    out.append(known(spark, 600, 900))
    return out


def batch_of(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    return df.selectExpr("concat('k', id % 3) AS kind", "id AS name", "concat(CASE WHEN id % 2 = 0 THEN 'text ' ELSE 'new ' END, id) AS text")


def test_classes_equal_the_plain_ledger(spark, held):
    batch = batch_of(spark, [*range(580, 640), *range(890, 950), 2, 3]).unionByName(
        spark.createDataFrame([(None, 5, "a"), ("k0", None, "b"), ("k0", 3, "c"), ("k0", 3, "text 3"), ("é", 9999, "x"), ("é", 9999, "y")], "kind string, name long, text string")
    )
    assert rows(held.classify(batch, "text")) == rows(change.classify_increment(batch, held.rows(), KEY, "text"))
    assert held.rows().count() == 900
    none = batch.limit(0)
    assert held.classify(none, "text").count() == 0 and held.folders(none) == []


def test_a_batch_opens_only_what_may_hold_its_keys(spark, held):
    every = len(held.folders(batch_of(spark, range(900))))
    assert every == 16
    # three keys of the first append: their three buckets at most, and of the second append next to nothing
    few = held.folders(batch_of(spark, [5, 6, 7]))
    first = held._state()[1].parts[0]
    assert 1 <= sum(first in f for f in few) <= 3 and len(few) <= 4
    opened = held.near(batch_of(spark, [5, 6, 7])).inputFiles()
    assert {f.rsplit("/", 1)[0].removeprefix("file://") for f in opened} == set(few)
    # strangers are let through by about one in a hundred of their tests
    through = [len(held.folders(batch_of(spark, [10**6 + i]))) for i in range(4)]
    assert sum(through) <= 2
    assert held.near(batch_of(spark, [])).count() == 0
    held.compact()
    assert len(held.folders(batch_of(spark, range(900)))) == 8 and held.rows().count() == 900


def test_applied_batches_are_remembered(spark, held):
    batch = batch_of(spark, [898, 899, 900, 901])
    done = held.apply(batch, "text")
    assert sorted(r.name for r in done.ledger.collect()) == [900, 901]
    assert {(r.name, r.state) for r in held.classify(batch, "text").collect()} == {(898, "SAME"), (899, "CHANGED"), (900, "SAME"), (901, "SAME")}
    assert held.apply(batch, "text", allow=False).blocked is False
    blocked = held.apply(batch_of(spark, [5000]), "text", allow=False)
    assert blocked.blocked and held.rows().count() == 902
    with pytest.raises(RuntimeError, match="another writer"):
        held.create(known(spark, 0, 1), KEY)
