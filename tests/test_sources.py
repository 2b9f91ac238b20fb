from __future__ import annotations

from decimal import Decimal

import pytest

from rowkeel.operators.audit import audit_unique
from rowkeel.operators.conform import conform
from rowkeel.sources import catalog
from rowkeel.sources.staging import scratch_root, stage, stage_counted
from rowkeel.sources.tables import Source, jdbc_options, read_source

COLUMNS = (
    "table_schema string, table_name string, column_name string, place int, type_text string, not_null boolean, "
    "is_identity boolean, is_generated boolean, value_text string"
)
CONSTRAINTS = (
    "table_schema string, table_name string, name string, kind string, key_columns string, parent_schema string, "
    "parent_table string, parent_columns string, on_delete string, condition string"
)

KINDS = [
    ("integer", "int", {}),
    ("numeric(18,4)", "decimal(18,4)", {}),
    ("numeric", "decimal(38,10)", {"exact": True}),
    ("character varying(20)", "string", {"max_chars": 20}),
    ("character(64)", "string", {"max_chars": 64}),
    ("timestamp with time zone", "timestamp", {}),
    ("timestamp(3) without time zone", "timestamp_ntz", {}),
    ("time without time zone", "string", {"format": "time"}),
    ("jsonb", "string", {"json": True}),
    ("public.vector(384)", "array<float>", {"dims": 384}),
    ("integer[]", "array<int>", {}),
]


@pytest.mark.parametrize("text,kind,limits", KINDS)
def test_types(text, kind, limits):
    assert catalog.spark_kind(text) == (kind, limits)


def test_unknown_type():
    with pytest.raises(ValueError, match="no Spark type"):
        catalog.spark_kind("tsvector")


def test_constants():
    assert catalog.constant("'Seller'::character varying") == "Seller"
    assert catalog.constant("''::character varying") == ""
    assert catalog.constant("'it''s'::text") == "it's"
    assert catalog.constant("true") is True and catalog.constant("1") == 1
    assert catalog.constant("0.0") == Decimal("0.0")
    assert catalog.constant("now()") is None and catalog.constant(None) is None


def test_spec_from_catalog(spark):
    def col(table, name, place, kind, not_null=False, identity=False, generated=False, value=None, schema="public"):
        return (schema, table, name, place, kind, not_null, identity, generated, value)

    columns = spark.createDataFrame(
        [
            col("lines", "id", 1, "bigint", True, True),
            col("lines", "entry_id", 2, "bigint", True),
            col("lines", "debit", 3, "numeric(18,4)", True),
            col("lines", "credit", 4, "numeric(18,4)", True, value="0.0"),
            col("lines", "status", 5, "character varying(6)", value="'Open'::character varying"),
            col("lines", "is_open", 6, "boolean", generated=True, value="((status)::text = 'Open'::text)"),
            col("entries", "id", 1, "bigint", True, True),
            col("pg_class", "oid", 1, "oid", schema="pg_catalog"),
        ],
        COLUMNS,
    )
    constraints = spark.createDataFrame(
        [
            ("public", "lines", "pk", "p", "id", None, None, None, None, None),
            ("public", "lines", "fk", "f", "entry_id", "public", "entries", "id", "r", None),
            ("public", "lines", "xor", "c", None, None, None, None, None, "((debit = (0)::numeric) <> (credit = (0)::numeric))"),
            ("public", "lines", "ux", "u", "entry_id,status", None, None, None, None, "((status)::text = 'Open'::text)"),
        ],
        CONSTRAINTS,
    )
    spec = catalog.spec_from_catalog(columns, constraints)
    assert sorted(spec.tables) == ["public.entries", "public.lines"]
    lines = spec.tables["public.lines"]
    assert lines.primary_key == ("id",) and lines.column("id").identity
    assert lines.column("credit").default == Decimal("0.0") and lines.column("status").max_chars == 6
    assert [(fk.parent, fk.on_delete) for fk in spec.foreign_keys] == [("public.entries", "RESTRICT")]

    rows = spark.createDataFrame(
        [("1", "1", "5", "0", "Open"), ("2", "1", "0", "0", "Closed"), ("3", "1", "0", "2", "Open")],
        "id string, entry_id string, debit string, credit string, status string",
    )
    good, bad = conform(rows, lines)
    assert [r.reasons for r in bad.collect()] == [["check:xor"]]
    assert sorted((r.id, r.is_open) for r in good.collect()) == [(1, True), (3, True)]
    assert audit_unique(good, list(lines.uniques[0].columns), lines.uniques[0].where).first()["n"] == 2


def test_jdbc_options():
    s = Source("jdbc:postgresql://h/db", "jdbc", table="public.t", split_column="id", lower=0, upper=100, partitions=8)
    got = jdbc_options(s)
    assert got["partitionColumn"] == "id" and got["numPartitions"] == "8" and got["dbtable"] == "public.t"
    with pytest.raises(ValueError):
        jdbc_options(Source("jdbc:x", "jdbc", table="t", split_column="id"))


def test_parquet_source(spark, sf):
    df = read_source(spark, Source(f"{sf}/nation.parquet", columns=("n_name",)))
    assert df.columns == ["n_name"] and df.count() == 25
    with pytest.raises(ValueError, match="unknown source kind"):
        read_source(spark, Source("x", "other"))


def test_cuts_go_to_the_shared_folder(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark)
    assert before is None or root == before.rstrip("/")
    cut, got = stage_counted(spark.range(10), "test")
    assert got["rows"] == 10 and cut.inputFiles()[0].startswith(f"file://{root}/rowkeel/test-")
    assert stage(spark.range(0)).count() == 0
