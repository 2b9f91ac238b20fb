"""One report over everything a specification asks of a set of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowkeel.operators.audit import audit_fks, audit_keys
from rowkeel.operators.conform import REASONS, annotate
from rowkeel.sources.tables import union_all
from rowkeel.spec import Frames, Spec


def row_violations(frames: Frames, spec: Spec) -> DataFrame:
    """``(table_name, detail, rows)``: how many rows break each type, length, NULL or check rule."""
    parts = [
        annotate(frames[n], table).select(F.lit(n).alias("table_name"), F.explode(REASONS).alias("detail"))
        for n, table in spec.tables.items()
        if n in frames
    ]
    return union_all(parts).groupBy("table_name", "detail").agg(F.count(F.lit(1)).alias("rows"))


def audit_all(frames: Frames, spec: Spec) -> DataFrame:
    """``(kind, table_name, detail, rows)`` of every violated rule; empty when all holds."""
    rows = row_violations(frames, spec).select(F.lit("row").alias("kind"), "table_name", "detail", "rows")
    keys = audit_keys(frames, spec).select(
        F.lit("key").alias("kind"),
        "table_name",
        F.concat_ws(" where ", "key_columns", "key_where").alias("detail"),
        F.col("bad_rows").alias("rows"),
    )
    fks = audit_fks(frames, spec).select(
        F.lit("foreign key").alias("kind"),
        F.col("child").alias("table_name"),
        F.concat_ws(" -> ", "child_columns", "parent").alias("detail"),
        F.col("orphan_rows").alias("rows"),
    )
    return rows.unionByName(keys).unionByName(fks)
