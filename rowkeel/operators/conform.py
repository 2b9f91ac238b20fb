"""Fitting rows to a table specification: alignment, renames, defaults, types and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.functions.rows import exceeds_scale, time_text, uuid_text, valid_json
from rowkeel.sources.copytext import decode_value
from rowkeel.spec import Column as ColumnSpec
from rowkeel.spec import Frames, Table

REASONS = "_reasons"


def rename(frames: Frames, tables: dict[str, str], columns: dict[str, dict[str, str]] | None = None) -> Frames:
    """Guarded renames (P6): a name that is not there is skipped; columns are keyed by the new table name."""
    out = {tables.get(n, n) if tables.get(n, n) not in frames else n: df for n, df in frames.items()}
    for name, cmap in (columns or {}).items():
        if name in out:
            present = set(out[name].columns)
            out[name] = out[name].withColumnsRenamed(
                {old: new for old, new in cmap.items() if old in present and new not in present}
            )
    return out


def add_generated(df: DataFrame, table: Table) -> DataFrame:
    """Stored generated columns, computed from the loaded ones (P5)."""
    made = {c.name: F.expr(c.generated).cast(c.spark_type) for c in table.columns if c.generated is not None}
    df = df.withColumns(made) if made else df
    return df.select(*[F.col(f"`{c.name}`") for c in table.columns], *[F.col(c) for c in df.columns if c == REASONS])


def align(df: DataFrame, table: Table, generate: bool = True) -> tuple[DataFrame | None, list[str]]:
    """Keep the columns both sides know, fill new ones with their default.

    Returns ``(frame, dropped columns)``; the frame is None when nothing is in common.
    """
    stored = {c.name: c for c in table.stored_columns}
    common = [c for c in df.columns if c in stored]
    dropped = [c for c in df.columns if c not in stored]
    if not common:
        return None, dropped
    cols = []
    for c in table.stored_columns:
        if c.name in common:
            cols.append(F.col(f"`{c.name}`"))
        else:
            cols.append(F.lit(c.default).cast(c.spark_type).alias(c.name))
    out = df.select(*cols)
    return (add_generated(out, table) if generate else out), dropped


def resolve_default(df: DataFrame, fk: str, parent: DataFrame, parent_key: str, default_pred: str) -> DataFrame:
    """A NULL key stands for the one default row of the parent.

    The default key is a scalar subquery: one value, and an error if several rows claim to be it.
    """
    default = parent.where(F.expr(default_pred)).select(parent_key).scalar()
    return df.withColumn(fk, F.coalesce(F.col(fk), default))


def partial_rows(df: DataFrame, predicate: str) -> DataFrame:
    """The row subset of a partial index."""
    return df.where(F.expr(predicate))


def partial_counts(df: DataFrame, predicates: list[str]) -> DataFrame:
    """``(predicate, rows)``: the sizes of several partial indexes, counted in one scan."""
    counts = df.agg(*[F.count_if(F.expr(p)).alias(f"_{i}") for i, p in enumerate(predicates)])
    lines = [F.struct(F.lit(p).alias("predicate"), F.col(f"_{i}").alias("rows")) for i, p in enumerate(predicates)]
    return counts.select(F.inline(F.array(*lines)))


def _typed(raw: Column, have: T.DataType, c: ColumnSpec) -> Column:
    want = c.spark_type
    if have == want:
        out = raw
    elif isinstance(have, T.StringType):
        out = decode_value(raw, want)
    else:
        out = raw.try_cast(want)
    if c.format is not None:
        out = uuid_text(out) if c.format == "uuid" else time_text(out, c.format == "time zone")
    if c.max_chars is not None:
        # blanks beyond the limit are cut silently, anything else is a violation
        out = F.when(F.char_length(out) > c.max_chars, F.left(out, F.lit(c.max_chars))).otherwise(out)
    return out


def _reasons(raw: Column, typed: Column, c: ColumnSpec, not_null: bool) -> list[Column]:
    found = [F.when(raw.isNotNull() & typed.isNull(), f"{'format' if c.format else 'type'}:{c.name}")]
    if c.exact and isinstance(c.spark_type, T.DecimalType):
        found.append(F.when(exceeds_scale(raw.cast("string"), typed, c.spark_type.scale), f"scale:{c.name}"))
    if not_null:
        found.append(F.when(raw.isNull(), f"null:{c.name}"))
    if c.max_chars is not None:
        too_long = (F.char_length(raw) > c.max_chars) & (F.char_length(F.rtrim(raw)) > c.max_chars)
        found.append(F.when(too_long, f"length:{c.name}"))
    if c.json:
        found.append(F.when(~valid_json(typed), f"json:{c.name}"))
    if c.dims is not None:
        found.append(F.when(F.size(typed) != c.dims, f"dims:{c.name}"))
    return found


def annotate(df: DataFrame, table: Table) -> DataFrame:
    """Typed columns of ``table`` plus ``_reasons``, the codes of everything wrong with the row."""
    have = {f.name: f.dataType for f in df.schema.fields}
    typed, reasons = [], []
    for c in table.stored_columns:
        raw = F.col(f"`{c.name}`")
        value = _typed(raw, have[c.name], c)
        typed.append(value.alias(c.name))
        reasons += _reasons(raw, value, c, not c.nullable or c.name in table.primary_key)
    out = df.select(*typed, F.array_compact(F.array(*reasons)).alias(REASONS))
    if table.checks:
        broken = [F.when(~F.coalesce(F.expr(k.expr), F.lit(True)), f"check:{k.name}") for k in table.checks]
        out = out.withColumn(REASONS, F.concat(F.col(REASONS), F.array_compact(F.array(*broken))))
    return add_generated(out, table)


def conform(df: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Split into rows that fit the table, typed, and rows that do not, with reason codes."""
    marked = annotate(df, table)
    good = marked.where(F.size(REASONS) == 0).drop(REASONS)
    bad = marked.where(F.size(REASONS) > 0).withColumnRenamed(REASONS, "reasons")
    return good, bad
