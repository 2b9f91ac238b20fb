"""The constraint specification: plain data that says what every table must satisfy.

Nothing here touches Spark data; operators read it to build DataFrame plans.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

Frames = dict[str, DataFrame]

CASCADE = "CASCADE"
SET_NULL = "SET NULL"
SET_DEFAULT = "SET DEFAULT"
RESTRICT = "RESTRICT"
NO_ACTION = "NO ACTION"


@dataclass(frozen=True)
class Column:
    """One column. ``kind`` is a Spark DDL type string such as ``decimal(18,4)``."""

    name: str
    kind: str
    nullable: bool = True
    default: object = None
    max_chars: int | None = None
    generated: str | None = None
    identity: bool = False
    json: bool = False
    dims: int | None = None
    #: ``uuid``, ``time`` or ``time zone`` for text that has to have that form; it is kept in the database's own spelling.
    format: str | None = None
    #: Digits beyond the scale are a violation instead of being rounded, for numbers that are unbounded at their source.
    exact: bool = False

    @property
    def spark_type(self) -> T.DataType:
        return T.DataType.fromDDL(self.kind)


@dataclass(frozen=True)
class Unique:
    """A unique key, over the whole table or over the rows where ``where`` holds."""

    columns: tuple[str, ...]
    where: str | None = None
    name: str | None = None


@dataclass(frozen=True)
class Check:
    """A row condition; rows where it is NULL pass."""

    name: str
    expr: str


@dataclass(frozen=True)
class ForeignKey:
    """``child(columns)`` must exist in ``parent(parent_columns)`` unless a part is NULL."""

    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = NO_ACTION
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.child}({','.join(self.columns)})->{self.parent}"


@dataclass(frozen=True)
class PolymorphicKey:
    """``child(type_column, id_column)`` names a row of the table that belongs to its type, unless either part is NULL.

    ``parents`` has ``(type, table, key column)`` for every known type; types are compared as they are, case included.
    """

    child: str
    type_column: str
    id_column: str
    parents: tuple[tuple[str, str, str], ...]
    name: str | None = None

    @property
    def label(self) -> str:
        return self.name or f"{self.child}({self.type_column},{self.id_column})"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[Unique, ...] = ()
    checks: tuple[Check, ...] = ()

    def column(self, name: str) -> Column:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(f"{self.name} has no column {name}")

    @property
    def stored_columns(self) -> tuple[Column, ...]:
        """Columns that travel in a dump; generated ones are computed after the load."""
        return tuple(c for c in self.columns if c.generated is None)

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.columns])

    @property
    def stored_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.spark_type, True) for c in self.stored_columns])


@dataclass(frozen=True)
class Spec:
    tables: dict[str, Table]
    foreign_keys: tuple[ForeignKey, ...] = field(default_factory=tuple)
    polymorphic_keys: tuple[PolymorphicKey, ...] = field(default_factory=tuple)

    @classmethod
    def of(cls, tables: Iterable[Table], foreign_keys: Iterable[ForeignKey] = (), polymorphic_keys: Iterable[PolymorphicKey] = ()) -> Spec:
        by_name = {t.name: t for t in tables}
        fks, pks = tuple(foreign_keys), tuple(polymorphic_keys)
        for pk in pks:
            if len({t for t, _, _ in pk.parents}) < len(pk.parents):
                raise ValueError(f"{pk.label}: a type names two parents")
            for name in (pk.child, *(p for _, p, _ in pk.parents)):
                if name not in by_name:
                    raise ValueError(f"{pk.label}: unknown table {name}")
        for fk in fks:
            if len(fk.columns) != len(fk.parent_columns):
                raise ValueError(f"{fk.label}: child and parent key widths differ")
            for name in (fk.child, fk.parent):
                if name not in by_name:
                    raise ValueError(f"{fk.label}: unknown table {name}")
        return cls(by_name, fks, pks)

    def into(self, parent: str) -> list[ForeignKey]:
        return [fk for fk in self.foreign_keys if fk.parent == parent]

    def out_of(self, child: str) -> list[ForeignKey]:
        return [fk for fk in self.foreign_keys if fk.child == child]

    def referencing_closure(self, names: Iterable[str]) -> set[str]:
        """Every table that reaches one of ``names`` through foreign keys, without ``names``."""
        start = set(names)
        seen = set(start)
        todo = list(start)
        while todo:
            for fk in self.into(todo.pop()):
                if fk.child not in seen:
                    seen.add(fk.child)
                    todo.append(fk.child)
        return seen - start

    def with_foreign_keys(self, fks: Iterable[ForeignKey]) -> Spec:
        return replace(self, foreign_keys=tuple(fks))
