"""Key audits that follow changes without reading the tables again.

For every foreign key and every unique key the counts per key value are kept as a table of their own: how many child rows and how
many parent rows hold a value, or how many rows hold a unique key. Inserted rows count up and deleted ones down. A change writes
its own signed counts as one more part, reads only those earlier counts that lie in the buckets of its values, and moves the
totals by what became or ceased to be an orphan or a repeated key. The base tables are read once, when the counts are made.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.operators.audit import _key_type
from rowkeel.sources.staging import names_in, read_small_text, stage, write_if_absent
from rowkeel.sources.tables import union_all
from rowkeel.spec import Frames, Spec, Table

_COUNTS = "rule int, value string, hole boolean, children bigint, parents bigint"
_STORED = f"{_COUNTS}, _bucket int"
_TOTALS = "rule int, bad_keys bigint, bad_rows bigint"


@dataclass(frozen=True)
class _Rule:
    """One audited key: ``foreign`` (child and parent sides), ``primary`` or ``unique``."""

    kind: str
    name: str
    table: str
    columns: tuple[str, ...]
    parent: str = ""
    parent_columns: tuple[str, ...] = ()
    where: str | None = None
    types: tuple[str, ...] = ()


def _kinds(table: Table) -> dict:
    return {c.name: c.spark_type for c in table.columns}


def rules_of(spec: Spec) -> list[_Rule]:
    """The audited keys of a specification; their place in the list is their number in the counts."""
    kinds = {n: _kinds(t) for n, t in spec.tables.items()}
    out = []
    for fk in spec.foreign_keys:
        sig = tuple(_key_type(kinds[fk.child][c], kinds[fk.parent][p]) for c, p in zip(fk.columns, fk.parent_columns))
        out.append(_Rule("foreign", fk.label, fk.child, fk.columns, fk.parent, fk.parent_columns, None, sig))
    for name, t in spec.tables.items():
        keys = [("primary", t.primary_key, None)] if t.primary_key else []
        keys += [("unique", u.columns, u.where) for u in t.uniques]
        for kind, columns, where in keys:
            out.append(_Rule(kind, f"{name}({','.join(columns)})", name, columns, where=where, types=tuple(_key_type(kinds[name][c], kinds[name][c]) for c in columns)))
    return out


def signed_counts(rules: list[_Rule], inserted: Frames, deleted: Frames) -> DataFrame:
    """``rule, value, hole, children, parents`` of the changed rows, each table read once for its key columns."""

    def entry(number: int, columns: tuple[str, ...], types: tuple[str, ...], child: int, parent: int, counts: Column) -> Column:
        text = [F.col(c).cast(t).cast("string") for c, t in zip(columns, types)]
        hole = F.lit(False)
        for t in text:
            hole = hole | t.isNull()
        made = F.struct(
            F.lit(number).alias("rule"), F.to_json(F.array(*text)).alias("value"), hole.alias("hole"),
            F.lit(child).cast("bigint").alias("children"), F.lit(parent).cast("bigint").alias("parents"),
        )
        return F.when(counts, made)

    entries: dict[str, list[tuple]] = defaultdict(list)
    for number, r in enumerate(rules):
        holds = lambda columns: ~F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), F.lit(True))
        if r.kind == "foreign":
            entries[r.table].append((number, r.columns, r.types, 1, 0, holds(r.columns)))
            entries[r.parent].append((number, r.parent_columns, r.types, 0, 1, holds(r.parent_columns)))
        else:
            there = F.lit(True) if r.where is None else F.coalesce(F.expr(r.where), F.lit(False))
            entries[r.table].append((number, r.columns, r.types, 1, 0, there if r.kind == "primary" else there & holds(r.columns)))
    parts = []
    for sign, frames in ((1, inserted), (-1, deleted)):
        for name, df in frames.items():
            if entries.get(name):
                rows = F.array(*[entry(n, c, t, sign * child, sign * parent, w) for n, c, t, child, parent, w in entries[name]])
                parts.append(df.select(F.inline(F.array_compact(rows))))
    if not parts:
        spark = next(iter({**inserted, **deleted}.values())).sparkSession
        return spark.createDataFrame([], _COUNTS)
    return union_all(parts).groupBy("rule", "value", "hole").agg(F.sum("children").alias("children"), F.sum("parents").alias("parents"))


@dataclass(frozen=True)
class _State:
    parts: list[str]
    totals: str
    buckets: int


@dataclass(frozen=True)
class KeyCounts:
    """The kept counts below ``root``; :meth:`create` once, then :meth:`apply` for every change."""

    spark: SparkSession
    root: str
    spec: Spec

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in names_in(self.spark, f"{self.root}/versions") if n.endswith(".json"))

    def _state(self) -> tuple[int, _State]:
        number = max(self._versions(), default=0)
        if not number:
            raise ValueError(f"no counts at {self.root}")
        return number, _State(**json.loads(read_small_text(self.spark, f"{self.root}/versions/{number:020d}.json")))

    def _commit(self, number: int, state: _State) -> None:
        if not write_if_absent(self.spark, f"{self.root}/versions/{number:020d}.json", json.dumps(asdict(state), indent=2)):
            raise RuntimeError(f"another writer changed the counts at {self.root}")

    def _written(self, counts: DataFrame, buckets: int) -> tuple[str, DataFrame]:
        path = f"{self.root}/parts/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64("rule", "value"), F.lit(buckets)).cast("int")
        counts.where("children <> 0 OR parents <> 0").withColumn("_bucket", bucket).hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        return path, self.spark.read.schema(_STORED).parquet(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return union_all([self.spark.read.schema(_STORED).parquet(p) for p in paths])

    def _bad(self, counts: DataFrame, prefix: str = "") -> tuple[Column, Column]:
        """Bad keys (0 or 1) and bad rows of one value."""
        children, parents = F.coalesce(f"{prefix}children", F.lit(0)), F.coalesce(f"{prefix}parents", F.lit(0))
        foreign = F.col("rule").isin([i for i, r in enumerate(rules_of(self.spec)) if r.kind == "foreign"])
        bad = F.when(foreign, (children > 0) & (parents <= 0)).otherwise((children > 1) | (F.col("hole") & (children > 0)))
        return bad.cast("bigint"), F.when(bad, children).otherwise(F.lit(0)).cast("bigint")

    def create(self, frames: Frames, buckets: int = 64) -> None:
        """Count all keys of all tables, each read once. Choose ``buckets`` so that one holds some hundred megabytes of counts."""
        rules = rules_of(self.spec)
        path, counts = self._written(signed_counts(rules, frames, {}), buckets)
        keys, rows = self._bad(counts)
        totals = counts.groupBy("rule").agg(F.sum(keys).alias("bad_keys"), F.sum(rows).alias("bad_rows"))
        at = f"{self.root}/totals/{uuid.uuid4().hex}"
        stage(totals, path=at)
        self._commit(1, _State([path], at, buckets))

    def apply(self, inserted: Frames | None = None, deleted: Frames | None = None) -> None:
        """Follow inserted and deleted rows (an update is both); rows of tables outside the specification are ignored."""
        number, state = self._state()
        path, delta = self._written(signed_counts(rules_of(self.spec), inserted or {}, deleted or {}), state.buckets)
        # one row per touched bucket: the scan of earlier counts leaves out all others
        touched = [r[0] for r in delta.select("_bucket").distinct().collect()]
        value = ["_bucket", "rule", "value", "hole"]
        old = self._read(state.parts).where(F.col("_bucket").isin(touched)).join(delta.select(*value), value, "left_semi")
        old = old.groupBy(*value).agg(F.sum("children").alias("b_children"), F.sum("parents").alias("b_parents"))
        both = delta.join(old, value, "left")
        for c in ("children", "parents"):
            both = both.withColumn(f"a_{c}", F.coalesce(f"b_{c}", F.lit(0)) + F.col(c))
        (keys_before, rows_before), (keys_after, rows_after) = self._bad(both, "b_"), self._bad(both, "a_")
        moved = both.select("rule", (keys_after - keys_before).alias("bad_keys"), (rows_after - rows_before).alias("bad_rows"))
        totals = self.spark.read.schema(_TOTALS).parquet(state.totals).unionByName(moved)
        at = f"{self.root}/totals/{uuid.uuid4().hex}"
        stage(totals.groupBy("rule").agg(F.sum("bad_keys").alias("bad_keys"), F.sum("bad_rows").alias("bad_rows")), path=at)
        self._commit(number + 1, _State([*state.parts, path], at, state.buckets))

    def compact(self) -> None:
        """Add up all parts into one; values that no row holds any more go."""
        number, state = self._state()
        summed = self._read(state.parts).groupBy("rule", "value", "hole").agg(F.sum("children").alias("children"), F.sum("parents").alias("parents"))
        path, _ = self._written(summed, state.buckets)
        self._commit(number + 1, _State([path], state.totals, state.buckets))

    def _report(self, kinds: tuple[str, ...]) -> DataFrame:
        rules = rules_of(self.spec)
        totals = self.spark.read.schema(_TOTALS).parquet(self._state()[1].totals)
        wanted = totals.where((F.col("bad_rows") > 0) & F.col("rule").isin([i for i, r in enumerate(rules) if r.kind in kinds]))
        text = lambda f: F.get(F.array(*[F.lit(f(r)).cast("string") for r in rules]), F.col("rule"))
        return wanted.select(
            text(lambda r: r.name).alias("constraint"),
            text(lambda r: r.table).alias("table_name"),
            text(lambda r: ",".join(r.columns)).alias("key_columns"),
            text(lambda r: r.where).alias("key_where"),
            text(lambda r: r.parent or None).alias("parent"),
            "bad_keys",
            "bad_rows",
        )

    def orphans(self) -> DataFrame:
        """Like :func:`rowkeel.operators.audit.audit_fks` over the tables as they are now."""
        return self._report(("foreign",)).select(F.col("table_name").alias("child"), F.col("key_columns").alias("child_columns"), "parent", F.col("bad_rows").alias("orphan_rows"))

    def bad_keys(self) -> DataFrame:
        """Like :func:`rowkeel.operators.audit.audit_keys` over the tables as they are now."""
        return self._report(("primary", "unique")).select("table_name", "key_columns", "key_where", "bad_keys", "bad_rows")
