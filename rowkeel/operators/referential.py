"""Deleting a set of rows and following its foreign keys.

Every deleted row has a *level*: 0 for the rows that were asked for, and one more than the lowest level of a row that it
cascades from. Levels are found table by table, in the order in which deletes can reach them: the tables that cascades
reach form a graph, and each of its strongly connected parts is finished before the next one starts. A table that refers to
itself is closed by pointer doubling: a row looks at its ancestors 1, 2, 4, ... steps up, so a chain of a thousand rows takes
eleven rounds. Only several tables that refer to each other in a circle are walked round by round.

With all levels written down, one pass over the key columns of every table counts what is deleted and nulled, and what
RESTRICT and NO ACTION forbid.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowkeel.sources.staging import stage, stage_counted
from rowkeel.sources.tables import union_all
from rowkeel.spec import CASCADE, NO_ACTION, RESTRICT, SET_DEFAULT, SET_NULL, ForeignKey, Frames, Spec

_FIXED = "SET NULL on a NOT NULL column"


@dataclass(frozen=True)
class DeleteResult:
    """``frames`` are unchanged when ``blocked``; ``report`` is ``(table_name, action, rows)``.

    ``rounds`` has the rounds that keys within one table, or within a circle of tables, took.
    """

    frames: Frames
    report: DataFrame
    blocked: bool
    rounds: dict[str, int] = field(default_factory=dict)


def _referenced_columns(fks: list[ForeignKey], table: str) -> list[str]:
    return list(dict.fromkeys(c for fk in fks if fk.parent == table for c in fk.parent_columns))


def deletion_order(start: str, cascades: list[ForeignKey]) -> list[list[str]]:
    """The tables that deletes from ``start`` can reach, parents first; tables that reach one another stand together."""
    below: dict[str, list[str]] = defaultdict(list)
    for fk in cascades:
        below[fk.parent].append(fk.child)

    def reached(table: str) -> set[str]:
        seen, todo = {table}, [table]
        while todo:
            for child in below[todo.pop()]:
                if child not in seen:
                    seen.add(child)
                    todo.append(child)
        return seen

    names = reached(start)
    reach = {n: reached(n) for n in names}
    parts = {frozenset(m for m in reach[n] if n in reach[m]) for n in names}
    # whoever reaches more parts comes first
    return [sorted(p) for p in sorted(parts, key=lambda p: (-len(reach[min(p)]), min(p)))]


def _keys_of(fk: ForeignKey, rows: DataFrame, step: int) -> DataFrame:
    """The parent keys of ``rows`` under the child's names, each with its lowest level and ``step``."""
    cols = [F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)]
    found = rows.where(F.col("_level").isNotNull()).select(*cols, "_level").dropna()
    return found.groupBy(*fk.columns).agg((F.min("_level") + step).cast("int").alias("_level"))


def _closed(state: DataFrame, fk: ForeignKey) -> tuple[DataFrame, int, bool]:
    """``state`` with the levels that come down a key of the table to itself, the rounds taken, and whether any level changed.

    After round i every row knows the lowest level that an ancestor less than 2^i steps up gives it, and points at its ancestor 2^i
    steps up. A round that changes nothing is the last: what comes from further up would have changed a row on the way. Rows
    that have come to the top of their chain without a level are no longer looked at.
    """
    columns = state.columns
    ups = [f"_up{i}" for i in range(len(fk.columns))]
    rows = state.select("*", *[F.col(c).alias(u) for c, u in zip(fk.columns, ups)])
    rounds, changed = 0, False
    while True:
        there = F.lit(True)
        for u in ups:
            there = there & F.col(u).isNotNull()
        seen = rows.where(F.col("_level").isNotNull() | there).dropna(subset=list(fk.parent_columns))
        above = seen.select(
            *[F.col(p).alias(u) for p, u in zip(fk.parent_columns, ups)], *[F.col(u).alias(f"_next{u}") for u in ups], F.col("_level").alias("_from")
        ).distinct()
        climbing = rows.where(there).join(above, ups, "left")
        level = F.least("_level", (F.col("_from") + F.lit(1 << min(rounds, 30))).cast("int"))
        moved = climbing.select(
            *[c for c in columns if c != "_level"],
            level.alias("_level"),
            *[F.col(f"_next{u}").alias(u) for u in ups],
            (~F.equal_null(level, F.col("_level"))).alias("_new"),
        )
        done = rows.where(~there).withColumn("_new", F.lit(False))
        rows, got = stage_counted(moved.unionByName(done), "levels", new=F.count_if("_new"))
        rows, rounds = rows.drop("_new"), rounds + 1
        if not got["new"]:
            return rows.select(*columns), rounds, changed
        changed = True


def delete_where(frames: Frames, table: str, pred: str, spec: Spec) -> DeleteResult:
    """Delete the rows of ``table`` satisfying ``pred`` with every referential action.

    Only key columns are read until the surviving rows are made. RESTRICT counts rows that are not deleted at the level
    of their parent or before; NO ACTION counts what is left at the end; a row that is both nulled and deleted counts as deleted.
    SET DEFAULT gives the column its default; whether that names a row is for an audit to say.
    Keys that are referred to are unique, as SQL asks for.
    """
    fks = [fk for fk in spec.foreign_keys if fk.child in frames and fk.parent in frames]
    cascades = [fk for fk in fks if fk.on_delete == CASCADE]
    root = F.coalesce(F.expr(pred), F.lit(False))
    marks: dict[ForeignKey, DataFrame] = {}
    rounds: dict[str, int] = {}

    for part in deletion_order(table, cascades):
        inside = [fk for fk in cascades if fk.child in part and fk.parent in part]
        states: dict[str, tuple[DataFrame, int]] = {}
        for name in part:
            wanted = _referenced_columns(fks, name)
            wanted += [c for fk in inside if fk.child == name for c in fk.columns if c not in wanted]
            if not wanted:
                continue
            hits = [(fk, marks[fk]) for fk in cascades if fk.child == name and fk in marks]
            found = _first_levels(frames[name], root if name == table else None, hits, wanted, bool(inside))
            states[name] = _counted(found)
        if inside and any(n for _, n in states.values()):
            rounds["+".join(part)] = _settle(states, inside)
        for name, (rows, n) in states.items():
            for fk in fks:
                if fk.parent == name and n:
                    # written once, so that adaptive execution can split a key, or the NULLs, that hold a large share of the child
                    marks[fk] = stage(_keys_of(fk, rows, 0 if fk.on_delete != CASCADE else 1), "marks")

    touched = [n for n in frames if n == table or any(fk.child == n for fk in marks)]
    flagged = {n: [fk for fk in fks if fk.child == n and fk in marks] for n in touched}
    counts = union_all([_counts(frames[n], n, root if n == table else None, flagged[n], marks, spec) for n in touched])
    if any(_may_forbid(fk, spec) for fk in marks):
        # a few rows per table
        counts = stage(counts, "counts")
        forbidden = counts.where(~F.col("action").isin("deleted", "nulled", "defaulted"))
        if not forbidden.isEmpty():
            return DeleteResult(frames, forbidden, True, rounds)
    out = dict(frames)
    for n in touched:
        by = lambda action: [(fk, marks[fk].drop("_level")) for fk in flagged[n] if fk.on_delete == action]  # noqa: E731, B023
        cleared = [*((fk, keys, {}) for fk, keys in by(SET_NULL)), *((fk, keys, _defaults(fk, spec)) for fk, keys in by(SET_DEFAULT))]
        out[n] = _survivors(frames[n], root if n == table else None, by(CASCADE), cleared)
    return DeleteResult(out, counts, False, rounds)


def _defaults(fk: ForeignKey, spec: Spec) -> dict[str, Column]:
    found = [spec.tables[fk.child].column(c) for c in fk.columns]
    return {c.name: F.lit(c.default).cast(c.spark_type) for c in found}


def _may_forbid(fk: ForeignKey, spec: Spec) -> bool:
    """Whether rows that point at deleted ones may stop the delete."""
    if fk.on_delete == SET_DEFAULT:
        found = [spec.tables[fk.child].column(c) for c in fk.columns]
        return any(c.default is None and not c.nullable for c in found)
    if fk.on_delete == SET_NULL:
        return not all(spec.tables[fk.child].column(c).nullable for c in fk.columns)
    return fk.on_delete in (RESTRICT, NO_ACTION)


def _first_levels(df: DataFrame, own: Column | None, hits: list[tuple[ForeignKey, DataFrame]], wanted: list[str], whole: bool) -> DataFrame:
    """``wanted`` columns and ``_level`` of the rows that ``own`` or the finished tables reach; with ``whole`` of all rows."""
    parts = [] if own is None else [df.where(own).select(*wanted, F.lit(0).alias("_level"))]
    for fk, keys in hits:
        need = list(dict.fromkeys([*fk.columns, *wanted]))
        parts.append(df.select(*need).join(keys, list(fk.columns)).select(*wanted, "_level"))
    if whole:
        parts.append(df.select(*wanted, F.lit(None).cast("int").alias("_level")))
    if not parts:
        return df.limit(0).select(*wanted, F.lit(0).alias("_level"))
    return union_all(parts).groupBy(*wanted).agg(F.min("_level").alias("_level"))


def _counted(found: DataFrame) -> tuple[DataFrame, int]:
    written, got = stage_counted(found, "doomed", levels=F.count("_level"))
    return written, got["levels"]


def _settle(states: dict[str, tuple[DataFrame, int]], inside: list[ForeignKey]) -> int:
    """Bring the levels of one part of the key graph to rest; returns the rounds."""
    rounds, going = 0, True
    own = {n: [fk for fk in inside if fk.child == fk.parent == n] for n in states}
    while going:
        going = False
        for name, keys in own.items():
            for fk in keys:
                if states[name][1]:
                    closed, took, changed = _closed(states[name][0], fk)
                    rounds += took
                    states[name] = _counted(closed) if changed else states[name]
                    # another key of the table may go on from here
                    going |= changed and len(keys) > 1
        for fk in inside:
            if fk.child != fk.parent and states[fk.parent][1]:
                rounds += 1
                above = stage(_keys_of(fk, states[fk.parent][0], 1), "marks").withColumnRenamed("_level", "_from")
                rows = states[fk.child][0].join(above, list(fk.columns), "left")
                level = F.least("_level", "_from")
                rows = rows.withColumn("_new", ~F.equal_null(level, F.col("_level"))).withColumn("_level", level)
                written, got = stage_counted(rows.select(*states[fk.child][0].columns, "_new"), "doomed", levels=F.count("_level"), new=F.count_if("_new"))
                if got["new"]:
                    states[fk.child], going = (written.drop("_new"), got["levels"]), True
    return rounds


def _mark(df: DataFrame, keys: list[tuple[str, ForeignKey, DataFrame]]) -> DataFrame:
    """Add one boolean column per foreign key: does the row point at one of its keys?"""
    for flag, fk, gone in keys:
        hit = gone.withColumn(flag, F.lit(True))
        df = df.join(hit, list(fk.columns), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    return df


def _survivors(df: DataFrame, own: Column | None, gone_by, null_by) -> DataFrame:
    out = df if own is None else df.where(~own)
    for fk, keys in gone_by:
        out = out.join(keys, list(fk.columns), "left_anti")
    flags = [(f"_null{i}", fk, keys) for i, (fk, keys, _) in enumerate(null_by)]
    out = _mark(out, flags)
    cleared: dict[str, Column] = {}
    for (flag, fk, _), (_, _, defaults) in zip(flags, null_by):
        for c in fk.columns:
            cleared[c] = F.when(~F.col(flag), cleared.get(c, F.col(c))).otherwise(defaults.get(c, F.lit(None)))
    return out.select(*[cleared[c].alias(c) if c in cleared else F.col(c) for c in df.columns])


def _counts(df: DataFrame, name: str, own: Column | None, fks: list[ForeignKey], marks: dict[ForeignKey, DataFrame], spec: Spec) -> DataFrame:
    """Rows deleted, nulled and forbidden of one table, in one pass over its key columns."""
    need = list(dict.fromkeys(c for fk in fks for c in fk.columns))
    rows = df.select(F.when(F.lit(False) if own is None else own, F.lit(0)).alias("_own"), *need)
    up = {}
    for i, fk in enumerate(fks):
        up[fk] = F.col(f"_up{i}")
        rows = rows.join(marks[fk].withColumnRenamed("_level", f"_up{i}"), list(fk.columns), "left")
    none = F.lit(None).cast("int")
    level = F.least(F.col("_own"), none, *[up[fk] for fk in fks if fk.on_delete == CASCADE])
    stays = level.isNull()
    nulled, defaulted, forbidden = F.lit(False), F.lit(False), defaultdict(list)
    for fk in fks:
        hit = up[fk].isNotNull()
        if fk.on_delete in (SET_NULL, SET_DEFAULT):
            nulled, defaulted = (nulled | hit, defaulted) if fk.on_delete == SET_NULL else (nulled, defaulted | hit)
            if _may_forbid(fk, spec):
                forbidden[_FIXED].append(hit & stays)
        elif fk.on_delete == RESTRICT:
            forbidden[RESTRICT].append(hit & (stays | (level > up[fk])))
        elif fk.on_delete == NO_ACTION:
            forbidden[NO_ACTION].append(hit & stays)
    counted = {"deleted": [~stays], "nulled": [nulled & stays], "defaulted": [defaulted & stays], **forbidden}
    # a row that breaks two keys counts twice
    sums = [sum((F.count_if(c) for c in found[1:]), F.count_if(found[0])) for found in counted.values()]
    one = rows.agg(*[s.alias(f"n{i}") for i, s in enumerate(sums)])
    pairs = F.array(*[F.struct(F.lit(a).alias("action"), F.col(f"n{i}").alias("rows")) for i, a in enumerate(counted)])
    return one.select(F.lit(name).alias("table_name"), F.inline(pairs)).where("rows > 0")
