"""Data changes: insert-if-absent, backfill, family clean-up, ids, increments, scrub rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeel.functions.rows import content_key
from rowkeel.sources.staging import stage, stage_counted
from rowkeel.spec import ForeignKey, Frames, Spec

_ROW_BITS = 33


def _keyed(key: list[str]) -> Column:
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    return known


def _one_per_key(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, the least by its other columns; rows with a NULL key never conflict and all stay."""
    rest = [c for c in df.columns if c not in key]
    known = _keyed(key)
    if not rest:
        return df.where(known).distinct().unionByName(df.where(~known))
    least = df.where(known).groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
    return least.unionByName(df.where(~known)).select(*df.columns)


def absent_rows(
    target: DataFrame, source: DataFrame, key: list[str], defaults: dict[str, object | Column] | None = None
) -> DataFrame:
    """The rows that insert-if-absent adds, shaped like the target; append these to a stored table."""
    # equal keys collapse before the join, so a frequent key does not skew it
    fresh = _one_per_key(source, key).join(target.select(*key), key, "left_anti").select(*source.columns)
    kinds = {f.name: f.dataType for f in target.schema.fields}
    given = defaults or {}
    cols = []
    for c in target.columns:
        if c in fresh.columns:
            value = F.col(c)
        else:
            d = given.get(c)
            value = d if isinstance(d, Column) else F.lit(d)
        cols.append(value.cast(kinds[c]).alias(c))
    return fresh.select(*cols)


def insert_absent(
    target: DataFrame, source: DataFrame, key: list[str], defaults: dict[str, object | Column] | None = None
) -> DataFrame:
    """The target with the source rows whose natural key it lacks."""
    return target.unionByName(absent_rows(target, source, key, defaults))


def backfill(
    target: DataFrame,
    source: DataFrame,
    on: dict[str, str],
    set_columns: dict[str, str],
    guard: str | None = None,
) -> DataFrame:
    """Set columns from the matching source row where ``guard`` holds, by default where they are NULL.

    ``on`` maps target to source key columns, ``set_columns`` target to source columns. A source
    key with several rows gives the least one.
    """
    keys = [F.col(s).alias(f"_k{i}") for i, s in enumerate(on.values())]
    given = source.select(*keys, *[F.col(s).alias(f"_v{i}") for i, s in enumerate(set_columns.values())])
    names = [f"_k{i}" for i in range(len(on))]
    given = _one_per_key(given.dropna(subset=names), names).withColumn("_hit", F.lit(True))
    cond = F.lit(True)
    for (t, _), k in zip(on.items(), names):
        cond = cond & (F.col(t) == F.col(k))
    joined = target.join(given, cond, "left")
    cols = []
    for c in target.columns:
        if c in set_columns:
            i = list(set_columns).index(c)
            may = F.col(c).isNull() if guard is None else F.expr(guard)
            cols.append(F.when(F.col("_hit") & may, F.col(f"_v{i}")).otherwise(F.col(c)).alias(c))
        else:
            cols.append(F.col(c))
    return joined.select(*cols)


def scrub_family(frames: Frames, parent: str, pred: str, fks: Sequence[ForeignKey]) -> Frames:
    """Remove the children of the flagged parents, then the parents."""
    flagged = frames[parent].where(F.expr(pred))
    out = dict(frames)
    for fk in fks:
        if fk.parent != parent or fk.child not in out:
            continue
        gone = flagged.select(*[F.col(p).alias(c) for c, p in zip(fk.columns, fk.parent_columns)])
        out[fk.child] = out[fk.child].join(gone, list(fk.columns), "left_anti").select(*out[fk.child].columns)
    out[parent] = out[parent].where(~F.coalesce(F.expr(pred), F.lit(False)))
    return out


def assign_ids(df: DataFrame, id_column: str, start: int, order_by: list[str] | None = None) -> DataFrame:
    """Number the rows from ``start`` without gaps.

    The place of every row (task, position) is written down first; the rows per task give each
    task its offset, and a row's id is offset plus position. No step sees all rows in one task, and a
    lost executor cannot renumber rows. ``order_by`` (a unique key) fixes the order.
    """
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed, "ids").withColumn("_task", F.shiftright("_place", _ROW_BITS))
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    # one row per write task, so the running sum over all of them is small
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    position = F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    out = placed.join(offsets, "_task")
    new_id = (F.lit(start).cast("bigint") + F.col("_offset") + position).alias(id_column)
    return out.select(new_id, *[c for c in df.columns if c != id_column])


def classify_increment(batch: DataFrame, ledger: DataFrame, key: list[str], content: str) -> DataFrame:
    """``(key..., checksum, state)`` of a batch against the applied ledger.

    NEW is not in the ledger, SAME has its checksum, CHANGED has another one. The ledger holds
    ``key`` and ``checksum``; only keys and checksums are shuffled. A key that the batch repeats gives one row
    per checksum; of a key that is not in the ledger the least checksum is NEW and the others are CHANGED. Rows with
    a NULL key never conflict and are all NEW.
    """
    seen = ledger.select(*key, F.col("checksum").alias("_was"), F.lit(True).alias("_known"))
    hashed = batch.select(*key, content_key(content).alias("checksum"))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("checksum"))
    once = hashed.where(_keyed(key)).distinct().withColumn("_nth", nth)
    now = once.unionByName(hashed.where(~_keyed(key)).withColumn("_nth", F.lit(1))).join(seen, key, "left")
    state = (
        F.when(F.col("_known").isNull() & (F.col("_nth") == 1), "NEW")
        .when(F.col("_known") & F.equal_null(F.col("_was"), F.col("checksum")), "SAME")
        .otherwise("CHANGED")
    )
    return now.select(*key, "checksum", state.alias("state"))


@dataclass(frozen=True)
class IncrementResult:
    """What applying a batch appends: ``rows`` to the table and ``ledger`` rows to the ledger.

    ``blocked`` means that records are pending but changes were not allowed; both are empty then.
    """

    rows: DataFrame
    ledger: DataFrame
    changed: DataFrame
    blocked: bool = False


def apply_increment(
    batch: DataFrame, ledger: DataFrame, key: list[str], content: str, allow: bool = True
) -> IncrementResult:
    """Only NEW records are applied, one per key; CHANGED ones are reported, never redone."""
    states = classify_increment(batch, ledger, key, content)
    rest = [c for c in batch.columns if c not in key]
    absent = batch.join(ledger.select(*key), key, "left_anti").select(*key, content_key(content).alias("_checksum"), *rest)
    fresh = _one_per_key(absent, key)
    blocked = not allow and not fresh.isEmpty()
    if blocked:
        fresh = fresh.where(F.lit(False))
    return IncrementResult(
        rows=fresh.select(*batch.columns),
        ledger=fresh.select(*key, F.col("_checksum").alias("checksum")),
        changed=states.where(F.col("state") == "CHANGED"),
        blocked=blocked,
    )


@dataclass(frozen=True)
class ScrubRule:
    """A named clean-up step; it must be idempotent, since every restore runs all of them."""

    name: str
    apply: Callable[[Frames], Frames]


@dataclass(frozen=True)
class ScrubOutcome:
    name: str
    table: str
    affected: int


def run_scrubs(
    frames: Frames,
    rules: Sequence[ScrubRule],
    spec: Spec | None = None,
    place: Callable[[str], str] | None = None,
) -> tuple[Frames, list[ScrubOutcome]]:
    """Run the rules in order; each is written out whole before the next starts, a failure stops.

    ``affected`` counts removed, changed and added rows: by primary key where ``spec`` gives one, else the larger of
    the rows lost and the rows gained. ``place`` names the folder a changed table is written to.
    """
    out = dict(frames)
    outcomes = []
    for rule in rules:
        result = rule.apply(dict(out))
        changed = [n for n in result if n not in out or result[n] is not out[n]]
        written = {}
        for name in changed:
            written[name], got = stage_counted(result[name], "scrub", place(name) if place else None)
            if name in out:
                outcomes.append(ScrubOutcome(rule.name, name, _affected(out[name], written[name], name, spec)))
            else:
                outcomes.append(ScrubOutcome(rule.name, name, got["rows"]))
        out = {**result, **written}
    return out, outcomes


def _affected(before: DataFrame, after: DataFrame, name: str, spec: Spec | None) -> int:
    """Keys and row hashes of both versions meet in one aggregation; whole rows are not shuffled."""
    both = [c for c in before.columns if c in after.columns]
    key = list(spec.tables[name].primary_key) if spec is not None and name in spec.tables else []
    key = key if set(key) <= set(both) else []
    # the hash passes over nulls, so their places are hashed too
    row = F.xxhash64(*both, *[F.col(c).isNull() for c in both]).alias("_row")
    sides = before.select(*key, row, F.lit(-1).alias("_n")).union(after.select(*key, row, F.lit(1).alias("_n")))
    moved = sides.groupBy(*key, "_row").agg(F.sum("_n").alias("_n")).where("_n <> 0")
    gained, lost = F.sum(F.greatest("_n", F.lit(0))), F.sum(F.greatest(-F.col("_n"), F.lit(0)))
    per_key = moved.groupBy(*key).agg(F.greatest(gained, lost).alias("_n"))
    return per_key.agg(F.sum("_n")).first()[0] or 0


__all__ = [
    "IncrementResult",
    "ScrubOutcome",
    "ScrubRule",
    "absent_rows",
    "apply_increment",
    "assign_ids",
    "backfill",
    "classify_increment",
    "insert_absent",
    "run_scrubs",
    "scrub_family",
]
