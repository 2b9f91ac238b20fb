"""Set-based constraint audits: foreign keys, unique keys, cardinality, high-water marks, differences."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.functions.rows import row_hash
from rowkeel.sources.staging import stage
from rowkeel.sources.tables import union_all
from rowkeel.spec import Frames, PolymorphicKey, Spec

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_PARENT_ROW = -1
_SLOTS = 8
_KEYS_SCHEMA = "table_name string, key_columns string, key_where string, bad_keys bigint, bad_rows bigint"
_REFERENCES_SCHEMA = "constraint string, child string, child_columns string, parent string, parent_type string, orphan_rows bigint"


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], parent_columns: list[str]) -> DataFrame:
    """Child rows whose whole non-NULL key has no parent row.

    The parentless *keys* are found and written down first, on key columns only and pre-aggregated
    before the shuffle, so a key shared by a third of all rows travels once per task. The full
    child rows are then semi-joined with the written keys: their size is known, so the rows are not
    shuffled when the keys are few, and a frequent key is split by AQE otherwise (which it
    could not do within one stage with the first join).
    """
    keys = child.select(*columns).dropna().distinct()
    parents = parent.select(*[F.col(p).alias(c) for c, p in zip(columns, parent_columns)])
    lost = stage(keys.join(parents, columns, "left_anti"), "lost-keys")
    return child.join(lost, columns, "left_semi").select(*child.columns)


def _key_type(child: T.DataType, parent: T.DataType) -> str:
    def norm(t: T.DataType) -> str:
        return "bigint" if isinstance(t, _INTEGERS) else t.simpleString()

    a, b = norm(child), norm(parent)
    if a == b:
        return a
    if isinstance(child, T.NumericType) and isinstance(parent, T.NumericType):
        return "decimal(38,10)"
    return "string"


@dataclass(frozen=True)
class _Leg:
    """One table that a key may point to; legs of a polymorphic key share its ``key`` and hold for one ``type`` each."""

    constraint: str
    child: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    shown: str
    key: PolymorphicKey | None = None
    type: str | None = None


def audit_fks(frames: Frames, spec: Spec, loaded: Iterable[str] | None = None) -> DataFrame:
    """Every foreign key whose child was loaded, with its count of orphan rows where above 0.

    Every table is scanned once, whatever number of keys it takes part in: it emits one short
    row per key value, tagged with the parent key it belongs to. One aggregation per key
    type, keyed on (parent, value) and combined before its shuffle, then sees both the children
    and the parent of each value, so no join and no broadcast is needed.
    """
    plain = replace(spec, polymorphic_keys=())
    return audit_references(frames, plain, loaded).select("child", "child_columns", "parent", "orphan_rows")


def audit_references(frames: Frames, spec: Spec, loaded: Iterable[str] | None = None) -> DataFrame:
    """:func:`audit_fks` that names the constraint and also follows polymorphic keys:
    ``(constraint, child, child_columns, parent, parent_type, orphan_rows)``.

    A polymorphic key sends every row once, to the parent that its type names, whatever the number of types. ``parent_type`` is that
    type, and NULL for a foreign key. Types that the specification does not know are reported with a NULL parent, one row per
    type. Parents that are not among ``frames`` are not checked.
    """
    wanted = set(frames) if loaded is None else set(loaded)
    legs = [
        _Leg(fk.label, fk.child, fk.columns, fk.parent, fk.parent_columns, ",".join(fk.columns))
        for fk in spec.foreign_keys
        if fk.child in wanted and fk.child in frames and fk.parent in frames
    ]
    legs += [
        _Leg(key.label, key.child, (key.id_column,), parent, (column,), f"{key.type_column},{key.id_column}", key, kind)
        for key in spec.polymorphic_keys
        for kind, parent, column in key.parents
        if key.child in wanted and key.child in frames and parent in frames
    ]
    if not legs:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], _REFERENCES_SCHEMA)

    types = {n: {f.name: f.dataType for f in frames[n].schema.fields} for leg in legs for n in (leg.child, leg.parent)}
    by_type: dict[tuple[str, ...], list[_Leg]] = defaultdict(list)
    for leg in legs:
        sig = tuple(_key_type(types[leg.child][c], types[leg.parent][p]) for c, p in zip(leg.columns, leg.parent_columns))
        by_type[sig].append(leg)
    # the unknown types of a key are looked for where its first leg is
    first = {leg.key: sig for sig, group in reversed(by_type.items()) for leg in reversed(group) if leg.key}
    return union_all([_audit_one_type(frames, group, sig, [k for k, s in first.items() if s == sig]) for sig, group in by_type.items()])


def _audit_one_type(frames: Frames, legs: list[_Leg], sig: tuple[str, ...], unknown: list[PolymorphicKey]) -> DataFrame:
    keys = [f"k{i}" for i in range(len(sig))]
    places: dict[tuple[str, tuple[str, ...]], list[_Leg]] = defaultdict(list)
    for leg in legs:
        places[(leg.parent, leg.parent_columns)].append(leg)

    emitted: dict[str, list[Column]] = defaultdict(list)
    owner: list[_Leg | None] = []
    by_kind: dict[PolymorphicKey, list[tuple[str, int, int]]] = defaultdict(list)
    # only groups with polymorphic keys carry a type
    kinds = ["kind"] if unknown else []

    def entry(tag: Column, slot: Column, values: Iterable[Column], kind: Column) -> Column:
        named = [v.cast(t).alias(k) for v, t, k in zip(values, sig, keys)]
        return F.struct(tag.alias("tag"), slot.alias("slot"), *named, *([kind.cast("string").alias("kind")] if kinds else []))

    none, tag = F.lit(None), 0
    for (parent, parent_columns), members in places.items():
        for start in range(0, len(members), _SLOTS):
            chunk = members[start : start + _SLOTS]
            emitted[parent].append(entry(F.lit(tag), F.lit(_PARENT_ROW), map(F.col, parent_columns), none))
            for slot, leg in enumerate(chunk):
                if leg.key:
                    by_kind[leg.key].append((leg.type, tag, slot))
                else:
                    emitted[leg.child].append(entry(F.lit(tag), F.lit(slot), map(F.col, leg.columns), none))
            owner += chunk + [None] * (_SLOTS - len(chunk))
            tag += 1

    for key, legs_of in by_kind.items():
        # one row per child row, whatever the number of types
        kind = F.col(key.type_column).cast("string")
        place = lambda i: F.element_at(F.create_map(*[x for leg in legs_of for x in (F.lit(leg[0]), F.lit(leg[i]))]), kind)  # noqa: E731, B023
        emitted[key.child].append(entry(place(1), place(2), [F.col(key.id_column)], none))
    for key in unknown:
        known = [F.lit(t) for t, _, _ in key.parents]
        kind, there = F.col(key.type_column).cast("string"), F.col(key.id_column).isNotNull()
        lost = ~kind.isin(*known) & there
        emitted[key.child].append(entry(F.when(lost, F.lit(tag)), F.lit(0), [none] * len(sig), kind))
        owner += [_Leg(key.label, key.child, (), "", (), f"{key.type_column},{key.id_column}", key)] + [None] * (_SLOTS - 1)
        tag += 1

    values = union_all([frames[n].select(F.inline(F.array(*entries))) for n, entries in emitted.items()])
    width = min(_SLOTS, max(len(m) for m in places.values()))
    whole = reduce(and_, [F.col(k).isNotNull() for k in keys])
    per_key = (
        values.where(F.col("tag").isNotNull() & (whole | F.col("kind").isNotNull()) if kinds else whole)
        .groupBy("tag", *keys, *kinds)
        .agg(
            F.max(F.col("slot") == _PARENT_ROW).alias("found"),
            *[F.count_if(F.col("slot") == s).alias(f"n{s}") for s in range(width)],
        )
        .where(~F.col("found"))
    )
    counts = F.array(*[F.struct(F.lit(s).alias("slot"), F.col(f"n{s}").alias("n")) for s in range(width)])
    totals = (
        per_key.select("tag", *kinds, F.inline(counts))
        .where("n > 0")
        .groupBy("tag", "slot", *kinds)
        .agg(F.sum("n").alias("orphan_rows"))
    )
    place = F.col("tag") * _SLOTS + F.col("slot")

    def label(text: Callable[[_Leg], str | None]) -> Column:
        return F.get(F.array(*[F.lit(text(leg) if leg else None).cast("string") for leg in owner]), place)

    kind = label(lambda leg: leg.type)
    return totals.select(
        label(lambda leg: leg.constraint).alias("constraint"),
        label(lambda leg: leg.child).alias("child"),
        label(lambda leg: leg.shown).alias("child_columns"),
        label(lambda leg: leg.parent or None).alias("parent"),
        (F.coalesce(kind, F.col("kind")) if kinds else kind).alias("parent_type"),
        "orphan_rows",
    )


def audit_unique(df: DataFrame, key: list[str], where: str | None = None, primary: bool = False) -> DataFrame:
    """Keys held by more than one row, ``(key..., n)`` (A2).

    Keys with a NULL part never conflict; for a primary key they are violations themselves.
    """
    rows = df if where is None else df.where(F.expr(where))
    rows = rows.select(*key)
    if not primary:
        return rows.dropna().groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    missing = F.lit(False)
    for k in key:
        missing = missing | F.col(k).isNull()
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(missing | (F.col("n") > 1))


def audit_keys(frames: Frames, spec: Spec, loaded: Iterable[str] | None = None) -> DataFrame:
    """All primary and unique keys at once: ``(table_name, key_columns, key_where, bad_keys, bad_rows)``.

    Built like :func:`audit_fks`: each table is scanned once, every row gives one short row per
    key it takes part in, and one aggregation per key type counts them.
    """
    wanted = set(frames) if loaded is None else set(loaded)
    by_type: dict[tuple[str, ...], list[tuple[str, tuple[str, ...], str | None, bool]]] = defaultdict(list)
    for name, table in spec.tables.items():
        if name not in frames or name not in wanted:
            continue
        kinds = {f.name: f.dataType for f in frames[name].schema.fields}
        keys = [(table.primary_key, None, True)] if table.primary_key else []
        keys += [(u.columns, u.where, False) for u in table.uniques]
        for columns, where, primary in keys:
            by_type[tuple(_key_type(kinds[c], kinds[c]) for c in columns)].append((name, columns, where, primary))
    if not by_type:
        spark = next(iter(frames.values())).sparkSession
        return spark.createDataFrame([], _KEYS_SCHEMA)
    return union_all([_audit_keys_of_type(frames, members, sig) for sig, members in by_type.items()])


def _audit_keys_of_type(frames: Frames, members: list, sig: tuple[str, ...]) -> DataFrame:
    keys = [f"k{i}" for i in range(len(sig))]
    emitted: dict[str, list[Column]] = defaultdict(list)
    for tag, (name, columns, where, primary) in enumerate(members):
        counts = F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))
        if not primary:
            for c in columns:
                counts = counts & F.col(c).isNotNull()
        values = [F.col(c).cast(t).alias(k) for c, t, k in zip(columns, sig, keys)]
        emitted[name].append(F.struct(F.lit(tag).alias("tag"), counts.alias("counts"), *values))
    rows = union_all([frames[n].select(F.inline(F.array(*entries))) for n, entries in emitted.items()])
    per_key = rows.where("counts").groupBy("tag", *keys).agg(F.count(F.lit(1)).alias("n"))
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    bad = per_key.where(missing | (F.col("n") > 1)).groupBy("tag")
    totals = bad.agg(F.count(F.lit(1)).alias("bad_keys"), F.sum("n").alias("bad_rows"))

    def label(texts: list[str | None]) -> Column:
        return F.get(F.array(*[F.lit(t).cast("string") for t in texts]), F.col("tag"))

    return totals.select(
        label([m[0] for m in members]).alias("table_name"),
        label([",".join(m[1]) for m in members]).alias("key_columns"),
        label([m[2] for m in members]).alias("key_where"),
        "bad_keys",
        "bad_rows",
    )


def audit_cardinality(df: DataFrame, group: list[str], pred: str, lo: int = 1, hi: int = 1) -> DataFrame:
    """Groups in which the number of rows satisfying ``pred`` is outside ``lo..hi`` (A3).

    Without group columns an empty table is one group with 0 rows.
    """
    counted = df.groupBy(*group).agg(F.count_if(F.expr(pred)).alias("n"))
    return counted.where((F.col("n") < lo) | (F.col("n") > hi))


def next_id(top: Column) -> Column:
    """The id after the high-water mark ``top``; 1 when there is none."""
    one = F.lit(1).cast("bigint")
    return F.when(top.isNull(), one).otherwise(F.greatest(top.cast("bigint"), one) + one)


def high_water(frames: Frames, identities: dict[str, list[str]]) -> DataFrame:
    """``(table_name, column_name, next_id)`` for the identity columns (A4).

    One scan per table and one pre-aggregated shuffle for all of them.
    """
    parts, none = [], []
    for name, columns in identities.items():
        ids = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("bigint").alias("id")) for c in columns]
        parts.append(frames[name].select(F.lit(name).alias("table_name"), F.inline(F.array(*ids))))
        none += [F.struct(F.lit(name).alias("table_name"), F.lit(c).alias("column_name")) for c in columns]
    # a row without an id for each column, so that an empty table has a group
    every = parts[0].sparkSession.range(1).select(F.inline(F.array(*none)))
    parts.append(every.withColumn("id", F.lit(None).cast("bigint")))
    tops = union_all(parts).groupBy("table_name", "column_name").agg(F.max("id").alias("top"))
    return tops.select("table_name", "column_name", next_id(F.col("top")).alias("next_id"))


def identities(spec: Spec) -> dict[str, list[str]]:
    found = {t.name: [c.name for c in t.columns if c.identity] for t in spec.tables.values()}
    return {n: cols for n, cols in found.items() if cols}


def reconcile(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """Rows on one side only (U1): ``side`` is MISSING (in ``a``, not in ``b``) or EXTRA.

    One aggregation over both inputs replaces the two set differences. As bags, ``copies``
    says how many more copies that side holds; rows are not repeated. Hashes of the rows meet first, so that only rows with
    a hash that is not on both sides alike are shuffled whole. A difference goes unseen only where a row that is lost and one that
    came instead share their 64 bits.
    """
    cols = a.columns
    b = b.select(*cols)
    # a hash of both sides has to mean the same
    if [f.dataType for f in a.schema.fields] == [f.dataType for f in b.schema.fields]:
        sides = a.select(row_hash(a, cols).alias("_hash"), F.lit(1).alias("_n")).union(b.select(row_hash(b, cols).alias("_hash"), F.lit(-1).alias("_n")))
        met = sides.groupBy("_hash").agg(F.count_if(F.col("_n") > 0).alias("_na"), F.count_if(F.col("_n") < 0).alias("_nb"))
        odd = stage(met.where("_na = 0 OR _nb = 0" if distinct else "_na <> _nb").select("_hash"), "odd-rows")
        a, b = (df.withColumn("_hash", row_hash(df, cols)).join(odd, "_hash", "left_semi").select(*cols) for df in (a, b))
    both = a.withColumn("_in_a", F.lit(1)).unionByName(b.withColumn("_in_a", F.lit(0)))
    counted = both.groupBy(*cols).agg(
        F.count_if(F.col("_in_a") == 1).alias("_na"), F.count_if(F.col("_in_a") == 0).alias("_nb")
    )
    side = F.when(F.col("_na") > F.col("_nb"), "MISSING").otherwise("EXTRA").alias("side")
    if distinct:
        return counted.where("_na = 0 OR _nb = 0").select(side, *cols)
    return counted.where("_na <> _nb").select(side, *cols, F.abs(F.col("_na") - F.col("_nb")).alias("copies"))
