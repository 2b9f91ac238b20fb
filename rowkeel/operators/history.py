"""Changes over time: snapshot comparison, locked and write-once rows, valid-time lookup."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.functions.rows import canonical_json, row_hash
from rowkeel.sources.staging import stage, stage_counted

INSERT, UPDATE, DELETE = "INSERT", "UPDATE", "DELETE"


def diff_snapshots(
    before: DataFrame,
    after: DataFrame,
    key: list[str],
    cols: list[str] | None = None,
    carry: Iterable[str] = (),
    digest: Iterable[str] = (),
    json: Iterable[str] = (),
) -> DataFrame:
    """Rows that differ between two snapshots with unique ``key``.

    Returns ``(key..., op, changed, old, new)``: ``changed`` lists the differing columns of an
    update (NULL equals NULL), ``old`` and ``new`` hold the ``carry`` columns. ``cols`` defaults to
    all non-key columns; nothing else is shuffled. Columns named in ``digest`` (long
    texts) are compared by their SHA-256, so 64 characters travel in place of the text. Columns named in ``json`` are
    compared as JSON values, likewise by a hash: blanks, the order of keys and the spelling of numbers do not matter.
    """
    cols = [c for c in before.columns if c not in key] if cols is None else list(cols)
    json = set(json)
    digest, carry = set(digest) | json, list(carry)

    def side(df: DataFrame, name: str) -> DataFrame:
        text = lambda c: canonical_json(c) if c in json else F.col(c)
        seen = [(F.sha2(text(c).cast("binary"), 256) if c in digest else F.col(c)).alias(c) for c in cols]
        kept = [F.col(c) for c in carry if c not in key and (c not in cols or c in digest)]
        compared = F.struct(*seen) if seen else F.struct(F.lit(True).alias("_row"))
        return df.select(*key, compared.alias(name), F.struct(F.lit(True).alias("_row"), *kept).alias(f"{name}_kept"))

    both = side(before, "b").join(side(after, "a"), key, "full_outer")
    changed = F.array_compact(
        F.array(*[F.when(~F.equal_null(F.col(f"b.{c}"), F.col(f"a.{c}")), c) for c in cols]).cast("array<string>")
    )
    op = (
        F.when(F.col("b").isNull(), INSERT)
        .when(F.col("a").isNull(), DELETE)
        .when(F.size(changed) > 0, UPDATE)
    )

    def carried(name: str) -> Column:
        # NULL for the missing side, not a struct of NULLs
        place = lambda c: c if c in key else f"{name}_kept.{c}" if c not in cols or c in digest else f"{name}.{c}"
        fields = [F.col(place(c)).alias(c) for c in carry]
        return F.when(F.col(name).isNotNull(), F.struct(F.lit(True).alias("_row"), *fields))

    out = both.select(
        *key,
        op.alias("op"),
        F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), changed).alias("changed"),
        carried("b").alias("old"),
        carried("a").alias("new"),
    )
    return out.where(F.col("op").isNotNull())


def _exempt_books(books: DataFrame, book_key: str, code: str, exempt_code: str) -> DataFrame:
    return books.where(F.col(code) == exempt_code).select(F.col(book_key).alias("_book"), F.lit(True).alias("_exempt"))


def audit_header_changes(
    before: DataFrame,
    after: DataFrame,
    books: DataFrame,
    key: list[str],
    status: str = "status",
    book: str = "book_id",
    free: Iterable[str] = ("reversed_by_entry_id",),
    book_key: str = "id",
    book_code: str = "code",
    exempt_code: str = "TRAINING",
) -> DataFrame:
    """Forbidden changes to ledger headers (R4), as ``(key..., op, reason)``.

    A Posted row may only turn Reversed with nothing but ``free`` columns changed along; a
    Reversed row may not change; neither may be deleted outside the exempt book.
    """
    changes = diff_snapshots(before, after, key, carry=[status, book])
    was, now = F.col(f"old.{status}"), F.col(f"new.{status}")
    frozen_changed = F.size(F.array_except("changed", F.array(*[F.lit(c) for c in [status, *free]]))) > 0
    reason = (
        F.when((F.col("op") == DELETE) & was.isin("Posted", "Reversed"), "deleted")
        .when((F.col("op") == UPDATE) & (was == "Reversed"), "reversed is locked")
        .when(
            (F.col("op") == UPDATE)
            & (was == "Posted")
            & (~F.equal_null(now, F.lit("Reversed")) | frozen_changed),
            "posted is append-only",
        )
    )
    suspects = changes.select(*key, "op", reason.alias("reason"), F.col(f"old.{book}").alias("_book"))
    suspects = suspects.where(F.col("reason").isNotNull())
    flagged = suspects.join(_exempt_books(books, book_key, book_code, exempt_code), "_book", "left")
    return flagged.where((F.col("op") != DELETE) | F.col("_exempt").isNull()).select(*key, "op", "reason")


def audit_line_changes(
    before: DataFrame,
    after: DataFrame,
    headers: DataFrame,
    books: DataFrame,
    key: list[str],
    header: list[str],
    header_key: list[str],
    status: str = "status",
    book: str = "book_id",
    book_key: str = "id",
    book_code: str = "code",
    exempt_code: str = "TRAINING",
    strict: bool = False,
) -> DataFrame:
    """Forbidden changes to ledger lines (R5), as ``(key..., op, reason)``.

    The old parent's status decides; a missing parent allows the change. ``strict`` also
    reports inserts into, and moves under, a Posted or Reversed header.
    """
    # whether a line changed is all that counts here, so a hash stands for the compared columns on the way
    compared = [c for c in before.columns if c not in key]
    hashed = lambda df: df.withColumn("_hash", row_hash(df, compared))
    changes = diff_snapshots(hashed(before), hashed(after), key, ["_hash"], carry=[*header, book])
    if strict:
        changes = stage(changes.drop("changed"), "line-changes")
    locked = headers.where(F.col(status).isin("Posted", "Reversed")).select(
        *[F.col(h).alias(f"_h{i}") for i, h in enumerate(header_key)], F.col(status).alias("_status")
    )
    places = [f"_h{i}" for i in range(len(header))]

    def under(rows: DataFrame, side: str) -> DataFrame:
        return rows.select("*", *[F.col(f"{side}.{h}").alias(p) for h, p in zip(header, places)]).join(locked, places)

    touched = under(changes.where(F.col("op").isin(UPDATE, DELETE)), "old")
    touched = touched.select(*key, "op", F.concat(F.lit("line of a "), F.col("_status"), F.lit(" header")).alias("reason"),
                             F.col(f"old.{book}").alias("_book"))
    touched = touched.join(_exempt_books(books, book_key, book_code, exempt_code), "_book", "left")
    out = touched.where((F.col("op") != DELETE) | F.col("_exempt").isNull()).select(*key, "op", "reason")
    if not strict:
        return out
    moved = F.lit(False)
    for h in header:
        moved = moved | ~F.equal_null(F.col(f"old.{h}"), F.col(f"new.{h}"))
    arrived = changes.where((F.col("op") == INSERT) | ((F.col("op") == UPDATE) & moved))
    arrived = under(arrived, "new").select(
        *key, "op", F.concat(F.lit("line put under a "), F.col("_status"), F.lit(" header")).alias("reason")
    )
    return out.unionByName(arrived)


def audit_write_once(
    before: DataFrame, after: DataFrame, key: list[str], digest: Iterable[str] = ()
) -> DataFrame:
    """Changed or removed rows of an append-only table (R6), as ``(key..., op)``."""
    return diff_snapshots(before, after, key, digest=digest).where(F.col("op") != INSERT).select(*key, "op")


def audit_locked(
    before: DataFrame,
    after: DataFrame,
    key: list[str],
    state: str,
    locked_states: Iterable[str],
    digest: Iterable[str] = (),
) -> DataFrame:
    """Changed or removed rows that were in a locked state (R6b), as ``(key..., op, state)``."""
    changes = diff_snapshots(before, after, key, carry=[state], digest=digest)
    held = F.col(f"old.{state}").isin(*locked_states)
    return changes.where((F.col("op") != INSERT) & held).select(*key, "op", F.col(f"old.{state}").alias("state"))


# ---------------------------------------------------------------------------------------------
# valid-time lookup

_BASE = 16
_LEVELS = 12


def _seconds(c: Column, kind: T.DataType) -> Column:
    """Whole seconds, in the order of ``c``; zone-less for zone-less types."""
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("bigint") * 86400
    if isinstance(kind, T.TimestampNTZType):
        day = F.unix_date(c.cast("date")).cast("bigint") * 86400
        return day + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_seconds(c)
    return c.cast("bigint")


def resolve_asof(
    facts: DataFrame,
    dim: DataFrame,
    key: list[str],
    ts: str,
    valid_from: str,
    valid_to: str,
    hot_rows: int | None = 1_000_000,
    hot_pairs: int = 100_000_000,
) -> DataFrame:
    """Facts with every dimension row valid at their time: ``from <= ts < to``, a NULL ``to`` is open.

    Keys with more than ``hot_rows`` rows on a side, or ``hot_pairs`` pairs to compare, are also split
    by time: a range of length L is filed under the time slots it covers at the level whose slots
    are about L/16 wide, and the hot facts look up their slot at each level in use. So a key
    holding a third of all rows spreads over many tasks, and facts meet only ranges near their
    time. Finding the hot keys is one pre-aggregated pass over the keys of both sides;
    ``hot_rows=None`` leaves it out.
    """
    kind = facts.schema[ts].dataType
    on_dim = [c for c in dim.columns if c not in key]
    hot = None
    if hot_rows is not None:
        hot = _hot_keys(facts, dim, key, ts, valid_from, valid_to, kind, hot_rows, hot_pairs)
    left, right, slot = facts, dim, []
    if hot is not None:
        slot = ["_level", "_slot"]
        left = facts.join(hot, key, "left").withColumn("_t", _seconds(F.col(ts), kind))
        slots = F.transform("_levels", lambda lv: F.struct(lv.alias("l"), _slot_of(F.col("_t"), lv).alias("b")))
        left = left.select(*facts.columns, F.inline(F.coalesce(slots, _everywhere())).alias(*slot))

        right = _clamped(dim.join(hot, key, "left"), valid_from, valid_to, kind)
        right = right.where(F.col("_lo").isNull() | (F.col("_from") <= F.col("_to")))
        lv = _level(F.col("_to") - F.col("_from"))
        cover = F.transform(
            F.sequence(_slot_of(F.col("_from"), lv), _slot_of(F.col("_to"), lv)),
            lambda b: F.struct(lv.alias("l"), b.alias("b")),
        )
        cover = F.when(F.col("_lo").isNull(), _everywhere()).otherwise(cover)
        right = right.select(*dim.columns, F.inline(cover).alias(*slot))

    f, d = left.alias("f"), right.alias("d")
    cond = F.col(f"d.{valid_from}") <= F.col(f"f.{ts}")
    cond = cond & (F.col(f"d.{valid_to}").isNull() | (F.col(f"f.{ts}") < F.col(f"d.{valid_to}")))
    for k in [*key, *slot]:
        cond = cond & (F.col(f"f.{k}") == F.col(f"d.{k}"))
    return f.join(d, cond).select(*[F.col(f"f.{c}") for c in facts.columns], *[F.col(f"d.{c}") for c in on_dim])


def _everywhere() -> Column:
    return F.array(F.struct(F.lit(-1).alias("l"), F.lit(0).cast("bigint").alias("b")))


def _widths() -> Column:
    return F.array(*[F.lit(_BASE**i).cast("bigint") for i in range(_LEVELS)])


def _slot_of(t: Column, level: Column) -> Column:
    return F.floor(t / F.get(_widths(), level)).cast("bigint")


def _level(length: Column) -> Column:
    """The lowest level whose slots cover ``length`` with at most 17 of them."""
    out = F.lit(_LEVELS - 1)
    for i in reversed(range(_LEVELS - 1)):
        out = F.when(length <= _BASE ** (i + 1), i).otherwise(out)
    return out


def _clamped(dim: DataFrame, valid_from: str, valid_to: str, kind: T.DataType) -> DataFrame:
    """Range ends in seconds, cut to the times at which the key has facts."""
    start = F.greatest(_seconds(F.col(valid_from), kind), F.col("_lo"))
    end = F.least(F.coalesce(_seconds(F.col(valid_to), kind), F.col("_hi")), F.col("_hi"))
    return dim.withColumns({"_from": start, "_to": end})


def _hot_keys(facts, dim, key, ts, valid_from, valid_to, kind, hot_rows, hot_pairs) -> DataFrame | None:
    """``(key..., _lo, _hi, _levels)`` of the hot keys; None when there are none."""
    t = _seconds(F.col(ts), kind)
    n = facts.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    m = dim.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"))
    # as doubles, because the product of two large counts may not fit
    pairs = F.col("_n").cast("double") * F.col("_m")
    busy = n.join(m, key).where((F.col("_n") > hot_rows) | (F.col("_m") > hot_rows) | (pairs > hot_pairs))
    busy, got = stage_counted(busy.drop("_n", "_m"), "hot-keys")
    if got["rows"] == 0:
        return None
    level = _level(F.col("_to") - F.col("_from"))
    used = (
        _clamped(dim.join(busy, key), valid_from, valid_to, kind)
        .where(F.col("_from") <= F.col("_to"))
        .groupBy(*key)
        .agg(F.collect_set(level).alias("_levels"))
    )
    # a hot key whose ranges all miss its facts has no level and so no result
    empty = F.array().cast("array<int>")
    return stage(busy.join(used, key, "left").withColumn("_levels", F.coalesce("_levels", empty)), "hot-key-levels")
