"""Audits of validity ranges (J6): which ranges of a key overlap, where are gaps, and what is covered.

Ranges are half-open, ``from <= t < to``, and a NULL ``to`` is open. All operators sweep over the starts of the ranges of a
key and compare each with the furthest end so far. Rows are ordered once by range partitioning on (key, start, end),
so a key with very many ranges is split by time over many tasks; what an earlier task has reached is one value per (key, task)
and is carried into the later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowkeel.sources.staging import stage

_BEFORE = (Window.unboundedPreceding, -1)


def _end(to: Column) -> Column:
    """An end that sorts open ranges last."""
    return F.struct(to.isNull().alias("open"), to.alias("at"))


def _swept(df: DataFrame, key: list[str], valid_from: str, valid_to: str) -> DataFrame:
    """``key..., _from, _end, _copies, _reach``: each distinct range that holds some time, and the furthest end before it.

    Equal ranges are counted before the shuffle, so that a range that a third of all rows repeat is one row.
    """
    rows = df.dropna(subset=[*key, valid_from]).where(F.col(valid_to).isNull() | (F.col(valid_from) < F.col(valid_to)))
    once = rows.groupBy(*key, F.col(valid_from).alias("_from"), _end(F.col(valid_to)).alias("_end")).agg(F.count(F.lit(1)).alias("_copies"))
    order = [*key, "_from", "_end"]
    # the task of a row is written down, so that a repeated task cannot deal rows anew
    dealt = stage(once.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()), "ranges")
    per_task = dealt.groupBy(*key, "_task").agg(F.max("_end").alias("_most"))
    earlier = F.max("_most").over(Window.partitionBy(*key).orderBy("_task").rowsBetween(*_BEFORE))
    carried = per_task.withColumn("_carried", earlier).where(F.col("_carried").isNotNull()).drop("_most")
    own = F.max("_end").over(Window.partitionBy(*key, "_task").orderBy("_from", "_end").rowsBetween(*_BEFORE))
    reached = dealt.withColumn("_own", own).join(carried, [*key, "_task"], "left")
    return reached.select(*order, "_copies", F.greatest("_own", "_carried").alias("_reach"))


def audit_ranges(df: DataFrame, key: list[str], valid_from: str, valid_to: str, kinds: tuple[str, ...] = ("overlap", "gap", "empty")) -> DataFrame:
    """What is wrong with the ranges of every key: ``(key..., kind, starts_at, ends_at, ranges)``.

    ``overlap``: that time belongs to ``ranges`` rows and to one that starts earlier (or is equal); one row per distinct range that meets
    an earlier one. ``gap``: no range holds that time, although one ends before it and one starts after it.
    ``empty``: a range that holds no time or has no start; its ends stand as they are. A NULL end is open. Rows
    with a NULL in the key belong to no key and are left out.
    """
    swept = _swept(df, key, valid_from, valid_to)
    start, end, reach, copies = F.col("_from"), F.col("_end"), F.col("_reach"), F.col("_copies")
    met = reach.isNotNull() & (reach["open"] | (start < reach["at"]))

    def found(kind: str, first: Column, last: Column, n: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), first.alias("starts_at"), last.alias("ends_at"), n.alias("ranges"))

    hits = F.array(
        F.when(met, found("overlap", start, F.least(end, reach)["at"], copies)).when(
            copies > 1, found("overlap", start, end["at"], copies - 1)
        ),
        F.when(reach.isNotNull() & ~reach["open"] & (reach["at"] < start), found("gap", reach["at"], start, F.lit(0).cast("bigint"))),
    )
    out = swept.select(*key, F.inline(F.filter(hits, lambda h: h.isNotNull() & h["kind"].isin(*kinds))))
    if "empty" not in kinds:
        return out
    none = df.dropna(subset=key).where(F.col(valid_from).isNull() | (F.col(valid_from) >= F.col(valid_to)))
    none = none.groupBy(*key, F.col(valid_from).alias("starts_at"), F.col(valid_to).alias("ends_at")).agg(F.count(F.lit(1)).alias("ranges"))
    return out.unionByName(none.withColumn("kind", F.lit("empty")))


def covered(df: DataFrame, key: list[str], valid_from: str, valid_to: str) -> DataFrame:
    """The time that the ranges of a key hold together, as few ranges as possible: ``(key..., from, to, ranges)``.

    Ranges that touch become one; ``ranges`` counts the rows that went into it. Runs are numbered like places in
    :func:`audit_ranges`: by the breaks before a row in its task, and the breaks of earlier tasks.
    """
    swept = _swept(df, key, valid_from, valid_to)
    reach = F.col("_reach")
    breaks = reach.isNull() | (~reach["open"] & (reach["at"] < F.col("_from")))
    # every row of a run knows where the run starts: the last break at or before it
    starts = swept.where(breaks).select(*key, F.col("_from").alias("_run"))
    marked = swept.select(*key, "_from", "_end", "_copies").unionByName(
        starts.select(*key, F.col("_run").alias("_from"), F.lit(None).cast(swept.schema["_end"].dataType).alias("_end"), F.lit(0).cast("bigint").alias("_copies"))
    )
    dealt = stage(marked.repartitionByRange(*key, "_from").withColumn("_task", F.spark_partition_id()), "runs")
    is_break = F.col("_end").isNull()
    last = F.max(F.when(is_break, F.col("_from")))
    per_task = dealt.groupBy(*key, "_task").agg(last.alias("_last"))
    before = F.max("_last").over(Window.partitionBy(*key).orderBy("_task").rowsBetween(*_BEFORE))
    carried = per_task.withColumn("_carried", before).where(F.col("_carried").isNotNull()).drop("_last")
    own = last.over(Window.partitionBy(*key, "_task").orderBy("_from"))
    runs = dealt.withColumn("_own", own).join(carried, [*key, "_task"], "left").withColumn("_run", F.coalesce("_own", "_carried"))
    whole = runs.where(~is_break).groupBy(*key, "_run").agg(F.max("_end").alias("_end"), F.sum("_copies").alias("ranges"))
    return whole.select(*key, F.col("_run").alias(valid_from), F.col("_end.at").alias(valid_to), "ranges")
