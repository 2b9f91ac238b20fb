"""Tables kept with a digest tree, so that two states are compared without reading what is equal.

A row belongs to a *bucket* by the hash of its key. The rows of a bucket lie in a folder of their own, and beside the table lies one
digest per bucket: the number of its rows and sums and exclusive-ors of two row hashes, which do not depend on the order of rows.
Digests of a level are added up to those of the level above, ``fanout`` to one. Two tables are compared from the top:
only below nodes that differ are the nodes of the next level looked at, and only rows of differing buckets are read.

A change writes the touched buckets anew and names the folders of all others again, so versions share what is equal.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.operators.audit import reconcile
from rowkeel.operators.history import diff_snapshots
from rowkeel.sources.staging import names_in, read_small_text, stage, write_if_absent
from rowkeel.sources.tables import union_all

BUCKET = "_bucket"
_SUMS = ("rows", "sum_a", "sum_b", "xor_a", "xor_b")


@dataclass(frozen=True)
class State:
    """One version: where its leaf digests are, and how rows are dealt."""

    number: int
    digests: str
    key: list[str]
    schema: str
    buckets: int
    fanout: int


def _bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _leaves(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One digest per bucket of ``rows``."""
    a, b = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    return rows.groupBy(BUCKET).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(a.cast("decimal(38,0)")).alias("sum_a"),
        F.sum(b.cast("decimal(38,0)")).alias("sum_b"),
        F.bit_xor(a).alias("xor_a"),
        F.bit_xor(b).alias("xor_b"),
    )


def level_of(leaves: DataFrame, width: int) -> DataFrame:
    """``node`` digests of ``width`` buckets each, added up from the leaves."""
    sums = [F.sum(c).alias(c) for c in ("rows", "sum_a", "sum_b")] + [F.bit_xor(c).alias(c) for c in ("xor_a", "xor_b")]
    return leaves.groupBy(F.floor(F.col(BUCKET) / width).cast("int").alias("node")).agg(*sums)


@dataclass(frozen=True)
class DigestedTable:
    """A table below ``root``: ``versions/`` (small files), ``digests/`` and ``parts/`` (rows by bucket)."""

    spark: SparkSession
    root: str

    def numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in names_in(self.spark, f"{self.root}/versions") if n.endswith(".json"))

    def state(self, number: int | None = None) -> State:
        number = max(self.numbers(), default=0) if number is None else number
        if number not in self.numbers():
            raise ValueError(f"no version {number} at {self.root}")
        return State(**json.loads(read_small_text(self.spark, f"{self.root}/versions/{number:020d}.json")))

    def leaves(self, number: int | None = None) -> DataFrame:
        """``_bucket, rows, sum_a, sum_b, xor_a, xor_b, part`` of a version; buckets without rows are absent."""
        return self.spark.read.parquet(self.state(number).digests)

    def read(self, number: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets; folders of other buckets are not listed in the scan."""
        state = self.state(number)
        schema = T.StructType.fromJson(json.loads(state.schema))
        named = self.leaves(number).select(BUCKET, "part")
        # one row per bucket
        parts: dict[str, list[int]] = defaultdict(list)
        wanted = None if buckets is None else set(buckets)
        for r in named.collect():
            if wanted is None or r[BUCKET] in wanted:
                parts[r["part"]].append(r[BUCKET])
        if not parts:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField(BUCKET, T.IntegerType())])
        frames = [self.spark.read.schema(stored).parquet(f"{self.root}/parts/{p}").where(F.col(BUCKET).isin(ids)) for p, ids in sorted(parts.items())]
        return union_all(frames).select(*schema.names)

    def _add(self, rows: DataFrame, state: State, kept: DataFrame | None, number: int) -> State:
        part, digests = uuid.uuid4().hex, f"{self.root}/digests/{uuid.uuid4().hex}"
        # buckets of very many rows are split over tasks, small ones share a task
        dealt = rows.withColumn(BUCKET, _bucket(state.key, state.buckets)).hint("rebalance", BUCKET)
        dealt.write.partitionBy(BUCKET).mode("errorifexists").parquet(f"{self.root}/parts/{part}")
        stored = T.StructType([*rows.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        written = self.spark.read.schema(stored).parquet(f"{self.root}/parts/{part}")
        leaves = _leaves(written, rows.columns).withColumn("part", F.lit(part))
        stage(leaves if kept is None else leaves.unionByName(kept), path=digests)
        made = State(number, digests, state.key, state.schema, state.buckets, state.fanout)
        if not write_if_absent(self.spark, f"{self.root}/versions/{number:020d}.json", json.dumps(asdict(made), indent=2)):
            raise RuntimeError(f"another writer made version {number} of {self.root}")
        return made

    def write(self, df: DataFrame, key: list[str], buckets: int = 256, fanout: int = 16) -> State:
        """The first version. Choose ``buckets`` so that one holds some hundred megabytes."""
        if self.numbers():
            raise FileExistsError(f"{self.root} holds a table already")
        if BUCKET in df.columns:
            raise ValueError(f"{BUCKET} is the name of the bucket column")
        return self._add(df, State(0, "", list(key), df.schema.json(), buckets, fanout), None, 1)

    def apply(self, upserts: DataFrame | None = None, deletes: DataFrame | None = None, base: int | None = None) -> State:
        """A new version with rows added or replaced by key, and others removed; only their buckets are read and written.

        ``deletes`` has the key columns. A key of both is kept as its upsert. Keys compare NULL-safe. Of two writers on
        one version the second is refused.
        """
        state = self.state(base)
        key = state.key
        names = T.StructType.fromJson(json.loads(state.schema)).names
        given = [d for d in (upserts, deletes) if d is not None]
        keys = stage(union_all([d.select(*key) for d in given]).withColumn(BUCKET, _bucket(key, state.buckets)).distinct(), "changed-keys")
        # one row per touched bucket
        touched = [r[0] for r in keys.select(BUCKET).distinct().collect()]
        old = self.read(state.number, touched)
        gone = keys.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)])
        same = F.lit(True)
        for i, k in enumerate(key):
            same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
        rows = old.join(gone, same, "left_anti")
        if upserts is not None:
            rows = rows.unionByName(upserts.select(*names))
        kept = self.leaves(state.number).where(~F.col(BUCKET).isin(touched))
        return self._add(rows, state, kept, state.number + 1)

    def damaged(self, number: int | None = None) -> list[int]:
        """Buckets whose rows no longer have the digest that was kept."""
        state = self.state(number)
        names = T.StructType.fromJson(json.loads(state.schema)).names
        now = _leaves(self.read(number).withColumn(BUCKET, _bucket(state.key, state.buckets)), names)
        return sorted(r[0] for r in _unequal(self.leaves(number).drop("part"), now, BUCKET).collect())


def _unequal(a: DataFrame, b: DataFrame, node: str) -> DataFrame:
    """Nodes whose digests differ; a node that one side lacks differs."""
    differs = F.lit(False)
    for c in _SUMS:
        differs = differs | ~F.equal_null(F.col(f"a.{c}"), F.col(f"b.{c}"))
    both = a.alias("a").join(b.alias("b"), node, "full_outer")
    return both.where(differs).select(node)


def differing_buckets(a: DigestedTable, b: DigestedTable, of_a: int | None = None, of_b: int | None = None) -> list[int]:
    """Buckets in which two versions differ, found from the root down; below equal nodes nothing is compared.

    The list is bounded by the number of buckets, which does not grow with the rows.
    """
    one, two = a.state(of_a), b.state(of_b)
    if (one.key, one.schema, one.buckets) != (two.key, two.schema, two.buckets):
        raise ValueError("the tables have different keys, columns or numbers of buckets")
    left, right = a.leaves(of_a).drop("part"), b.leaves(of_b).drop("part")
    width = 1
    while width < one.buckets:
        width *= one.fanout
    found: list[int] = [0]
    while found:
        node = F.floor(F.col(BUCKET) / (width * one.fanout)).cast("int")
        below = [side.where(node.isin(found)) for side in (left, right)]
        found = sorted(r[0] for r in _unequal(*[level_of(side, width) for side in below], "node").collect())
        if width == 1:
            return found
        width //= one.fanout
    return found


def diff_by_digest(a: DigestedTable, b: DigestedTable, of_a: int | None = None, of_b: int | None = None, **options) -> DataFrame:
    """:func:`rowkeel.operators.history.diff_snapshots` of two versions with a unique key, reading differing buckets only."""
    found = differing_buckets(a, b, of_a, of_b)
    return diff_snapshots(a.read(of_a, found), b.read(of_b, found), a.state(of_a).key, **options)


def reconcile_by_digest(a: DigestedTable, b: DigestedTable, of_a: int | None = None, of_b: int | None = None, distinct: bool = True) -> DataFrame:
    """:func:`rowkeel.operators.audit.reconcile` of two versions, reading differing buckets only."""
    found = differing_buckets(a, b, of_a, of_b)
    return reconcile(a.read(of_a, found), b.read(of_b, found), distinct)
