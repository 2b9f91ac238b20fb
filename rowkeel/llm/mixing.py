"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its rows, about ``BLOCK_WORDS`` words each. Its target is a number of whole
passes over the source and a rest; the rest is a prefix of the source's blocks in a permuted order, and of the
rows in the block where it ends. That makes an exact quota of block draws per source. A binary tree over the output shards
splits the quotas: at each node the left half's blocks are drawn without replacement from the node's, source by source.
Each shard ends with a number of draws per source, takes the next such run of permuted blocks, and orders its rows by
a hash. All draws depend on the seed and the rows only, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkeel.llm.common import WORD, table, text_of
from rowkeel.sources.staging import stage

#: Words of a block, blocks of an output shard, blocks of a slice when the end of a rest is searched.
BLOCK_WORDS, SHARD_BLOCKS, SLICE_BLOCKS = 20_000, 64, 1024
#: Orders tried in the block where a rest ends.
LAST_ORDERS = 16
#: A recipe is written by people and held by the driver; a table with more sources than this is refused.
MOST_SOURCES = 100_000


def words_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def repeating_weights(n: int) -> list[float]:
    """5, 2, 1, repeating, for sources by code point, null last."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(n)]


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of all words by weight, none above ``most`` times its source; the excess is shared again until none is above."""
    out = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes)) if sizes[i]], float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > most * sizes[i]] if total else []
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total if total else 0.0
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(most * sizes[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


@dataclass
class Part:
    """One source of a recipe; ``steps`` are the permutations of its passes: position = (a * block + c) mod blocks."""

    number: int
    source: str | None
    size: int
    target: float
    blocks: int
    full: int
    steps: list[tuple[int, int]]
    #: where the rest ends: blocks taken whole, and of the next one the rows up to ``cut`` in one of several orders (none if None)
    whole: int = 0
    order: int = 0
    cut: int | None = None

    @property
    def draws(self) -> int:
        return self.full * self.blocks + self.whole + (self.cut is not None)


def _key(docs: DataFrame, seed: int) -> Column:
    parts = [F.col("doc_id")] if "doc_id" in docs.columns else []
    return F.xxhash64(F.lit(seed), *parts, F.col("source"), F.col("text"))


def sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """``source, size, h`` and further columns: all that planning needs, without the texts."""
    return docs.select(*more, F.col("source").cast("string").alias("source"), words_of(text_of()).alias("size"), _key(docs, seed).alias("h"))


def _frame(spark: SparkSession, parts: list[Part]) -> DataFrame:
    rows = [(p.number, p.source, p.size, p.target, p.blocks, p.full, [a for a, _ in p.steps], [c for _, c in p.steps], p.whole, p.order, p.cut) for p in parts]
    schema = "k int, source string, source_size long, target double, blocks long, full int, pa array<long>, pc array<long>, whole long, `order` int, cut long"
    return spark.createDataFrame(rows, schema)


def _with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The recipe's row for each row; the recipe has at most MOST_SOURCES rows, so it may be broadcast."""
    named = parts.withColumnRenamed("source", "__s")
    return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("b", F.pmod("h", "blocks"))


def _position(b: Column, turn: Column) -> Column:
    # blocks < 2^31, so the product stays a long
    return F.pmod(F.get("pa", turn) * b + F.get("pc", turn), F.col("blocks"))


def _crossing(rows: DataFrame, place: str, need: dict[int, float]) -> dict[int, tuple[int, float]]:
    """Per source the place where the running sum of ``words`` reaches ``need``, and the sum before it; one row per source goes to the driver."""
    w = Window.partitionBy("k").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    wanted = rows.sparkSession.createDataFrame([(k, float(n)) for k, n in need.items()], "k int, need double")
    run = rows.join(F.broadcast(wanted), "k").withColumn("upto", F.sum("words").over(w)).where(F.col("upto") >= F.col("need"))
    found = run.groupBy("k").agg(F.min_by(F.struct(place, (F.col("upto") - F.col("words")).alias("before")), place).alias("at"))
    return {r.k: (r["at"][0], float(r["at"][1])) for r in found.collect()}


def plan(rows: DataFrame, weigh: Callable[[list[str | None]], list[float]] | None = None, most: float = 3.0, seed: int = 11, block_words: int = BLOCK_WORDS) -> list[Part]:
    """The recipe for ``rows`` (see :func:`sized`, written down): one entry per source, by code point, null last."""
    spark = rows.sparkSession
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    found = sorted(((r["source"], int(r["size"])) for r in found), key=lambda s: (s[0] is None, s[0] or ""))
    weights = weigh([s for s, _ in found]) if weigh else repeating_weights(len(found))
    parts = []
    for i, ((source, size), target) in enumerate(zip(found, targets([s for _, s in found], weights, most), strict=True)):
        blocks, full = max(1, -(-size // block_words)), int(target // size) if size else 0
        steps = []
        for turn in range(full + 1):
            rng = np.random.default_rng([seed, i, turn])
            a = int(rng.integers(1, blocks + 1))
            while math.gcd(a, blocks) != 1:
                a = a % blocks + 1
            steps.append((a, int(rng.integers(0, blocks))))
        parts.append(Part(i, source, size, target, blocks, full, steps))
    need = {p.number: p.target - p.full * p.size for p in parts if p.size and p.target - p.full * p.size >= 0.5}
    if need:
        last = _with_part(rows, _frame(spark, parts)).withColumn("place", _position(F.col("b"), F.col("full"))).where(F.col("k").isin(list(need)))
        blocks = last.groupBy("k", "place").agg(F.sum("size").alias("words"))
        blocks = blocks.withColumn("slice", F.expr(f"place div {SLICE_BLOCKS}"))
        slices = _crossing(blocks.groupBy("k", "slice").agg(F.sum("words").alias("words")), "slice", need)
        inside = spark.createDataFrame([(k, s) for k, (s, _) in slices.items()], "k int, slice long")
        need = {k: need[k] - before for k, (_, before) in slices.items()}
        ends = _crossing(blocks.join(F.broadcast(inside), ["k", "slice"]), "place", need)
        need = {k: need[k] - before for k, (_, before) in ends.items()}
        edge = spark.createDataFrame([(k, p, float(need[k])) for k, (p, _) in ends.items()], "k int, place long, need double")
        run = last.join(F.broadcast(edge), ["k", "place"]).groupBy("k", "need", "h").agg(F.sum("size").alias("words"))
        # rows of the last block in several orders; the order and the end that come nearest are kept
        run = run.withColumn("order", F.explode(F.sequence(F.lit(0), F.lit(LAST_ORDERS - 1)))).withColumn("g", F.xxhash64("h", "order"))
        upto = F.sum("words").over(Window.partitionBy("k", "order").orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
        near = run.withColumn("miss", F.abs(upto - F.col("need"))).groupBy("k", "need").agg(F.min(F.struct("miss", "order", "g")).alias("best"))
        cuts = {r.k: (r.best.order, r.best.g) for r in near.collect() if r.best.miss < r.need}
        for k, (place, _) in ends.items():
            parts[k].whole = place
            parts[k].order, parts[k].cut = cuts.get(k, (0, None))
    return parts


def split_tree(quotas: list[int], shards: int, first: int, last: int, seed: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``shard, first draw and number of draws per source`` for the shards from ``first`` to ``last`` exclusive.

    Only the nodes above these shards are visited; a node's draw depends on its range and the seed, so tasks agree.
    """
    total = int(sum(quotas))
    fill = lambda shard: total * shard // shards

    def descend(low: int, high: int, start: np.ndarray, own: np.ndarray) -> Iterator:
        if high <= first or low >= last:
            return
        if high - low == 1:
            yield low, start, own
            return
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(own, fill(mid) - fill(low), method="marginals")
        yield from descend(low, mid, start, left)
        yield from descend(mid, high, start + left, own - left)

    yield from descend(0, shards, np.zeros(len(quotas), np.int64), np.array(quotas, np.int64))


def _draws(spark: SparkSession, parts: list[Part], seed: int, shard_blocks: int) -> DataFrame:
    """``k, draw, shard``: one row per block draw, made by tasks that each walk their part of the tree."""
    quotas = [p.draws for p in parts]
    shards = max(1, -(-sum(quotas) // shard_blocks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if not ids:
                continue
            out: list[tuple[int, int, int, int]] = []
            for shard, start, own in split_tree(quotas, shards, ids[0], ids[-1] + 1, seed):
                out += [(int(k), shard, int(start[k]), int(own[k])) for k in np.flatnonzero(own)]
            k, shard, start, n = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch([pa.array(k, pa.int32()), pa.array(shard, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["k", "shard", "start", "n"])

    runs = spark.range(shards).mapInArrow(run, "k int, shard long, start long, n long")
    return runs.select("k", "shard", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("draw"))


def apply(docs: DataFrame, parts: list[Part], seed: int = 11, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """``row`` (all columns of ``docs``), ``shard`` and ``position``: one row per taken copy of a row.

    ``docs`` needs ``source`` and either the columns of :func:`sized` in the same form or ``text``.
    """
    spark = docs.sparkSession
    h = F.col("h") if {"h", "size"} <= set(docs.columns) and "text" not in docs.columns else _key(docs, seed)
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), h.alias("h"))
    named = _with_part(rows, _frame(spark, parts)).where(F.col("target") > 0)
    place = _position(F.col("b"), F.col("full"))
    in_rest = (place < F.col("whole")) | ((place == F.col("whole")) & (F.xxhash64("h", "order") <= F.col("cut")))
    turns = F.filter(F.sequence(F.lit(0), F.col("full")), lambda t: (t < F.col("full")) | F.coalesce(in_rest, F.lit(False)))
    taken = named.withColumn("turn", F.explode(turns))
    taken = taken.select("row", "h", "k", (F.col("turn") * F.col("blocks") + _position(F.col("b"), F.col("turn"))).alias("draw"))
    dealt = taken.join(_draws(spark, parts, seed, shard_blocks), ["k", "draw"])
    w = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "h", "draw"), "h", "draw")
    return dealt.withColumn("position", F.row_number().over(w)).select("row", "shard", "position")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that the mix takes of it.

    A null text has no words, a null source is a source of its own (the last), repeated rows are rows like others,
    null ids are kept, extra columns are ignored, an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = stage(sized(docs, 11, "doc_id").withColumn("r", F.monotonically_increasing_id()), "mix")
    parts = plan(rows)
    copies = apply(rows, parts).groupBy(F.col("row.r").alias("r")).agg(F.sum("row.size").alias("taken"))
    named = _with_part(rows, _frame(spark, parts))
    return named.join(copies, "r", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 11) -> DataFrame:
    """``docs`` mixed: its columns, a row once per copy taken, in shards (one task each) in their shuffled order."""
    parts = plan(stage(sized(docs, seed), "mix"), seed=seed)
    dealt = apply(docs, parts, seed)
    return dealt.repartition("shard").sortWithinPartitions("shard", "position").select("row.*")
