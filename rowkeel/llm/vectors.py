"""Vectors in blocks: the grid of row shards and query blocks that both vector searches run on.

Every shard meets every query block in one group, so a group holds at most about ``SHARD_ROWS`` rows and ``BLOCK_QUERIES``
queries whatever the table's size, and nothing is broadcast. Each group returns its best few per query; a ranked
window merges the shards.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and queries of one group; they bound its memory and change no result.
SHARD_ROWS, BLOCK_QUERIES = 8192, 2048


def usable(df: DataFrame, nonzero: bool = False) -> DataFrame:
    """``vec_id, embedding`` (doubles) of the rows that take part.

    Left out: null ids, null or empty vectors, vectors with a null, NaN or infinite component, and zero vectors where
    ``nonzero``. Rows that share an id are rows like others; none of them is a neighbour of that id.
    """
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0)
    fine &= F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    if nonzero:
        fine &= F.exists(e, lambda x: x != 0)
    return df.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def by_id(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids in rising order and their vectors."""
    ids = table["vec_id"].to_numpy()
    width = len(table["embedding"][0]) if len(ids) else 0
    x = matrix(table["embedding"], width) if len(ids) else np.zeros((0, 0))
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def search_blocks(vectors: DataFrame, every: int, kernel: Callable, score_type: str) -> DataFrame:
    """``query_id, vec_id, score`` of ``kernel(query ids, query vectors, ids, vectors)`` over all groups.

    Vectors of different lengths never meet: the length is part of the group's key.
    """
    rows = vectors.count()
    shards = max(1, -(-rows // SHARD_ROWS))
    blocks = max(1, -(-rows // (every * BLOCK_QUERIES)))
    keyed = vectors.withColumn("width", F.size("embedding"))
    # rows of one id, and equal rows, spread over all shards
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards))
    left = keyed.withColumn("shard", spread).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = keyed.where(F.col("vec_id") % every == 0)
    right = asked.withColumn("block", F.pmod(F.hash("vec_id", F.monotonically_increasing_id()), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    kind = pa.int64() if score_type == "long" else pa.float64()

    def group(rows_in: pa.Table, queries_in: pa.Table) -> pa.Table:
        found = ([], [], [])
        if rows_in.num_rows and queries_in.num_rows:
            ids, x = by_id(rows_in)
            asked_ids, q = by_id(queries_in)
            for a, b, s in kernel(asked_ids, q, ids, x):
                for part, values in zip(found, (np.full(len(b), a), b, s), strict=True):
                    part.append(values)
        cut = [np.concatenate(p) if p else np.zeros(0) for p in found]
        return pa.table({"query_id": pa.array(cut[0], pa.int64()), "vec_id": pa.array(cut[1], pa.int64()), "score": pa.array(cut[2], kind)})

    key = ["width", "block", "shard"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(group, f"query_id long, vec_id long, score {score_type}")


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best per query over all shards, ties to the smaller id."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
