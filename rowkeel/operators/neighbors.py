"""Nearest vectors by cosine similarity (J8): exact for small and for large query sets, and by LSH."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowkeel.sources.staging import stage

# tasks carry these small helpers along, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PAIRS = "query_id bigint, neighbor_id bigint, similarity double"
#: A task multiplies so many queries with so many corpus rows at a time; the first rows only set a bar.
_QUERY_CHUNK, _CORPUS_CHUNK, _FIRST_CHUNK = 512, 1024, 256
#: Queries of a scan whose vectors are in double precision at a time.
_SCAN_CHUNK = 8192
#: Distances to pivots that a task holds at a time.
_DISTANCES = 1 << 19
#: Pivots go to every task; so many bytes of them at most.
PIVOT_BYTES = 64 << 20
#: The vectors of one side of a group, in double precision; so many bytes of them at most.
BLOCK_BYTES = 16 << 20
#: Tables that would fit into fewer blocks are still cut into so many, for the sake of idle cores.
_BLOCKS, _LEAST_BLOCK = 8, 1024
_LEADERS = 1024
_ROUND = 6


def _matrix(batch, name: str) -> np.ndarray:
    """A list column as a matrix of its own type."""
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    lengths = np.unique(np.diff(col.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {lengths.tolist()}")
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _unit(m: np.ndarray) -> np.ndarray:
    """The rows of a matrix at length one, in double precision."""
    m = m.astype(np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    return m


def _vectors(batch, name: str) -> np.ndarray:
    """A list column as a matrix of unit rows in double precision."""
    return _unit(_matrix(batch, name))


def _ints(batch, name: str) -> np.ndarray:
    col = batch.column(name)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.to_numpy(zero_copy_only=False)


def _best(q_ids, q, c_ids, c, k, self_excluded, bar=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k most similar of ``c`` for every row of ``q``, at ``bar`` or above where that is given; ties by id."""
    rows, ids, sims = _best_by_place(q_ids, q, c_ids, c, k, self_excluded, bar)
    return q_ids[rows], ids, sims


def _best_by_place(q_ids, q, c_ids, c, k, self_excluded, bar):
    """:func:`_best` with the places of the queries instead of their ids."""
    order = np.argsort(c_ids, kind="stable")
    ends = [0, *range(_FIRST_CHUNK, len(c_ids), _CORPUS_CHUNK), len(c_ids)]
    chunks = [(c_ids[at], c[at]) for at in (order[s:e] for s, e in zip(ends, ends[1:])) if len(at)]
    out = ([], [], [])
    for s in range(0, len(q_ids), _QUERY_CHUNK):
        part = slice(s, s + _QUERY_CHUNK)
        rows, ids, sims = _best_of_chunks(q_ids[part], q[part], chunks, k, self_excluded, None if bar is None else bar[part])
        for o, got in zip(out, (rows + s, ids, sims)):
            o.append(got)
    return tuple(np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, (np.int64, np.int64, np.float64)))


def _best_of_chunks(q_ids, q, chunks, k, self_excluded, bar):
    """:func:`_best` of a few queries, named by their places; the ids of ``chunks`` ascend.

    A product has to reach the least similarity that still counts before it is rounded and ranked. With k found, an
    equal one of a later chunk no longer counts, as its id is higher.
    """
    half = 0.5 * 10.0**-_ROUND
    low = np.full(len(q), -np.inf) if bar is None else bar - 1.2 * half
    rows, ids, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for c_ids, c in chunks:
        s, n = q @ c.T, len(c_ids)
        if self_excluded:
            first, last = np.searchsorted(c_ids, q_ids, "left"), np.searchsorted(c_ids, q_ids, "right")
            while len(own := np.flatnonzero(first < last)):
                s[own, first[own]] = -np.inf
                first[own] += 1
        if n > k and np.isneginf(low).any():
            low = np.maximum(low, np.partition(s, n - k, axis=1)[:, n - k] - 2.2 * half)
        at = np.flatnonzero(s >= low[:, None])
        if not len(at):
            continue
        r, j = np.divmod(at, n)
        found = np.round(s.ravel()[at], _ROUND)
        real = np.isfinite(found)
        got = (rows, r[real]), (ids, c_ids[j[real]]), (sims, found[real])
        rows, ids, sims = _ranked(*[np.concatenate(x) for x in got], k)
        last = np.flatnonzero(np.bincount(rows, minlength=len(q)) >= k)
        low[last] = np.maximum(low[last], sims[np.searchsorted(rows, last, "right") - 1] + 0.8 * half)
    return rows, ids, sims


def _ranked(q_ids, n_ids, sims, k):
    order = np.lexsort((n_ids, -sims, q_ids))
    q_ids, n_ids, sims = q_ids[order], n_ids[order], sims[order]
    start = np.concatenate(([True], q_ids[1:] != q_ids[:-1])) if len(q_ids) else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(start, np.arange(len(q_ids)), 0)) if len(q_ids) else np.zeros(0, int)
    keep = np.arange(len(q_ids)) - first < k
    return q_ids[keep], n_ids[keep], sims[keep]


def _pair_table(q_ids, n_ids, sims) -> dict:
    return {
        "query_id": pa.array(q_ids, pa.int64()),
        "neighbor_id": pa.array(n_ids, pa.int64()),
        "similarity": pa.array(sims, pa.float64()),
    }


def _prepared(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Usable rows as ``(id, vec)``; a missing or zero vector, or one with a null, NaN or infinite element, has no direction."""
    sized = F.exists(vec_col, lambda v: v != 0)
    sized &= F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("vec")).where(
        F.col("vec").isNotNull() & sized
    )


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k best per query; Spark limits each group before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "neighbor_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def knn(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    broadcast_bytes: int = 64 << 20,
    pivots: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """The exact k nearest corpus rows of every query: ``(query_id, neighbor_id, similarity, rank)``.

    Similarity is the cosine rounded to 6 digits, ties go to the lower id. A query set whose
    measured size is within ``broadcast_bytes`` goes to every task, and each task keeps the k best of
    its part of the corpus. A larger set is joined by cells, see :func:`knn_by_cells`.
    """
    q, c = _prepared(queries, id_col, vec_col), _prepared(corpus, id_col, vec_col)
    shape = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if (shape["n"] or 0) * ((shape["d"] or 0) + 1) * 8 <= broadcast_bytes:
        return _top(_scan_with_queries(q, c, k, exclude_self), k)
    return knn_by_cells(queries, corpus, k, id_col, vec_col, exclude_self, pivots, block)


def _scan_with_queries(q: DataFrame, c: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    table = q.toArrow()
    if table.num_rows == 0:
        return q.sparkSession.createDataFrame([], _PAIRS)
    shared = q.sparkSession.sparkContext.broadcast((_ints(table, "id"), _matrix(table, "vec")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, raw = shared.value
        # per query, its k best so far
        ids, sims = np.zeros((len(q_ids), k), np.int64), np.full((len(q_ids), k), -np.inf)
        for b in batches:
            if not b.num_rows:
                continue
            c_ids, cv = _ints(b, "id"), _vectors(b, "vec")
            for s in range(0, len(q_ids), _SCAN_CHUNK):
                part = slice(s, s + _SCAN_CHUNK)
                places = np.arange(len(q_ids[part]))
                kept = np.isfinite(sims[part])
                old = np.repeat(places, kept.sum(axis=1)), ids[part][kept], sims[part][kept]
                got = _best_by_place(q_ids[part], _unit(raw[part]), c_ids, cv, k, exclude_self, sims[part][:, -1])
                rows, n_ids, best = _ranked(*[np.concatenate(x) for x in zip(old, got)], k)
                nth = np.arange(len(rows)) - np.searchsorted(rows, rows, "left")
                ids[part][rows, nth], sims[part][rows, nth] = n_ids, best
        for s in range(0, len(q_ids), _SCAN_CHUNK):
            kept = np.isfinite(sims[s : s + _SCAN_CHUNK])
            of = np.repeat(q_ids[s : s + _SCAN_CHUNK], kept.sum(axis=1))
            yield pa.RecordBatch.from_pydict(_pair_table(of, ids[s : s + _SCAN_CHUNK][kept], sims[s : s + _SCAN_CHUNK][kept]))

    return c.mapInArrow(scan, _PAIRS)


def _block_rows(rows: int, size: int) -> int:
    """Rows of a block, by the number of rows in the table and the size of their vectors."""
    return max(1, min(BLOCK_BYTES // (8 * max(size, 1)), max(_LEAST_BLOCK, -(-rows // _BLOCKS))))


def _dealt(count: np.ndarray, centers: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Cells dealt out to shards of at most ``block`` rows, close ones together: the first shard of every cell, and how many it takes.

    A cell with more rows than a shard takes several for itself.
    """
    leaders = centers[: min(_LEADERS, max(1, int(count.sum()) // block))]
    step = max(1, _DISTANCES // len(leaders))
    led = np.concatenate([_distances(centers[s : s + step], leaders).argmin(axis=1) for s in range(0, len(centers), step)])
    first, parts = np.zeros(len(count), np.int64), np.maximum(1, -(-count // block))
    shard = filled = 0
    for cell in np.argsort(led, kind="stable"):
        if filled and filled + count[cell] > block:
            shard, filled = shard + 1, 0
        first[cell], filled = shard, filled + count[cell]
        if parts[cell] > 1:
            shard, filled = shard + parts[cell], 0
    return first, parts


def knn_by_cells(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    pivots: int | None = None,
    block: int | None = None,
) -> DataFrame:
    """Exact k nearest rows for query sets of any size, as an equi-join on shards of space.

    Some corpus vectors, as many as the square root of their number and at least 16, serve as pivots (``PIVOT_BYTES`` of them at most); every
    vector belongs to the cell of its nearest pivot, and close cells share a shard of at most ``block`` rows (by default what ``BLOCK_BYTES``
    hold). A query first searches the shards of the nearest cells that hold k rows, which gives a true distance bound, and then only those
    shards with a cell that can hold something closer by the triangle inequality. Queries travel in blocks, likewise by cells: a
    vector is sent once per shard or block that it meets, never once per cell, and a task holds one shard and one block.
    """
    q, c = _prepared(queries, id_col, vec_col), _prepared(corpus, id_col, vec_col)
    spark = q.sparkSession
    shape = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    if pivots is None:
        pivots = min(PIVOT_BYTES // (8 * (shape["d"] or 1)), max(16, isqrt(shape["n"])))
    picked = c.orderBy(F.xxhash64("id"), "id").limit(pivots).toArrow()
    if picked.num_rows == 0:
        return spark.createDataFrame([], _PAIRS + ", rank int")
    block = block or _block_rows(shape["n"], shape["d"])
    middle = _vectors(picked, "vec")
    centers = spark.sparkContext.broadcast(middle)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, len(centers.value)):
            d = _distances(_vectors(b, "vec"), centers.value)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "id": b.column("id"),
                    "vec": b.column("vec"),
                    "cell": pa.array(near.astype(np.int64)),
                    "dist": pa.array(d[np.arange(len(near)), near]),
                }
            )

    def placed(df: DataFrame, label: str) -> tuple[DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows with their shard; per cell its rows, radius, first shard and number of shards."""
        vec = df.schema["vec"].dataType.simpleString()
        cells = stage(df.mapInArrow(assign, f"id bigint, vec {vec}, cell bigint, dist double"), label)
        count, radius = np.zeros(len(middle), np.int64), np.full(len(middle), -np.inf)
        # one row per pivot
        for s in cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("r")).collect():
            count[s["cell"]], radius[s["cell"]] = s["n"], s["r"]
        first, parts = _dealt(count, middle, block)
        layout = spark.createDataFrame(pa.table({"cell": np.arange(len(middle)), "first": first, "parts": parts}))
        shard = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
        return cells.join(layout, "cell").select("id", "vec", shard.alias("shard")), count, radius, first, parts

    c, count, radius, first, parts = placed(c, "corpus-cells")
    q = placed(q, "query-cells")[0].withColumnRenamed("shard", "block")
    # the shards of all cells in use, in order, and where each shard begins
    used = np.repeat(np.flatnonzero(count), parts[count > 0])
    shards = first[used] + np.concatenate([np.arange(p) for p in parts[count > 0]])
    used, shards = used[np.argsort(shards, kind="stable")], np.sort(shards)
    starts = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1])))
    layout = spark.sparkContext.broadcast((count, radius, used, shards[starts], starts))
    enough = k + 1 if exclude_self else k

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First the shards of the nearest cells with enough rows; with a known bound all others within it."""
        n, r, used, shards, starts = layout.value
        for b in _slices(batches, max(len(n), len(used))):
            d = _distances(_vectors(b, "vec"), centers.value)
            order = np.argsort(np.where(n > 0, d, np.inf), axis=1)
            before = np.cumsum(n[order], axis=1) - n[order]
            home = np.zeros(d.shape, bool)
            np.put_along_axis(home, order, before < enough, axis=1)
            meets = np.logical_or.reduceat(home[:, used], starts, axis=1)
            if "bar" in b.schema.names:
                bar = b.column("bar").to_numpy(zero_copy_only=False)
                # two units in the last kept digit cover the rounding; fewer than k found means no bound
                bound = np.where(np.isneginf(bar), 2.0, np.sqrt(2 - 2 * (np.maximum(bar, -1.0) - 2 * 10.0**-_ROUND)))
                within = d - r[None, :] <= bound[:, None] + 1e-9
                meets = np.logical_or.reduceat(within[:, used], starts, axis=1) & ~meets
            rows, places = np.nonzero(meets)
            ends = np.concatenate(([0], np.cumsum(meets.sum(axis=1))))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(shards[places], pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "shards"])

    def searched(q: DataFrame, label: str) -> DataFrame:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in q.schema.fields)
        sent = stage(q.mapInArrow(probe, f"{kinds}, shards array<int>"), label).withColumn("shard", F.explode("shards")).drop("shards")
        # a shard goes only to blocks with a query for it
        met = c.join(stage(sent.select("shard", "block").distinct(), f"{label}-pairs"), "shard")
        return _search(sent, met, ["shard", "block"], k, exclude_self)

    near = stage(_top(searched(q, "near-probes"), k).drop("rank"), "near")
    worst = near.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
    bar = F.coalesce(F.when(F.col("n") >= k, F.col("s")), F.lit(float("-inf")))
    far = searched(q.join(worst, "id", "left").select("id", "vec", "block", bar.alias("bar")), "far-probes")
    return _top(near.unionByName(far), k)


def _distances(v: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Euclidean distances between unit vectors."""
    return np.sqrt(np.maximum(2.0 - 2.0 * (v @ centers.T), 0.0))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Parts of batches for which ``width`` numbers per row fit into ``_DISTANCES``."""
    step = max(1, _DISTANCES // max(width, 1))
    for b in batches:
        for s in range(0, b.num_rows, step):
            yield b.slice(s, step)


def _search(q: DataFrame, c: DataFrame, keys: list[str], k: int, exclude_self: bool) -> DataFrame:
    """The k best per query and group, never the pairs of a group; with a column ``bar`` only those that reach it."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table(_pair_table([], [], []))
        bar = [left.column("bar").to_numpy()] if "bar" in left.column_names else []
        sides = _ints(left, "id"), _vectors(left, "vec"), _ints(right, "id"), _vectors(right, "vec")
        return pa.table(_pair_table(*_best(*sides, k, exclude_self, *bar)))

    return q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(search, _PAIRS)


def _bucket_join(q: DataFrame, c: DataFrame, k: int, exclude_self: bool, block: int) -> DataFrame:
    """The k best per query among the rows of its buckets; both sides carry ``(id, vec, cell)``.

    A bucket with more than ``block`` rows on a side is split there by a hash of the id, and the other
    side is repeated once per part, so no group grows with its bucket. A group returns k rows
    per query, never its pairs.
    """
    sizes = (
        q.select("cell", F.lit(1).alias("nq"), F.lit(0).alias("nc"))
        .unionByName(c.select("cell", F.lit(0).alias("nq"), F.lit(1).alias("nc")))
        .groupBy("cell")
        .agg(F.sum("nq").alias("nq"), F.sum("nc").alias("nc"))
    )
    # every listed bucket has more than `block` rows, so the list is short
    large = sizes.where((F.col("nq") > 0) & (F.col("nc") > 0) & ((F.col("nq") > block) | (F.col("nc") > block)))
    parts = large.select(
        "cell",
        F.ceil(F.col("nq") / block).cast("int").alias("qp"),
        F.ceil(F.col("nc") / block).cast("int").alias("cp"),
    )
    parts = stage(parts, "large-buckets")

    def split(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.select("id", "vec", "cell").join(parts, "cell", "left")
        mine = F.pmod(F.xxhash64("id"), F.coalesce(own, F.lit(1))).cast("int")
        theirs = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return out.select("id", "vec", "cell", mine.alias(own), theirs.alias(other))

    return _search(split(q, "qp", "cp"), split(c, "cp", "qp"), ["cell", "qp", "cp"], k, exclude_self)


def _spread(units: DataFrame) -> float:
    """The root of the mean squared distance of unit vectors from their mean, for one of their dimensions."""
    from pyspark.ml.stat import Summarizer

    # one row of d variances
    variance = units.select(Summarizer.variance(F.col("features")).alias("v")).first()["v"]
    mean = float(np.mean(variance.toArray())) if variance is not None else 0.0
    return mean**0.5 if mean > 0 else 1.0


def knn_lsh(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    width: float = 2.0,
    projections: int = 4,
    tables: int = 20,
    seed: int = 17,
    block: int | None = None,
) -> DataFrame:
    """Approximate k nearest rows: only rows that share a random-projection bucket are compared.

    A bucket is one cell of ``projections`` random projections together (all have to agree); ``tables`` such partitions are
    searched (one has to agree). Cells are ``width`` times as wide as the measured spread of a projection. More tables or
    wider cells raise the recall, more projections lower the number of compared pairs. Buckets are searched in the
    same bounded blocks as the cells of the exact search.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def unit(df: DataFrame) -> DataFrame:
        v = F.col("vec").cast("array<double>")
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        return df.withColumn("features", array_to_vector(F.transform(v, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))))

    q, c = unit(_prepared(queries, id_col, vec_col)), unit(_prepared(corpus, id_col, vec_col))
    lsh = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", bucketLength=width * _spread(c), numHashTables=tables * projections, seed=seed
    )
    model = lsh.fit(c)

    def buckets(df: DataFrame, label: str) -> DataFrame:
        """Every vector is hashed and written once; it is repeated per table only on its way to the buckets."""
        floors = F.transform("hashes", lambda h: F.get(vector_to_array(h), F.lit(0)))
        hashed = model.transform(df).select("id", "vec", floors.alias("floors"))
        own = lambda t: F.xxhash64(t, F.slice("floors", t * projections + 1, projections))
        cells = F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), own)
        return stage(hashed, label).select("id", "vec", F.explode(cells).alias("cell"))

    if block is None:
        shape = c.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
        block = _block_rows(shape["n"], shape["d"] or 1)
    pairs = _bucket_join(buckets(q, "query-buckets"), buckets(c, "corpus-buckets"), k, exclude_self, block)
    # rows of a query meet in one shuffle, for the repeats and for the ranks
    return _top(pairs.repartition("query_id").distinct(), k)
