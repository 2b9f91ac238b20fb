"""Nearest vectors by a navigable graph (J8): built by neighbour-of-neighbour rounds, searched best first.

**Index.** Equal vectors are one *node*, so a vector that a third of all rows share is one point of the graph; its rows are
listed beside it. A first graph links neighbours in the order of a few random projections. Then each round
brings, for every node, its own neighbours and those that have it as a neighbour together, compares them with one another, and
keeps the best of each. Only pairs with a link that is new since the last round are compared, so rounds get cheaper; they end
when few links change. Lists are bounded by the degree, so no group grows with the table.

**Search.** All queries walk at once. In every round each query opens its best few unopened nodes; their neighbours that
it has not seen yet are joined with their vectors and compared exactly, and the best ``beam`` are kept. A query ends
when its beam holds only opened nodes. Graph, vectors and walks are tables partitioned by their keys: nothing of the index is
broadcast or held in one task.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkeel.operators import neighbors
from rowkeel.operators.change import assign_ids
from rowkeel.operators.neighbors import _prepared
from rowkeel.sources.staging import scratch_path, stage, stage_counted

# tasks carry these small helpers along, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Links of a node, projections that the first graph is taken from, nodes compared together there.
DEGREE, PROJECTIONS, NEIGHBOURHOOD = 24, 4, 96
#: Rounds end when at most this share of all links is new.
SETTLED, MOST_ROUNDS = 0.02, 20
#: Rows listed for one vector; a search may ask for fewer neighbours than that.
COPIES = 256
#: Nodes from which every search starts.
ENTRIES = 32
_LISTS_AT_ONCE = 256
_ROUND = 6
_TABLES = ("nodes", "links", "entries")


@dataclass(frozen=True)
class GraphIndex:
    """The written tables of an index.

    ``nodes`` (``node, vec, ids``) has one row per distinct vector with the lowest ids of its rows; ``links`` (``node, near``) the
    neighbours of each node, both ways; ``entries`` (like nodes) those where searches start.
    """

    nodes: DataFrame
    links: DataFrame
    entries: DataFrame
    rounds: int = 0
    #: Pairs compared while the index was built, repeated ones included.
    compared: int = 0

    @staticmethod
    def open(spark: SparkSession, path: str) -> GraphIndex:
        """An index that :func:`build_graph` wrote to ``path``."""
        return GraphIndex(*(spark.read.parquet(f"{path}/{t}") for t in _TABLES))


def _unit(batch: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(batch, pa.ChunkedArray):
        batch = batch.combine_chunks()
    m = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _codes(m: np.ndarray) -> pa.Array:
    """Rows as short binary values; half precision is enough to choose links."""
    size = 2 * m.shape[1]
    flat = np.ascontiguousarray(m, np.float16).tobytes()
    return pa.array([flat[i : i + size] for i in range(0, len(flat), size)], pa.binary())


def _decoded(codes: pa.Array, rows: int) -> np.ndarray:
    """The matrix of a binary column without nulls."""
    at = np.frombuffer(codes.buffers()[1], np.int32)[codes.offset : codes.offset + rows + 1]
    return np.frombuffer(codes.buffers()[2], np.float16, (int(at[-1]) - int(at[0])) // 2, int(at[0])).reshape(rows, -1).astype(np.float32)


def _coded(nodes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("node"), _codes(_unit(b.column("vec")))], names=["node", "code"])

    return nodes.mapInArrow(run, "node bigint, code binary")


def _first_links(coded: DataFrame, dim: int, degree: int, seed: int) -> DataFrame:
    """Links among nodes that follow one another in the order of random projections, ``NEIGHBOURHOOD`` at a time."""
    parts = []
    for p in range(PROJECTIONS):
        axis = np.random.default_rng((seed, p)).normal(size=dim).astype(np.float32)

        def project(batches: Iterator[pa.RecordBatch], axis=axis) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    at = _decoded(b.column("code"), b.num_rows) @ axis
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.float64))], names=["node", "code", "at"])

        def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, rows = np.zeros(0, np.int64), []
            for b in batches:
                ids = np.concatenate((ids, b.column("node").to_numpy()))
                rows += [_decoded(b.column("code"), b.num_rows)] if b.num_rows else []
                m = np.concatenate(rows) if rows else np.zeros((0, 1), np.float32)
                # the last nodes of a batch wait for the next one; a rest at the end shares places with those before it
                for s in range(0, len(ids) - NEIGHBOURHOOD + 1, NEIGHBOURHOOD):
                    yield _best_links(ids[s : s + NEIGHBOURHOOD], m[s : s + NEIGHBOURHOOD], degree)
                done = len(ids) // NEIGHBOURHOOD * NEIGHBOURHOOD
                ids, rows = ids[done:], [m[done:]]
            if len(ids) > 1:
                yield _best_links(ids, rows[0], degree)

        ordered = coded.mapInArrow(project, "node bigint, code binary, at double").repartitionByRange("at", "node").sortWithinPartitions("at", "node")
        parts.append(ordered.select("node", "code").mapInArrow(link, "src bigint, dst bigint, sim float"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _best_links(ids: np.ndarray, m: np.ndarray, degree: int) -> pa.RecordBatch:
    sims = m @ m.T
    np.fill_diagonal(sims, -np.inf)
    top = min(degree, len(ids) - 1)
    near = np.argpartition(-sims, top - 1, axis=1)[:, :top] if top else np.zeros((len(ids), 0), np.int64)
    rows = np.repeat(np.arange(len(ids)), top)
    return pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(ids[near.ravel()]), pa.array(sims[rows, near.ravel()])], names=["src", "dst", "sim"])


def _best(links: DataFrame, degree: int) -> DataFrame:
    """The best links of every node; a link seen before is not fresh."""
    once = links.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return once.withColumn("place", place).where(F.col("place") <= degree).drop("place")


def _compared_among(lists: DataFrame) -> DataFrame:
    """Pairs of one list with a fresh link, where a node gains by it; the lists of many nodes are compared in one step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, _LISTS_AT_ONCE):
                part = b.slice(s, _LISTS_AT_ONCE).column("around")
                sizes = np.diff(part.offsets.to_numpy())
                flat = part.flatten()
                n, widest = len(sizes), int(sizes.max(initial=0))
                if widest < 2:
                    continue
                where = (np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))
                code = _decoded(flat.field("code"), len(flat))
                m = np.zeros((n, widest, code.shape[1]), np.float32)
                ids, floor, fresh = np.full((n, widest), -1, np.int64), np.full((n, widest), np.inf, np.float32), np.zeros((n, widest), bool)
                m[where], ids[where] = code, flat.field("node").to_numpy()
                floor[where] = flat.field("floor").to_numpy()
                fresh[where] = flat.field("fresh").to_numpy(zero_copy_only=False)
                sims = m @ m.transpose(0, 2, 1)
                asked = (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, :, None] != ids[:, None, :]) & (ids >= 0)[:, None, :] & (ids >= 0)[:, :, None]
                compared = int(asked.sum()) // 2
                g, i, j = np.nonzero(asked & (sims > floor[:, :, None]))
                # the first row also says how many pairs were compared; a list without gain has a row for that alone
                src, dst, sim, count = ids[g, i], ids[g, j], sims[g, i, j], np.zeros(max(len(g), 1), np.int64)
                if not len(g):
                    src = dst = np.full(1, -1, np.int64)
                    sim = np.zeros(1, np.float32)
                count[0] = compared
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (src, dst, sim, count)], names=["src", "dst", "sim", "compared"])

    return lists.mapInArrow(run, "src bigint, dst bigint, sim float, compared bigint")


def build_graph(
    corpus: DataFrame,
    id_col: str = "id",
    vec_col: str = "embedding",
    degree: int = DEGREE,
    seed: int = 17,
    path: str | None = None,
) -> GraphIndex:
    """Index every usable row of ``corpus``; written below ``path``, or in the shared scratch folder.

    Rows whose vector is null, zero or holds a null, NaN or infinite element have no direction and stay out, as in the exact
    search. Rows with a null id stay out as well. A repeated id is listed for each of its vectors.
    """
    spark = corpus.sparkSession
    path = path or scratch_path(spark, "graph")
    rows = _prepared(corpus, id_col, vec_col).where(F.col("id").isNotNull())
    rows = rows.select("id", F.col("vec").cast("array<float>").alias("vec"))
    # a vector of very many rows is cut to its lowest ids before the shuffle
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    lowest = rows.distinct().withColumn("place", place).where(F.col("place") <= COPIES)
    found = lowest.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    named = found.withColumn("least", F.get("ids", F.lit(0))).withColumn("hash", F.xxhash64("vec"))
    nodes = stage(assign_ids(named, "node", 0, ["least", "hash"]).select("node", "vec", "ids"), path=f"{path}/nodes")
    entries = stage(nodes.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(ENTRIES), path=f"{path}/entries")
    shape = nodes.limit(1).select(F.size("vec").alias("dim")).first()
    empty = spark.createDataFrame([], "src bigint, dst bigint, sim float, fresh boolean")
    total = nodes.count()
    if total < 2:
        links = stage(nodes.select("node", F.array().cast("array<bigint>").alias("near")), path=f"{path}/links")
        return GraphIndex(nodes, links, entries)
    coded = stage(_coded(nodes), "graph-codes")
    first_links = _first_links(coded, shape["dim"], degree, seed).withColumn("fresh", F.lit(True))
    links = stage(_best(empty.unionByName(first_links), degree), "graph-links")
    rounds, compared = 0, PROJECTIONS * total * NEIGHBOURHOOD // 2
    while rounds < MOST_ROUNDS:
        rounds += 1
        own = links.select(F.col("src").alias("of"), F.col("dst").alias("node"), "fresh")
        back = links.select(F.col("dst").alias("of"), F.col("src").alias("node"), "fresh")
        turn = F.row_number().over(Window.partitionBy("of").orderBy(F.desc("fresh"), F.xxhash64("node", F.lit(rounds)), "node"))
        back = back.withColumn("place", turn).where(F.col("place") <= degree).drop("place")
        around = own.unionByName(back).groupBy("of", "node").agg(F.bool_or("fresh").alias("fresh"))
        floors = links.groupBy(F.col("src").alias("node")).agg(F.when(F.count(F.lit(1)) >= degree, F.min("sim")).otherwise(F.lit(-2.0)).cast("float").alias("floor"))
        known = coded.join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0).cast("float")))
        lists = around.join(known, "node").groupBy("of").agg(F.collect_list(F.struct("node", "code", "floor", "fresh")).alias("around"))
        # lists without a fresh link have nothing to compare
        lists = lists.where(F.exists("around", lambda a: a["fresh"])).select("around")
        pairs = stage(_compared_among(lists), "graph-pairs")
        old = links.withColumn("fresh", F.lit(False))
        new = pairs.where("src >= 0").select("src", "dst", "sim").withColumn("fresh", F.lit(True))
        links, seen = stage_counted(_best(old.unionByName(new), degree), "graph-links", fresh=F.count_if("fresh"))
        compared += pairs.agg(F.sum("compared")).first()[0] or 0
        if seen["fresh"] <= SETTLED * seen["rows"]:
            break
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "sim")
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    back = back.withColumn("place", place).where(F.col("place") <= 2 * degree).drop("place")
    near = links.select("src", "dst").unionByName(back.select("src", "dst")).groupBy("src").agg(F.collect_set("dst").alias("near"))
    near = stage(near.withColumnRenamed("src", "node"), path=f"{path}/links")
    return GraphIndex(nodes, near, entries, rounds, compared)


_BEAM = "beam array<struct<sim:double,node:bigint,opened:boolean>>, seen array<bigint>, next array<bigint>"


def _walked(walks: DataFrame, beam: int, opened: int, entries: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """Walks after their new nodes (``fresh``: node and vector), or at the start the ``entries``, were compared with the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"beam": [], "seen": [], "next": []}
            queries = _unit(b.column("vec")) if b.num_rows else np.zeros((0, 1))
            for i in range(b.num_rows):
                held = {h["node"]: (h["sim"], h["opened"]) for h in b.column("beam")[i].as_py()}
                seen = b.column("seen")[i].values.to_numpy() if len(b.column("seen")[i]) else np.zeros(0, np.int64)
                fresh = b.column("fresh")[i].values
                if entries or fresh is not None and len(fresh):
                    ids, vecs = entries or (fresh.field("node").to_numpy(), _unit(fresh.field("vec")))
                    sims = np.round(vecs @ queries[i], 12)
                    seen = np.concatenate((seen, ids))
                    held.update((int(n), (float(s), False)) for n, s in zip(ids, sims, strict=True))
                best = sorted(held.items(), key=lambda h: (-h[1][0], h[0]))[:beam]
                wanted = [n for n, (_, done) in best if not done][:opened]
                going = set(wanted)
                out["beam"].append([{"sim": s, "node": n, "opened": done or n in going} for n, (s, done) in best])
                out["seen"].append(seen)
                out["next"].append(wanted)
            kinds = {"beam": pa.list_(pa.struct([("sim", pa.float64()), ("node", pa.int64()), ("opened", pa.bool_())]))}
            arrays = [pa.array(out[n], kinds.get(n, pa.list_(pa.int64()))) for n in out]
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vec"), *arrays], names=["query_id", "vec", *out])

    return walks.mapInArrow(run, f"query_id bigint, vec array<float>, {_BEAM}")


def search_graph(
    index: GraphIndex,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vec_col: str = "embedding",
    exclude_self: bool = True,
    beam: int = 32,
    opened: int = 8,
    most_rounds: int = 64,
) -> tuple[DataFrame, DataFrame]:
    """``(query_id, neighbor_id, similarity, rank)`` of the k nearest found, and ``(query_id, compared)``.

    Similarity is the exact cosine, rounded and ordered as in :func:`rowkeel.operators.neighbors.knn`. A wider ``beam`` raises the
    recall and the number of compared rows. Queries are named by a unique id; with ``exclude_self`` a row of that id is no
    neighbour. ``opened`` nodes are opened by a query in one round.
    """
    if k + exclude_self > COPIES:
        raise ValueError(f"a search gives fewer than {COPIES} neighbours")
    beam = max(beam, k + exclude_self)
    q = _prepared(queries, id_col, vec_col).select(F.col("id").alias("query_id"), F.col("vec").cast("array<float>").alias("vec"))
    none = {"beam": "array<struct<sim:double,node:bigint,opened:boolean>>", "seen": "array<bigint>", "fresh": "array<struct<node:bigint,vec:array<float>>>"}
    first = q.select("*", *[F.array().cast(t).alias(n) for n, t in none.items()])
    # at most ENTRIES rows
    entries = index.entries.select("node", "vec").toArrow()
    start = (entries["node"].to_numpy(), _unit(entries["vec"])) if entries.num_rows else None
    walks, state = stage_counted(_walked(first, beam, opened, start), "graph-walks", left=F.sum(F.size("next")))
    for _ in range(most_rounds):
        if not state["left"]:
            break
        steps = walks.select("query_id", F.explode("next").alias("node")).join(index.links, "node")
        found = steps.select("query_id", F.explode("near").alias("node")).groupBy("query_id").agg(F.collect_set("node").alias("found"))
        unseen = walks.select("query_id", "seen").join(found, "query_id").select("query_id", F.explode(F.array_except("found", "seen")).alias("node"))
        fresh = unseen.join(index.nodes, "node").groupBy("query_id").agg(F.collect_list(F.struct("node", "vec")).alias("fresh"))
        going = walks.join(fresh, "query_id", "left").withColumn("fresh", F.coalesce("fresh", F.array().cast(none["fresh"])))
        walks, state = stage_counted(_walked(going.select("query_id", "vec", "beam", "seen", "fresh"), beam, opened), "graph-walks", left=F.sum(F.size("next")))
    hits = walks.select("query_id", F.inline("beam")).join(index.nodes.select("node", F.explode("ids").alias("id")), "node").where(F.lit(not exclude_self) | (F.col("id") != F.col("query_id")))
    pairs = hits.select("query_id", F.col("id").alias("neighbor_id"), F.round("sim", _ROUND).alias("similarity"))
    top = neighbors._top(pairs.groupBy("query_id", "neighbor_id").agg(F.max("similarity").alias("similarity")), k)
    return top, walks.select("query_id", F.size("seen").cast("bigint").alias("compared"))


def recall_of(found: DataFrame, true: DataFrame) -> DataFrame:
    """One row ``(true_pairs, found_pairs)``: how many neighbours are as near as the exact ones, whichever of equal ones was taken."""
    bar = true.groupBy("query_id").agg(F.min("similarity").alias("bar"), F.count(F.lit(1)).alias("n"))
    good = found.join(bar, "query_id").where(F.col("similarity") >= F.col("bar")).groupBy("query_id").agg(F.count(F.lit(1)).alias("hit"))
    both = bar.join(good, "query_id", "left")
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("true_pairs"), F.coalesce(F.sum(F.least("hit", "n")), F.lit(0)).alias("found_pairs"))
