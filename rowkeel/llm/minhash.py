"""MinHash near-duplicates with sequential Bayesian verification.

Texts with equal shingle sets are one *node*. Signatures of ``BANDS * ROWS`` minima are cut into bands; nodes that agree
in a band share a bucket and are candidates. A candidate's signature is compared batch by batch: after n minima with m
matches the similarity's posterior is Beta(m + 1, n - m + 1), and the pair is dropped once the chance that it reaches
the threshold is below ``MISS``. Survivors are verified on their full shingle sets, so every link is exact; what banding
and pruning may lose together at the threshold is below 1e-7 a pair.

Buckets are never expanded into all pairs. First each member meets its bucket's least member, which joins nearly all
copies. Pairs inside a component need no look any more; the buckets that still hold several components are compared
inside tasks, in pairs of blocks of bounded size, and only verified links leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm.common import WORD, free_name, pieces, resident, table, text_of, tokens
from rowkeel.llm.graph import components
from rowkeel.sources.staging import stage

ROWS, BANDS, BATCH, MISS = 5, 44, 20, 1e-9
HASHES = ROWS * BANDS
#: Members of a block when a bucket is compared inside tasks.
BLOCK = 2048
_WORDS_KEPT = 300_000
_rng = np.random.default_rng(2024)
_XOR = _rng.integers(0, 1 << 32, HASHES, np.uint64).astype(np.uint32)
_TIMES = _rng.integers(0, 1 << 31, HASHES, np.uint64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_FOLD = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, k: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct ``k``-word shingles; with fewer words the whole sequence is one."""
    words = tokens(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(resident(("minhash",), _Words).__getitem__, words), np.uint64, len(words))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _FOLD + h[j : len(h) - n + 1 + j]
    return np.unique(_mixed(out))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of minima per set; no set may be empty."""
    out = np.empty((len(sets), HASHES), np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 16):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[at:end]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        v = np.empty_like(x)
        for i in range(HASHES):
            np.bitwise_xor(x, _XOR[i], out=v)
            np.multiply(v, _TIMES[i], out=v)
            out[at:end, i] = np.minimum.reduceat(v, starts)
        at = end
    return out


def least_matches(threshold: float, miss: float = MISS) -> np.ndarray:
    """Per number of compared batches, the fewest matches with which a pair may still reach the threshold.

    P(S >= t | m of n) is the chance of at most m successes in n + 1 trials of chance t.
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Indices of the row pairs that no batch prunes."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, need in enumerate(least):
        cut = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (a[alive, cut] == b[alive, cut]).sum(axis=1)
        keep = matches >= need
        alive, matches = alive[keep], matches[keep]
    return alive


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _signed(docs: DataFrame, k: int, keep: list[str]) -> DataFrame:
    """``keep`` columns, the key of the text, the set's size and fingerprint, and its signature (null for an empty set)."""
    schema = T.StructType([*docs.select(*keep).schema, *T._parse_datatype_string("t1 long, t2 long, n long, fp binary, sig array<int>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            sets = [shingle_set(t.as_py(), k) for t in batch.column("__text")]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in full]) if full else np.zeros((0, HASHES), np.uint32)
            ends = np.zeros(len(sets) + 1, np.int32)
            ends[1:] = np.cumsum([HASHES if len(s) else 0 for s in sets])
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.reshape(-1).view(np.int32)), mask=pa.array([not len(s) for s in sets]))
            fp = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            own = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__text"]
            yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(fp, pa.binary()), lists], names=schema.names)

    text = text_of()
    rows = docs.select(*keep, *text_key(text), text.alias("__text"))
    return rows.mapInArrow(run, schema)


def text_key(text: Column) -> list[Column]:
    """128 bits that name a text, made without Python; they find the texts of nodes again."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _bands() -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * ROWS + 1, ROWS)))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, HASHES)


def _pruned(pairs: DataFrame, sigs: DataFrame, threshold: float) -> DataFrame:
    least = least_matches(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                alive = surviving(_matrix(batch.column("sa")), _matrix(batch.column("sb")), least)
                yield batch.select(["a", "b"]).take(pa.array(alive))

    joined = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb, good = batch.column("ta"), batch.column("tb"), []
            for i, node in enumerate(a):
                if node not in last:
                    last = {node: shingle_set(ta[i].as_py(), k)}
                if linked(last[node], shingle_set(tb[i].as_py(), k), percent):
                    good.append(i)
            yield pa.record_batch([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], names=["a", "b"])

    joined = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a")
    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _across(members: DataFrame, sigs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Verified links between different components in the same bucket; ``members`` is ``band, key, node, n, component``.

    A pair that shares several buckets is looked at in the first band in which it agrees only. Pairs never leave their task:
    a first pass names the members that have a surviving pair, a second one fetches their texts and verifies.
    """
    least = least_matches(percent / 100)
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cut = members.withColumn("blocks", blocks).withColumn("own", own)
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("band", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "component")
    rows = stage(cut.join(sigs, "node"), "blocks")
    group = ["band", "key", "x", "y"]

    def pairs(table_: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
        """Surviving pairs as indices: one row and the rows it is paired with."""
        comp, own = table_["component"].to_numpy(), table_["own"].to_numpy()
        x, y, band = (table_[c][0].as_py() for c in ("x", "y", "band"))
        sig = _matrix(table_["sig"].combine_chunks())
        for i in range(len(comp)):
            # within one block the later rows; across two blocks the other block's rows
            rest = np.arange(i + 1, len(comp)) if x == y else (np.flatnonzero(own == y) if own[i] == x else np.zeros(0, int))
            rest = rest[comp[rest] != comp[i]]
            if len(rest):
                rest = rest[surviving(np.broadcast_to(sig[i], (len(rest), HASHES)), sig[rest], least)]
                rest = rest[(sig[rest] == sig[i]).reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band]
                if len(rest):
                    yield i, rest

    def touched(table_: pa.Table) -> pa.Table:
        mark = np.zeros(table_.num_rows, bool)
        for i, rest in pairs(table_):
            mark[i] = True
            mark[rest] = True
        return table_.select([*group, "node"]).filter(pa.array(mark))

    def verify(table_: pa.Table) -> pa.Table:
        node, comp = table_["node"].to_numpy(), table_["component"].to_numpy()
        sets = [shingle_set(t.as_py(), k) for t in table_["text"]]
        # components that a link of this group joined need no further pair
        root: dict[int, int] = {}

        def find(c: int) -> int:
            while c in root:
                c = root[c]
            return c

        out = []
        for i, rest in pairs(table_):
            for j in rest:
                p, q = find(comp[i]), find(comp[j])
                if p != q and linked(sets[i], sets[j], percent):
                    root[max(p, q)] = min(p, q)
                    out.append((min(node[i], node[j]), max(node[i], node[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    met = rows.groupBy(*group).applyInArrow(touched, "band int, key long, x int, y int, node long")
    full = rows.join(met, [*group, "node"]).join(texts, "node")
    return full.groupBy(*group).applyInArrow(verify, "a long, b long")


def _grouped(docs: DataFrame, id_column: str, k: int, percent: int) -> DataFrame:
    """``r, id, t1, t2, n, component`` of every row; ``component`` is a node, null for an empty set. ``r`` numbers the rows of a written table."""
    rows = stage(_signed(docs.withColumnRenamed(id_column, "id"), k, ["id"]).withColumn("r", F.monotonically_increasing_id()), "signed")
    nodes = stage(rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min("r").alias("node")), "nodes")
    of_node = rows.join(nodes.select(F.col("node").alias("r")), "r", "left_semi")
    sigs = of_node.select(F.col("r").alias("node"), "sig")
    banded = of_node.select(F.col("r").alias("node"), F.posexplode(_bands()).alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stage(banded.join(buckets, ["band", "key"]), "buckets")
    near = stage(members.select("node").distinct(), "near")
    keys = of_node.select(F.col("r").alias("node"), "t1", "t2").join(near, "node", "left_semi")
    text = text_of()
    found = docs.select(*text_key(text), text.alias("text")).join(keys, ["t1", "t2"])
    texts = stage(found.groupBy("node").agg(F.first("text").alias("text")), "texts")
    threshold = percent / 100
    star = members.where("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")).distinct()
    tried = stage(_pruned(star, sigs, threshold), "tried")
    links = stage(_verified(tried, texts, k, percent), "links")
    joined = components(links)
    named = members.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("band", "key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("band", "key")
    across = _across(named.select("band", "key", "node", "n", "component").join(mixed, ["band", "key"]), sigs, texts, k, percent)
    whole = components(links.union(stage(across, "across")))
    of_fp = nodes.join(whole, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return rows.select("r", "id", "t1", "t2", "n", "fp").join(of_fp, "fp", "left").drop("fp")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles``, ``component_id`` and ``kept``.

    ``component_id`` is the least id reachable over links; null where no row of the component has an id. A null text is an
    empty one; texts without words are linked with nothing and are their own component. Repeated rows and copies are one
    node. Rows with a repeated id are told apart. An empty table gives no rows. Extra columns are ignored.
    """
    rows = stage(_grouped(docs.select(id_column, "text"), id_column, shingle_words, percent), "grouped")
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("component_id"))
    named = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return named.select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group, all columns; rows without words all stay.

    The row with the least ``doc_id`` stays (nulls last); which of several rows with that id and text is of no account.
    Rows are found again by the key of their text and their id.
    """
    groups = _grouped(docs.select("doc_id", "text"), "doc_id", shingle_words, percent).where("component IS NOT NULL")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t1", "t2")).alias("best")
    first = stage(groups.groupBy("component").agg(best).select("best.id", "best.t1", "best.t2"), "first")
    row, key = (free_name(docs, n) for n in ("row", "key"))
    of_row = lambda t1, t2, i: F.struct(t1, t2, F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("")))
    keep = first.select(of_row(F.col("t1"), F.col("t2"), F.col("id")).alias(key))
    t1, t2 = text_key(text_of())
    worded = F.rlike(text_of(), F.lit(WORD))
    keyed = docs.where(worded).select(F.struct("*").alias(row), of_row(t1, t2, F.col("doc_id")).alias(key))
    one = keyed.join(keep, key, "left_semi").groupBy(key).agg(F.first(row).alias(row)).select(f"{row}.*")
    return one.unionByName(docs.where(~worded))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component at two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)
