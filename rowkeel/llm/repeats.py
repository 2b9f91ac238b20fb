"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

Texts come in batches. A batch gets a sorted array of its sampled suffixes (see :mod:`suffixes`), equal neighbours counted; it is
merge-scanned against the arrays of the existing levels for suffixes that occur in both, and becomes a level itself. Levels
of equal size are merged before the next batch comes, so an index of n batches has at most log n levels and an entry is
rewritten log n times.

Suffixes that the scans report are the only ones looked at again. Runs of windows with equal bytes throughout are
settled by their span hash; runs that share their anchor only are compared window by window, on one representative of each
distinct run. All hashes have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm import suffixes
from rowkeel.llm.common import pieces, stage_once, table, text_of

LENGTH, BATCHES = 200, 3
#: Distinct runs of one anchor that a task compares at once; it bounds memory and changes no result.
RUNS_IN_TASK = 16_384
_ENTRY = "d long, key long, span long, start long, windows int"


def entries(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The sampled suffixes of ``d, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            d = batch.column("d").to_numpy()
            which, key, span, start, count = suffixes.entries([t.as_py().encode() for t in batch.column("text")], length)
            yield pa.record_batch([d[which], key, span, start, count.astype(np.int32)], names=["d", "key", "span", "start", "windows"])

    return docs.select("d", "text").mapInArrow(run, _ENTRY)


class Family:
    """Levels of sorted suffix arrays ``key, n``; level sizes are numbers of batches, powers of two."""

    def __init__(self) -> None:
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> DataFrame:
        """The keys of ``batch`` (entries) that occur twice in it, or in it and in a level; the batch becomes a level."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, one), (_, two) = self.levels.pop(), self.levels.pop()
            merged = one.union(two).groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key")
            self.levels.append((2 * size, stage_once(merged, "level")))
        array = stage_once(batch.groupBy("key").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("key"), "level")
        hits = array.where("n > 1").select("key")
        for _, level in self.levels:
            hits = hits.union(array.join(level.select("key"), "key").select("key"))
        self.levels.append((1, array))
        return hits


def _contexts(docs: DataFrame, info: DataFrame, length: int) -> DataFrame:
    """``key, span, n, runs, context``: the bytes under one representative of each run whose anchor has several distinct runs."""
    wanted = info.where("runs > 1").select("rep.d", F.struct(F.col("rep.start").alias("start"), F.col("rep.windows").alias("windows"), "key", "span", "n", "runs").alias("one"))
    lists = wanted.groupBy("d").agg(F.collect_list("one").alias("all"))
    schema = "key long, span long, n long, runs long, context binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            rows = []
            for text, all_ in zip(batch.column("text"), batch.column("all").to_pylist(), strict=True):
                raw = text.as_py().encode()
                rows += [(e["key"], e["span"], e["n"], e["runs"], raw[e["start"] : e["start"] + e["windows"] + length - 1]) for e in all_]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.binary())], names=["key", "span", "n", "runs", "context"])

    # of copies of a text one is enough
    return docs.join(lists, "d").select("text", "all").mapInArrow(run, schema).dropDuplicates(["key", "span"])


def _window_hashes(contexts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, offset, hash`` of every window of every context."""
    out: list[list[np.ndarray]] = [[], [], []]
    # cut runs come without bytes
    there = np.flatnonzero([len(c) >= length for c in contexts])
    for data, held in suffixes.parts([contexts[i] for i in there], length):
        h = suffixes.Hashes(data).all_of(length).view(np.int64)
        piece = np.array(held, np.int64)
        counts = piece[:, 3] - length + 1
        offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        values = (np.repeat(there[piece[:, 0]], counts), offset + np.repeat(piece[:, 1], counts), h[np.repeat(piece[:, 2], counts) + offset])
        for o, v in zip(out, values, strict=True):
            o.append(v)
    row, offset, h = (np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)
    return row, offset, h


def _partial(contexts: DataFrame, length: int) -> DataFrame:
    """For runs that occur once: which of their windows another run with the same anchor holds too.

    Tasks compare whole groups of anchors. The runs of a common anchor are cut into classes of window hashes, as many as
    keep a class near the size of ``RUNS_IN_TASK`` runs; equal windows fall into the same class.
    """
    groups = max(1, contexts.count() // 4096)
    windows = pa.list_(pa.int64())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of common anchors as ``(class, offsets, hashes)``; the others keep their bytes."""
        for batch in batches:
            classes = -(-batch.column("runs").to_numpy() // RUNS_IN_TASK)
            source, part, offsets, hashes = list(np.flatnonzero(classes == 1)), [], [], []
            part, offsets, hashes = [0] * len(source), [None] * len(source), [None] * len(source)
            large = np.flatnonzero(classes > 1)
            row, offset, h = _window_hashes(batch.column("context").take(pa.array(large)).to_pylist(), length)
            for i, index in enumerate(large):
                own_offset, own_h = offset[row == i], h[row == i]
                own_class = own_h.view(np.uint64) % np.uint64(classes[index])
                for c in np.unique(own_class):
                    source.append(index)
                    part.append(int(c))
                    offsets.append(own_offset[own_class == c])
                    hashes.append(own_h[own_class == c])
            taken = pa.array(source, pa.int64())
            bytes_ = [c if o is None else None for c, o in zip(batch.column("context").take(taken).to_pylist(), offsets, strict=True)]
            yield pa.record_batch(
                [*(batch.column(c).take(taken) for c in ("key", "span", "n")), pa.array(part, pa.int32()), pa.array(bytes_, pa.binary()), pa.array(offsets, windows), pa.array(hashes, windows)],
                names=["key", "span", "n", "part", "context", "offsets", "hashes"],
            )

    def compare(group: pa.Table) -> pa.Table:
        n, key = group["n"].to_numpy(), group["key"].to_numpy()
        contexts_, offsets, hashes = (group[c].to_pylist() for c in ("context", "offsets", "hashes"))
        row, offset, h = _window_hashes([c or b"" for c in contexts_], length)
        cut_rows = [i for i, o in enumerate(offsets) if o is not None]
        if cut_rows:
            row = np.concatenate([row, *(np.full(len(offsets[i]), i) for i in cut_rows)])
            offset = np.concatenate([offset, *(np.array(offsets[i]) for i in cut_rows)])
            h = np.concatenate([h, *(np.array(hashes[i]) for i in cut_rows)])
        own = suffixes.mixed(h.view(np.uint64) ^ suffixes.mixed(key[row].view(np.uint64)))
        _, where, count = np.unique(own, return_inverse=True, return_counts=True)
        again = (count[where] > 1) & (n[row] == 1)
        row, offset = row[again], offset[again]
        order = np.lexsort((offset, row))
        row, offset = row[order], offset[order]
        first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1))) if len(row) else np.zeros(0, np.int64)
        taken = pa.array(row[first])
        size = np.diff(np.append(first, len(row))).astype(np.int32)
        return pa.table({"key": group["key"].take(taken), "span": group["span"].take(taken), "offset": pa.array(offset[first].astype(np.int32)), "windows": pa.array(size)})

    schema = "key long, span long, n long, part int, context binary, offsets array<long>, hashes array<long>"
    parted = contexts.mapInArrow(cut, schema).groupBy(F.pmod(F.xxhash64("key", "part"), F.lit(groups)).alias("g"))
    return parted.applyInArrow(compare, "key long, span long, offset int, windows int")


def repeated(docs: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """``d, found``: for each text with repeats the byte ranges ``(begin, end)`` of its repeated windows, unmerged.

    ``docs`` is ``d, text`` with ``d`` the 64-bit hash of the text; equal texts count as often as they occur.
    """
    all_ = stage_once(entries(docs, length), "entries")
    family = Family()
    hits = None
    for i in range(batches):
        new = family.add(all_.where(F.pmod("d", F.lit(batches)) == i))
        hits = new if hits is None else hits.union(new)
    hits = stage_once(hits.distinct(), "hits")
    again = stage_once(all_.join(hits, "key", "left_semi"), "again")
    runs = again.groupBy("key", "span", "windows").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "start", "windows")).alias("rep"))
    runs = stage_once(runs, "runs")
    info = runs.join(runs.groupBy("key").agg(F.count(F.lit(1)).alias("runs")), "key")
    contexts = stage_once(_contexts(docs, info, length), "contexts")
    partial = stage_once(_partial(contexts, length), "partial")
    whole = runs.where("n > 1").select("key", "span", F.lit(0).alias("offset"), "windows")
    found = again.select("d", "start", "key", "span").distinct().join(whole.union(partial), ["key", "span"])
    begin = F.col("start") + F.col("offset")
    return found.groupBy("d").agg(F.collect_list(F.struct(begin.alias("begin"), (begin + F.col("windows") + (length - 1)).alias("end"))).alias("found"))


def cut_text(raw: bytes, found: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes outside the ranges, the number inside, and the number of maximal runs."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for r in sorted((r["begin"], r["end"]) for r in found or ()):
        if r[0] > end:
            kept.append(raw[at : r[0]])
            runs += 1
            removed += r[1] - r[0]
            end = at = r[1]
        elif r[1] > end:
            removed += r[1] - end
            end = at = r[1]
    kept.append(raw[at:])
    return b"".join(kept), removed, runs


def without_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, batches: int = BATCHES, digest: bool = False) -> DataFrame:
    """``keep`` columns, ``n_bytes, n_removed, n_spans`` and ``kept``, the remaining bytes (their SHA-256 in hex where ``digest``).

    Every byte under a string of ``length`` bytes that also starts elsewhere is removed, in all its places. A null text is
    empty; shorter texts keep everything; repeated rows remove one another; ids may be null or repeated. An empty table
    gives no rows. Removal may split a character, so ``kept`` is binary.
    """
    text = text_of()
    keyed = docs.select(*keep, text.alias("text"), F.xxhash64(text).alias("d"))
    plain = docs.select(text.alias("text"), F.xxhash64(text).alias("d"))
    joined = keyed.join(repeated(plain, length, batches), "d", "left").select(*keep, F.col("text").alias("__text"), F.col("found").alias("__found"))
    kind = T.StringType() if digest else T.BinaryType()
    numbers = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([*docs.select(*keep).schema, *numbers, T.StructField("kept", kind)])

    def run(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches_in, "__text"):
            rows = []
            for t, found in zip(batch.column("__text"), batch.column("__found").to_pylist(), strict=True):
                raw = t.as_py().encode()
                kept, removed, runs = cut_text(raw, found)
                rows.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest() if digest else kept))
            columns = list(zip(*rows, strict=True))
            own = [batch.column(i) for i, n in enumerate(batch.schema.names) if n not in ("__text", "__found")]
            out = [*own, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string() if digest else pa.binary())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return joined.mapInArrow(run, schema)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeats of 200 bytes, digested."""
    return without_repeats(table(spark, sf_dir, "documents"), ["doc_id"], digest=True).withColumnRenamed("kept", "kept_sha256")
