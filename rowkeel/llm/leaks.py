"""Benchmark decontamination by Aho-Corasick automata over normalised windows of the test items.

A *window* is ``window`` consecutive words of a test text, or all words of a shorter one. The windows are written between
blanks (`` w1 w2 ... ``) into one automaton, and the normalised words of a document, between blanks too, are read by it once:
every place where a window occurs is reported, overlaps included. The words of a reported place are *hit*; only documents
with a hit are looked at again, to turn word numbers into offsets of the original text.

What goes to the executors is bounded: a word longer than ``LONGEST`` bytes is written as a digest of 34 bytes, so a window has
a known largest size, and an automaton takes ``PAIRS`` rows of (window, item). More test items make
more automata, each in a pass of its own, whose finds are brought together by the hash of the text. Documents are not
shuffled when one automaton holds all, and whatever the number of automata only those with finds are otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from uuid import uuid4

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm import wording
from rowkeel.llm.common import free_name, pieces, resident, table, text_of
from rowkeel.operators.change import assign_ids
from rowkeel.sources.staging import stage

WINDOW = 10
#: Bytes of a word that is written out; a longer one is written as a zero byte and a digest of 128 bits.
LONGEST = 64
#: (window, item) rows of one automaton: at most 65 MB of patterns.
PAIRS = 100_000

_SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
_FOUND = f"struct<n_words:long,spans:{_SPANS},items:array<string>>"


def _written(words: list[bytes]) -> list[bytes]:
    if words and max(map(len, words)) > LONGEST:
        return [w if len(w) <= LONGEST else b"\x00" + blake2b(w, digest_size=16).hexdigest().encode() for w in words]
    return words


def windows_of(text: str, window: int) -> set[str]:
    """The windows of a test text as patterns of the automaton; none without words."""
    words = _written(wording.normal_words(text.encode()))
    n = len(words)
    return {f" {b' '.join(words[i : i + window]).decode()} " for i in range(max(1, n - window + 1))} if n else set()


def pairs_of(items: DataFrame, id_col: str, text_cols: tuple[str, ...], window: int) -> DataFrame:
    """Distinct ``(pattern, item)`` of all texts of the items; a null id is the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = sorted(windows_of(text, window))
                for at in range(0, len(found), 1 << 13):
                    part = found[at : at + (1 << 13)]
                    yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([item] * len(part), pa.string())], names=["pattern", "item"])

    texts = F.explode(F.array(*[text_of(c) for c in text_cols])).alias("text")
    return items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), texts).mapInArrow(run, "pattern string, item string").distinct()


class Automaton:
    """All windows of one broadcast in one machine; the value of a window are its items."""

    def __init__(self, patterns: list[str], items: list[str]):
        owners: dict[str, list[str]] = {}
        for p, i in zip(patterns, items, strict=True):
            owners.setdefault(p, []).append(i)
        self.items = list(owners.values())
        self.machine = ahocorasick.Automaton()
        for number, p in enumerate(owners):
            self.machine.add_word(p, (number, p.count(" ") - 1))
        if owners:
            self.machine.make_automaton()

    def scan(self, data: bytes) -> tuple[int, list[dict], list[str]]:
        """Words of a text, its maximal runs of hit words, and the items that occur.

        ``first`` and ``last`` number words from 0, last exclusive; ``start`` and ``end`` are code points of the text.
        """
        words = _written(wording.normal_words(data))
        if not words or not self.items:
            return len(words), [], []
        line = f" {b' '.join(words).decode()} "
        found = list(self.machine.iter(line))
        if not found:
            return len(words), [], []
        blanks = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), "<u4") == 0x20)
        stop = np.searchsorted(blanks, [end for end, _ in found])
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, stop, -1)
        np.add.at(change, stop - np.array([n for _, (_, n) in found]), 1)
        hit = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        first, last = edges[::2], edges[1::2]
        begin, end = wording.word_bytes(data)
        before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
        spans = zip(first.tolist(), last.tolist(), before[begin[first]].tolist(), before[end[last - 1]].tolist(), strict=True)
        names = {i for number in {number for _, (number, _) in found} for i in self.items[number]}
        return len(words), [dict(zip(("first", "last", "start", "end"), s, strict=True)) for s in spans], sorted(names)


def _scanned(docs: DataFrame, text: str, sent: Broadcast, into: str, only_found: bool) -> DataFrame:
    """``docs`` without ``text`` and with the struct ``into``; with ``only_found`` just the rows that have finds."""
    rest = docs.drop(text)
    schema = T.StructType([*rest.schema.fields, T.StructField(into, T._parse_datatype_string(_FOUND))])
    token = ("leaks", uuid4().hex)
    types = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = resident(token, lambda: Automaton(*sent.value))
        for batch in pieces(batches, text):
            got = [machine.scan(v.as_buffer().to_pybytes()) for v in batch.column(text)]
            kept = [i for i, g in enumerate(got) if g[1] or not only_found]
            if not kept:
                continue
            columns = zip(*(got[i] for i in kept), strict=True)
            struct = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["n_words", "spans", "items"])
            own = [c for c in batch.schema.names if c != text]
            rows = batch if len(kept) == batch.num_rows else batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in own), struct], names=[*own, into])

    return docs.select(*rest.columns, text).mapInArrow(run, schema)


def _merged(finds: DataFrame) -> DataFrame:
    """``key, spans``: the spans of several automata as maximal runs, where those that overlap or touch are one."""
    parts = finds.select("key", F.inline("leak.spans"))
    order = Window.partitionBy("key").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = parts.withColumn("begins", F.coalesce((F.col("first") > reach).cast("int"), F.lit(1)))
    runs = begins.withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = runs.groupBy("key", "run").agg(*[f(c).alias(c) for f, c in ((F.min, "first"), (F.max, "last"), (F.min, "start"), (F.max, "end"))])
    return whole.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("first", "last", "start", "end"))).alias("spans"))


def found_in(
    docs: DataFrame,
    items: DataFrame,
    item_id: str = "item_id",
    item_texts: tuple[str, ...] = ("text",),
    text_col: str = "text",
    window: int = WINDOW,
    into: str = "leak",
    pairs: int = PAIRS,
) -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``, ``spans`` of hit words, and the ids of ``items`` that occur, as sorted texts.

    ``item_texts`` are the columns of a test item, as its question and its answer. A span has its words (``first, last``) and its place in the
    original text (``start, end``, code points, end exclusive). All columns stay, whatever their names; ``into`` must not be
    one of them. A null text has no words; repeated rows give equal rows; a null item id counts as an item named by the empty
    text; without items nothing is hit.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{into} is a column already")
    spark = docs.sparkSession
    known = stage(pairs_of(items, item_id, item_texts, window), "windows")
    groups = max(1, -(-known.count() // pairs))
    text, key = free_name(docs, "_leak_text"), free_name(docs, "_leak_key")
    named = docs.withColumn(text, text_of(text_col))

    def sent(part: DataFrame) -> Broadcast:
        # at most `pairs` rows of bounded length
        rows = part.select("pattern", "item").toArrow()
        return spark.sparkContext.broadcast((rows["pattern"].to_pylist(), rows["item"].to_pylist()))

    if groups == 1:
        return _scanned(named, text, sent(known), into, False)
    numbered = stage(assign_ids(known, "number", 0), "window-numbers")
    texts = named.select(F.sha2(text, 256).alias("key"), F.col(text).alias("text"))
    for g in range(groups):
        part = numbered.where((F.col("number") >= g * pairs) & (F.col("number") < (g + 1) * pairs))
        finds = _scanned(texts, "text", sent(part), "leak", True).dropDuplicates(["key"])
        finds = stage(finds, "leaks")
        every = finds if g == 0 else every.unionByName(finds)
    names = every.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("leak.items")))).alias("items"))
    merged = _merged(every).join(names, "key")
    found = free_name(docs, "_leak_found")
    merged = merged.select(F.col("key").alias(key), F.struct("spans", "items").alias(found))
    n_words = F.regexp_count(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(wording.PATTERN)).cast("long")
    spans, owners = F.coalesce(F.col(found)["spans"], F.array().cast(_SPANS)), F.coalesce(F.col(found)["items"], F.array().cast("array<string>"))
    whole = F.struct(n_words.alias("n_words"), spans.alias("spans"), owners.alias("items"))
    return named.withColumn(key, F.sha2(text, 256)).join(merged, key, "left").withColumn(into, whole).select(*docs.columns, into)


def decontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows that hold a window of an item."""
    into = free_name(docs, "leak")
    return found_in(docs, items, into=into, **options).where(F.size(F.col(into)["spans"]) == 0).drop(into)


def op12_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words, those hit by test items, and the items.

    A null or empty text has no words; null ids and repeated rows are rows like others; equal item ids count as one item and a
    null one as the empty text; extra columns are ignored; an empty table gives no rows, and without items nothing is hit.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leak = found_in(docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("leak.spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    out = leak.select("doc_id", "leak.n_words", hit.alias("n_hit"), "leak.items")
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[k + 1:k + least(len(w), 10)], ' ') AS gram
  FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 9))) AS k FROM i WHERE len(w) > 0)),
g AS (
  SELECT rid, k, size, array_to_string(w[k + 1:k + size], ' ') AS gram
  FROM (SELECT rid, w, size, unnest(range(0, len(w) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM p) WHERE len(w) >= size)),
m AS (SELECT rid, k, size, item FROM g JOIN p USING (size, gram)),
h AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(k, k + size)) AS pos FROM m) GROUP BY rid),
s AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(s.n, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN s USING (rid)
"""
