"""Importance resampling towards a target distribution, ranked by a distributed radix sort.

Runs of one to three words are hashed into ``BUCKETS`` buckets. The counts of all source and of all target texts are added up by
a shuffle of at most ``BUCKETS`` rows a task; their log ratio is an array that every task holds, and a text's weight is the sum of
its buckets' entries. A Gumbel draw from the hash of the id makes the highest scores a sample without replacement.

The ranks come from a least-significant-digit radix sort. All rows are dealt into blocks of ``BLOCK`` places. In each pass a table
of (block, digit) counts is summed into global offsets: first by digit, then by block. Every block then puts its rows in order
of place, numbers the rows of each digit (a stable counting sort), and adds the offset; that number is the row's place in
the next pass, and its block follows from it. Blocks are equally full in every pass whatever the keys are, so no
key, however frequent, makes a large task. Each pass is a written table, from which lost tasks start again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm.common import free_name, pieces, table, text_of
from rowkeel.llm.wording import normal_words
from rowkeel.operators.change import assign_ids
from rowkeel.sources.staging import stage

BUCKETS = 10_000
#: Places of a block, and the widest digit in bits.
BLOCK, DIGIT_BITS = 1 << 15, 13
#: Words that a text needs to be drawn, and the drawn share in percent.
LEAST_WORDS, PERCENT = 20, 5


def feature_buckets(data: bytes, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Words of a text, and the bucket of every run of one to three words.

    A run's checksum goes on from that of the run without its last word, so every word is read three times however long runs are.
    """
    words = normal_words(data)
    one = list(map(crc32, words))
    joined = [b" " + w for w in words[1:]]
    two = list(map(crc32, joined, one))
    three = list(map(crc32, joined[1:], two))
    return len(words), np.array(one + two + three, np.uint32) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts; a task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in pieces(batches, "text"):
            for value in batch.column("text"):
                sums += np.bincount(feature_buckets(value.as_buffer().to_pybytes(), buckets)[1], minlength=buckets)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], names=["bucket", "n"])

    found = texts.select(text_of(text_col).alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of every bucket, rounded down."""
    s, t, n = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, text_col: str = "text", into: str = "importance") -> DataFrame:
    """``docs`` with a struct ``into``: ``n_words``, ``n_features`` and ``weight``; a null text has none and weighs 0."""
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    @F.arrow_udf("struct<n_words:long,n_features:long,weight:long>")
    def weigh(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = sent.value
        for part in parts:
            rows = np.zeros((len(part), 3), np.int64)
            for i, value in enumerate(part):
                n, found = feature_buckets(value.as_buffer().to_pybytes(), len(own))
                rows[i] = n, len(found), own[found].sum()
            yield pa.StructArray.from_arrays([pa.array(rows[:, i].copy()) for i in range(3)], ["n_words", "n_features", "weight"])

    return docs.withColumn(into, weigh(text_of(text_col)))


def gumbel(row_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel draw from the seed and the id, rounded down; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


@dataclass(frozen=True)
class Field:
    """One field of the sort key: a column that counts from 0 as an unsigned number of ``bits`` bits."""

    value: Column
    bits: int


def ascending(column: str, least: int | None, most: int | None) -> Field:
    """A long column whose rows lie within ``least`` and ``most``, smallest first, nulls last."""
    if least is None:
        return Field(F.lit(0).cast("long"), 0)
    if most - least < (1 << 63) - 1:
        return Field(F.coalesce(F.col(column) - F.lit(least), F.lit(most - least + 1)).cast("long"), (most - least + 1).bit_length())
    # the sign bit turned over orders signed numbers as unsigned ones; one bit more in front for null
    return Field(F.col(column).bitwiseXOR(F.lit(-(1 << 63))), 64)


def descending(column: str, least: int, most: int) -> Field:
    return Field(F.lit(most) - F.col(column), (most - least).bit_length())


def digit(fields: list[Field], low: int, width: int) -> Column:
    """Bits ``low`` to ``low + width`` of the fields written one after another, the last field lowest."""
    out, at = F.lit(0).cast("long"), 0
    for f in reversed(fields):
        first, end = max(low, at), min(low + width, at + f.bits)
        if first < end:
            part = F.shiftrightunsigned(F.coalesce(f.value, F.lit(0).cast("long")), first - at).bitwiseAND(F.lit((1 << (end - first)) - 1))
            out = out.bitwiseOR(F.shiftleft(part, first - low))
        at += f.bits
    return out.cast("int")


def offsets(rows: DataFrame) -> DataFrame:
    """``of_block, of_digit, offset``: the place of the first row of every (block, digit), from the counts of ``rows``."""
    counts = rows.groupBy("block", "digit").agg(F.count(F.lit(1)).alias("n"))
    # at most one row per digit, so the running sum over all of them is small
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.groupBy("digit").agg(F.sum("n").alias("n")).select("digit", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return within.join(base, "digit").select(F.col("block").alias("of_block"), F.col("digit").alias("of_digit"), (F.col("base") + F.col("earlier")).alias("offset"))


def counting_pass(rows: DataFrame, name: Column, block: int) -> DataFrame:
    """One stable pass: ``rows`` (with ``place`` and ``block``) at their places after ordering by the digit ``name``."""
    rows = rows.withColumn("digit", name)
    schema = rows.drop("digit").schema

    def put(mine: pa.Table, table_of: pa.Table) -> pa.Table:
        n = mine.num_rows
        if not n:
            return schema_empty
        place = mine["place"].to_numpy()
        digits = mine["digit"].to_numpy().astype(np.uint16)
        here = np.empty(n, np.int64)
        # places of a block are a run without gaps
        here[place - place.min()] = np.arange(n)
        size = int(digits.max()) + 1
        start = np.cumsum(np.bincount(digits, minlength=size)) - np.bincount(digits, minlength=size)
        by_digit = here[np.argsort(digits[here], kind="stable")]
        among = np.empty(n, np.int64)
        among[by_digit] = np.arange(n) - start[digits[by_digit]]
        offset = np.zeros(size, np.int64)
        offset[table_of["of_digit"].to_numpy()] = table_of["offset"].to_numpy()
        new = offset[digits] + among
        out = mine.drop_columns(["digit"])
        out = out.set_column(out.schema.get_field_index("place"), "place", pa.array(new))
        return out.set_column(out.schema.get_field_index("block"), "block", pa.array(new // block))

    schema_empty = pa.table({f.name: pa.array([], pa.int64()) for f in schema.fields})
    moved = rows.groupBy("block").cogroup(offsets(rows).groupBy("of_block")).applyInArrow(put, schema)
    return stage(moved, "radix")


def radix_sorted(rows: DataFrame, fields: list[Field], block: int = BLOCK, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``rows`` (columns of type long) with ``place``, their number from 0 in the order of ``fields``, the first one most significant.

    Rows equal in all fields keep the order they are first written in.
    """
    placed = stage(assign_ids(rows, "place", 0).withColumn("block", F.floor(F.col("place") / block).cast("long")), "radix")
    total = sum(f.bits for f in fields)
    passes = -(-total // digit_bits)
    for i in range(passes):
        low, high = total * i // passes, total * (i + 1) // passes
        placed = counting_pass(placed, digit(fields, low, high - low), block)
    return placed.drop("block")


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, block: int = BLOCK, digit_bits: int = DIGIT_BITS) -> DataFrame:
    """``scored`` (``doc_id, n_words, n_features, weight, score``, all long) with ``rank`` from 1 of the drawn rows, null for all others.

    Drawn are the highest scores among rows of enough words; ties go to the smaller id, then to fewer features, a null id last.
    """
    fit = scored.where(F.col("n_words") >= least_words)
    spans = ("score", "doc_id", "n_features")
    seen = fit.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}_{c}") for c in spans for k, f in (("min", F.min), ("max", F.max))]).first()
    rest = scored.where(F.coalesce(F.col("n_words") < least_words, F.lit(True))).withColumn("rank", F.lit(None).cast("long"))
    if not seen["n"]:
        return rest
    bounds = {c: (seen[f"min_{c}"], seen[f"max_{c}"]) for c in spans}
    fields = [descending("score", *bounds["score"]), ascending("doc_id", *bounds["doc_id"]), ascending("n_features", *bounds["n_features"])]
    if fields[1].bits == 64:
        fields.insert(1, Field(F.col("doc_id").isNull().cast("long"), 1))
    order = radix_sorted(fit, fields, block, digit_bits)
    rank = F.when(F.col("place") < percent * seen["n"] // 100, F.col("place") + 1)
    return order.withColumn("rank", rank).drop("place").unionByName(rest)


def scored(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row of ``docs`` against the texts of ``target``, as a written table."""
    gain = gains(bucket_counts(docs, text_col), bucket_counts(target))
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = weighed(named, gain).select("doc_id", "importance.*")
    return stage(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scores")


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` whose ids are drawn, with all their columns, whatever these are called.

    Rows that share an id are drawn together when one of them is.
    """
    own = free_name(docs, "_drawn_id")
    drawn = ranked(scored(docs, target), **options).where(F.col("rank").isNotNull())
    return docs.join(drawn.select(F.col("doc_id").alias(own)).distinct(), F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the test items, its score, and its rank where it is drawn.

    A null or empty text has no words, weighs 0 and is never drawn; a null id draws as the empty text and loses ties; repeated
    rows are ranked one after another; extra columns are ignored; an empty table gives no rows; without target texts the gains are
    those of an even target.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked(scored(docs, table(spark, sf_dir, "benchmark"))).select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum of a run, byte by byte, from the shifted table of its polynomial that SQL works out itself.
_CRC = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, octet_length(encode(f))::INT),
    lambda i: ('0x' || substr(hex(encode(f)), 2 * i::INT + 1, 2))::UBIGINT)),
    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255)::INT + 1]))"""
ORACLE = f"""
WITH step AS (
  SELECT list(list_reduce(list_prepend(n::UBIGINT, list_transform(range(0, 8), lambda x: x::UBIGINT)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY n) AS crc
  FROM range(0, 256) r(n)),
a AS (
  SELECT TRUE AS own, row_number() OVER () AS rid, doc_id, text FROM documents
  UNION ALL SELECT FALSE, row_number() OVER (), NULL, text FROM benchmark),
w AS (
  SELECT own, rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM a),
f AS (SELECT own, rid, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM w),
n AS (SELECT own, rid, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT f, (xor({_CRC}, 4294967295::UBIGINT) % 10000)::INT AS bucket FROM (SELECT DISTINCT f FROM n), step),
c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM n JOIN b USING (f) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
  FROM c),
v AS (SELECT rid, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE own GROUP BY rid),
z AS (
  SELECT rid, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN v USING (rid) WHERE own),
o AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place,
    count(*) FILTER (n_words >= 20) OVER () AS n FROM z)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM o
"""
