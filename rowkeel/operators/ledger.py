"""An applied-once ledger whose files have membership filters.

Ledger rows (key and checksum) lie in one folder per append and bucket of the key's hash. Beside each folder stands a Bloom filter of
its keys, as a table of 64-bit words. A batch tests its keys against the filters of their buckets and then opens only the
folders that may hold one of them. A filter never denies a key that is there, so the result is that of the whole ledger.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.operators.change import IncrementResult, apply_increment, classify_increment
from rowkeel.sources.staging import names_in, read_small_text, stage, write_if_absent
from rowkeel.sources.tables import union_all

#: Bits per key and hash functions: about one key in a hundred is let through in vain.
BITS, HASHES = 10, 7
_WORDS = "_bucket int, part string, word bigint, bits bigint"
_SIZES = "_bucket int, part string, words bigint"


@dataclass(frozen=True)
class _State:
    parts: list[str]
    key: list[str]
    schema: str
    buckets: int


def _keyed(key: list[str]) -> Column:
    return ~F.array_contains(F.array(*[F.col(k).isNull() for k in key]), F.lit(True))


def _bucketed(df: DataFrame, key: list[str], buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))


def _places(key: list[str]) -> Column:
    """The hashes of a key; one gives a word and a bit of a filter of any size."""
    return F.array(*[F.xxhash64(F.lit(i), *key) for i in range(HASHES)])


def _word(h: Column, words: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 6), words)


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))


@dataclass(frozen=True)
class FilteredLedger:
    """The ledger below ``root``: ``parts/`` (rows), ``sizes/`` and ``words/`` (filters), ``versions/`` (small files)."""

    spark: SparkSession
    root: str

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in names_in(self.spark, f"{self.root}/versions") if n.endswith(".json"))

    def _state(self) -> tuple[int, _State]:
        number = max(self._versions(), default=0)
        if not number:
            raise ValueError(f"no ledger at {self.root}")
        return number, _State(**json.loads(read_small_text(self.spark, f"{self.root}/versions/{number:020d}.json")))

    def _commit(self, number: int, state: _State) -> None:
        if not write_if_absent(self.spark, f"{self.root}/versions/{number:020d}.json", json.dumps(asdict(state), indent=2)):
            raise RuntimeError(f"another writer changed the ledger at {self.root}")

    def _schema(self, state: _State) -> T.StructType:
        return T.StructType.fromJson(json.loads(state.schema))

    def _read(self, kind: str, parts: list[str], schema: str) -> DataFrame:
        return union_all([self.spark.read.schema(schema).parquet(f"{self.root}/{kind}/{p}") for p in parts])

    def _written(self, rows: DataFrame, key: list[str], buckets: int) -> str:
        part = uuid.uuid4().hex
        dealt = _bucketed(rows, key, buckets).hint("rebalance", "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/parts/{part}")
        stored = self.spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_bucket", T.IntegerType())])).parquet(f"{self.root}/parts/{part}")
        keys = stored.select("_bucket", _places(key).alias("places"))
        words = F.ceil(F.count(F.lit(1)) * BITS / 64).cast("bigint")
        sizes = stage(keys.groupBy("_bucket").agg(words.alias("words")).select("_bucket", F.lit(part).alias("part"), "words"), path=f"{self.root}/sizes/{part}")
        marked = keys.join(sizes, "_bucket").select("_bucket", "part", "words", F.explode("places").alias("h"))
        bits = marked.groupBy("_bucket", "part", _word(F.col("h"), F.col("words")).alias("word")).agg(F.bit_or(_bit(F.col("h"))).alias("bits"))
        stage(bits, path=f"{self.root}/words/{part}")
        return part

    def create(self, ledger: DataFrame, key: list[str], buckets: int = 16) -> None:
        """Start with the rows of a ledger (``key`` and ``checksum``). Choose ``buckets`` so that a folder holds some hundred megabytes."""
        rows = ledger.select(*key, "checksum")
        self._commit(1, _State([self._written(rows, key, buckets)], list(key), rows.schema.json(), buckets))

    def append(self, ledger: DataFrame) -> None:
        number, state = self._state()
        rows = ledger.select(*state.key, "checksum")
        self._commit(number + 1, _State([*state.parts, self._written(rows, state.key, state.buckets)], state.key, state.schema, state.buckets))

    def compact(self) -> None:
        """Write all parts as one, so that a batch tests one filter per bucket."""
        number, state = self._state()
        self._commit(number + 1, _State([self._written(self.rows(), state.key, state.buckets)], state.key, state.schema, state.buckets))

    def rows(self) -> DataFrame:
        _, state = self._state()
        schema = self._schema(state)
        return union_all([self.spark.read.schema(schema).parquet(f"{self.root}/parts/{p}").select(*schema.names) for p in state.parts])

    def folders(self, batch: DataFrame) -> list[str]:
        """The folders that may hold a key of the batch; keys with a NULL are never in the way."""
        _, state = self._state()
        keys = _bucketed(batch.select(*state.key).where(_keyed(state.key)).distinct(), state.key, state.buckets)
        keys = keys.select("_bucket", F.xxhash64(F.lit("key"), *state.key).alias("id"), _places(state.key).alias("places"))
        asked = keys.join(self._read("sizes", state.parts, _SIZES), "_bucket").select("_bucket", "part", "words", "id", F.explode("places").alias("h"))
        asked = asked.select("_bucket", "part", "id", _word(F.col("h"), F.col("words")).alias("word"), _bit(F.col("h")).alias("bit"))
        met = asked.join(self._read("words", state.parts, _WORDS), ["_bucket", "part", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) != 0)
        # a key may be there when all of its bits are set; keys that share an id let through a folder too many at most
        through = met.groupBy("_bucket", "part", "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HASHES)
        found = through.select("_bucket", "part").distinct()
        # one row per folder of the ledger at most
        return sorted(f"{self.root}/parts/{r['part']}/_bucket={r['_bucket']}" for r in found.collect())

    def near(self, batch: DataFrame) -> DataFrame:
        """The ledger rows that matter for a batch, and others of the same folders."""
        _, state = self._state()
        schema, found = self._schema(state), self.folders(batch)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*found).select(*schema.names)

    def classify(self, batch: DataFrame, content: str) -> DataFrame:
        """:func:`rowkeel.operators.change.classify_increment` against this ledger."""
        return classify_increment(batch, self.near(batch), self._state()[1].key, content)

    def apply(self, batch: DataFrame, content: str, allow: bool = True) -> IncrementResult:
        """:func:`rowkeel.operators.change.apply_increment`, with the new rows appended to the ledger."""
        done = apply_increment(batch, self.near(batch), self._state()[1].key, content, allow)
        if not done.blocked:
            fresh = stage(done.ledger, "increment")
            self.append(fresh)
        return done
