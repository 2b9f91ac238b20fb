"""Stored trigram postings (J7): names are split once, and batches are looked up and appended.

The order of grams, rarest first, is fixed when the index is made; grams that come up later stand before all others. So the
prefix filter of :mod:`rowkeel.operators.similar` stays exact while the index grows: two similar names meet at a gram of their
prefixes. A posting is ``(gram, band, size, place, name)``, without the gram set; postings lie in folders by the hash of gram and size
band, so a batch reads those of its own grams and of sizes that can be similar. Sets are fetched for surviving pairs only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.operators.change import assign_ids
from rowkeel.operators.similar import trigrams
from rowkeel.sources.staging import names_in, read_small_text, stage, write_if_absent
from rowkeel.sources.tables import union_all

_NAMES = "name string, grams array<bigint>"
_COPIES = "name string, copies bigint"
_POSTINGS = "gram bigint, band int, size int, place int, name string, _bucket int"
_RANKS = "gram string, rank bigint"


def _code(gram: Column) -> Column:
    """The three code points of a gram as one negative number, different for every gram."""
    digits = F.hex(F.encode(gram, "utf-32"))
    points = [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(3)]
    return F.lit(-(1 << 63)) + F.shiftleft(points[0], 42) + F.shiftleft(points[1], 21) + points[2]


def _band(size: Column) -> Column:
    """Sizes are filed by powers of two."""
    return F.floor(F.log2(size)).cast("int")


def _kept(size: Column, threshold: float) -> Column:
    """Length of the prefix; the tolerance keeps a product that should be whole from being rounded up."""
    return size - F.ceil(size * F.lit(threshold) - 1e-9).cast("int") + 1


@dataclass(frozen=True)
class _State:
    ranks: str
    names: list[str]
    copies: list[str]
    postings: list[str]
    threshold: float
    buckets: int


@dataclass(frozen=True)
class TrigramIndex:
    """An index below ``root``: :meth:`create` once, then :meth:`lookup` and :meth:`append`."""

    spark: SparkSession
    root: str

    def _versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n, _ in names_in(self.spark, f"{self.root}/versions") if n.endswith(".json"))

    def _state(self) -> tuple[int, _State]:
        number = max(self._versions(), default=0)
        if not number:
            raise ValueError(f"no index at {self.root}")
        return number, _State(**json.loads(read_small_text(self.spark, f"{self.root}/versions/{number:020d}.json")))

    def _commit(self, number: int, state: _State) -> None:
        if not write_if_absent(self.spark, f"{self.root}/versions/{number:020d}.json", json.dumps(asdict(state), indent=2)):
            raise RuntimeError(f"another writer changed the index at {self.root}")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return union_all([self.spark.read.schema(schema).parquet(p) for p in paths])

    def _new(self, kind: str) -> str:
        return f"{self.root}/{kind}/{uuid.uuid4().hex}"

    def _split(self, names: DataFrame, ranks: DataFrame) -> DataFrame:
        """``name, grams`` in the order of the index; the only place where a text is split."""
        grams = stage(names.select("name", F.explode(trigrams("name")).alias("gram")), "split")
        known = grams.select("gram").distinct().join(ranks, "gram", "left")
        known = known.select("gram", F.coalesce("rank", _code(F.col("gram"))).alias("rank"))
        sets = grams.join(known, "gram").groupBy("name").agg(F.sort_array(F.collect_list("rank")).alias("grams"))
        return stage(sets, "ordered")

    def _post(self, sets: DataFrame, threshold: float, buckets: int) -> str:
        size = F.size("grams")
        rows = sets.select("name", size.alias("size"), F.posexplode(F.slice("grams", F.lit(1), _kept(size, threshold))).alias("place", "gram"))
        rows = rows.withColumn("band", _band(F.col("size"))).withColumn("_bucket", _bucket(F.col("gram"), F.col("band"), buckets))
        path = self._new("postings")
        rows.select("gram", "band", "size", "place", "name", "_bucket").hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(path)
        return path

    def create(self, df: DataFrame, text: str, threshold: float = 0.3, buckets: int = 64) -> None:
        """Index the names of ``df``; no lookup may ask for less than ``threshold``."""
        counted = _counted(df, text)
        copies = self._new("copies")
        stage(counted, path=copies)
        names = self._read([copies], _COPIES).select("name")
        counts = names.select(F.explode(trigrams("name")).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        ranks = self._new("ranks")
        stage(assign_ids(counts, "rank", 1, ["n", "gram"]).select("gram", "rank"), path=ranks)
        sets = self._split(names, self.spark.read.schema(_RANKS).parquet(ranks))
        at = self._new("names")
        stage(sets, path=at)
        self._commit(1, _State(ranks, [at], [copies], [self._post(sets, threshold, buckets)], threshold, buckets))

    def append(self, batch: DataFrame, text: str) -> int:
        """Add the names of a batch; those that are there already only gain copies. Returns the number of new names."""
        number, state = self._state()
        copies = self._new("copies")
        stage(_counted(batch, text), path=copies)
        names = self._read([copies], _COPIES).select("name")
        fresh = stage(names.join(self._read(state.names, _NAMES).select("name"), "name", "left_anti"), "fresh-names")
        sets = self._split(fresh, self.spark.read.schema(_RANKS).parquet(state.ranks))
        at = self._new("names")
        stage(sets, path=at)
        postings = self._post(sets, state.threshold, state.buckets)
        self._commit(number + 1, _State(state.ranks, [*state.names, at], [*state.copies, copies], [*state.postings, postings], state.threshold, state.buckets))
        return fresh.count()

    def lookup(self, batch: DataFrame, text: str, threshold: float | None = None) -> DataFrame:
        """``(name, match, similarity, copies)`` like :func:`rowkeel.operators.similar.trigram_lookup`, over what was indexed so far."""
        _, state = self._state()
        threshold = state.threshold if threshold is None else threshold
        if threshold < state.threshold:
            raise ValueError(f"the index was made for similarities from {state.threshold}")
        sets = self._split(_counted(batch, text).select("name"), self.spark.read.schema(_RANKS).parquet(state.ranks))
        size = F.size("grams")
        least, most = F.ceil(size * threshold - 1e-9).cast("int"), F.floor(size / threshold + 1e-9).cast("int")
        probes = sets.select("name", size.alias("own_size"), least.alias("least"), most.alias("most"), F.posexplode(F.slice("grams", F.lit(1), _kept(size, threshold))).alias("own_place", "gram"))
        probes = probes.withColumn("band", F.explode(F.sequence(_band(F.col("least")), _band(F.col("most")))))
        probes = stage(probes.withColumn("_bucket", _bucket(F.col("gram"), F.col("band"), state.buckets)), "probes")
        # one row per bucket
        touched = [r[0] for r in probes.select("_bucket").distinct().collect()]
        postings = self._read(state.postings, _POSTINGS).where(F.col("_bucket").isin(touched)).withColumnRenamed("name", "match")
        met = probes.join(postings, ["_bucket", "gram", "band"])
        needed = F.lit(threshold / (1 + threshold)) * (F.col("own_size") + F.col("size")) - 1e-9
        fits = F.col("size").between(F.col("least"), F.col("most")) & (F.col("place") < _kept(F.col("size"), threshold))
        # from a common gram on, two names share no more than what is left of the shorter rest; before it, no more than the places
        rest = F.least(F.col("own_size") - F.col("own_place"), F.col("size") - F.col("place"))
        fits = fits & (rest + F.least("own_place", "place") >= needed)
        pairs = stage(met.where(fits).select("name", "match").distinct(), "candidates")
        stored = self._read(state.names, _NAMES).join(pairs.select(F.col("match").alias("name")).distinct(), "name", "left_semi")
        found = pairs.join(sets, "name").join(stored.select(F.col("name").alias("match"), F.col("grams").alias("theirs")), "match")
        common = F.size(F.array_intersect("grams", "theirs"))
        sized = found.select("name", "match", F.explode(F.array(common)).alias("common"), (F.size("grams") + F.size("theirs")).alias("sizes"))
        ratio = F.col("common") / (F.col("sizes") - F.col("common"))
        hits = sized.where(ratio >= threshold).select("name", "match", F.round(ratio, 6).alias("similarity"))
        copies = self._read(state.copies, _COPIES).groupBy(F.col("name").alias("match")).agg(F.sum("copies").alias("copies"))
        return hits.join(copies, "match").select("name", "match", "similarity", "copies")


def _bucket(gram: Column, band: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram, band), F.lit(buckets)).cast("int")


def _counted(df: DataFrame, text: str) -> DataFrame:
    """Distinct names with a letter or a digit, and their rows."""
    rows = df.where(F.col(text).rlike(r"[\p{L}\p{N}]")).groupBy(F.col(text).alias("name"))
    return rows.agg(F.count(F.lit(1)).alias("copies"))
