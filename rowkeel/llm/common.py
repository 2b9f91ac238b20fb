"""What the operators share: table access, free column names, and Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.sources.staging import stage

#: Code points of the white space that separates words, as a Java pattern of one word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that ``df`` does not have yet, whatever its extra columns are called."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of ``column``, so that memory follows bytes and not rows.

    A row longer than that makes a batch of its own.
    """
    for batch in batches:
        size, first = 0, 0
        at = batch.schema.get_field_index(column)
        for i, n in enumerate(pa.compute.binary_length(batch.column(at)).to_pylist()):
            if size and size + (n or 0) > most_bytes:
                yield batch.slice(first, i - first)
                size, first = 0, i
            size += n or 0
        if first < batch.num_rows:
            yield batch.slice(first)


def tokens(text: str) -> list[bytes]:
    """Words in lower case (A-Z only): ``bytes.split`` and ``bytes.lower`` know exactly the ASCII space and letters."""
    return text.encode("utf-8", "surrogatepass").lower().split()


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_held: tuple = (None, None)


def resident(key: tuple, make: Callable):
    """What a worker process keeps between tasks: the tables of one operator at a time.

    A worker serves one operator after another; without this, the tables of all of them would add up in its memory.
    """
    global _held
    if _held[0] != key:
        release()
        _held = (key, make())
    return _held[1]


def release() -> None:
    """Forget the tables of the last operator."""
    global _held
    if _held[0] is not None:
        _held = (None, None)
        pa.default_memory_pool().release_unused()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Spark drops the shuffle files of what runs inside when it has ended, not when memory is next collected."""
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def stage_once(df: DataFrame, label: str) -> DataFrame:
    """:func:`stage` for large shuffles, which go when the table is written."""
    with shuffles_dropped(df.sparkSession):
        return stage(df, label)


def hash_sample(df: DataFrame, rows: int, *key: str) -> DataFrame:
    """At most ``rows`` rows, those of the lowest hash of ``key``, one per hash.

    Hashes are counted first, each once, so that only about twice as many rows as asked for are ever ordered.
    """
    h = free_name(df, "h")
    hashed = df.withColumn(h, F.xxhash64(*key))
    n = hashed.select(h).distinct().count()
    if n > 4 * rows:
        hashed = hashed.where(F.pmod(h, F.lit(1 << 40)) < int((1 << 40) * 2 * rows / n))
    return hashed.dropDuplicates([h]).orderBy(F.pmod(h, F.lit(1 << 40)), h).limit(rows).drop(h)


def scored_by(make: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[[Column], Column]:
    """A column function of texts: ``make`` runs once per task and gives a function from texts to numbers."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        f = make()
        for part in parts:
            yield pd.Series(f(part.tolist()), dtype="float64")

    return scored
