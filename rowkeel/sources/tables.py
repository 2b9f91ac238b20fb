"""Reading live tables: Parquet folders or JDBC tables read over a split key."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.spec import Frames, Spec


@dataclass(frozen=True)
class Source:
    """Where one table lives. ``columns`` empty means all.

    With a ``schema`` no file footer is read while planning. For JDBC give ``split_column`` with its bounds so that executors read ranges side by side;
    rows outside the bounds still arrive, in the first and last range.
    """

    location: str
    kind: str = "parquet"
    columns: tuple[str, ...] = ()
    schema: T.StructType | None = None
    table: str | None = None
    split_column: str | None = None
    lower: int | None = None
    upper: int | None = None
    partitions: int = 1
    fetch_rows: int = 10_000
    properties: dict = field(default_factory=dict)


def jdbc_options(source: Source) -> dict[str, str]:
    """Reader options of a JDBC source."""
    if not source.table:
        raise ValueError("a JDBC source needs a table")
    options = {"url": source.location, "dbtable": source.table, "fetchsize": str(source.fetch_rows)}
    options.update({k: str(v) for k, v in source.properties.items()})
    if source.split_column is not None:
        if source.lower is None or source.upper is None:
            raise ValueError("split_column needs lower and upper")
        options.update(
            partitionColumn=source.split_column,
            lowerBound=str(source.lower),
            upperBound=str(source.upper),
            numPartitions=str(source.partitions),
        )
    return options


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    """A lazy scan of the listed columns."""
    if source.kind == "jdbc":
        df = spark.read.format("jdbc").options(**jdbc_options(source)).load()
    elif source.kind == "parquet":
        reader = spark.read if source.schema is None else spark.read.schema(source.schema)
        df = reader.parquet(source.location)
    else:
        raise ValueError(f"unknown source kind {source.kind}")
    return df.select(*source.columns) if source.columns else df


def read_frames(spark: SparkSession, sources: dict[str, Source]) -> Frames:
    return {name: read_source(spark, s) for name, s in sources.items()}


def empty_frame(spark: SparkSession, spec: Spec, name: str) -> DataFrame:
    return spark.createDataFrame([], spec.tables[name].schema)


def table_totals(frames: Frames, sums: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per table: its row count, and per listed column its sum (A1).

    Returns ``(table_name, measure, amount)``; ``measure`` is ``rows`` or the summed column. Each table
    is read once for the listed columns only, and all tables share one pre-aggregated shuffle.
    """
    wanted = {n: (sums or {}).get(n, []) for n in frames}
    width = max((len(c) for c in wanted.values()), default=0)
    parts = []
    for name, df in frames.items():
        cols = [F.col(c).cast("decimal(38,6)") for c in wanted[name]]
        cols += [F.lit(None).cast("decimal(38,6)")] * (width - len(cols))
        parts.append(df.select(F.lit(name).alias("table_name"), F.lit(True).alias("row"), *[c.alias(f"s{i}") for i, c in enumerate(cols)]))
    per_table = with_all_tables(parts, list(frames)).groupBy("table_name").agg(
        F.count("row").cast("double").alias("rows"),
        *[F.sum(f"s{i}").cast("double").alias(f"s{i}") for i in range(width)],
    )
    names = per_name({n: F.array(*[F.lit(m) for m in ["rows", *c]]) for n, c in wanted.items()}, F.col("table_name"))
    amounts = F.array("rows", *[f"s{i}" for i in range(width)])
    pairs = F.transform(names, lambda m, i: F.struct(m.alias("measure"), F.get(amounts, i).alias("amount")))
    return per_table.select("table_name", F.inline(pairs))


def per_name(values: dict[str, Column], name: Column) -> Column:
    """The value that belongs to the table named by ``name``."""
    pairs = [x for n, v in values.items() for x in (F.lit(n), v)]
    return F.element_at(F.create_map(*pairs), name)


def with_all_tables(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """The united parts and one otherwise empty row per name, so that empty tables keep their group."""
    both = union_all(parts)
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in both.schema.fields if f.name != "table_name"]
    every = both.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("table_name"), *rest)
    return both.unionByName(every)


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name, paired as a balanced tree so that hundreds of tables stay plannable."""
    if not parts:
        raise ValueError("nothing to unite")
    while len(parts) > 1:
        parts = [
            parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i]
            for i in range(0, len(parts), 2)
        ]
    return parts[0]
