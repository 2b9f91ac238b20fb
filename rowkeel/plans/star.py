"""The star-schema tables as a specification, and inputs with known violations derived from them.

The given tables are clean, so violations are planted by fixed expressions on the keys; the
queries then run over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rowkeel.sources.tables import Source, read_frames
from rowkeel.spec import Column, ForeignKey, Frames, Spec, Table

NAMES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def _table(name: str, columns: str, key: tuple[str, ...] = (), identity: bool = False, **more) -> Table:
    cols = []
    for part in columns.split(", "):
        col, kind = part.split(" ")
        cols.append(Column(col, kind, nullable=col not in key, identity=identity and col in key, **more.get(col, {})))
    return Table(f"main.{name}", tuple(cols), key)


def star_spec() -> Spec:
    tables = [
        _table("region", "r_regionkey int, r_name string", ("r_regionkey",)),
        _table("nation", "n_nationkey int, n_name string, n_regionkey int", ("n_nationkey",)),
        _table(
            "customer",
            "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
            ("c_custkey",),
            True,
        ),
        _table("supplier", "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", ("s_suppkey",), True),
        _table(
            "part",
            "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
            ("p_partkey",),
            True,
        ),
        _table(
            "orders",
            "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
            "o_orderdate timestamp_ntz, o_orderpriority string",
            ("o_orderkey",),
            True,
        ),
        _table(
            "lineitem",
            "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
            "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
            "l_shipdate timestamp_ntz",
        ),
        _table(
            "events",
            "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
            ("event_id",),
            True,
            props={"json": True},
        ),
        _table("documents", "doc_id bigint, text string, lang string, source string, n_chars bigint", ("doc_id",), True),
        _table(
            "embeddings",
            "vec_id bigint, embedding array<float>, label int",
            ("vec_id",),
            True,
            embedding={"dims": 64},
        ),
        _table("pages", "page_id bigint, url string, html string", ("page_id",), True),
        _table("benchmark", "item_id bigint, text string", ("item_id",), True),
        _table("labels", "doc_id bigint, quality int, toxic int", ("doc_id",)),
        _table("conversations", "conv_id bigint, turn bigint, role string, text string", ("conv_id", "turn")),
    ]
    return Spec.of(tables, star_foreign_keys())


def star_foreign_keys(on_delete: str = "NO ACTION") -> list[ForeignKey]:
    def fk(child: str, column: str, parent: str, parent_column: str) -> ForeignKey:
        return ForeignKey(f"main.{child}", (column,), f"main.{parent}", (parent_column,), on_delete)

    return [
        fk("nation", "n_regionkey", "region", "r_regionkey"),
        fk("customer", "c_nationkey", "nation", "n_nationkey"),
        fk("supplier", "s_nationkey", "nation", "n_nationkey"),
        fk("orders", "o_custkey", "customer", "c_custkey"),
        fk("lineitem", "l_orderkey", "orders", "o_orderkey"),
        fk("lineitem", "l_partkey", "part", "p_partkey"),
        fk("lineitem", "l_suppkey", "supplier", "s_suppkey"),
        fk("labels", "doc_id", "documents", "doc_id"),
        fk("events", "user_id", "customer", "c_custkey"),
    ]


def spec_with_actions(actions: dict[tuple[str, str], str]) -> Spec:
    """The star specification with other delete actions, keyed by (child, parent)."""
    fks = []
    for fk in star_foreign_keys():
        pair = (fk.child.removeprefix("main."), fk.parent.removeprefix("main."))
        fks.append(ForeignKey(fk.child, fk.columns, fk.parent, fk.parent_columns, actions.get(pair, fk.on_delete)))
    return star_spec().with_foreign_keys(fks)


def load(spark: SparkSession, sf_dir: str, *names: str) -> Frames:
    spec = star_spec()
    sources = {
        f"main.{n}": Source(f"{sf_dir}/{n}.parquet", schema=spec.tables[f"main.{n}"].schema) for n in (names or NAMES)
    }
    return read_frames(spark, sources)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return load(spark, sf_dir, name)[f"main.{name}"]


def orders_live(orders: DataFrame) -> DataFrame:
    return orders.where("o_orderstatus <> 'F'")


def orders_null_fk(orders: DataFrame) -> DataFrame:
    return orders.withColumn("o_custkey", F.expr("if(o_orderkey % 10 = 0, null, o_custkey)"))


def books(region: DataFrame) -> DataFrame:
    """One ledger book per region row; the first is the sandbox."""
    code = F.when(F.col("r_regionkey") == 0, "TRAINING").otherwise("MAIN")
    return region.select(F.col("r_regionkey").alias("id"), code.alias("code"))


def headers_before(orders: DataFrame) -> DataFrame:
    status = F.expr("case o_orderstatus when 'F' then 'Posted' when 'P' then 'Reversed' else 'Draft' end")
    return orders.select(
        "o_orderkey", status.alias("status"), F.expr("cast(o_custkey % 5 as int)").alias("book_id"),
        "o_totalprice", "o_orderdate", "o_orderpriority",
    )


def headers_after(orders: DataFrame) -> DataFrame:
    before = headers_before(orders).where("o_orderkey % 11 <> 0")
    flipped = F.expr("if(o_orderkey % 7 = 0 and status = 'Posted', 'Reversed', status)")
    price = F.expr(
        "if(not (o_orderkey % 7 = 0 and status = 'Posted') and o_orderkey % 13 = 0, o_totalprice + 1, o_totalprice)"
    )
    return before.withColumns({"status": flipped, "o_totalprice": price})


def lines_before(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Every line with all its columns; ``copy`` numbers lines that share order and number, and the book is the header's."""
    rest = [c for c in lineitem.columns if c not in ("l_orderkey", "l_linenumber")]
    copy = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*rest))
    book = F.expr("cast(o_custkey % 5 as int)").alias("book_id")
    # one row per order, so that lines meet their books first and are numbered where they are, without another shuffle
    of = orders.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.collect_list(F.struct(book)).alias("books"))
    numbered = lineitem.join(of, "l_orderkey", "left").withColumn("copy", copy)
    return numbered.select(*lineitem.columns, "copy", F.explode_outer("books").alias("of")).select(*lineitem.columns, "copy", "of.book_id")


def lines_after(before: DataFrame) -> DataFrame:
    """Some lines removed, some changed, some moved to another order, some added."""
    kept = before.where("(l_orderkey + l_linenumber) % 17 <> 0")
    changed = kept.withColumn(
        "l_quantity", F.expr("if((l_orderkey + l_linenumber) % 19 = 0, l_quantity + 1, l_quantity)")
    )
    added = before.where("l_linenumber = 1 and l_orderkey % 23 = 0").withColumn("l_linenumber", F.lit(100))
    return changed.unionByName(added)


def docs_after(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id % 23 <> 0").withColumn("text", F.expr("if(doc_id % 29 = 0, concat(text, 'x'), text)"))


def validity(events: DataFrame) -> DataFrame:
    """Overlapping validity ranges per user, some of them open."""
    end = F.expr("if(event_id % 101 = 0, cast(null as timestamp_ntz), ts + make_dt_interval(0, cast(floor(value) as int)))")
    return events.select(
        "user_id", F.col("ts").alias("valid_from"), end.alias("valid_to"),
        F.col("event_id").alias("owner_id"), F.col("event_type").alias("label"),
    )


