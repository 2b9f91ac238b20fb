"""A specification from a PostgreSQL catalog, so that no table has to be described by hand.

Two small queries list the columns and the constraints; read them over JDBC with
:func:`read_catalog`. The catalog grows with the schema, not with the data.
"""

from __future__ import annotations

import re
from collections import defaultdict
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession

from rowkeel.functions.rows import name_matches
from rowkeel.sources.manifest import SYSTEM_SCHEMAS, also_skipped
from rowkeel.spec import CASCADE, NO_ACTION, RESTRICT, SET_DEFAULT, SET_NULL, Check, Column, ForeignKey, Spec, Table, Unique

COLUMNS_QUERY = """
SELECT s.nspname AS table_schema, t.relname AS table_name, c.attname AS column_name, c.attnum AS place,
       format_type(c.atttypid, c.atttypmod) AS type_text, c.attnotnull AS not_null,
       c.attidentity <> '' OR coalesce(pg_get_expr(d.adbin, d.adrelid), '') LIKE 'nextval(%' AS is_identity,
       c.attgenerated <> '' AS is_generated, pg_get_expr(d.adbin, d.adrelid) AS value_text
FROM pg_attribute c
JOIN pg_class t ON t.oid = c.attrelid AND t.relkind = 'r'
JOIN pg_namespace s ON s.oid = t.relnamespace
LEFT JOIN pg_attrdef d ON d.adrelid = c.attrelid AND d.adnum = c.attnum
WHERE c.attnum > 0 AND NOT c.attisdropped
"""

# kind: p primary key, u unique index, f foreign key, c check
CONSTRAINTS_QUERY = """
SELECT s.nspname AS table_schema, t.relname AS table_name, k.conname AS name, k.contype::text AS kind,
       (SELECT string_agg(a.attname, ',' ORDER BY n) FROM unnest(k.conkey) WITH ORDINALITY u(num, n)
        JOIN pg_attribute a ON a.attrelid = k.conrelid AND a.attnum = u.num) AS key_columns,
       ps.nspname AS parent_schema, pt.relname AS parent_table,
       (SELECT string_agg(a.attname, ',' ORDER BY n) FROM unnest(k.confkey) WITH ORDINALITY u(num, n)
        JOIN pg_attribute a ON a.attrelid = k.confrelid AND a.attnum = u.num) AS parent_columns,
       k.confdeltype::text AS on_delete,
       CASE WHEN k.contype = 'c' THEN pg_get_expr(k.conbin, k.conrelid) END AS condition
FROM pg_constraint k
JOIN pg_class t ON t.oid = k.conrelid
JOIN pg_namespace s ON s.oid = t.relnamespace
LEFT JOIN pg_class pt ON pt.oid = k.confrelid
LEFT JOIN pg_namespace ps ON ps.oid = pt.relnamespace
WHERE k.contype IN ('p', 'f', 'c')
UNION ALL
SELECT s.nspname, t.relname, i.relname, 'u',
       (SELECT string_agg(a.attname, ',' ORDER BY n) FROM unnest(x.indkey) WITH ORDINALITY u(num, n)
        JOIN pg_attribute a ON a.attrelid = x.indrelid AND a.attnum = u.num WHERE n <= x.indnkeyatts),
       NULL, NULL, NULL, NULL, pg_get_expr(x.indpred, x.indrelid)
FROM pg_index x
JOIN pg_class t ON t.oid = x.indrelid
JOIN pg_class i ON i.oid = x.indexrelid
JOIN pg_namespace s ON s.oid = t.relnamespace
WHERE x.indisunique AND NOT x.indisprimary AND x.indexprs IS NULL
"""

# The catalog's delete-action letters, and type names with their Spark type.
ACTIONS = {"a": NO_ACTION, "r": RESTRICT, "c": CASCADE, "n": SET_NULL, "d": SET_DEFAULT}
TYPES = {
    "smallint": "smallint",
    "integer": "int",
    "bigint": "bigint",
    "boolean": "boolean",
    "real": "float",
    "double precision": "double",
    "numeric": "decimal(38,10)",
    "text": "string",
    "uuid": "string",
    "bytea": "binary",
    "date": "date",
    "json": "string",
    "jsonb": "string",
    "integer[]": "array<int>",
}


def spark_kind(type_text: str) -> tuple[str, dict]:
    """The Spark type of a catalog type and the column limits it brings along."""
    kind = re.sub(r"^.*\.", "", type_text.strip().lower())
    size = re.fullmatch(r"([a-z ]+?)\s*\(([\d,]+)\)( with(?:out)? time zone)?", kind)
    name, numbers = (size.group(1) + (size.group(3) or ""), size.group(2)) if size else (kind, None)
    if name == "numeric" and not numbers:
        return TYPES[name], {"exact": True}
    if name == "uuid":
        return TYPES[name], {"format": "uuid"}
    if name == "numeric" and numbers:
        return f"decimal({numbers if ',' in numbers else numbers + ',0'})", {}
    if name in ("character varying", "character"):
        return "string", {"max_chars": int(numbers)} if numbers else {}
    if name == "vector":
        return "array<float>", {"dims": int(numbers)} if numbers else {}
    if name == "timestamp with time zone":
        return "timestamp", {}
    if name == "timestamp without time zone":
        return "timestamp_ntz", {}
    if name.startswith("time ") or name == "time":
        return "string", {"format": "time zone" if name.endswith("with time zone") else "time"}
    if name in TYPES:
        return TYPES[name], {"json": True} if name in ("json", "jsonb") else {}
    raise ValueError(f"no Spark type for {type_text}")


def spark_expr(text: str) -> str:
    """A catalog condition without its type annotations, which Spark infers itself."""
    return re.sub(r"::(?:[a-z_]+\.)?[a-z]+(?: (?:varying|precision|with time zone|without time zone))?(?:\([\d,]+\))?", "", text)


def constant(text: str | None):
    """The value of a constant default; anything computed by the server gives None."""
    bare = spark_expr(text or "").strip().strip("()")
    if bare in ("true", "false"):
        return bare == "true"
    if re.fullmatch(r"-?\d+", bare):
        return int(bare)
    if re.fullmatch(r"-?\d+\.\d+", bare):
        return Decimal(bare)
    quoted = re.fullmatch(r"'((?:[^']|'')*)'", bare)
    return quoted.group(1).replace("''", "'") if quoted else None


def spec_from_catalog(columns: DataFrame, constraints: DataFrame, skip: tuple[str, ...] = SYSTEM_SCHEMAS) -> Spec:
    """Build the specification from the two catalog listings; tables matching ``skip`` stay out."""
    cols, keys = defaultdict(list), defaultdict(list)
    for r in sorted(columns.collect(), key=lambda r: r["place"]):
        name = f"{r['table_schema']}.{r['table_name']}"
        if name_matches(name, skip):
            continue
        kind, limits = spark_kind(r["type_text"])
        value = r["value_text"]
        cols[name].append(
            Column(
                r["column_name"],
                kind,
                nullable=not r["not_null"],
                default=None if r["is_generated"] else constant(value),
                generated=spark_expr(value) if r["is_generated"] else None,
                identity=r["is_identity"],
                **limits,
            )
        )
    fks = []
    for r in constraints.collect():
        name = f"{r['table_schema']}.{r['table_name']}"
        if name not in cols:
            continue
        if r["kind"] == "f":
            parent = f"{r['parent_schema']}.{r['parent_table']}"
            if parent in cols:
                fks.append(
                    ForeignKey(
                        name,
                        tuple(r["key_columns"].split(",")),
                        parent,
                        tuple(r["parent_columns"].split(",")),
                        ACTIONS[r["on_delete"]],
                        r["name"],
                    )
                )
        else:
            keys[name].append(r)
    tables = []
    for name, made in cols.items():
        primary = next((tuple(k["key_columns"].split(",")) for k in keys[name] if k["kind"] == "p"), ())
        uniques = tuple(
            Unique(tuple(k["key_columns"].split(",")), spark_expr(k["condition"]) if k["condition"] else None, k["name"])
            for k in keys[name]
            if k["kind"] == "u"
        )
        checks = tuple(Check(k["name"], spark_expr(k["condition"])) for k in keys[name] if k["kind"] == "c")
        tables.append(Table(name, tuple(made), primary, uniques, checks))
    return Spec.of(tables, fks)


def read_catalog(spark: SparkSession, url: str, properties: dict[str, str] | None = None, skip: tuple[str, ...] = SYSTEM_SCHEMAS) -> Spec:
    """The specification of a live database."""

    def run(query: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=url, query=query, **(properties or {})).load()

    return spec_from_catalog(run(COLUMNS_QUERY), run(CONSTRAINTS_QUERY), (*skip, *also_skipped(spark)))
