"""The same results in SQL over the given tables, written independently of the operators."""

from __future__ import annotations

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_ORDERS_LIVE = "(SELECT * FROM orders WHERE o_orderstatus <> 'F')"
_CUSTOMER_CUT = "(SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING')"
_DOCS_CUT = "(SELECT * FROM documents WHERE lang <> 'fr')"

# tables as read by the audits in which parents were removed
_CUT = {"orders": _ORDERS_LIVE, "customer": _CUSTOMER_CUT, "documents": _DOCS_CUT}

_FKS = [
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


#: tables after the change that the kept counts follow
_MUTATED = {
    "customer": "(SELECT * FROM customer WHERE c_custkey % 17 <> 0)",
    "orders": "(SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 1 THEN -o_custkey - 1 ELSE o_custkey END AS o_custkey FROM orders WHERE o_orderkey % 11 <> 0)",
    "lineitem": "(SELECT * FROM lineitem WHERE l_orderkey % 22 <> 0)",
    "labels": "(SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 5 = 0 "
    "UNION ALL SELECT -doc_id - 1 FROM labels WHERE doc_id % 5 = 0)",
}
_KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id",
    "conversations": "conv_id,turn",
}


def _key_counts(cut: dict[str, str]) -> str:
    parts = []
    for name, key in _KEYS.items():
        empty = " OR ".join(f"{c} IS NULL" for c in key.split(","))
        parts.append(
            f"SELECT '{name}' AS table_name, '{key}' AS key_columns, CAST(NULL AS VARCHAR) AS key_where, count(*) AS bad_keys, CAST(sum(n) AS BIGINT) AS bad_rows "
            f"FROM (SELECT {key}, count(*) AS n FROM {cut.get(name, name)} GROUP BY ALL HAVING count(*) > 1 OR {empty})"
        )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE bad_keys > 0"


def _fk_counts(cut: dict[str, str], only: set[str] | None = None) -> str:
    parts = []
    for child, c, parent, p in _FKS:
        if only is None or child in only:
            parts.append(
                f"SELECT '{child}' AS child, '{c}' AS child_columns, '{parent}' AS parent, count(*) AS orphan_rows "
                f"FROM {cut.get(child, child)} ch WHERE ch.{c} IS NOT NULL "
                f"AND NOT EXISTS (SELECT 1 FROM {cut.get(parent, parent)} pa WHERE pa.{p} = ch.{c})"
            )
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") t WHERE orphan_rows > 0"


def _totals() -> str:
    rows = [f"SELECT '{n}' AS table_name, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS amount FROM {n}" for n in NAMES]
    sums = [
        f"SELECT '{t}', '{c}', round(CAST(sum(CAST({c} AS DECIMAL(38,6))) AS DOUBLE), 2) FROM {t}"
        for t, c in [("lineitem", "l_quantity"), ("orders", "o_totalprice"), ("documents", "n_chars")]
    ]
    return " UNION ALL ".join(rows + sums)


def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for code, letter in [(8, "b"), (9, "t"), (10, "n"), (11, "v"), (12, "f"), (13, "r")]:
        out = f"replace({out}, chr({code}), chr(92) || '{letter}')"
    return f"coalesce({out}, chr(92) || 'N')"


def _plain(column: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), chr(92) || 'N')"


_TAB = " || chr(9) || "
_DOC_LINE = _TAB.join(
    [_plain("doc_id"), _escaped("text"), _escaped("lang"), _escaped("source"), _plain("n_chars")]
)



def _decimal(column: str) -> str:
    return _plain(f"CAST({column} AS DECIMAL(20,6))")


def _moment(column: str) -> str:
    return _plain(f"strftime({column}, '%Y-%m-%d %H:%M:%S.%f')")


def _decimals(column: str) -> str:
    return f"'[' || array_to_string(list_transform({column}, lambda x: CAST(CAST(x AS DECIMAL(20,6)) AS VARCHAR)), ',') || ']'"


_DUMP_LINES = {
    "customer": [_plain("c_custkey"), _escaped("c_name"), _plain("c_nationkey"), _decimal("c_acctbal"), _escaped("c_mktsegment")],
    "supplier": [_plain("s_suppkey"), _escaped("s_name"), _plain("s_nationkey"), _decimal("s_acctbal")],
    "part": [_plain("p_partkey"), *[_escaped(f"p_{c}") for c in ("name", "brand", "type")], _plain("p_size"), _decimal("p_retailprice")],
    "orders": [_plain("o_orderkey"), _plain("o_custkey"), _escaped("o_orderstatus"), _decimal("o_totalprice"), _moment("o_orderdate"),
               _escaped("o_orderpriority")],
    "lineitem": [*[_plain(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber")],
                 *[_decimal(f"l_{c}") for c in ("quantity", "extendedprice", "discount", "tax")],
                 _escaped("l_returnflag"), _escaped("l_linestatus"), _moment("l_shipdate")],
    "events": [_plain("event_id"), _moment("ts"), _plain("user_id"), _escaped("event_type"), _decimal("value"), _escaped("props")],
    "embeddings": [_plain("vec_id"), _decimals("embedding"), _plain("label")],
    "region": [_plain("r_regionkey"), _escaped("r_name")],
    "nation": [_plain("n_nationkey"), _escaped("n_name"), _plain("n_regionkey")],
    "documents": [_DOC_LINE],
    "pages": [_plain("page_id"), _escaped("url"), _escaped("html")],
    "benchmark": [_plain("item_id"), _escaped("text")],
    "labels": [_plain("doc_id"), _plain("quality"), _plain("toxic")],
    "conversations": [_plain("conv_id"), _plain("turn"), _escaped("role"), _escaped("text")],
}

_HEADERS = """
hb AS (
  SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Posted' WHEN 'P' THEN 'Reversed' ELSE 'Draft' END AS status,
         CAST(o_custkey % 5 AS INTEGER) AS book_id, o_totalprice, o_orderdate, o_orderpriority
  FROM orders),
ha AS (
  SELECT o_orderkey,
         CASE WHEN o_orderkey % 7 = 0 AND status = 'Posted' THEN 'Reversed' ELSE status END AS status,
         book_id,
         CASE WHEN NOT (o_orderkey % 7 = 0 AND status = 'Posted') AND o_orderkey % 13 = 0
              THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
         o_orderdate, o_orderpriority
  FROM hb WHERE o_orderkey % 11 <> 0)"""

_LINES = (
    _HEADERS
    + """,
lb AS (
  SELECT lineitem.*, CAST(o_custkey % 5 AS INTEGER) AS book_id,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
           l_returnflag, l_linestatus, l_shipdate) AS copy
  FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
la AS (
  SELECT l_orderkey, l_linenumber, CAST(copy AS INTEGER) AS copy,
         CASE WHEN (l_orderkey + l_linenumber) % 19 = 0 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, book_id
  FROM lb WHERE (l_orderkey + l_linenumber) % 17 <> 0
  UNION ALL
  SELECT l_orderkey, 100, CAST(copy AS INTEGER), l_quantity, book_id FROM lb WHERE l_linenumber = 1 AND l_orderkey % 23 = 0)"""
)

_LINE_VIOLATIONS = """
SELECT b.l_orderkey, b.l_linenumber, CAST(b.copy AS INTEGER) AS copy, CASE WHEN a.l_orderkey IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op,
       'line of a ' || h.status || ' header' AS reason
FROM lb b LEFT JOIN la a ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.copy = b.copy
JOIN hb h ON h.o_orderkey = b.l_orderkey AND h.status IN ('Posted', 'Reversed')
WHERE (a.l_orderkey IS NULL AND b.book_id <> 0)
   OR (a.l_orderkey IS NOT NULL AND (a.l_quantity <> b.l_quantity OR a.book_id <> b.book_id))"""

_LINE_INSERTS = """
SELECT a.l_orderkey, a.l_linenumber, a.copy, 'INSERT', 'line put under a ' || h.status || ' header'
FROM la a JOIN hb h ON h.o_orderkey = a.l_orderkey AND h.status IN ('Posted', 'Reversed')
WHERE NOT EXISTS (SELECT 1 FROM lb b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber AND b.copy = a.copy)"""

_DOCS_AFTER = """
docs_after AS (
  SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN text || 'x' ELSE text END AS text, lang, source, n_chars
  FROM documents WHERE doc_id % 23 <> 0)"""

_NEWLINES = "replace(text, chr(13) || chr(10), chr(10))"

_REPEATING = (
    _DOCS_AFTER
    + f""",
rows_ AS (
  SELECT source, doc_id, text FROM docs_after
  UNION ALL SELECT source, doc_id, text FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT source, doc_id, text || 'y' FROM documents WHERE doc_id % 7 = 0),
batch AS (SELECT source, doc_id, sha256({_NEWLINES}) AS checksum FROM rows_)"""
)

_ASOF = """
SELECT f.event_id, d.owner_id, d.label
FROM (SELECT event_id, user_id, ts + INTERVAL 1 HOUR AS at FROM events) f
JOIN (SELECT user_id, ts AS valid_from, event_id AS owner_id, event_type AS label,
             CASE WHEN event_id % 101 = 0 THEN NULL ELSE ts + to_hours(CAST(floor(value) AS INTEGER)) END AS valid_to
      FROM events) d
  ON d.user_id = f.user_id AND d.valid_from <= f.at AND (d.valid_to IS NULL OR f.at < d.valid_to)"""

_RANGES = """
WITH v AS (
  SELECT user_id, ts AS valid_from, CASE WHEN event_id % 101 <> 0 THEN ts + to_hours(CAST(floor(value) AS INTEGER)) END AS valid_to FROM events),
d AS (
  SELECT user_id, valid_from AS f, coalesce(valid_to, TIMESTAMP 'infinity') AS t, count(*) AS n FROM v
  WHERE user_id IS NOT NULL AND (valid_to IS NULL OR valid_from < valid_to) GROUP BY ALL),
w AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d)"""

_KNN = """
SELECT query_id, neighbor_id, similarity, CAST(rank AS INTEGER) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id,
         round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS similarity,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY
           round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) DESC, c.vec_id) AS rank
  FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id) t
WHERE rank <= 5"""

_TRIGRAMS = r"""
WITH n AS (SELECT p_name AS name, count(*) AS copies FROM part WHERE p_name IS NOT NULL GROUP BY 1),
w AS (SELECT name, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS word FROM n),
p AS (SELECT name, '  ' || word || ' ' AS padded FROM w),
g AS (SELECT DISTINCT name, substr(padded, i, 3) AS gram FROM
        (SELECT name, padded, unnest(range(1, length(padded) - 1)) AS i FROM p)),
s AS (SELECT name, count(*) AS size FROM g GROUP BY 1),
c AS (SELECT a.name AS name_a, b.name AS name_b, count(*) AS shared
      FROM g a JOIN g b ON a.gram = b.gram AND a.name < b.name GROUP BY 1, 2)
SELECT name_a, name_b, round(shared / (sa.size + sb.size - shared), 6) AS similarity,
       na.copies AS copies_a, nb.copies AS copies_b
FROM c JOIN s sa ON sa.name = name_a JOIN s sb ON sb.name = name_b
JOIN n na ON na.name = name_a JOIN n nb ON nb.name = name_b
WHERE shared / (sa.size + sb.size - shared) >= 0.3"""

_TRIGRAM_STORED = r"""
WITH q AS (
  SELECT DISTINCT 1 AS batch, p_name AS name, 0.4 AS bar FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT DISTINCT 2, p_name || ' ' || lower(p_type), 0.5 FROM part),
e AS (
  SELECT 1 AS batch, p_name AS name, count(*) AS copies FROM part WHERE p_partkey % 2 = 0 GROUP BY 2
  UNION ALL SELECT 2, p_name, count(*) FROM part GROUP BY 2),
w AS (SELECT name, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS word FROM (SELECT name FROM q UNION SELECT name FROM e)),
p AS (SELECT name, '  ' || word || ' ' AS padded FROM w),
g AS (SELECT DISTINCT name, substr(padded, i, 3) AS gram FROM (SELECT name, padded, unnest(range(1, length(padded) - 1)) AS i FROM p)),
s AS (SELECT name, count(*) AS size FROM g GROUP BY 1),
c AS (
  SELECT q.batch, q.name, e.name AS match, any_value(bar) AS bar, any_value(copies) AS copies, count(*) AS shared
  FROM q JOIN g a ON a.name = q.name JOIN g b ON b.gram = a.gram JOIN e ON e.name = b.name AND e.batch = q.batch GROUP BY 1, 2, 3)
SELECT c.name, match, round(shared / (x.size + y.size - shared), 6) AS similarity, copies, CAST(batch AS INTEGER) AS batch
FROM c JOIN s x ON x.name = c.name JOIN s y ON y.name = match WHERE shared / (x.size + y.size - shared) >= bar"""

_TRIGRAM_LOOKUP = r"""
WITH b AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS name FROM part),
e AS (SELECT p_name AS name, count(*) AS copies FROM part GROUP BY 1),
n AS (SELECT name FROM b UNION SELECT name FROM e),
w AS (SELECT name, unnest(regexp_extract_all(lower(name), '[a-z0-9]+')) AS word FROM n),
p AS (SELECT name, '  ' || word || ' ' AS padded FROM w),
g AS (SELECT DISTINCT name, substr(padded, i, 3) AS gram FROM
        (SELECT name, padded, unnest(range(1, length(padded) - 1)) AS i FROM p)),
s AS (SELECT name, count(*) AS size FROM g GROUP BY 1),
gb AS (SELECT * FROM g WHERE name IN (SELECT name FROM b)),
ge AS (SELECT * FROM g WHERE name IN (SELECT name FROM e)),
c AS (SELECT gb.name AS name, ge.name AS match, count(*) AS shared FROM gb JOIN ge ON gb.gram = ge.gram GROUP BY 1, 2)
SELECT c.name, c.match, round(shared / (sb.size + se.size - shared), 6) AS similarity, e.copies
FROM c JOIN s sb ON sb.name = c.name JOIN s se ON se.name = c.match JOIN e ON e.name = c.match
WHERE shared / (sb.size + se.size - shared) >= 0.5"""

_CUST3 = "(SELECT c_custkey FROM customer WHERE c_nationkey = 3)"
_ORD3 = f"(SELECT o_orderkey FROM orders WHERE o_custkey IN {_CUST3})"


def _restore_report() -> str:
    loaded = [n for n in NAMES if n not in ("pages", "benchmark", "labels")]
    parts = [
        f"SELECT 'loaded' AS kind, '{n}' AS name, count(*) AS rows FROM {n}" + (" WHERE p_size <> 7" if n == "part" else "")
        for n in loaded
    ]
    ids = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey",
           "events": "event_id", "documents": "doc_id", "embeddings": "vec_id"}
    parts += [
        f"SELECT 'next_id', '{t}.{c}', greatest(max({c}), 1) + 1 FROM {t}" + (" WHERE p_size <> 7" if t == "part" else "")
        for t, c in ids.items()
    ]
    parts += [f"SELECT 'excluded', '{n}', 0" for n in ("pages", "benchmark", "labels")]
    # documents were loaded and labels were not, so the labels are emptied
    parts += ["SELECT 'emptied', 'labels', 0"]
    parts += [
        "SELECT 'scrubbed', '0010-finished-orders:orders', count(*) FROM orders WHERE o_orderstatus = 'F'",
        "SELECT 'scrubbed', '0010-finished-orders:lineitem', count(*) FROM lineitem l JOIN orders o "
        "ON o.o_orderkey = l.l_orderkey WHERE o_orderstatus = 'F'",
        "SELECT 'scrubbed', '0020-mask-names:customer', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'",
        "SELECT 'orphans', 'lineitem(l_partkey)->part', count(*) FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey "
        "JOIN part p ON p.p_partkey = l.l_partkey WHERE o_orderstatus <> 'F' AND p_size = 7",
    ]
    return "SELECT kind, name, CAST(rows AS BIGINT) AS rows FROM (" + " UNION ALL ".join(parts) + ") t WHERE kind <> 'orphans' OR rows > 0"


def oracle() -> dict[str, str]:
    """One SQL text per registered query that SQL can express."""
    glob_name = "(CASE WHEN value > 50 THEN 'web.' ELSE 'app.' END || event_type)"
    price_text = "CASE WHEN p_partkey % 50 = 0 THEN 'n/a' ELSE CAST(p_retailprice + 50 AS VARCHAR) END"
    price = f"TRY_CAST({price_text} AS DECIMAL(5,2))"
    brand = "CASE WHEN p_partkey % 77 = 0 THEN NULL ELSE p_brand END"
    debit = "CASE WHEN l_linenumber = 7 THEN NULL ELSE l_discount END"
    broken = "CASE WHEN value > 100 THEN substr(props, 1, length(props) - 1) WHEN value > 90 THEN NULL ELSE props END"
    audit_rows = _fk_counts(_CUT)
    return {
        "source_scan": "SELECT l_orderkey, l_suppkey FROM lineitem",
        "table_totals": _totals(),
        "copy_lines": f"SELECT doc_id, {_DOC_LINE} AS line FROM documents",
        "copy_split": f"""
            SELECT doc_id, {_escaped("text")} AS second,
                   sha256({_TAB.join([_escaped("lang"), _escaped("source"), _plain("n_chars")])}) AS rest_hash
            FROM documents""",
        "copy_roundtrip": _totals(),
        "copy_roundtrip_differences": "SELECT '' AS table_name, '' AS side, CAST(0 AS BIGINT) AS copies WHERE 1 = 0",
        "manifest_totals": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, count(*) AS rows, CAST(sum(strlen({_TAB.join(fields)}) + 1) AS BIGINT) AS bytes FROM {t}"
            for t, fields in _DUMP_LINES.items()
        ),
        "manifest_mismatches": """
            SELECT 'orders' AS table_name, count(*) AS expected_rows, count(*) FILTER (o_orderstatus <> 'F') AS actual_rows
            FROM orders
            UNION ALL SELECT 'nation', count(*), count(*) FROM nation""",
        "glob_filter": f"""
            SELECT event_id, {glob_name} AS name FROM events
            WHERE {glob_name} ILIKE 'web.s%' OR event_type ILIKE 'cl_ck' OR {glob_name} ILIKE '%.error'""",
        "align_columns": """
            SELECT c_custkey, c_mktsegment, 'standard' AS c_tier, CAST(7 AS INTEGER) AS c_rank,
                   CAST(NULL AS VARCHAR) AS c_note, c_mktsegment = 'BUILDING' AS is_building
            FROM customer""",
        "generated_column": "SELECT event_id AS owner_id, event_type AS label, event_id % 101 = 0 AS is_active FROM events",
        "renamed_columns": "SELECT o_orderkey, o_custkey AS customer_id, o_orderstatus FROM orders",
        "live_rows": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'",
        "partial_predicates": """
            SELECT '(deleted_at IS NULL)' AS predicate, count(*) AS rows FROM lineitem WHERE NOT l_tax > 0.05
            UNION ALL SELECT '(l_returnflag = ''R'')', count(*) FROM lineitem WHERE l_returnflag = 'R'
            UNION ALL SELECT 'is_open', count(*) FROM lineitem WHERE l_linestatus = 'O'
            UNION ALL SELECT '((l_tax IS NOT NULL) AND (l_linenumber <> 4))', count(*) FROM lineitem
              WHERE l_tax IS NOT NULL AND l_linenumber <> 4""",
        "resolve_default": """
            SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 7 ELSE c_nationkey END AS c_nationkey FROM customer""",
        "conform_good": f"""
            SELECT p_partkey, p_name, CAST({price} AS DOUBLE) AS p_price, {brand} AS p_brand FROM part
            WHERE length(p_name) <= 9 AND {price} IS NOT NULL AND {brand} IS NOT NULL""",
        "conform_bad_reasons": f"""
            SELECT * FROM (
              SELECT p_partkey, concat_ws('|',
                CASE WHEN length(p_name) > 9 THEN 'length:p_name' END,
                CASE WHEN {brand} IS NULL THEN 'null:p_brand' END,
                CASE WHEN {price} IS NULL THEN 'type:p_price' END) AS reasons
              FROM part) t WHERE reasons <> ''""",
        "check_violations": f"""
            SELECT * FROM (
              SELECT l_orderkey, l_partkey, l_linenumber, concat_ws('|',
                CASE WHEN ({debit} = 0) = (l_tax = 0) THEN 'check:debit_xor_credit' END,
                CASE WHEN l_tax >= 0.08 THEN 'check:small' END) AS reasons
              FROM lineitem) t WHERE reasons <> ''""",
        "json_validity": f"""
            SELECT event_id, 'json:props' AS reasons FROM events
            WHERE {broken} IS NOT NULL AND NOT json_valid({broken})""",
        "vector_dimensions": "SELECT vec_id, 'dims:embedding' AS reasons FROM embeddings WHERE label = 3",
        "int_arrays": """
            SELECT event_id,
                   CAST(CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN 0 ELSE 2 END AS INTEGER) AS n,
                   CAST(CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_id END AS INTEGER) AS second
            FROM events""",
        "scalar_functions": """
            SELECT c_custkey, upper(c_name) AS name_upper, lower(c_mktsegment) AS segment_lower,
                   CAST(c_custkey AS VARCHAR) AS key_text, coalesce(nullif(c_nationkey, 3), -1) AS nation_or_default,
                   greatest(c_custkey, CAST(c_nationkey AS BIGINT)) AS larger,
                   nullif(c_nationkey, 3) IS DISTINCT FROM nullif(c_nationkey, 4) AS is_distinct,
                   c_mktsegment IN ('BUILDING', 'MACHINERY') AS in_list, nullif(c_nationkey, 3) IS NULL AS is_missing
            FROM customer""",
        "content_checksum": f"""
            SELECT doc_id, sha256(replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10), chr(10))) AS checksum
            FROM documents""",
        "expired_rows": """
            SELECT event_id, event_type FROM events
            WHERE ts + INTERVAL 3 DAY <= TIMESTAMP '2024-01-15 00:00:00' AND event_type <> 'error'""",
        "fk_orphans_one": f"""
            SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem l
            WHERE l_orderkey IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_ORDERS_LIVE} o WHERE o.o_orderkey = l.l_orderkey)""",
        "fk_audit_all": audit_rows,
        "fk_audit_loaded": _fk_counts(
            {**_CUT, "orders": "(SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_custkey END AS o_custkey "
             "FROM orders WHERE o_orderstatus <> 'F')"},
            {"orders", "labels"},
        ),
        "unique_violations": """
            SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
        "partial_unique_violations": """
            SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R'
            GROUP BY 1, 2 HAVING count(*) > 1""",
        "key_audit_all": """
            SELECT 'orders' AS table_name, 'o_orderkey' AS key_columns, CAST(NULL AS VARCHAR) AS key_where,
                   CAST(1 AS BIGINT) AS bad_keys, count(*) AS bad_rows FROM orders WHERE o_orderkey % 100 = 0
            UNION ALL
            SELECT 'lineitem', 'l_orderkey,l_linenumber', NULL, count(*), CAST(sum(n) AS BIGINT) FROM
              (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
            UNION ALL
            SELECT 'lineitem', 'l_orderkey,l_partkey', 'l_returnflag = ''R''', b, s FROM
              (SELECT count(*) AS b, CAST(sum(n) AS BIGINT) AS s FROM
                (SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_partkey HAVING count(*) > 1))
              WHERE b > 0""",
        "default_cardinality": """
            SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) AS n
            FROM customer GROUP BY 1
            HAVING count(*) FILTER (c_mktsegment = 'BUILDING' AND c_acctbal > 5000) NOT BETWEEN 1 AND 3""",
        "high_water": " UNION ALL ".join(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, coalesce(greatest(max({c}), 1) + 1, 1) AS next_id FROM {t}"
            for t, c in [("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"),
                         ("orders", "o_orderkey"), ("events", "event_id"), ("documents", "doc_id"),
                         ("embeddings", "vec_id"), ("benchmark", "item_id")]
        ) + " UNION ALL SELECT 'pages', 'page_id', 1",
        "reconcile_rows": f"""
            WITH {_HEADERS.strip()},
            b AS (SELECT status, book_id, o_orderpriority, o_totalprice FROM hb),
            a AS (SELECT status, book_id, o_orderpriority, o_totalprice FROM ha)
            SELECT 'MISSING' AS side, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
            UNION ALL SELECT 'EXTRA', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
        "reconcile_bags": f"""
            WITH {_HEADERS.strip()},
            b AS (SELECT status, book_id, o_orderpriority FROM hb), a AS (SELECT status, book_id, o_orderpriority FROM ha)
            SELECT side, status, book_id, o_orderpriority, count(*) AS copies FROM (
              SELECT 'MISSING' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
              UNION ALL SELECT 'EXTRA', * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) t
            GROUP BY ALL""",
        "audit_report": f"""
            SELECT 'foreign key' AS kind, child AS table_name, child_columns || ' -> ' || parent AS detail, orphan_rows AS rows
            FROM ({audit_rows})""",
        "insert_absent": """
            SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'
            UNION ALL
            SELECT DISTINCT user_id, 'unknown', 'WEB' FROM events
            WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
        "backfill_null": """
            SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN user_id ELSE o_custkey END AS o_custkey
            FROM orders LEFT JOIN events ON event_id = o_orderkey""",
        "scrub_family": f"""
            SELECT 'orders' AS table_name, 'rows' AS measure, CAST(count(*) AS DOUBLE) AS amount FROM {_ORDERS_LIVE}
            UNION ALL SELECT 'lineitem', 'rows', count(*) FROM lineitem
              WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
            UNION ALL SELECT 'lineitem', 'l_linenumber', sum(l_linenumber) FROM lineitem
              WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
        "scrub_rules": """
            SELECT CAST(1 AS INTEGER) AS run, '0010-finished-orders' AS rule, 'orders' AS table_name, count(*) AS affected
            FROM orders WHERE o_orderstatus = 'F'
            UNION ALL SELECT 1, '0010-finished-orders', 'lineitem', count(*) FROM lineitem
              WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
            UNION ALL SELECT 1, '0020-mask-names', 'customer', count(*) FROM customer WHERE c_mktsegment = 'BUILDING'
            UNION ALL SELECT 2, '0010-finished-orders', 'orders', 0
            UNION ALL SELECT 2, '0010-finished-orders', 'lineitem', 0
            UNION ALL SELECT 2, '0020-mask-names', 'customer', 0""",
        "scrub_masked_lines": """
            SELECT '0030-untaxed' AS rule, 'lineitem' AS table_name, count(*) AS affected
            FROM lineitem WHERE l_returnflag = 'R' AND l_tax <> 0""",
        "increment_repeated": f"""
            WITH {_REPEATING.strip()}
            SELECT source, doc_id, min(checksum) AS checksum FROM batch WHERE doc_id % 2 <> 0 GROUP BY 1, 2""",
        "increment_repeated_changed": f"""
            WITH {_REPEATING.strip()},
            ledger AS (SELECT source, doc_id, sha256({_NEWLINES}) AS was FROM documents WHERE doc_id % 2 = 0),
            low AS (SELECT source, doc_id, min(checksum) AS was FROM batch WHERE doc_id % 2 <> 0 GROUP BY 1, 2)
            SELECT DISTINCT b.source, b.doc_id, b.checksum, 'CHANGED' AS state
            FROM batch b JOIN (SELECT * FROM ledger UNION ALL SELECT * FROM low) l
              ON l.source = b.source AND l.doc_id = b.doc_id AND l.was <> b.checksum""",
        "assign_ids": "SELECT 1000 + row_number() OVER (ORDER BY ts, event_id) AS row_id, event_id FROM events",
        "increment_classes": f"""
            WITH {_DOCS_AFTER.strip()},
            ledger AS (SELECT source, doc_id, sha256({_NEWLINES}) AS was FROM documents WHERE doc_id % 2 = 0)
            SELECT d.source, d.doc_id, sha256({_NEWLINES}) AS checksum,
                   CASE WHEN l.doc_id IS NULL THEN 'NEW' WHEN l.was = sha256({_NEWLINES}) THEN 'SAME' ELSE 'CHANGED' END AS state
            FROM docs_after d LEFT JOIN ledger l ON l.source = d.source AND l.doc_id = d.doc_id""",
        "increment_filtered": f"""
            WITH {_DOCS_AFTER.strip()},
            ledger AS (SELECT source, doc_id, sha256({_NEWLINES}) AS was FROM documents WHERE doc_id % 2 = 0)
            SELECT d.source, d.doc_id, sha256({_NEWLINES}) AS checksum,
                   CASE WHEN l.doc_id IS NULL THEN 'NEW' WHEN l.was = sha256({_NEWLINES}) THEN 'SAME' ELSE 'CHANGED' END AS state
            FROM docs_after d LEFT JOIN ledger l ON l.source = d.source AND l.doc_id = d.doc_id""",
        "increment_applied": f"""
            WITH {_DOCS_AFTER.strip()}
            SELECT source, doc_id, sha256({_NEWLINES}) AS checksum FROM docs_after WHERE doc_id % 2 <> 0""",
        "cascade_delete_counts": f"""
            SELECT * FROM (
              SELECT 'customer' AS table_name, 'deleted' AS action, count(*) AS rows FROM customer WHERE c_nationkey = 3
              UNION ALL SELECT 'orders', 'deleted', count(*) FROM orders WHERE o_custkey IN {_CUST3}
              UNION ALL SELECT 'lineitem', 'deleted', count(*) FROM lineitem WHERE l_orderkey IN {_ORD3}) t WHERE rows > 0""",
        "cascade_delete_survivors": f"""
            SELECT l_linenumber, l_returnflag, count(*) AS rows FROM lineitem WHERE l_orderkey NOT IN {_ORD3} GROUP BY 1, 2""",
        "set_null_rows": f"""
            SELECT o_orderkey, CASE WHEN o_custkey IN {_CUST3} THEN NULL ELSE o_custkey END AS o_custkey FROM orders""",
        "set_null_counts": f"""
            SELECT * FROM (
              SELECT 'customer' AS table_name, 'deleted' AS action, count(*) AS rows FROM customer WHERE c_nationkey = 3
              UNION ALL SELECT 'orders', 'nulled', count(*) FROM orders WHERE o_custkey IN {_CUST3}
              UNION ALL SELECT 'events', 'deleted', count(*) FROM events WHERE user_id IN {_CUST3}) t WHERE rows > 0""",
        "restrict_report": """
            SELECT * FROM (
              SELECT 'customer' AS table_name, 'RESTRICT' AS action, count(*) AS rows FROM customer WHERE c_nationkey IN (3, 5)
              UNION ALL SELECT 'supplier', 'NO ACTION', count(*) FROM supplier WHERE s_nationkey IN (3, 5)) t WHERE rows > 0""",
        "no_action_after_cascade": f"""
            SELECT * FROM (
              SELECT 'nation' AS table_name, 'deleted' AS action, count(*) AS rows FROM nation WHERE n_nationkey = 3
              UNION ALL SELECT 'customer', 'deleted', count(*) FROM customer WHERE c_nationkey = 3
              UNION ALL SELECT 'supplier', 'deleted', count(*) FROM supplier WHERE s_nationkey = 3
              UNION ALL SELECT 'events', 'deleted', count(*) FROM events WHERE user_id IN {_CUST3}
              UNION ALL SELECT 'orders', 'deleted', count(*) FROM orders WHERE o_custkey IN {_CUST3}) t WHERE rows > 0""",
        "self_cascade_counts": """
            WITH RECURSIVE t(k) AS (
              SELECT p_partkey FROM part WHERE p_partkey = 1
              UNION SELECT p_partkey FROM part JOIN t ON p_partkey // 10 = t.k AND p_partkey >= 10)
            SELECT 'part' AS table_name, 'deleted' AS action, count(*) AS rows FROM t HAVING count(*) > 0""",
        "snapshot_diff": f"""
            WITH {_HEADERS.strip()}
            SELECT * FROM (
              SELECT o_orderkey, 'DELETE' AS op, CAST(NULL AS VARCHAR) AS changed FROM hb
              WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ha)
              UNION ALL
              SELECT b.o_orderkey, 'UPDATE', concat_ws(',', CASE WHEN b.status <> a.status THEN 'status' END,
                CASE WHEN b.o_totalprice <> a.o_totalprice THEN 'o_totalprice' END)
              FROM hb b JOIN ha a ON a.o_orderkey = b.o_orderkey
              WHERE b.status <> a.status OR b.o_totalprice <> a.o_totalprice) t""",
        "header_violations": f"""
            WITH {_HEADERS.strip()}
            SELECT b.o_orderkey, 'DELETE' AS op, 'deleted' AS reason FROM hb b
            WHERE b.status IN ('Posted', 'Reversed') AND b.book_id <> 0 AND b.o_orderkey NOT IN (SELECT o_orderkey FROM ha)
            UNION ALL
            SELECT b.o_orderkey, 'UPDATE',
                   CASE b.status WHEN 'Reversed' THEN 'reversed is locked' ELSE 'posted is append-only' END
            FROM hb b JOIN ha a ON a.o_orderkey = b.o_orderkey
            WHERE (b.status = 'Reversed' AND b.o_totalprice <> a.o_totalprice)
               OR (b.status = 'Posted' AND (a.status <> b.status OR a.o_totalprice <> b.o_totalprice)
                   AND (a.status <> 'Reversed' OR a.o_totalprice <> b.o_totalprice))""",
        "line_violations": f"WITH {_LINES.strip()} {_LINE_VIOLATIONS}",
        "line_violations_strict": f"WITH {_LINES.strip()} {_LINE_VIOLATIONS} UNION ALL {_LINE_INSERTS}",
        "write_once_violations": f"""
            WITH {_DOCS_AFTER.strip()}
            SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op
            FROM documents d LEFT JOIN docs_after a ON a.doc_id = d.doc_id WHERE a.doc_id IS NULL OR a.text <> d.text""",
        "locked_violations": f"""
            WITH {_DOCS_AFTER.strip()}
            SELECT d.doc_id, CASE WHEN a.doc_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS op, d.lang
            FROM documents d LEFT JOIN docs_after a ON a.doc_id = d.doc_id
            WHERE (a.doc_id IS NULL OR a.text <> d.text) AND d.lang IN ('en', 'fr')""",
        "asof_resolve": _ASOF,
        "asof_resolve_split": _ASOF,
        "trigram_pairs": _TRIGRAMS,
        "trigram_lookup": _TRIGRAM_LOOKUP,
        "knn_exact": _KNN,
        "knn_cells": _KNN,
        "knn_dirty": f"""
            WITH usable AS (SELECT * FROM embeddings WHERE vec_id % 10 NOT IN (1, 2, 3, 4)), found AS ({_KNN.replace("embeddings", "usable")})
            SELECT found.*, way FROM found, (VALUES ('scan'), ('cells')) w(way)""",
        "knn_lsh": f"SELECT count(*) AS true_pairs, TRUE AS exact_similarity, TRUE AS recall_reached FROM ({_KNN})",
        "knn_graph": """
            SELECT least(10, n - 1) * q AS true_pairs, TRUE AS exact_similarity, TRUE AS recall_reached, TRUE AS compared_sublinear
            FROM (SELECT count(*) AS n, count(*) FILTER (vec_id % 100 = 0) AS q FROM embeddings)""",
        "store_versions": """
            WITH o AS (SELECT count(*) AS n, count(*) FILTER (o_orderstatus <> 'F') AS m FROM orders),
            e AS (SELECT count(*) AS n, count(*) FILTER (event_type <> 'purchase') AS m FROM events), c AS (SELECT count(*) AS n FROM customer)
            SELECT CAST(version AS INTEGER) AS version, table_name, row_count FROM (
              SELECT unnest([1, 2, 3, 4, 5]) AS version, 'orders' AS table_name, unnest([n, m, m, m, n]) AS row_count FROM o
              UNION ALL SELECT unnest([1, 2, 3, 4, 5]), 'events', unnest([n, n, m, m, n]) FROM e
              UNION ALL SELECT unnest([1, 2, 3, 4, 5]), 'customer', unnest([n, n, n, 0, n]) FROM c)""",
        "fk_audit_polymorphic": """
            WITH c AS (SELECT * FROM customer WHERE c_custkey % 10 <> 0),
            n AS (
              SELECT CASE doc_id % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'customer' WHEN 2 THEN 'part' WHEN 3 THEN 'Part' END AS t, n_chars AS i FROM documents
              UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'customer' WHEN 'O' THEN 'supplier' ELSE 'ship' END, o_custkey FROM orders),
            a AS (
              SELECT t, 'orders' AS parent, i FROM n WHERE t = 'order' AND NOT EXISTS (FROM orders WHERE o_orderkey = i)
              UNION ALL SELECT t, 'customer', i FROM n WHERE t = 'customer' AND NOT EXISTS (FROM c WHERE c_custkey = i)
              UNION ALL SELECT t, 'part', i FROM n WHERE t = 'part' AND NOT EXISTS (FROM part WHERE p_partkey = i)
              UNION ALL SELECT t, 'supplier', i FROM n WHERE t = 'supplier' AND NOT EXISTS (FROM supplier WHERE s_suppkey = i)
              UNION ALL SELECT t, NULL, i FROM n WHERE t NOT IN ('order', 'customer', 'part', 'supplier'))
            SELECT 'notes_entity' AS "constraint", 'notes' AS child, 'entity_type,entity_id' AS child_columns, parent, t AS parent_type, count(i) AS orphan_rows
            FROM a GROUP BY parent, t HAVING count(i) > 0
            UNION ALL SELECT 'orders_customer', 'orders', 'o_custkey', 'customer', NULL, count(*)
            FROM orders WHERE NOT EXISTS (FROM c WHERE c_custkey = o_custkey) HAVING count(*) > 0""",
        "range_overlaps": f"""
            {_RANGES}
            SELECT user_id, 'overlap' AS kind, f AS starts_at, nullif(least(t, reach), TIMESTAMP 'infinity') AS ends_at, n AS ranges FROM w WHERE f < reach
            UNION ALL SELECT user_id, 'overlap', f, nullif(t, TIMESTAMP 'infinity'), n - 1 FROM w WHERE n > 1 AND NOT coalesce(f < reach, FALSE)
            UNION ALL SELECT user_id, 'gap', reach, f, 0 FROM w WHERE reach < f
            UNION ALL SELECT user_id, 'empty', valid_from, valid_to, count(*) FROM v WHERE valid_from >= valid_to GROUP BY ALL""",
        "range_coverage": f"""
            {_RANGES},
            g AS (SELECT *, count(*) FILTER (reach IS NULL OR reach < f) OVER (PARTITION BY user_id ORDER BY f, t) AS run FROM w)
            SELECT user_id, min(f) AS valid_from, nullif(max(t), TIMESTAMP 'infinity') AS valid_to, CAST(sum(n) AS BIGINT) AS ranges FROM g GROUP BY user_id, run""",
        "deep_cascade_counts": """
            WITH RECURSIVE gone(k) AS (
              SELECT o_orderkey FROM orders WHERE o_orderkey % 3000 = 100
              UNION SELECT o_orderkey FROM orders JOIN gone ON o_orderkey - 1 = k AND o_orderkey % 1000 <> 0)
            SELECT 'orders' AS table_name, 'deleted' AS action, count(*) AS rows FROM gone
            UNION ALL SELECT 'lineitem', 'deleted', count(*) FROM lineitem WHERE l_orderkey IN (SELECT k FROM gone)""",
        "snapshot_diff_digest": """
            SELECT o_orderkey, 'DELETE' AS op, CAST(NULL AS VARCHAR) AS changed FROM orders WHERE o_orderkey < 9 AND o_orderkey % 500 <> 7
            UNION ALL SELECT o_orderkey, 'UPDATE', 'o_totalprice' FROM orders WHERE o_orderkey % 500 = 7 AND o_totalprice IS NOT NULL
            UNION ALL SELECT -3, 'INSERT', NULL FROM orders WHERE o_orderkey = 3""",
        "fk_audit_delta": _fk_counts(_MUTATED),
        "key_audit_delta": _key_counts(_MUTATED),
        "conform_formats": """
            WITH e AS (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS h FROM events)
            SELECT event_id,
              CASE WHEN event_id % 6 < 3 THEN concat_ws('-', left(h, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21)) END AS ref,
              CASE event_id % 5 WHEN 0 THEN '09:30:00' WHEN 1 THEN '23:59:59.25' WHEN 3 THEN '24:00:00' END AS opens,
              CAST(CASE event_id % 4 WHEN 0 THEN 1.123456789 WHEN 1 THEN event_id + 0.5 WHEN 2 THEN 2.5 ELSE 0 END AS DOUBLE) AS share,
              concat_ws(',', CASE WHEN event_id % 6 IN (3, 4) THEN 'format:ref' END, CASE WHEN event_id % 5 IN (2, 4) THEN 'format:opens' END,
                CASE WHEN event_id % 4 IN (0, 3) THEN 'scale:share' END) AS reasons
            FROM e""",
        "trigram_stored": _TRIGRAM_STORED,
        "json_changes": """
            SELECT event_id, 'UPDATE' AS op, 'props' AS changed FROM events
            WHERE event_id % 13 IN (0, 2) AND props IS NOT NULL AND event_type IS NOT NULL AND json_extract(props, '$.k') IS NOT NULL""",
        "restore_report": _restore_report(),
        "restored_totals": """
            SELECT table_name, measure, CAST(amount AS DOUBLE) AS amount FROM (
              """ + " UNION ALL ".join(
                f"SELECT '{n}' AS table_name, 'rows' AS measure, count(*) AS amount FROM {n}" for n in NAMES if n != "lineitem"
            ) + """
              UNION ALL SELECT 'lineitem', 'rows', 0
              UNION ALL SELECT 'orders', 'o_custkey', sum(o_custkey) FROM orders) t""",
    }
