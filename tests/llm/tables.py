"""Small tables with odd rows, for Spark and DuckDB alike."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

DOCUMENTS = {"doc_id": pa.int64(), "text": pa.string(), "lang": pa.string(), "source": pa.string(), "n_chars": pa.int64()}
#: Extra columns whose names the operators might use themselves.
EXTRA = {"n": pa.int64(), "key": pa.string(), "rank": pa.int64(), "fim": pa.string(), "leak": pa.string(), "_fim_text": pa.string(), "_leak_key": pa.string()}
BENCHMARK = {"item_id": pa.int64(), "text": pa.string()}

PASSAGE = "The quick Brown fox, jumps over the lazy dog and runs far away from Él."
ROWS = [
    (1, PASSAGE),
    (2, f"before it {PASSAGE.upper().replace('ÉL', 'Él')} after it, " + " ".join(f"w{i % 37}" for i in range(60))),
    (2, f"before it {PASSAGE.upper().replace('ÉL', 'Él')} after it, " + " ".join(f"w{i % 37}" for i in range(60))),
    (None, " ".join(f"x{i % 11}" for i in range(80))),
    (3, None),
    (4, ""),
    (5, " \t\n "),
    (6, "one"),
    (7, "keeps <P> marks <S> in <M> its text " * 9),
    (-8, "größe   日本語   text\u000bwith\u000cblanks " * 30),
    (9, "ab " * 3000),
    (10, "long " + "z" * 70000 + " word " + " ".join(f"y{i}" for i in range(400))),
    (2**62, "ab " * 25),
    (2**62, "ab " * 25),
    (-(2**62), "ab " * 26),
    *((20 + i, f"row {i} " + " ".join(f"v{(i * j) % 13}" for j in range(30))) for i in range(60)),
]
ITEMS = [(1, PASSAGE), (1, PASSAGE), (2, "w1 w2 w3"), (None, "ab ab ab ab ab ab ab ab ab ab ab"), (3, None), (4, "..."), (5, "Z" * 70000 + " word y0 y1"), (11, "W3 w4, w5"), (12, "one")]


def write(folder: str, documents=ROWS, items=ITEMS, extra: bool = True) -> str:
    """One Parquet file per table, with extra columns whose names clash."""
    more = EXTRA if extra else {}
    data = {
        "documents": {
            "doc_id": [r[0] for r in documents],
            "text": [r[1] for r in documents],
            **{c: [None if i % 2 else 7 if t == pa.int64() else "x" for i in range(len(documents))] for c, t in {**DOCUMENTS, **more}.items() if c not in ("doc_id", "text")},
        },
        "benchmark": {"item_id": [r[0] for r in items], "text": [r[1] for r in items], "key": ["k"] * len(items)},
    }
    types = {"documents": DOCUMENTS | more, "benchmark": BENCHMARK | {"key": pa.string()}}
    for name, columns in data.items():
        pq.write_table(pa.table({c: pa.array(v, types[name][c]) for c, v in columns.items()}), f"{folder}/{name}.parquet")
    return folder


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con
