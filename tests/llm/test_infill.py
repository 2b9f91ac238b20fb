"""The learned rank index against a plain search, and cutting and rebuilding on odd rows."""

from __future__ import annotations

import hashlib
import random
import re

import compare
import numpy as np
import pytest
import tables

from rowkeel.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_ends(text: str) -> list[int]:
    return [0, *(len(text[: m.end()].encode()) for m in TOKEN.finditer(text))]


def test_boundaries_are_those_of_the_pattern():
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice("ab é日   \t\n\x0b\x0c\r\x1f\x7f😀") for _ in range(rng.randrange(40)))
        assert infill.boundaries(np.frombuffer(text.encode(), np.uint8)).tolist() == plain_ends(text)


@pytest.mark.parametrize("slack", [1, 7, 100, 126])
def test_index_gives_every_boundary_exactly(slack):
    rng = random.Random(slack)
    for widths in ([5], [1, 2, 30000], [1] * 50 + [400], [3, 9, 4, 14]):
        ends = np.cumsum([0, *(rng.choice(widths) for _ in range(3000))])
        index = infill.fit(ends, slack)
        assert [index.offset(r) for r in range(len(ends))] == ends.tolist()
        assert np.abs(index.missed.astype(int)).max() <= slack + 1
        assert len(index.first) <= len(ends)
    assert len(infill.fit(np.arange(0, 50000, 5)).first) == 1
    # words of ordinary text: one segment covers many of them
    ends = np.cumsum([0, *(rng.randint(2, 12) for _ in range(20000))])
    assert len(infill.fit(ends, 100).first) < 300


def test_index_of_an_empty_text():
    index = infill.fit(infill.boundaries(np.zeros(0, np.uint8)))
    assert index.tokens == 0
    assert index.offset(0) == 0


def plain_form(doc_id, text: str) -> tuple:
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = TOKEN.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_rows_equal_a_plain_cut(spark):
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice("ab é日 \n<PSM>") for _ in range(rng.randrange(60)))) for i in range(400)]
    rows += [r for r in tables.ROWS if r[0] is not None and r[1] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = infill.infilled(docs).select("doc_id", "text", "fim.*", infill.restored(infill.F.col("fim.form"), infill.F.col("fim.output")).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_form(r.doc_id, r.text)
        assert r.back == r.text
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_all_columns_stay(spark, tmp_path):
    docs = spark.read.parquet(f"{tables.write(str(tmp_path))}/documents.parquet")
    out = infill.infilled(docs, into="filled")
    assert out.columns == [*docs.columns, "filled"]
    assert out.drop("filled").exceptAll(docs).isEmpty() and docs.exceptAll(out.drop("filled")).isEmpty()
    with pytest.raises(ValueError, match="column already"):
        infill.infilled(docs)


@pytest.mark.parametrize("documents", [tables.ROWS, []], ids=["odd", "empty"])
def test_query_on_odd_tables(spark, tmp_path, documents):
    folder = tables.write(str(tmp_path), documents)
    assert compare.differences(infill.op11_infill(spark, folder), tables.connect(folder), infill.ORACLE) is None
