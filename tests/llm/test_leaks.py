"""The automata against a plain search of every window, and places in the original text."""

from __future__ import annotations

import random
import re

import compare
import pytest
import tables
from pyspark.sql import functions as F

from rowkeel.llm import leaks, wording

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def plain_found(text: str, items: list[tuple], window: int) -> tuple[int, set[int], list[str]]:
    words = WORD.findall(lowered(text))
    hit, names = set(), set()
    for item, content in items:
        own = WORD.findall(lowered(content or ""))
        size = min(len(own), window)
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if grams and tuple(words[i : i + size]) in grams:
                hit.update(range(i, i + size))
                names.add("" if item is None else str(item))
    return len(words), hit, sorted(names)


def test_words_are_those_of_the_pattern():
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("aZ09é日ß😀 _-`{\x7f\x00\n") for _ in range(rng.randrange(40)))
        data = text.encode()
        assert [w.decode() for w in wording.normal_words(data)] == WORD.findall(lowered(text))
        begin, end = wording.word_bytes(data)
        assert [lowered(data[a:b].decode()) for a, b in zip(begin, end, strict=True)] == WORD.findall(lowered(text))


@pytest.fixture(scope="module")
def random_case():
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice(["a", "B", "é", "日", "q" * 90, "q" * 91]) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))
    items = [(rng.choice([1, 2, 3, 4, None]), text(rng.randrange(0, 12))) for _ in range(12)]
    return [(i, text(rng.randrange(0, 120))) for i in range(120)], items


@pytest.mark.parametrize("pairs", [leaks.PAIRS, 7], ids=["one", "many"])
def test_finds_equal_a_plain_search(spark, random_case, pairs):
    rows, items = random_case
    docs = spark.createDataFrame(rows + tables.ROWS, "doc_id long, text string")
    known = spark.createDataFrame(items + tables.ITEMS, "item_id long, text string")
    got = leaks.found_in(docs, known, window=4, pairs=pairs).collect()
    assert len(got) == docs.count()
    hits = 0
    for r in got:
        n, hit, names = plain_found(r.text or "", items + tables.ITEMS, 4)
        spans = r.leak.spans
        assert (r.leak.n_words, {w for s in spans for w in range(s.first, s.last)}, r.leak.items) == (n, hit, names)
        assert all(a.last < b.first for a, b in zip(spans, spans[1:], strict=False))
        words = WORD.findall(lowered(r.text or ""))
        for s in spans:
            # the place in the original text holds exactly the hit words
            assert WORD.findall(lowered(r.text[s.start : s.end])) == words[s.first : s.last]
            assert not WORD.findall(lowered(r.text[s.start : s.start + 1])) == []
        hits += bool(hit)
    assert hits > 40


def test_patterns_have_a_known_size():
    found = leaks.windows_of(" ".join(["é" * 5000] * 20), 10)
    assert max(len(w.encode()) for w in found) <= 10 * (leaks.LONGEST + 1) + 1
    assert leaks.windows_of("x" * 65 + " b", 10) != leaks.windows_of("x" * 66 + " b", 10)


def test_questions_and_answers_share_an_automaton(spark):
    items = spark.createDataFrame([(1, "what is the name", "no one knows")], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, "What, is the NAME?"), (2, "as no one knows it"), (3, "what is no one")], "doc_id long, text string")
    got = {r.doc_id: len(r.leak.spans) for r in leaks.found_in(docs, items, item_texts=("question", "answer")).collect()}
    assert got == {1: 1, 2: 1, 3: 0}
    assert [r.doc_id for r in leaks.decontaminated(docs, items, item_texts=("question", "answer")).collect()] == [3]


def test_all_columns_stay(spark, tmp_path):
    folder = tables.write(str(tmp_path))
    docs, items = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    for pairs in (leaks.PAIRS, 5):
        out = leaks.found_in(docs, items, into="found", pairs=pairs)
        assert out.columns == [*docs.columns, "found"]
        assert out.drop("found").exceptAll(docs).isEmpty() and docs.exceptAll(out.drop("found")).isEmpty()
    kept = leaks.decontaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.where(F.col("doc_id").isin(1, 2, 6)).isEmpty()
    with pytest.raises(ValueError, match="column already"):
        leaks.found_in(docs, items)


@pytest.mark.parametrize("documents", [tables.ROWS, []], ids=["odd", "empty"])
@pytest.mark.parametrize("items", [tables.ITEMS, [], [(3, None), (4, "!")]], ids=["odd", "empty", "wordless"])
def test_query_on_odd_tables(spark, tmp_path, documents, items):
    folder = tables.write(str(tmp_path), documents, items)
    assert compare.differences(leaks.op12_leaks(spark, folder), tables.connect(folder), leaks.ORACLE) is None
