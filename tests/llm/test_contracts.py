"""Cases that contracts name and given tables lack: repeated vector ids, large components, letters of later Unicode versions."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest
from pyspark.errors import PythonException, SparkRuntimeException
from tokenizers import Tokenizer

from rowkeel.llm import bpe, crosspolytope, lm, maxscore

VECTORS = "vec_id long, embedding array<double>, label int, shard long, block int, score string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 5, 6, "x") for i, v in rows], VECTORS)


def test_rows_of_a_repeated_id_are_all_candidates(spark):
    v = vectors(spark, [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.1, 0.9]), (3, [0.5, 0.5]), (3, [0.5, 0.5])])
    got = [tuple(r) for r in maxscore.exact_top_k(v, 5, 50).collect()]
    assert sorted(got) == [(0, 1, 1, 256 * 230), (0, 2, 3, 256 * 128), (0, 3, 3, 256 * 128), (0, 4, 1, 256 * 25)]
    near = [(r.query_id, r["rank"], r.vec_id, r.score) for r in crosspolytope.approximate_nearest(v, 20, 20).collect()]
    assert sorted(near) == [(0, 1, 1, 0.9), (0, 2, 3, 0.5), (0, 3, 3, 0.5), (0, 4, 1, 0.1)]
    # both rows of a query id ask; neither finds the other
    asked = vectors(spark, [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [0.25, 0.75]), (8, [0.5, 0.0])])
    got = [(r["rank"], r.vec_id, r.score) for r in maxscore.exact_top_k(asked, 5, 50).collect()]
    assert sorted(got) == [(1, 7, 256 * 192), (2, 8, 256 * 128), (3, 7, 256 * 64), (4, 8, 0)]


def test_a_third_of_all_rows_under_one_id(spark):
    rng = np.random.default_rng(1)
    rows = [(i if i % 3 else 9, [float(x) for x in rng.normal(size=6)]) for i in range(3000)]
    v = vectors(spark, rows)
    ids, x = np.array([i for i, _ in rows]), np.floor(np.array([r for _, r in rows]) * 256)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in maxscore.exact_top_k(v, 5, 500).collect()}
    for q in (500, 1000, 2000, 2500):
        s = x @ x[ids == q][0]
        best = sorted(((-int(a), int(b)) for a, b in zip(s, ids, strict=True) if b != q))[:5]
        assert [got[q, k + 1] for k in range(5)] == [(b, -a) for a, b in best]


def test_large_components(spark):
    big = float(1 << 30)
    v = vectors(spark, [(0, [big, 1.0]), (1, [big / 262144, 1.0]), (2, [big / 262144, 2.0]), (3, [-big / 262144, 2.0])])
    got = [(r.vec_id, r.score) for r in sorted(maxscore.exact_top_k(v, 5, 50).collect(), key=lambda r: r["rank"])]
    first = (1 << 38) * (1 << 20)
    assert got == [(2, first + 512 * 256), (1, first + 256 * 256), (3, -first + 512 * 256)]
    with pytest.raises(SparkRuntimeException, match="64 bits"):
        maxscore.exact_top_k(vectors(spark, [(0, [1e18, 0.0]), (1, [1.0, 1.0])]), 5, 50).collect()
    with pytest.raises(PythonException, match="64 bits"):
        maxscore.exact_top_k(vectors(spark, [(0, [1e12, 0.0]), (1, [1e12, 1.0])]), 5, 50).collect()


@pytest.mark.parametrize("search", [lambda v: maxscore.exact_top_k(v, 5, 50), lambda v: crosspolytope.approximate_nearest(v, 20, 20)])
def test_odd_vectors(spark, search):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0, 3.0]), (7, [0.5, 0.5])]
    assert [(r.query_id, r.vec_id) for r in search(vectors(spark, rows)).collect()] == [(0, 7)]
    assert search(vectors(spark, rows).limit(0)).count() == 0
    assert search(vectors(spark, rows)).columns == ["query_id", "rank", "vec_id", "score"]


def test_every_code_point_splits_as_the_library_does():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        automaton = bpe.Automaton(f.read())
    library = Tokenizer.from_file(path)
    for start in range(0, 0x110000, 512):
        points = [chr(c) for c in range(start, start + 512) if not 0xD800 <= c <= 0xDFFF]
        if points:
            # between a letter and a digit, and doubled after a blank
            text = "".join(f"a{c}1 {c}{c}x" for c in points)
            want = [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
            assert automaton.split(text) == want, hex(start)
    text = "\U00032476榸 a՘b 1\U00011de12"
    assert np.frombuffer(automaton.packed(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def plain_log10(model: lm.Model, symbols: list[int]) -> float:
    """The scaled forward recursion, one step and one state at a time."""
    states, total, a = range(len(model.start)), 0.0, None
    for s in symbols:
        came = list(model.start) if a is None else [sum(a[i] * model.move[i][j] for i in states) for j in states]
        a = [came[j] * model.emit[s][j] for j in states]
        scale = sum(a)
        a, total = [x / scale for x in a], total + np.log10(scale)
    return total


def test_scores_equal_a_plain_forward_pass(spark):
    texts = ["a b a c", "b b", None, "", "c a zz yy a", "a " * 700, "new words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learn = docs.where("doc_id < 6")
    counts = lm.stage(lm.count_words(learn))
    model = lm.train(learn, counts)
    got = {r.doc_id: r for r in lm.score(docs, model, counts, ["doc_id"]).collect()}
    held = {bytes(r.word): r.c for r in counts.collect()}
    index = {w: i for i, w in enumerate(model.symbols)}
    for i, text in enumerate(texts):
        words = [*(text or "").encode().split(), lm.END]
        want = plain_log10(model, [index.get(w, len(index)) for w in words])
        # a word that is no symbol has its smoothed share of what such words have together
        want += sum(np.log10(held.get(w, 0) + lm.ALPHA) - model.rare_log for w in words if w not in index)
        assert got[i].score == pytest.approx(want, rel=1e-9)
        assert got[i].n_tokens == len(words)


def test_training_ends_when_the_likelihood_settles(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "x y " * 30 if i % 2 else "p q " * 30) for i in range(40)], "doc_id long, text string")
    counts = lm.stage(lm.count_words(docs))
    seen = []
    step = lm.baum_welch_round
    monkeypatch.setattr(lm, "baum_welch_round", lambda s, m: seen.append(step(s, m)) or seen[-1])
    lm.train(docs, counts)
    told = [m.likelihood / m.tokens for m in seen]
    assert 2 <= len(seen) < lm.ROUNDS and all(m.tokens == 40 * 61 for m in seen)
    assert told == sorted(told) and told[-1] - told[-2] < lm.LEAST_GAIN
    seen.clear()
    lm.train(docs, counts, rounds=3, least_gain=-1.0)
    assert len(seen) == 3
