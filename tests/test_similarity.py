from __future__ import annotations

import random
import re
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowkeel.operators import neighbors, similar, trigram_index


def grams(text):
    out = set()
    for w in re.findall(r"[^\W_]+", text.lower()):
        p = f"  {w} "
        out |= {p[i : i + 3] for i in range(len(p) - 2)}
    return out


def brute_pairs(names, threshold):
    distinct = sorted({n for n in names if n is not None})
    out = {}
    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            ga, gb = grams(a), grams(b)
            if ga and gb and len(ga & gb) / len(ga | gb) >= threshold:
                out[(a, b)] = (round(len(ga & gb) / len(ga | gb), 6), names.count(a), names.count(b))
    return out


def some_names(n, seed):
    rng = random.Random(seed)
    words = ["part", "parts", "bolt", "bolts", "bold", "Größe", "M8", "washer", "wash", "x", "part-no"]
    # every name starts with the same word, so its grams are shared by all
    names = [" ".join(["part", *rng.choices(words, k=rng.randrange(1, 4))]) for _ in range(n)]
    return names + [None, "", "--", names[0], names[0], names[0].upper()]


def test_grams(spark):
    df = spark.createDataFrame([("Cat CAT",), ("M-8",), ("",), (None,)], "t string")
    got = [r.g and sorted(r.g) for r in df.select(similar.trigrams("t").alias("g")).collect()]
    assert got == [["  c", " ca", "at ", "cat"], ["  8", "  m", " 8 ", " m "], [], None]


@pytest.mark.parametrize("threshold,block", [(0.3, 2048), (0.3, 4), (0.75, 3), (1.0, 4), (0.1, 5)])
def test_pairs_match_brute_force(spark, threshold, block):
    names = some_names(120, 1)
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = similar.trigram_pairs(df, "name", threshold, block).collect()
    found = {(r.name_a, r.name_b): (r.similarity, r.copies_a, r.copies_b) for r in got}
    assert len(found) == len(got)
    assert found == brute_pairs(names, threshold)


@pytest.mark.parametrize("block", [2048, 4])
def test_lookup_matches_brute_force(spark, block):
    have, new = some_names(80, 2), some_names(30, 3)
    df = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = similar.trigram_lookup(df(new), df(have), "name", 0.4, block).collect()
    want = set()
    for a in {n for n in new if n and grams(n)}:
        for b in {n for n in have if n and grams(n)}:
            s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if s >= 0.4:
                want.add((a, b, round(s, 6), have.count(b)))
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def brute_lookup(new, have, threshold):
    want = set()
    for a in {n for n in new if n and grams(n)}:
        for b in {n for n in have if n and grams(n)}:
            s = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
            if s >= threshold:
                want.add((a, b, round(s, 6), have.count(b)))
    return want


def test_stored_postings_match_brute_force_over_batches(spark, tmp_path, monkeypatch):
    df = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    index = trigram_index.TrigramIndex(spark, f"{tmp_path}/index")
    with pytest.raises(ValueError, match="no index"):
        index.lookup(df(["x"]), "name")
    have, second = some_names(70, 2), some_names(40, 5) + ["été zwölf", "été zwei", "日本 語彙", "😀x"]
    index.create(df(have), "name", 0.3, buckets=8)
    split = []
    grams_of = trigram_index.TrigramIndex._split
    monkeypatch.setattr(trigram_index.TrigramIndex, "_split", lambda self, names, ranks: split.append({r.name for r in names.collect()}) or grams_of(self, names, ranks))
    new = some_names(30, 3)
    for threshold in (0.3, 0.7):
        got = index.lookup(df(new), "name", threshold).collect()
        assert {tuple(r) for r in got} == brute_lookup(new, have, threshold) and len(got) == len({tuple(r) for r in got})
    # only names of the batches are split, not those that the index holds
    assert all(names <= set(new) for names in split)
    split.clear()
    fresh = {n for n in second if n and grams(n)} - set(have)
    assert index.append(df(second), "name") == len(fresh) and split == [fresh]
    # grams that came after the index was made
    late = ["zwölf été", "語彙 日本", "😀y 😀x", *new[:10]]
    for r in (index.lookup(df(late), "name").collect(),):
        assert {tuple(x) for x in r} == brute_lookup(late, have + second, 0.3)
    assert index.lookup(df(late).limit(0), "name").count() == 0
    assert index.append(df(second), "name") == 0
    assert {tuple(x) for x in index.lookup(df(late), "name").collect()} == brute_lookup(late, have + second + second, 0.3)
    with pytest.raises(ValueError, match="from 0.3"):
        index.lookup(df(late), "name", 0.2)


def test_a_lookup_reads_only_postings_of_its_grams(spark, tmp_path, monkeypatch):
    index = trigram_index.TrigramIndex(spark, f"{tmp_path}/index")
    index.create(spark.range(3000).selectExpr("concat('n', md5(cast(id AS string))) AS name"), "name", 0.5, buckets=64)
    seen = []
    read = trigram_index.TrigramIndex._read
    monkeypatch.setattr(trigram_index.TrigramIndex, "_read", lambda self, paths, schema: seen.append((paths, read(self, paths, schema))) or seen[-1][1])
    name = spark.range(1).selectExpr("concat('n', md5('7')) AS name")
    assert [tuple(r)[1:] for r in index.lookup(name, "name").collect()] == [(name.first()[0], 1.0, 1)]
    # the base is not among the inputs
    assert all(p.startswith(f"{tmp_path}/index/") for paths, _ in seen for p in paths)
    folders = {f.split("_bucket=")[1].split("/")[0] for paths, df in seen for f in df.inputFiles() if "_bucket=" in f}
    assert len(folders) == 64


def test_pairs_of_nothing(spark):
    assert similar.trigram_pairs(spark.createDataFrame([], "name string"), "name").count() == 0


def brute_knn(q, c, k, self_excluded=True):
    out = set()
    for qi, qv in q:
        best = []
        for ci, cv in c:
            if (self_excluded and ci == qi) or not any(cv) or not any(qv):
                continue
            s = np.dot(qv, cv) / np.linalg.norm(qv) / np.linalg.norm(cv)
            best.append((-round(float(s), 6), ci))
        out |= {(qi, ci, r + 1) for r, (_, ci) in enumerate(sorted(best)[:k])}
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 8))
    rows = [(i, [float(np.float32(x)) for x in centers[min(i % 9, 5)] + 0.2 * rng.normal(size=8)]) for i in range(300)]
    # copies: a third of all rows are one vector, so ties are broken by id
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    rows += [(5000, [0.0] * 8)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")


@pytest.mark.parametrize("way", ["queries to all tasks", "cells", "cells in blocks", "one pivot", "more than there are"])
def test_knn_matches_brute_force(spark, clustered, way):
    c = frame(spark, clustered).repartition(5)
    k = 500 if way == "more than there are" else 4
    q = frame(spark, clustered[:60] + clustered[300:320] + clustered[-1:])
    if way == "queries to all tasks":
        got = neighbors.knn(q, c, k)
    elif way == "cells":
        got = neighbors.knn(q, c, k, broadcast_bytes=0, pivots=12)
    elif way == "cells in blocks":
        got = neighbors.knn_by_cells(q, c, k, pivots=6, block=16)
    elif way == "one pivot":
        got = neighbors.knn_by_cells(q, c, k, pivots=1, block=50)
    else:
        got = neighbors.knn_by_cells(q, c, k, pivots=5)
    found = {(r.query_id, r.neighbor_id, r["rank"]) for r in got.collect()}
    assert found == brute_knn(clustered[:60] + clustered[300:320], clustered[:-1], k)


def test_cells_skip_far_ones(spark, clustered):
    """The bound of the first search keeps most cells out of the second."""
    rng = np.random.default_rng(0)
    far = [(i, [float(x) for x in np.eye(8)[i % 8] + 0.01 * rng.normal(size=8)]) for i in range(400)]
    df = frame(spark, far)
    got = neighbors.knn_by_cells(df, df, 3, pivots=8)
    assert {(r.query_id, r.neighbor_id, r["rank"]) for r in got.collect()} == brute_knn(far, far, 3)


def test_self_included_on_demand(spark, clustered):
    df = frame(spark, clustered[:50])
    got = neighbors.knn(df, df, 1, exclude_self=False).collect()
    assert all(r.query_id == r.neighbor_id and r.similarity == 1.0 for r in got) and len(got) == 50


def test_lsh_finds_the_copies(spark, clustered):
    df = frame(spark, clustered)
    got = neighbors.knn_lsh(df, df, 2, block=32).where(F.col("query_id") >= 1000)
    assert got.where("similarity = 1.0").count() == 300


def test_lsh_compares_a_small_share_of_well_spread_clusters(spark, monkeypatch):
    """Candidates, repeats over tables included, stay below a tenth of what all tables together could compare."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(40, 32))
    rows = [(i, (centers[i % 40] + 0.02 * rng.normal(size=32)).tolist()) for i in range(1200)]
    met = spark.sparkContext.accumulator(0)
    best = neighbors._best

    def counted(q_ids, q, c_ids, c, k, self_excluded):
        met.add(len(q_ids) * len(c_ids))
        return best(q_ids, q, c_ids, c, k, self_excluded)

    monkeypatch.setattr(neighbors, "_best", counted)
    df = frame(spark, rows)
    near = {(r.query_id, r.neighbor_id) for r in neighbors.knn_lsh(df, df, 3).collect()}
    monkeypatch.undo()
    compared = met.value
    exact = {(r.query_id, r.neighbor_id) for r in neighbors.knn(df, df, 3).collect()}
    assert len(near & exact) / len(exact) > 0.9
    assert 0 < compared < 0.1 * 20 * len(rows) ** 2


def test_vectors_with_nan_or_null_elements_take_no_neighbour_away(spark):
    rows = [(i, [float(i % 5 + 1), float(i), 1.0]) for i in range(20)]
    odd = [(100, [float("nan"), 1.0, 1.0]), (101, [None, 1.0, 1.0]), (102, [float("inf"), 1.0, 1.0])]
    clean = spark.createDataFrame(rows, "id long, embedding array<double>")
    dirty = spark.createDataFrame(rows + odd, "id long, embedding array<double>")
    want = sorted(map(tuple, neighbors.knn(clean, clean, 3).collect()))
    assert sorted(map(tuple, neighbors.knn(dirty, dirty, 3).collect())) == want
    assert sorted(map(tuple, neighbors.knn_by_cells(dirty, dirty, 3).collect())) == want


@pytest.mark.parametrize("way", ["cells", "lsh"])
def test_vectors_are_written_once_not_per_cell_or_bucket(spark, monkeypatch, way):
    """Without structure nearly every cell is probed; a vector still travels per block of rows only."""
    rng = np.random.default_rng(7)
    n, k = 600, 3
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=24)]) for i in range(n)]
    df, staged, stage = frame(spark, rows), [], neighbors.stage
    monkeypatch.setattr(neighbors, "stage", lambda *a, **b: staged.append(stage(*a, **b)) or staged[-1])
    if way == "cells":
        got = neighbors.knn_by_cells(df, df, k, pivots=24)
        assert {(r.query_id, r.neighbor_id, r["rank"]) for r in got.collect()} == brute_knn(rows, rows, k)
    else:
        assert neighbors.knn_lsh(df, df, k).count() == n * k
    assert max(s.count() for s in staged if "vec" in s.columns) == n
    assert max(s.count() for s in staged) <= n * k


def test_memory_of_a_search_does_not_grow_with_the_corpus():
    """Not even where all rows are copies, so that every pair is a tie."""
    q, c = np.ones((1500, 4)) / 2, np.ones((40_000, 4)) / 2
    tracemalloc.start()
    ids, found, sims = neighbors._best(np.arange(1500), q, np.arange(40_000)[::-1], c, 3, True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.reshape(-1, 3)[[0, 1, 2, 9]].tolist() == [[1, 2, 3], [0, 2, 3], [0, 1, 3], [0, 1, 2]] and set(sims) == {1.0}
    assert peak < 64 << 20
