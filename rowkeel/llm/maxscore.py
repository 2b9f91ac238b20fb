"""Exact top-k by MaxScore over postings of quantized dimensions.

A term is a dimension; its postings are the rows with their integer components. A query knows an upper bound of every
term's contribution in the shard. Terms sorted by bound split in two: the *non-essential* ones, whose bounds together
stay below what a row still needs, and the *essential* ones. Essential postings are traversed term by term for all
rows; the others are probed only for rows that can still reach the threshold, which rises as rows are scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.llm.common import table
from rowkeel.llm.vectors import ranked, search_blocks, usable

#: Rows scored between two updates of the threshold.
RUN_ROWS = 2048


def quantized(vectors: DataFrame) -> DataFrame:
    """floor(256 x) of every component, as doubles that hold the integer exactly; one beyond 64 bits stops the search."""
    refused = F.raise_error(F.lit("a component times 256 does not fit into 64 bits")).cast("double")
    whole = lambda x: F.when(F.abs(x * 256) < F.lit(2.0**63), F.floor(x * 256).cast("double")).otherwise(refused)
    return vectors.withColumn("embedding", F.transform("embedding", whole))


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size; one beyond 64 bits stops the search."""
    whole = [int(v) for v in q]
    scores = [sum(a * int(b) for a, b in zip(whole, row, strict=True)) for row in rows]
    if any(not -(1 << 63) <= s < 1 << 63 for s in scores):
        raise OverflowError("an inner product does not fit into 64 bits")
    return np.array(scores, np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def top_k(k: int):
    """The kernel of :func:`search_blocks`: exact, for any signs, ties to the smaller id."""

    def kernel(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Iterator:
        # doubles add up integers exactly below 2^53; larger ones are rare and go without bounds
        if len(ids) and float(np.abs(rows).max()) * float(np.abs(queries).max()) * rows.shape[1] >= 2.0**53:
            for query_id, q in zip(query_ids, queries, strict=True):
                others = np.flatnonzero(ids != query_id)
                score = _exact(q, rows[others])
                order = sorted(range(len(others)), key=lambda i: (-int(score[i]), ids[others[i]]))[:k]
                yield query_id, ids[others][order], score[order]
            return
        runs = []
        for at in range(0, len(ids), RUN_ROWS):
            part = np.ascontiguousarray(rows[at : at + RUN_ROWS].T)
            runs.append((ids[at : at + RUN_ROWS], part, part.min(axis=1), part.max(axis=1)))
        for query_id, q in zip(query_ids, queries, strict=True):
            best, named = np.zeros(0), np.zeros(0, np.int64)
            for run_ids, postings, low, high in runs:
                bound = np.maximum(q * low, q * high)
                floor = np.minimum(q * low, q * high)
                terms = np.argsort(-(bound - floor), kind="stable")
                # rest[i]: the most that the terms from i on can add
                rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)
                bar = best[-1] if len(best) == k else -np.inf
                if rest[0] < bar:
                    continue
                # non-essential: the longest tail whose spread leaves the essential part to decide
                spread = np.append(np.cumsum((bound - floor)[terms][::-1])[::-1], 0.0)
                cut = int(np.argmax(spread <= max(0.0, rest[0] - bar) / 4)) if np.isfinite(bar) else len(terms)
                score = np.zeros(postings.shape[1])
                for t in terms[:cut]:
                    score += q[t] * postings[t]
                alive = np.flatnonzero(score + rest[cut] >= bar)
                for i in range(cut, len(terms)):
                    if not len(alive):
                        break
                    score[alive] += q[terms[i]] * postings[terms[i]][alive]
                    alive = alive[score[alive] + rest[i + 1] >= bar]
                alive = alive[run_ids[alive] != query_id]
                if len(alive) > 4 * k:
                    # all rows at the k-th score stay, so that ties go by id
                    kth = np.partition(score[alive], len(alive) - k)[len(alive) - k]
                    alive = alive[score[alive] >= kth]
                best, named = _best(np.append(best, score[alive]), np.append(named, run_ids[alive]), k)
            yield query_id, named, best.astype(np.int64)

    return kernel


def exact_top_k(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each id divisible by ``every`` its ``k`` highest integer inner products.

    See :func:`usable` for the rows left out. Each row is a candidate, and each row of a query id asks. Fewer than ``k`` candidates: all of them. Empty table:
    no rows. Ties go to the smaller id. Extra columns are ignored.
    """
    return ranked(search_blocks(quantized(usable(vectors)), every, top_k(k), "long"), k)


def op7_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each query's five highest integer inner products.

    Null ids, and vectors that are null, empty or hold a null or non-finite component, take no part; rows that share an id are all
    candidates of other ids; vectors of different lengths never meet; ties go to the smaller id; an empty table gives no rows; extra
    columns are ignored. Components or products beyond 64 bits stop the query with a message.
    """
    return exact_top_k(table(spark, sf_dir, "embeddings"), 5, 50)


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
