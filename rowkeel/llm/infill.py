"""Fill-in-the-middle with a piecewise-linear learned index from token ranks to byte offsets.

A text is cut only between tokens. Where token ``r`` ends is a growing function of ``r`` that is close to a line, so the
index keeps line segments, each within ``SLACK`` bytes of all boundaries that it covers, and one signed byte per
boundary: what the line misses. A cut at any rank is then one search among the segments, one prediction, and one
correction, which makes it exact.

Offsets are bytes of the UTF-8 text; a cut never falls inside a character, because tokens begin and end at ASCII
white space. Everything is row by row: no shuffle, and memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm.common import free_name, pieces, table, text_of

#: Marks of prefix, suffix and middle. A text that holds one of them stays plain, so that every output can be undone.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that a line may miss a boundary by; with one more for rounding it has to fit into a signed byte.
SLACK = 100
#: Boundaries that a segment is first tried on; doubled while all of them fit.
FIRST_REACH = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def boundaries(data: np.ndarray) -> np.ndarray:
    """Byte offsets where tokens end, 0 first: a token is a word with the white space before it, or white space at the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    space = _SPACE[data]
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    return np.concatenate(([0], ends, [len(data)])).astype(np.int64)


@dataclass(frozen=True)
class RankIndex:
    """``first`` ranks, ``base`` offsets and ``slope`` of the segments, and the ``missed`` bytes of every boundary."""

    first: np.ndarray
    base: np.ndarray
    slope: np.ndarray
    missed: np.ndarray

    @property
    def tokens(self) -> int:
        return len(self.missed) - 1

    def predicted(self, rank: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, rank, side="right") - 1
        return self.base[s] + np.rint(self.slope[s] * (rank - self.first[s])).astype(np.int64)

    def offset(self, rank: int) -> int:
        """The exact byte offset after ``rank`` tokens."""
        return int(self.predicted(np.array([rank]))[0]) + int(self.missed[rank])


def _reach(ends: np.ndarray, start: int, slack: int) -> tuple[int, float]:
    """How far one line from boundary ``start`` stays within ``slack``: the last rank, and the line's slope.

    The slopes that suit all boundaries so far are an interval that only shrinks; the segment ends where it is empty.
    """
    low, high, at, width = -np.inf, np.inf, start + 1, FIRST_REACH
    while at < len(ends):
        part = ends[at : at + width] - ends[start]
        run = np.arange(at - start, at - start + len(part))
        lows = np.maximum(np.maximum.accumulate((part - slack) / run), low)
        highs = np.minimum(np.minimum.accumulate((part + slack) / run), high)
        bad = lows > highs
        if bad.any():
            n = int(bad.argmax())
            if n:
                low, high = lows[n - 1], highs[n - 1]
            return at + n - 1, (low + high) / 2
        low, high, at, width = lows[-1], highs[-1], at + len(part), width * 2
    return len(ends) - 1, (low + high) / 2 if np.isfinite(low) else 0.0


def fit(ends: np.ndarray, slack: int = SLACK) -> RankIndex:
    """The index of all boundaries; ``ends`` grows strictly but for an empty text.

    Two neighbours always fit one line, so there are at most as many segments as tokens, however uneven these are.
    """
    if not 0 < slack <= 126:
        raise ValueError("slack has to be within 1 and 126")
    first, slope, start = [0], [], 0
    while True:
        last, s = _reach(ends, start, slack)
        slope.append(s)
        if last >= len(ends) - 1:
            break
        start = last + 1
        first.append(start)
    firsts = np.array(first, np.int64)
    index = RankIndex(firsts, ends[firsts], np.array(slope), np.zeros(len(ends), np.int8))
    missed = ends - index.predicted(np.arange(len(ends)))
    if np.abs(missed).max() > 127:
        raise AssertionError("a line missed a boundary by more than its bound")
    return RankIndex(index.first, index.base, index.slope, missed.astype(np.int8))


def cuts(index: RankIndex, one: int, two: int) -> tuple[int, int]:
    """The two byte offsets after the tokens that the draws name, in order."""
    n = index.tokens
    first, last = sorted((one % (n + 1), two % (n + 1)))
    return index.offset(first), index.offset(last)


def _characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def draws(row_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of the seed and the id; a null id counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, into: str = "fim") -> DataFrame:
    """``docs`` with a struct ``into``: ``n`` tokens, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, ``output``.

    ``rate`` percent of the texts are rewritten, ``spm`` percent of those with the suffix first. All columns stay, whatever their
    names; ``into`` must not be one of them. A null text is the empty text and stays plain; repeated rows give equal rows.
    """
    if into.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"{into} is a column already")
    text, spin = free_name(docs, "_fim_text"), free_name(docs, "_fim_draws")
    result = T._parse_datatype_string("struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>")
    schema = T.StructType([*docs.schema.fields, T.StructField(into, result)])
    whole = F.col(text)
    h = draws(F.col(id_col), seed)
    marked = F.contains(whole, F.lit(PREFIX)) | F.contains(whole, F.lit(SUFFIX)) | F.contains(whole, F.lit(MIDDLE))
    form = F.when((whole == "") | marked | (h[2] % 100 >= rate), "plain").when(h[3] % 100 < spm, "spm").otherwise("psm")
    drawn = F.struct(form.alias("form"), h[0].alias("one"), h[1].alias("two"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            rows = []
            drawn = batch.column(spin)
            picks = zip(batch.column(text), *(drawn.field(i).to_pylist() for i in range(3)), strict=True)
            for value, form, one, two in picks:
                data = value.as_buffer().to_pybytes()
                seen = np.frombuffer(data, np.uint8)
                ends = boundaries(seen)
                n = len(ends) - 1
                if form == "plain":
                    rows.append((n, form, None, None, data))
                    continue
                a, b = cuts(fit(ends), one, two)
                before, between, after = data[:a], data[a:b], data[b:]
                out = (p, before, s, after, m, between) if form == "psm" else (s, after, p, before, m, between)
                rows.append((n, form, _characters(seen[:a]), _characters(seen[a:b]), b"".join(out)))
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            parts = [pa.array(c, t) for c, t in zip(columns, types)]
            parts.append(pa.array(columns[4], pa.binary()).cast(pa.string()))
            own = [c for c in batch.schema.names if c not in (text, spin)]
            struct = pa.StructArray.from_arrays(parts, ["n", "form", "prefix_chars", "middle_chars", "output"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), struct], names=[*own, into])

    return docs.withColumn(text, text_of(text_col)).withColumn(spin, drawn).mapInArrow(run, schema)


def restored(form: Column, output: Column) -> Column:
    """The exact text of an output: its parts stand between marks, which the text itself does not hold."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, third = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    return F.when(form == "psm", F.concat(first, third, second)).when(form == "spm", F.concat(second, third, first)).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rebuilt.

    A null or empty text has no tokens and stays plain; a null id draws as the empty text; repeated rows give equal rows; extra
    columns are ignored; an empty table gives no rows.
    """
    out = infilled(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return out.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
r AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform(range(0, 4), lambda i: ('0x' || substr(h, 8 * i::INT + 1, 8))::BIGINT) AS g FROM d),
c AS (
  SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 50 THEN 'plain'
      WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix
  FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
