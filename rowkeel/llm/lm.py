"""LM scoring with a hidden Markov model over words.

Word counts of all training documents come first. Words that are frequent enough (at most ``FREQUENT`` of them) are the
model's symbols; all others share one symbol and a smoothed distribution inside it, so that every word, known or not,
has a probability. Latent states are trained by Baum-Welch: each task runs forward and backward over its documents with
the current model and emits expected counts, Spark adds them up per symbol, the driver normalizes (its table is bounded
by ``FREQUENT``). The states start from a hash of each word, and every round covers all training documents. Scores are
exact: the scaled forward recursion runs over each whole document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import shake_128
from math import log10

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm.common import pieces, shuffles_dropped, table, text_of, tokens
from rowkeel.llm.quality import remainder
from rowkeel.sources.staging import stage

#: Latent states, most rounds over all training documents, most symbols, longest word that is a symbol.
STATES, ROUNDS, FREQUENT, SYMBOL_BYTES = 8, 27, 1 << 16, 64
#: Training ends when a round raised the likelihood of the training documents by less than this, in log10 a token.
LEAST_GAIN = 0.005
#: Training runs over stretches of so many words, each document being cut into stretches from end to end; scoring does not cut.
STRETCH = 512
ALPHA = 0.1
END = b""
_FLUSH = 200_000
_TOKENS_AT_ONCE = 2_000_000


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c`` over all ``text`` of ``docs``, the end of each document being the empty word. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "c"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column("text"):
                seen.update(tokens(text.as_py()))
                seen[END] += 1
                if len(seen) > _FLUSH:
                    yield out()
        if seen:
            yield out()

    return docs.select(text_of().alias("text")).mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """``emit`` has a row per symbol and a last one for all other words; ``base`` the log10 unigram probability of each symbol."""

    symbols: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    #: log10 likelihood of the training documents under the model before this one, and their tokens; 0 before the first round.
    likelihood: float = 0.0
    tokens: int = 0

    @property
    def base_log(self) -> float:
        """log10 of the unigram denominator."""
        return log10(self.total + ALPHA * (self.distinct + 1))

    @property
    def rare_log(self) -> float:
        """log10 of the denominator among words that are no symbols."""
        return log10(self.rest)

    @property
    def rest(self) -> float:
        """Smoothed count of all words that are no symbols, unknown ones included."""
        return self.total - int(self.counts.sum()) + ALPHA * (self.distinct - int((self.counts > 0).sum()) + 1)

    def unigram(self) -> np.ndarray:
        """Probabilities of the symbols and of all other words together."""
        p = np.append(self.counts + ALPHA, self.rest)
        return p / p.sum()


@lru_cache(maxsize=1)
def _index(sent: Broadcast) -> tuple[Model, dict[bytes, int]]:
    model = sent.value
    return model, {w: i for i, w in enumerate(model.symbols)}


def symbols_of(words: list[bytes], index: dict[bytes, int]) -> np.ndarray:
    other = len(index)
    return np.fromiter((index.get(w, other) for w in words), np.int32, len(words))


class Lockstep:
    """Sequences side by side: step t holds the t-th symbol of every sequence that is long enough, longest sequence first."""

    def __init__(self, sequences: list[np.ndarray]):
        lengths = np.array([len(s) for s in sequences])
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        # numbers of 16 bits are sorted by counting
        by_step = np.argsort(at.astype(np.uint16) if lengths[0] < 1 << 16 else at, kind="stable")
        self.symbols = np.concatenate([sequences[i] for i in self.order])[by_step]
        self.active = np.bincount(at)
        self.begin = np.append(0, np.cumsum(self.active))

    def likelihoods(self, model: Model) -> np.ndarray:
        """log10 of the likelihood of each sequence, by the scaled forward recursion."""
        logs = np.zeros(len(self.order))
        a = None
        for t, n in enumerate(self.active):
            seen = model.emit[self.symbols[self.begin[t] : self.begin[t] + n]]
            a = (model.start if a is None else a[:n] @ model.move) * seen
            scale = a.sum(axis=1)
            a /= scale[:, None]
            logs[:n] += np.log10(scale)
        out = np.empty(len(logs))
        out[self.order] = logs
        return out

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves, the state weights of each symbol in step order (forward and backward), a row per state, and the log10 likelihood.

        Single precision is enough for weights: every step is scaled, and they are added up in double precision.
        """
        k, n_all = len(model.start), len(self.symbols)
        start, move, emit = (x.astype(np.float32) for x in (model.start, model.move, model.emit.T))
        seen, ahead, scale = np.take(emit, self.symbols, axis=1), np.empty((k, n_all), np.float32), np.empty(n_all, np.float32)
        a = np.repeat(start[:, None], self.active[0], axis=1)
        for t, n in enumerate(self.active):
            b = self.begin[t]
            if t:
                a = move.T @ ahead[:, self.begin[t - 1] : self.begin[t - 1] + n]
            a *= seen[:, b : b + n]
            scale[b : b + n] = a.sum(axis=0)
            np.divide(a, scale[b : b + n], out=ahead[:, b : b + n])
        likelihood = float(np.log10(scale, dtype=np.float64).sum())
        moves, weights = np.zeros((k, k)), ahead.copy()
        # what a step tells the one before it; at the last step of a sequence nothing follows
        seen /= scale
        for t in range(len(self.active) - 2, -1, -1):
            n, b, c = self.active[t + 1], self.begin[t], self.begin[t + 1]
            told = seen[:, c : c + n]
            moves += ahead[:, b : b + n] @ told.T
            back = move @ told
            weights[:, b : b + n] *= back
            seen[:, b : b + n] *= back
        return weights[:, : self.active[0]].sum(axis=1, dtype=np.float64), model.move * moves, weights, likelihood


def _stretches(symbols: np.ndarray) -> list[np.ndarray]:
    return [symbols[i : i + STRETCH] for i in range(0, len(symbols), STRETCH)]


class Expected:
    """Expected counts of one round, added up in one task."""

    def __init__(self, model: Model):
        self.model, k = model, len(model.start)
        self.start, self.move, self.emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, len(model.emit)))
        self.likelihood, self.tokens = 0.0, 0

    def add(self, sequences: list[np.ndarray]) -> None:
        if not sequences:
            return
        steps = Lockstep(sequences)
        start, move, weights, likelihood = steps.expected(self.model)
        self.likelihood, self.tokens = self.likelihood + likelihood, self.tokens + len(steps.symbols)
        self.start += start
        self.move += move
        for own, w in zip(self.emit, weights, strict=True):
            own += np.bincount(steps.symbols, w, len(own))


def renewed(model: Model, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
    """The next model: expected counts, drawn a little towards the unigram and even moves so that nothing is impossible."""
    prior = 20 * model.unigram()[:, None]
    emit = (emit + prior) / (emit + prior).sum(axis=0)
    move = (move + 0.1) / (move + 0.1).sum(axis=1, keepdims=True)
    start = (start + 0.1) / (start + 0.1).sum()
    return Model(model.symbols, model.counts, model.total, model.distinct, start, move, emit)


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """``symbols`` of every stretch of all ``text`` of ``docs``: what the rounds read, so that words are looked up once."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, index = _index(sent)
        for batch in pieces(batches, "text"):
            found = [s for text in batch.column("text") for s in _stretches(symbols_of([*tokens(text.as_py()), END], index))]
            ends = np.cumsum([0, *map(len, found)])
            yield pa.record_batch([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], names=["symbols"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "symbols array<int>")


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    group, size = [], 0
    for batch in batches:
        column = batch.column("symbols")
        flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            group.append(flat[a:b])
            size += b - a
            if size > _TOKENS_AT_ONCE // 8:
                yield group
                group, size = [], 0
    yield group


def baum_welch_round(stretches: DataFrame, model: Model) -> Model:
    """One round over all ``symbols`` of ``stretches``: tasks emit expected counts per symbol, a shuffle adds them up."""
    spark, k, rows_of = stretches.sparkSession, len(model.start), len(model.emit)
    # the words stay with the driver: the rounds read symbols
    sent = spark.sparkContext.broadcast(Model([], model.counts[:0], 0, 0, model.start, model.move, model.emit))
    names = [f"s{i}" for i in range(k)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Expected(sent.value)
        for group in _groups(batches):
            sums.add(group)
        # symbols first, then the start, the moves, the likelihood and the tokens
        told = np.zeros((2, k))
        told[:, 0] = sums.likelihood, sums.tokens
        rows = np.concatenate([sums.emit.T, sums.start[None], sums.move, told])
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.record_batch([pa.array(used, pa.int32()), *(pa.array(rows[used, i]) for i in range(k))], names=["symbol", *names])

    schema = ", ".join(["symbol int", *(f"{n} double" for n in names)])
    with shuffles_dropped(spark):
        summed = stretches.mapInArrow(run, schema).groupBy("symbol").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    sent.destroy()
    rows = np.zeros((rows_of + 3 + k, k))
    for i, n in enumerate(names):
        rows[summed["symbol"].to_numpy(), i] = summed[n].to_numpy()
    made = renewed(model, rows[rows_of], rows[rows_of + 1 : -2], rows[:rows_of])
    made.likelihood, made.tokens = float(rows[-2, 0]), int(rows[-1, 0])
    return made


def _symbol_table(counts: DataFrame) -> tuple[list[bytes], np.ndarray, int, int]:
    """The frequent words, their counts, and the totals.

    The least count is read from a histogram over classes of counts (a fixed number of rows), so words need no global order.
    """
    level = F.floor(F.log2("c") * 64).cast("int")
    may = (F.octet_length("word") <= SYMBOL_BYTES).alias("may")
    classes = counts.groupBy(level.alias("level"), may).agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect()
    total, distinct = sum(r.c for r in classes), sum(r.n for r in classes)
    held, least = 0, None
    for r in sorted((r for r in classes if r.may), key=lambda r: -r.level):
        if held + r.n > FREQUENT:
            break
        held, least = held + r.n, r.level
    if least is None:
        return [END], np.zeros(1, np.int64), total, distinct
    found = counts.where((level >= least) & (F.octet_length("word") <= SYMBOL_BYTES)).toArrow()
    pairs = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda p: (-p[1], p[0]))
    return [w for w, _ in pairs], np.array([c for _, c in pairs], np.int64), total, distinct


def first_states(model: Model, states: int = STATES) -> Model:
    """Sticky states that a hash of each word draws apart: they start alike whatever the number and length of documents."""
    drawn = np.frombuffer(b"".join(shake_128(w).digest(4 * states) for w in model.symbols), "<u4").reshape(-1, states) / 2**32
    emit = model.unigram()[:, None] * np.exp(np.append(drawn - 0.5, np.zeros((1, states)), axis=0))
    move = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * (0.98 - 0.02 / max(1, states - 1))
    return Model(model.symbols, model.counts, model.total, model.distinct, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN) -> Model:
    """The model of ``text`` of ``docs``, given their written :func:`count_words`; every round covers all of it.

    A round tells the likelihood of the model that it started from; when that is less than ``least_gain`` a token above the one of the
    round before, the rounds end.
    """
    symbols, c, total, distinct = _symbol_table(counts)
    k = np.ones(1)
    model = first_states(Model(symbols, c, total, distinct, k, k[None], k[None]))
    stretches = stage(encoded(docs, model), "stretches")
    for i in range(rounds):
        before, model = model, baum_welch_round(stretches, model)
        if i and model.likelihood - before.likelihood < least_gain * model.tokens:
            break
    return model


def scored_symbols(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, the number of tokens, what the symbols add to all results, and the other words with their frequency."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*keep).schema, *T._parse_datatype_string("n_tokens long, n_known long, base_part double, score_part double, rare array<struct<word:binary,tf:int>>")])
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("tf", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, index = _index(sent)
        unigram = np.append(np.log10(own.counts + ALPHA) - own.base_log, 0.0)
        known = np.append(own.counts > 0, False)
        held: list[tuple] = []
        sequences: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            logs = Lockstep(sequences).likelihoods(own)
            at = 0
            for columns, numbers, rare in held:
                n = len(rare)
                yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, numbers), pa.array(logs[at : at + n]), rare], names=schema.names)
                at += n
            held.clear()
            sequences.clear()

        for batch in pieces(batches, "__text"):
            own_rows = []
            for text in batch.column("__text"):
                words = [*tokens(text.as_py()), END]
                s = symbols_of(words, index)
                other = s == len(index)
                rare = Counter(words[i] for i in np.flatnonzero(other)) if other.any() else {}
                sequences.append(s)
                size += len(s)
                own_rows.append((len(s), int(known[s].sum()), float(unigram[s].sum()), [{"word": w, "tf": f} for w, f in rare.items()]))
            numbers = [list(c) for c in zip(*own_rows, strict=True)]
            held.append(([batch.column(n) for n in batch.schema.names if n != "__text"], numbers[:3], pa.array(numbers[3], rare_type)))
            if size > _TOKENS_AT_ONCE:
                yield from out()
                size = 0
        if held:
            yield from out()

    return docs.select(*keep, text_of().alias("__text")).mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, counts: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``n_tokens, n_known, base_score, score`` of every row.

    Words that are no symbols are looked up by a join on the word; each occurs too seldom to make a hot key. The keep
    columns stay with their row through a row number in a written table, so they may repeat or be null.
    """
    parts = scored_symbols(docs, model, keep).withColumn("r", F.monotonically_increasing_id())
    parts = stage(parts, "lm")
    rare = parts.select("r", F.inline("rare")).join(counts.withColumnRenamed("c", "n"), "word", "left")
    n, log = F.coalesce("n", F.lit(0)), F.log10(F.coalesce("n", F.lit(0)) + ALPHA)
    sums = rare.groupBy("r").agg(
        F.sum("tf").alias("n_rare"), F.sum(F.when(n > 0, F.col("tf")).otherwise(0)).alias("rare_known"), F.sum(F.col("tf") * log).alias("rare_log")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return parts.drop("rare").join(sums, "r", "left").select(
        *keep,
        "n_tokens",
        (F.col("n_known") + zero("rare_known")).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_part") + zero("rare_log") - zero("n_rare") * model.base_log).alias("base_score"),
        (F.col("score_part") + zero("rare_log") - zero("n_rare") * model.rare_log).alias("score"),
    )


def held_out(doc_id: Column) -> Column:
    return remainder(doc_id, 10) == 0


def op3_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by the model of the training documents.

    A null or empty text is one end; null ids are held out; repeated rows get equal scores; extra columns are ignored; an
    empty table gives no rows, and without training documents every token has probability 1 in the base.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    learn = docs.where(~F.col("held_out"))
    counts = stage(count_words(learn), "words")
    return score(docs, train(learn, counts), counts, ["doc_id", "held_out"])
