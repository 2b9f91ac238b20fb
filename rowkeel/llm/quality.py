"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded, learned filters run over overlapping chunks of ``WIDTH`` bytes, one every ``STRIDE`` bytes, from
the first byte of a text to its last. Each filter's highest response over the whole text is kept; a logistic layer
combines them into one probability. The network is fitted by Adam on a bounded sample of labelled rows; scoring reads
every whole text, in slices of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowkeel.llm.common import free_name, hash_sample, scored_by, table, text_of

WIDTH, STRIDE, DEPTH, FILTERS = 12, 6, 6, 32
#: The sample that the network is fitted on: so many labelled rows at most, by hash, none of more bytes than this.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 32_768
EPOCHS, BATCH, RATE = 10, 32, 0.004
#: A document is kept from this probability on.
KEEP = 0.3
_SLICE = 1 << 18


@dataclass
class Network:
    embedding: np.ndarray  # 256 x DEPTH
    filters: np.ndarray  # WIDTH * DEPTH x FILTERS
    bias: np.ndarray
    weights: np.ndarray
    offset: float

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Responses of all filters to every chunk of ``data`` (bytes, at least WIDTH of them)."""
        x = np.ascontiguousarray(self.embedding[data])
        n = (len(data) - WIDTH) // STRIDE + 1
        item = x.itemsize
        chunks = np.lib.stride_tricks.as_strided(x, (n, WIDTH * DEPTH), (STRIDE * DEPTH * item, item))
        return chunks @ self.filters

    def pooled(self, text: bytes) -> np.ndarray:
        data = padded(text)
        best = np.full(FILTERS, -np.inf, np.float32)
        step = _SLICE // STRIDE * STRIDE
        for at in range(0, max(1, len(data) - WIDTH + 1), step):
            best = np.maximum(best, self.responses(data[at : at + step + WIDTH - STRIDE]).max(axis=0))
        return best

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.maximum(pooled + self.bias, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.weights + self.offset, -30, 30)))

    def score(self, texts: list[str]) -> np.ndarray:
        """Texts of usual length share matrix products; a long one is read in slices of its own."""
        out = np.zeros(len(texts))
        group, size = [], 0

        def flush() -> None:
            if not group:
                return
            starts = np.cumsum([0, *(len(d) for _, d in group[:-1])])
            all_ = self.responses(np.concatenate([d for _, d in group]))
            # the chunks of one text are those that start in it and end in it
            best = np.stack([all_[a // STRIDE : a // STRIDE + (len(d) - WIDTH) // STRIDE + 1].max(axis=0) for a, (_, d) in zip(starts, group, strict=True)])
            out[[i for i, _ in group]] = self.probability(best)

        for i, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            if len(raw) > _SLICE // 2:
                out[i] = self.probability(self.pooled(raw)[None])[0]
                continue
            data = padded(raw)
            if size + len(data) > _SLICE:
                flush()
                group, size = [], 0
            group.append((i, data))
            size += len(data)
        flush()
        return out


def padded(text: bytes) -> np.ndarray:
    """The bytes, followed by zeros up to a whole number of strides that holds the last chunk; an empty text is all zeros."""
    n = max(len(text), WIDTH)
    full = WIDTH + -(-(n - WIDTH) // STRIDE) * STRIDE
    out = np.zeros(full, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out


def fit(texts: list[str], labels: np.ndarray, seed: int = 3) -> Network:
    """Adam on the cross entropy; only a filter's best chunk gets its gradient. Without both labels, the constant answer."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    params = [
        rng.normal(0, 0.5, (256, DEPTH)).astype(f32),
        rng.normal(0, 1 / np.sqrt(WIDTH * DEPTH), (WIDTH * DEPTH, FILTERS)).astype(f32),
        np.zeros(FILTERS, f32),
        rng.normal(0, 0.3, FILTERS).astype(f32),
        np.zeros(1, f32),
    ]
    y = np.asarray(labels, f32)
    share = float(np.clip((y.sum() + 1) / (len(y) + 2), 0.01, 0.99))
    params[4][0] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        params[3][:] = 0
        return Network(*params[:4], float(params[4][0]))
    data = [padded(t.encode("utf-8", "surrogatepass")) for t in texts]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, rounds = 0, EPOCHS * -(-len(data) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            net = Network(*params[:4], float(params[4][0]))
            picked = order[at : at + BATCH]
            best, where = [], []
            for i in picked:
                r = net.responses(data[i])
                w = r.argmax(axis=0)
                best.append(r[w, np.arange(FILTERS)])
                where.append(w)
            pooled = np.stack(best)
            hidden = np.maximum(pooled + params[2], 0)
            error = ((net.probability(pooled) - y[picked]) / len(picked)).astype(f32)
            g_hidden = error[:, None] * params[3] * (hidden > 0)
            grads = [np.zeros_like(p) for p in params]
            grads[2], grads[3], grads[4] = g_hidden.sum(axis=0), hidden.T @ error + 1e-4 * params[3], error.sum(keepdims=True)
            for i, w, g in zip(picked, where, g_hidden, strict=True):
                chunks = data[i][w[:, None] * STRIDE + np.arange(WIDTH)]  # FILTERS x WIDTH bytes
                seen = params[0][chunks].reshape(FILTERS, WIDTH * DEPTH)
                grads[1] += seen.T * g
                np.add.at(grads[0], chunks, (params[1] * g).T.reshape(FILTERS, WIDTH, DEPTH))
            step += 1
            rate = RATE * (1 - step / (rounds + 1))
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(*params[:4], float(params[4][0]))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text; a null id counts as the empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(by))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """At most ``rows`` labelled texts of the learning part, the first by hash; several labels of an id count by their mean.

    The ids are chosen among the labels, so that only chosen texts are moved.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder(F.col("doc_id"), 5) != 0))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # as many again, for those whose text is too long or absent
    chosen = hash_sample(known, 2 * rows, "doc_id")
    texts = docs.select("doc_id", text_of().alias("text")).where(F.octet_length("text") <= most_bytes)
    picked = texts.join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
    got = picked.select("text", "y").toArrow()
    return got["text"].to_pylist(), got["y"].to_numpy()


def trained(docs: DataFrame, labels: DataFrame) -> Network:
    return fit(*labelled_sample(docs, labels))


def scorer(spark: SparkSession, network: Network):
    """A column function; the network has a few thousand numbers."""
    sent = spark.sparkContext.broadcast(network)
    return scored_by(lambda: sent.value.score)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability that its quality label is 1.

    Null and empty texts are scored like others (as zeros). Null ids are held out. Repeated rows get equal scores. An
    empty table gives no rows; without labels every score is 0.5.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = trained(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), scorer(spark, network)(text_of()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def kept(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` without the rows that the network rejects; all columns, whatever their names."""
    score = free_name(docs, "score")
    return docs.withColumn(score, scorer(docs.sparkSession, network)(text_of())).where(F.col(score) >= KEEP).drop(score)
