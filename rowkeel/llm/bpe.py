"""BPE encoding and decoding with a tokenization automaton.

States of the automaton are the tokens that were emitted last, arcs are labelled with the bytes of the next token. The
merges are compiled one after another, each as a gadget ``u v -> uv`` of rank ``k``: it cuts the arc ``v`` behind
``u`` and adds the arc ``uv``. A later token remembers the two pieces it was made of, so its state inherits the cuts
of its right piece made before it existed, and its arc goes with the arc of its left piece. Cuts are kept with the piece
they were made for and resolved into a row of the transition table when a state meets a label first.

A split word is then read through a table of byte transitions that gives the longest label at a place, and the
automaton accepts or refuses it; refused labels give way to their longest prefix that is a label. The accepted path is
unique: it is what applying the merges by rank gives. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowkeel.llm.common import pieces, resident, table, text_of

#: Words, and resolved table rows, that one Python worker keeps; they are forgotten when full, which changes no result.
CACHE_WORDS, CACHE_ROWS = 150_000, 200_000

#: The byte-level split. Letters come first because they are most frequent; no other part can start where they match.
WORDS = r""" ?\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"""


# Code points that this Python's classes count as letters or digits, and the tokenizers library, whose tables are of Unicode 16, does not.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9"
    "\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6"
    "\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2"
    "\U0001b123-\U0001b128\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
#: The same split for texts with such code points, which are neither letters nor digits there.
WORDS_BEFORE = rf""" ?(?:(?![{LATER}])\p{{L}})++|'(?:s|t|re|ve|m|ll|d)| ?(?:(?![{LATER}])\p{{N}})++| ?(?:[^\s\p{{L}}\p{{N}}]|[{LATER}])++|\s+(?!\S)|\s+"""


def byte_names() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """Compiled from the text of a byte-level ``tokenizer.json``."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, split = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"] or odd:
            raise ValueError("only plain byte-level BPE without normalizer is supported")
        names = byte_names()
        as_bytes = lambda token: bytes(names[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.labels = {i: b for b, i in self.ids.items()}
        #: the gadgets: what is cut behind a piece, by rank
        self.cuts: dict[tuple[int, int], int] = {}
        self.left: dict[int, tuple[int, int]] = {}
        self.right: dict[int, tuple[int, int]] = {}
        for k, merge in enumerate(model["merges"]):
            u, v = (self.ids[as_bytes(p)] for p in (merge.split(" ") if isinstance(merge, str) else merge))
            x = self.ids[self.labels[u] + self.labels[v]]
            if x in self.left:
                raise ValueError("two merges make the same token")
            self.cuts[u, v] = k
            self.left[x], self.right[x] = (u, k), (v, k)
        self.rows: dict[int, bool] = {}
        self.inside: dict[int, bool] = {}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels |= {i: t.encode() for t, i in self.added.items()}
        self.apart = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words, self.words_before, self.later = regex.compile(WORDS), regex.compile(WORDS_BEFORE), regex.compile(f"[{LATER}]")
        self._read_labels()
        self.cache: dict[str, bytes] = {}

    def _read_labels(self) -> None:
        """The byte transitions ``(node, byte) -> node``, the label ended at a node, and each label's longest proper prefix label."""
        self.step: dict[int, int] = {}
        self.ends, most = [-1], max(self.ids.values()) + 1
        self.shorter, self.size = [-1] * most, [0] * most
        for label, i in sorted((b, i) for b, i in self.ids.items()):
            node, last = 0, -1
            for b in label:
                if self.ends[node] >= 0:
                    last = self.ends[node]
                node = self.step.setdefault(node << 8 | b, len(self.ends))
                if node == len(self.ends):
                    self.ends.append(-1)
            self.ends[node], self.shorter[i], self.size[i] = i, last, len(label)

    def follows(self, state: int, label: int) -> bool:
        """Whether ``label`` may be read in ``state``: no gadget joined the pieces on both sides while both were still open."""
        known = self.rows.get(state << 32 | label)
        if known is None:
            known = True
            u, closed_u = state, len(self.cuts)
            while known and u is not None:
                v, closed_v = label, len(self.cuts)
                while v is not None:
                    k = self.cuts.get((u, v))
                    # of equal merges the left one goes first: it closes its right piece, but may take a left piece of the next
                    if k is not None and k < closed_u and k <= closed_v:
                        known = False
                        break
                    v, closed_v = self.left.get(v, (None, 0))
                u, closed_u = self.right.get(u, (None, 0))
            if len(self.rows) > CACHE_ROWS:
                self.rows.clear()
            self.rows[state << 32 | label] = known
        return known

    def path(self, word: bytes) -> list[int]:
        """The ids of one split word."""
        whole = self.ids.get(word)
        if whole is not None and (whole not in self.left or self.follows_inside(whole)):
            return [whole]
        step, ends, shorter, size, rows = self.step.get, self.ends, self.shorter, self.size, self.rows
        out: list[int] = []
        at, dead, n = 0, set(), len(word)
        while at < n:
            # the longest label at this place
            node, label = 0, -1
            for i in range(at, n):
                node = step(node << 8 | word[i])
                if node is None:
                    break
                if ends[node] >= 0:
                    label = ends[node]
            while True:
                while label >= 0:
                    if at + size[label] not in dead:
                        if not out:
                            break
                        ok = rows.get(out[-1] << 32 | label)
                        if ok or (ok is None and self.follows(out[-1], label)):
                            break
                    label = shorter[label]
                if label >= 0:
                    break
                # nothing goes on from here: take the last arc back
                if not out:
                    raise ValueError(f"no path reads {word!r}")
                dead.add(at)
                label = out.pop()
                at -= size[label]
                label = shorter[label]
            out.append(label)
            at += size[label]
        return out

    def follows_inside(self, token: int) -> bool:
        """Whether a token's own bytes are read as this one token."""
        known = self.inside.get(token)
        if known is None:
            known = self.inside[token] = self._reads_itself(token)
        return known

    def _reads_itself(self, token: int) -> bool:
        (u, k), (v, _) = self.left[token], self.right[token]
        for piece in (u, v):
            if piece in self.left and not self.follows_inside(piece):
                return False
        a, closed_a = u, k
        while a is not None:
            b, closed_b = v, k
            while b is not None:
                cut = self.cuts.get((a, b))
                if cut is not None and cut < closed_a and cut <= closed_b and cut < k:
                    return False
                b, closed_b = self.left.get(b, (None, 0))
            a, closed_a = self.right.get(a, (None, 0))
        return True

    def packed(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.apart is None or not self.apart.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [self._plain(text[at : m.start()]), self.added[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        words = self.split(text)
        cache = self.cache
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            got = cache.get(w)
            if got is None:
                got = np.array(self.path(w.encode()), "<u4").tobytes()
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(w) <= 64:
                    cache[w] = got
            out.append(got)
        return b"".join(out)

    def split(self, text: str) -> list[str]:
        """The words of a text; one of Latin-1 alone, which is told at once, holds no later code point."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            if self.later.search(text):
                return self.words_before.findall(text)
        return self.words.findall(text)

    def text(self, packed: bytes) -> str:
        """The labels of the ids, one after another; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def compiled(source: str) -> Automaton:
    """The automaton of a vocabulary, kept by the worker process until another operator or vocabulary comes."""
    return resident(("bpe", source), lambda: Automaton(source))


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file, read by the driver; its size does not depend on the data (the given ones have 1.6 MB)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, words: Broadcast, keep: list[str], packed: bool = False) -> DataFrame:
    """``keep`` columns and ``ids`` of the ``text`` column: an array of integers, or binary little-endian 32-bit ones where ``packed``.

    A null or empty text has no ids. One pass, no shuffle; texts are read whole.
    """
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("ids", T.BinaryType() if packed else T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(words.value)
        for batch in pieces(batches, "__text"):
            texts = batch.column("__text").to_pylist()
            got = [automaton.packed(t) for t in texts]
            if packed:
                ids = pa.array(got, pa.binary())
            else:
                ends = np.cumsum([0, *(len(g) // 4 for g in got)])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], names=[*names, "ids"])

    return docs.select(*keep, text_of().alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, words: Broadcast) -> DataFrame:
    """``encoded`` with ``decoded``, the text of its packed ``ids``; null ids give an empty text."""
    schema = T.StructType([*encoded.schema, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(words.value)
        for batch in pieces(batches, "ids", 8 << 20):
            texts = [automaton.text(b or b"") for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, keep: list[str], with_ids: bool = False) -> DataFrame:
    """``keep`` columns, the number of tokens, digests of the ids and of the decoded text, and the packed ids where ``with_ids``.

    Both directions are one pass of one worker, which holds one automaton.
    """
    words = vocabulary(docs.sparkSession, path)
    schema = T.StructType([*docs.select(*keep).schema, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = compiled(words.value)
        for batch in pieces(batches, "__text"):
            ids = [automaton.packed(t) for t in batch.column("__text").to_pylist()]
            texts = [automaton.text(b) for b in ids]
            own = [n for n in batch.schema.names if n != "__text"]
            columns = [*(batch.column(n) for n in own), pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*own, "ids", "decoded"])

    both = docs.select(*keep, text_of().alias("__text")).mapInArrow(run, schema)
    return both.select(
        *keep,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if with_ids else []),
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded. Null ids and repeated rows are rows like others; an empty table gives none."""
    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"])
