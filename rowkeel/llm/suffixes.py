"""Sampled suffixes of texts, in numpy: the entries that the suffix arrays of :mod:`repeats` sort.

A repeat is found through the suffixes that start at *anchors*. The anchor of a window of ``length`` bytes is its
``GRAM``-byte string of least hash, the leftmost of equal ones; it depends on the window's bytes only, so equal windows
have equal anchors at equal distances. Windows that follow one another mostly share an anchor: such a run is one entry,
named by the hash of its anchor's gram (``key``) and by the hash of all bytes that its windows cover (``span``).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

GRAM = 40
#: Bytes hashed at once; longer texts are read in overlapping parts.
PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_IDX = 22
_VALUES = np.random.default_rng(99).integers(0, 1 << 64, 256, np.uint64, endpoint=False)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.empty(n, np.uint64)
        p[0] = 1
        size = 1
        while size < n:
            more = min(size, n - size)
            p[size : size + more] = p[:more] * np.uint64(pow(base, size, 1 << 64))
            size += more
        out.append(p)
    return out[0], out[1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of one buffer of at most ``PART`` and a few bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _powers(max(PART + 4096, len(data) + 1))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUES[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours: prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def parts(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, int]]]]:
    """Buffers of about ``PART`` bytes and what they hold: (text, first byte, place in the buffer, bytes).

    A text longer than that is cut into parts that overlap by ``length - 1`` bytes, so each window lies in one of them.
    """
    held: list[tuple[int, int, int, int]] = []
    data: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - length + 1), PART // 2):
            piece = text[at : at + PART // 2 + length - 1]
            if size and size + len(piece) > PART:
                yield np.frombuffer(b"".join(data), np.uint8), held
                held, data, size = [], [], 0
            held.append((i, at, size, len(piece)))
            data.append(piece)
            size += len(piece)
    if held:
        yield np.frombuffer(b"".join(data), np.uint8), held


def entries(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """``text, key, span, start, windows`` of all entries: windows ``start .. start + windows - 1`` of that text."""
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    for data, held in parts(texts, length):
        if len(data) < length:
            continue
        hashes = Hashes(data)
        grams = hashes.all_of(GRAM)
        ranked = (grams >> np.uint64(_IDX) << np.uint64(_IDX)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(ranked, length - GRAM + 1) & np.uint64((1 << _IDX) - 1)).astype(np.int64)
        owner = np.full(len(anchor), -1, np.int32)
        for j, (_, _, place, n) in enumerate(held):
            owner[place : max(place, place + n - length + 1)] = j
        edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])) + 1
        first = np.append(0, edge)
        count = np.diff(np.append(first, len(anchor)))
        real = owner[first] >= 0
        first, count = first[real], count[real]
        piece = np.array(held, np.int64)[owner[first]]
        values = (piece[:, 0], grams[anchor[first]].view(np.int64), hashes.of(first, first + count + length - 1).view(np.int64), first - piece[:, 2] + piece[:, 1], count)
        for o, v in zip(out, values, strict=True):
            o.append(v)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(o) if o else empty for o in out)


def windows(text: bytes, start: int, count: int, length: int) -> np.ndarray:
    """Hashes of ``count`` windows of a text from ``start`` on."""
    return Hashes(np.frombuffer(text[start : start + count + length - 1], np.uint8)).all_of(length).view(np.int64)
