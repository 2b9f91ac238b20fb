"""Normalised words: A-Z in lower case, runs of letters, digits and all that is not ASCII; with their places in the text."""

from __future__ import annotations

import numpy as np

#: Word bytes are kept, A-Z become a-z, every other ASCII byte becomes a blank.
_KEPT = np.ones(256, bool)
_KEPT[:0x30] = _KEPT[0x3A:0x41] = _KEPT[0x5B:0x61] = _KEPT[0x7B:0x80] = False
NORMAL = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if _KEPT[b] else 0x20 for b in range(256))

#: The same words as a Java pattern, for a text whose A-Z are in lower case.
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normal_words(data: bytes) -> list[bytes]:
    return data.translate(NORMAL).split()


def word_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where the words begin and end."""
    kept = np.concatenate(([False], _KEPT[np.frombuffer(data, np.uint8)], [False]))
    edges = np.flatnonzero(kept[1:] != kept[:-1])
    return edges[::2], edges[1::2]
