"""Words of many texts at once: numpy over the UTF-8 bytes of a block of texts.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Words have 64-bit hashes: a polynomial over random
values of the bytes, modulo 2**64, then mixed. Two words of a corpus of n
different ones share a hash with a chance of about n * n / 2**65. A block holds
about a hundred bytes for each byte of text, so a worker's memory follows the
longest text once that is longer than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240301)
_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWERED = _VALUES.copy()
_LOWERED[65:91] = _VALUES[97:123]
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BLOCK_BYTES = 1_000_000
KEPT_BYTES = 8 * BLOCK_BYTES
_powers: dict[str, np.ndarray] = {}


def _power(which: str, n: int) -> np.ndarray:
    have = _powers.get(which)
    if have is None or len(have) < n:
        base = np.uint64(_R if which == "up" else _RINV)
        have = np.empty(max(n, BLOCK_BYTES + 1), np.uint64)
        have[0] = 1
        have[1:] = base
        np.multiply.accumulate(have, out=have)
        if n <= KEPT_BYTES:  # those of a very long text go with it
            _powers[which] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Bytes of some texts, each followed by a line feed, with their words."""

    def __init__(self, texts: list[bytes], lower: bool):
        self.n = len(texts)
        self.lengths = np.fromiter(map(len, texts), np.int64, self.n)
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) if self.n else np.empty(0, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]).astype(np.int64) if self.n else np.empty(0, np.int64)
        values = _LOWERED if lower else _VALUES
        self.sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(values[self.bytes] * _power("up", len(self.bytes)), out=self.sums[1:])
        inside = ~SPACE[self.bytes]
        edge = np.diff(inside.view(np.int8), prepend=0)
        self.word_starts = np.flatnonzero(edge == 1)
        self.word_ends = np.flatnonzero(edge == -1)  # a text ends with a line feed
        self.words = self.hash(self.word_starts, self.word_ends)
        self.doc = np.searchsorted(self.starts, self.word_starts, side="right") - 1
        self.n_words = np.bincount(self.doc, minlength=self.n)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * _power("down", len(self.bytes) + 1)[starts] + (ends - starts).astype(np.uint64))

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each window of `size` words that lies in one text, and the index of its first word."""
        n = len(self.words) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h += self.words[j : j + n] * _MIX[j]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return mix(h[at]), at


def blocks(batches: Iterator[pa.RecordBatch], column: int, lower: bool) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of the batches with about BLOCK_BYTES of text, and their words. A null text is an empty one."""
    for batch in batches:
        texts, first, held = [], 0, 0
        for i, t in enumerate(batch.column(column)):
            data = (t.as_py() or "").encode()
            texts.append(data)
            held += len(data)
            if held >= BLOCK_BYTES or len(texts) >= 4096:
                yield batch.slice(first, len(texts)), Block(texts, lower)
                texts, first, held = [], i + 1, 0
        if texts:
            yield batch.slice(first, len(texts)), Block(texts, lower)
