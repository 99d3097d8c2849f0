"""Words, word hashes and shingles of whole texts, for many texts at a time.

A word is a longest run of characters other than space and the controls 9 to 13, in UTF-8, after
A-Z became a-z. Work goes block by block (about a megabyte of text, or one longer text), so memory
follows the longest text and never the batch or the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


class _Tables(dict):
    """Power tables by base; they stay in the process that made them."""

    def __reduce__(self):
        return (_Tables, ())


_powers = _Tables()


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = values.astype(np.uint64) + np.uint64((2 * seed + 1) * _BASE % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = mixed(np.arange(256, dtype=np.uint64), seed=11)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _power_table(base: int, length: int) -> np.ndarray:
    """Powers 0 to ``length`` of ``base`` modulo 2**64, kept between calls."""
    table = _powers.get(base)
    if table is None or len(table) <= length:
        factors = np.full(max(length, BLOCK_BYTES) + 2, base, dtype=np.uint64)
        factors[0] = 1
        table = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return table


class Words:
    """The words of a block of texts.

    ``hashes`` has a 64-bit hash per word, ``starts`` and ``ends`` its bytes in ``buffer``, and text
    ``i`` owns the words from ``bounds[i]`` to ``bounds[i + 1]``; its bytes begin at ``offsets[i]``.
    """

    def __init__(self, texts: list[bytes | None]):
        texts = [text or b"" for text in texts]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        self.buffer = b" ".join(texts).lower() + b" "
        letters = np.frombuffer(self.buffer, dtype=np.uint8)
        space = _SPACE[letters]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edges = np.concatenate(([0], edges))
        self.starts, self.ends = edges[0::2], edges[1::2]
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.hashes = self._hashes(letters)

    def _hashes(self, letters: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.empty(0, dtype=np.uint64)
        power = _power_table(_BASE, len(letters))[: len(letters)]
        sums = np.zeros(len(letters) + 1, dtype=np.uint64)
        np.cumsum(_LETTER[letters] * power, out=sums[1:])
        inverse = _power_table(_BASE_INVERSE, len(letters))
        return mixed((sums[self.ends] - sums[self.starts]) * inverse[self.starts])

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def word(self, i: int) -> bytes:
        return self.buffer[self.starts[i] : self.ends[i]]

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of ``size`` words, and for each text where its runs begin.

        A text with fewer words, but some, has one shingle: all its words.
        """
        counts = np.diff(self.bounds)
        per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
        bounds = np.concatenate(([0], np.cumsum(per_text)))
        n = len(self.hashes)
        runs = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
        for k in range(size):
            runs = (runs + self.hashes[k : k + len(runs)]) * np.uint64(_BASE)
        first = np.repeat(self.bounds[:-1] - bounds[:-1], per_text) + np.arange(bounds[-1])
        short = np.flatnonzero((counts > 0) & (counts < size))
        whole = np.ones(bounds[-1], dtype=bool)
        whole[bounds[short]] = False
        out = np.empty(bounds[-1], dtype=np.uint64)
        out[whole] = runs[first[whole]]
        for i in short:
            value = counts[i : i + 1].astype(np.uint64)
            for k in range(self.bounds[i], self.bounds[i + 1]):
                value = (value + self.hashes[k]) * np.uint64(_BASE)
            out[bounds[i]] = value[0]
        return mixed(out, seed=size), bounds


def blocks(texts: list[bytes | None]) -> Iterator[tuple[int, Words]]:
    """The texts as blocks of words, each with the place of its first text."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text or b"") > BLOCK_BYTES:
            yield start, Words(texts[start:i])
            start, held = i, 0
        held += len(text or b"")
    if start < len(texts):
        yield start, Words(texts[start:])
