"""Words of a batch of texts as numpy arrays: where each begins, and 64-bit hashes of them.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; in UTF-8 these bytes never
occur inside another character, so the bounds found in bytes are those found in characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 4 << 20  # of text handled at once; a longer text is handled alone
HASHED_WORDS = 1 << 17  # words whose bytes are widened to 64 bits at once
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
LETTERS = np.zeros(256, bool)  # a word made of letters and digits only; bytes of other alphabets count as letters
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_OF_BYTE = np.random.default_rng(13).integers(1, 2**63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(batch: pa.RecordBatch, column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text each, or one row."""
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Words:
    """``starts[i]:ends[i]`` in ``data`` is word i; row r has words ``first[r]:first[r + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def joined(self, data: np.ndarray, keep: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Words of one text with one space between them, and where each word begins and ends.

        ``data``: the bytes to take, of the same length as those scanned. Only words of
        ``keep`` are taken; the places of others mean nothing.
        """
        starts, ends = (self.starts, self.ends) if keep is None else (self.starts[keep], self.ends[keep])
        mark = np.zeros(len(data) + 1, np.int8)  # each word and the white space byte behind it
        mark[starts] += 1
        mark[np.minimum(ends + 1, len(data))] -= 1
        taken = np.cumsum(mark[:-1], dtype=np.int8) > 0
        place = np.r_[0, np.cumsum(taken)]
        return np.where(_IS_WORD[data], data, np.uint8(32))[taken].tobytes(), place[self.starts], place[self.ends]

    def hashes(self) -> np.ndarray:
        out = np.empty(len(self.starts), np.uint64)
        for i in range(0, len(out), HASHED_WORDS):
            starts, length = self.starts[i:i + HASHED_WORDS], (self.ends - self.starts)[i:i + HASHED_WORDS]
            begin = np.cumsum(length) - length
            within = np.arange(length.sum()) - np.repeat(begin, length)
            power = np.cumprod(np.full(int(length.max()), _STEP | np.uint64(1)))
            value = _OF_BYTE[self.data[np.repeat(starts, length) + within]] * power[within]
            out[i:i + HASHED_WORDS] = np.add.reduceat(value, begin) + length.astype(np.uint64) * _STEP
        return mix(out)


def scan(texts: pa.Array, is_word: np.ndarray = _IS_WORD) -> Words:
    """The words of each text, runs of the given bytes; a null text has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before, after = np.r_[False, word[:-1]][:len(word)], np.r_[word[1:], False][:len(word)]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; sequences may run over the end of a text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _STEP + hashes[j:j + n]
    return mix(out)


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """For each position of ``grams``, whether its k words belong to one text."""
    n = int(first[-1]) - k + 1
    if n <= 0:
        return np.empty(0, bool)
    out = np.ones(n, bool)
    for j in range(1, k):  # the last k - 1 words of each text begin no sequence
        last = first[1:] - j
        last = last[(last >= first[:-1]) & (last < n)]
        out[last] = False
    return out
