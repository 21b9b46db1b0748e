"""Hashed text features and the fitting of linear models on a bounded sample.

A text is a bag of features, a few for each word, hashed into a fixed number of places. The
score of a text, or of a part of it, is the mean or sum of the weights at its places, so that
applying a model is one pass over the text with no table of words.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa

from tillwork.llm.words import LETTERS, Words, mix, scan


def prefix(words: Words, n: int) -> Words:
    return Words(words.data, words.starts, np.minimum(words.ends, words.starts + n), words.first)


def suffix(words: Words, n: int) -> Words:
    return Words(words.data, np.maximum(words.starts, words.ends - n), words.ends, words.first)


def places(hashes: Sequence[np.ndarray], dim: int) -> np.ndarray:
    """Place of each feature: one row per kind of feature, one column per word."""
    return np.stack([(mix(h + np.uint64(k + 1)) % np.uint64(dim)).astype(np.int32) for k, h in enumerate(hashes)])


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; zero where there are none."""
    out = np.zeros((len(first) - 1, *values.shape[1:]))
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out


class Bags:
    """Rows of places as a sparse matrix: how often each place occurs in each row."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, dim: int):
        self.row, self.col, self.value, self.n, self.dim = row, col, value, n, dim
        self.first = np.searchsorted(row, np.arange(n + 1))

    @staticmethod
    def of(parts: Sequence[tuple[np.ndarray, np.ndarray]], dim: int) -> Bags:
        """From parts of (places, first word of each row), whose rows follow each other."""
        row, col, value, n = [], [], [], 0
        for at, first in parts:
            of_word = np.repeat(np.arange(len(first) - 1), np.diff(first))
            key, count = np.unique((of_word * dim + at).ravel(), return_counts=True)
            row.append((key // dim + n).astype(np.int32))
            col.append((key % dim).astype(np.int32))
            value.append(count.astype(np.float32))
            n += len(first) - 1
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        return Bags(join(row, np.int32), join(col, np.int32), join(value, np.float32), n, dim)

    def times(self, w: np.ndarray) -> np.ndarray:
        return segment_sums(self.value * w[self.col], self.first)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * g[self.row], minlength=self.dim)

    def rows_with(self, of_row: np.ndarray) -> np.ndarray:
        """For each place, in how many of the groups ``of_row`` it occurs."""
        key = np.unique(of_row[self.row].astype(np.int64) * self.dim + self.col)
        return np.bincount(key % self.dim, minlength=self.dim)


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rate: float, rounds: int) -> np.ndarray:
    """Adam with a rate that falls to zero."""
    w, m, v = start.astype(float), np.zeros(len(start)), np.zeros(len(start))
    for i in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * 0.5 * (1 + np.cos(np.pi * (i - 1) / rounds))
        w = w - step * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def to_blob(w: np.ndarray) -> bytes:
    return w.astype("<f4").tobytes()


def from_blob(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<f4").astype(float)


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the capitals of ASCII and Latin-1 made small, no byte moved."""
    out = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    latin = np.r_[False, data[:-1] == 0xC3][:len(data)] & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    out[latin] += 32
    return out


def folded_words(texts: pa.Array) -> Words:
    """Words of letters and digits, capitals made small."""
    words = scan(texts, LETTERS)
    return Words(folded(words.data), words.starts, words.ends, words.first)
