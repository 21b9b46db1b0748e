"""Quality by ordinal regression on graded ratings.

A cumulative-link model: one score per text, a mean of hashed text weights shared by all grades,
and ordered thresholds; P(grade <= k) = sigmoid(threshold k - score). It gives the expected grade and
the probability of reaching a grade, by which documents are selected. Features are words, the
shapes of their beginnings and endings, and whether a word repeats the one before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import columns
from tillwork.llm.hashedtext import (
    Bags, descend, folded, from_blob, places, prefix, segment_sums, sigmoid, suffix, to_blob,
)
from tillwork.llm.words import Words, pieces, scan

DIM = 1 << 16
SAMPLE = 8000  # rated documents on which the model is fitted
MIN_DOCS = 4
SCALE, RATE, ROUNDS, RIDGE = 20.0, 0.05, 150, 1e-5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[[*range(97, 123), *range(128, 256)]] = ord("a")
_SHAPE[65:91], _SHAPE[48:58] = ord("A"), ord("0")


def _places(words: Words) -> np.ndarray:
    shape = Words(_SHAPE[words.data], words.starts, words.ends, words.first)
    word = Words(folded(words.data), words.starts, words.ends, words.first).hashes()
    again = np.r_[False, word[1:] == word[:-1]][:len(word)]
    again[words.first[:-1][words.first[:-1] < len(word)]] = False
    begin = prefix(shape, 2).hashes()
    return places([word, begin * np.uint64(3) + again.astype(np.uint64), suffix(shape, 3).hashes()], DIM)


def thresholds(raw: np.ndarray) -> np.ndarray:
    """Ordered thresholds from free numbers: the first, then logarithms of the steps."""
    return np.cumsum(np.r_[raw[:1], np.exp(raw[1:])])


def fit_weights(texts: list[pa.Array], grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds from texts and their grades 0 .. grades - 1."""
    parts = []
    for piece in texts:
        words = scan(piece)
        parts.append((_places(words), words.first))
    bags = Bags.of(parts, DIM)
    used = np.bincount(bags.col, minlength=DIM) >= MIN_DOCS
    bags.value *= (SCALE / np.maximum(segment_sums(bags.value, bags.first), 1))[bags.row].astype(np.float32)
    n = len(grade)

    def slope(p):
        cut = np.r_[-np.inf, thresholds(p[DIM:]), np.inf]
        score = bags.times(p[:DIM])
        upper, lower = sigmoid(cut[grade + 1] - score), sigmoid(cut[grade] - score)
        mass = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / mass / n, lower * (1 - lower) / mass / n
        by_cut = np.bincount(grade, -up, grades)[:-1] + np.bincount(grade, down, grades)[1:]
        by_raw = np.cumsum(by_cut[::-1])[::-1] * np.r_[1.0, np.exp(p[DIM + 1:])]
        return np.r_[np.where(used, bags.back(up - down) + RIDGE * p[:DIM], 0), by_raw]

    reached = np.clip(np.cumsum(np.bincount(grade, minlength=grades))[:-1] / max(n, 1), 1e-3, 1 - 1e-3)
    first = np.log(reached / (1 - reached))
    start = np.r_[np.zeros(DIM), first[:1], np.log(np.maximum(np.diff(first), 1e-2))]
    p = descend(slope, start, RATE, ROUNDS)
    return p[:DIM], thresholds(p[DIM:])


def fit(docs: DataFrame, ratings: DataFrame, eligible: Column, grades: int, sample: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The model, fitted in one task on at most ``sample`` rated documents, the first by hash of their id.

    ``ratings``: ``doc_id`` and ``grade``. Without rated rows every grade is equally likely.
    """
    known = ratings.filter("doc_id IS NOT NULL AND grade IS NOT NULL").filter(eligible).groupBy("doc_id").agg(
        F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    taken = named.join(F.broadcast(known), "doc_id").select("text", "grade")  # bounded, so it may be broadcast

    def train(table: pa.Table) -> pa.Table:
        batches = [p for b in table.to_batches() for p in pieces(b, "text")]
        grade = np.concatenate([np.asarray(b.column("grade")) for b in batches]).astype(np.int64)
        w, cut = fit_weights([p.column("text") for p in batches], grade, grades)
        return pa.table([pa.array([to_blob(w)]), pa.array([cut.tolist()], pa.list_(pa.float64()))], ["weights", "cuts"])

    model = taken.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(train, "weights binary, cuts array<double>").first()
    if model is None:
        even = np.arange(1, grades) / grades
        return np.zeros(DIM), np.log(even / (1 - even))
    return from_blob(model["weights"]), np.array(model["cuts"])


def reach(texts: pa.Array, weights: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """For each text, the probabilities of reaching grade 1, 2 and so on."""
    words = scan(texts)
    at = _places(words) if len(words.starts) else np.empty((3, 0), np.int32)
    total = segment_sums(weights[at].sum(0), words.first)
    score = total * SCALE / np.maximum(3 * words.counts, 1)
    return 1 - sigmoid(cuts[None, :] - score[:, None])


def grade(docs: DataFrame, ratings: DataFrame, grades: int = 3, wanted: int = 1, min_tail: float = 0.5,
          buckets: int = 5, held_out: int = 1, sample: int = SAMPLE, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``expected_grade``, ``tail``, ``kept``: one row per input row.

    ``tail``: the probability of grade ``wanted`` or better; a document is kept if that is
    at least ``min_tail``. Learns from ``ratings`` (``doc_id``, ``grade`` from 0) whose crc32 of the id
    as text, modulo ``buckets``, is not ``held_out``; nothing but text enters a score. A
    document with several ratings has the lowest. A null or wordless text has score 0; a null
    id is not held out; repeated rows each give a row. No rows give no rows.
    """
    bucket = F.crc32(F.col("doc_id").cast("string")) % buckets
    weights, cuts = fit(docs, ratings, bucket != held_out, grades, sample, id_col, text_col)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                tails = reach(part.column("text"), model.value, cuts)
                tail = tails[:, wanted - 1]
                yield pa.record_batch([part.column("doc_id"), part.column("held_out"), pa.array(tails.sum(1)),
                                       pa.array(tail), pa.array(tail >= min_tail)],
                                      ["doc_id", "held_out", "expected_grade", "tail", "kept"])

    named = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn(
        "held_out", F.coalesce(bucket == held_out, F.lit(False)))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, held_out boolean, expected_grade double, tail double, kept boolean")
