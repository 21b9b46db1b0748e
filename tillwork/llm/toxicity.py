"""Toxicity by multiple-instance learning.

Only documents are labelled. Each sentence gets a probability from hashed words and word
beginnings; a document is toxic if any sentence is: 1 - product of (1 - p), the noisy-or. The
weights of the sentence model are fitted through the noisy-or to the documents' labels, sparse by
an absolute penalty, so that what is learned are the few words that make a sentence toxic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import columns
from tillwork.llm.hashedtext import Bags, folded_words, from_blob, places, prefix, segment_sums, sigmoid, to_blob
from tillwork.llm.words import Words, pieces

DIM = 1 << 18
SAMPLE = 8000  # labelled documents on which the model is fitted
MIN_DOCS = 3  # a place is used if so many of them have it
PENALTY, STEP, ROUNDS, START = 2e-4, 20.0, 100, -6.0
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


def _sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word of each sentence (and the end), and the row of each; none without words."""
    row = words.rows()
    part = np.cumsum(_STOP[words.data])[words.starts] if len(words.starts) else words.starts
    new = np.r_[True, (np.diff(part) != 0) | (np.diff(row) != 0)][:len(part)]
    return np.r_[np.flatnonzero(new), len(part)], row[new]


def _places(words: Words) -> np.ndarray:
    return places([words.hashes(), prefix(words, 4).hashes(), prefix(words, 6).hashes()], DIM)


def fit_weights(texts: list[pa.Array], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of the sentence model, from documents and their labels."""
    parts, rows, n = [], [], 0
    for piece in texts:
        words = folded_words(piece)
        first, row = _sentences(words)
        parts.append((_places(words), first))
        rows.append(row + n)
        n += len(piece)
    bags, row = Bags.of(parts, DIM), np.concatenate(rows)
    bags.value[:] = 1
    of_doc = np.searchsorted(row, np.arange(n + 1))
    share = np.full(n, 1 / max(n, 1))
    used = bags.rows_with(row) >= MIN_DOCS

    def loss_and_slope(w, b):
        z = bags.times(w) + b
        burden = np.maximum(segment_sums(np.logaddexp(0, z), of_doc), 1e-12)
        loss = np.where(toxic, -np.log(-np.expm1(-burden)), burden) @ share
        slope = np.where(toxic, -1 / np.expm1(np.minimum(burden, 700)), 1.0) * share
        return loss + PENALTY * np.abs(w).sum(), slope[row] * sigmoid(z)

    w, b, step = np.zeros(DIM), START, STEP
    ahead, ahead_b, pace = w, b, 1.0
    best = (np.inf, w, b)
    for _ in range(ROUNDS):  # accelerated proximal steps
        loss, slope = loss_and_slope(ahead, ahead_b)
        if loss > 1.05 * best[0]:  # overshot: back to the best point, without momentum and with shorter steps
            _, w, b = best
            ahead, ahead_b, pace, step = w, b, 1.0, step / 2
            loss, slope = loss_and_slope(ahead, ahead_b)
        if loss < best[0]:
            best = (loss, ahead, ahead_b)
        new = ahead - step * bags.back(slope)
        new = np.where(used, np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0), 0)
        new_b = ahead_b - 0.05 * step * slope.sum()
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        k = (pace - 1) / next_pace
        ahead, ahead_b, pace = new + k * (new - w), new_b + k * (new_b - b), next_pace
        w, b = new, new_b
    _, w, b = min(best, (loss_and_slope(w, b)[0], w, b), key=lambda x: x[0])
    return w, b


def fit(docs: DataFrame, labels: DataFrame, eligible: Column, sample: int = SAMPLE, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, float]:
    """The model, fitted in one task on at most ``sample`` labelled documents, the first by hash of their id.

    ``eligible``: condition on ``doc_id`` that a row to learn from meets. Without labelled rows
    every score is near 0.
    """
    known = columns(labels, id_col, label_col).toDF("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.filter(eligible).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    taken = named.join(F.broadcast(known), "doc_id").select("text", "toxic")

    def train(table: pa.Table) -> pa.Table:
        batches = [p for batch in table.to_batches() for p in pieces(batch, "text")]
        toxic = np.concatenate([np.asarray(b.column("toxic").cast(pa.int64())) for b in batches]) > 0
        w, b = fit_weights([p.column("text") for p in batches], toxic)
        return pa.table([pa.array([to_blob(w)]), pa.array([b])], ["weights", "bias"])

    model = taken.withColumn("one", F.lit(1)).groupBy("one").applyInArrow(train, "weights binary, bias double").first()
    return (from_blob(model["weights"]), model["bias"]) if model else (np.zeros(DIM), START)


def score_texts(texts: pa.Array, weights: np.ndarray, bias: float) -> tuple[np.ndarray, list[str | None], np.ndarray]:
    """Score of each text, its worst sentence and that sentence's score."""
    words = folded_words(texts)
    at = _places(words) if len(words.starts) else np.empty((1, 0), np.int32)
    first, row = _sentences(words)
    z = np.full(len(row), float(bias))
    kind, word = np.nonzero(weights[at])  # few places have a weight
    sentence = np.searchsorted(first, word, "right") - 1
    key = np.unique(sentence * DIM + at[kind, word])
    np.add.at(z, key // DIM, weights[key % DIM])
    of_doc = np.searchsorted(row, np.arange(len(texts) + 1))
    burden = segment_sums(np.logaddexp(0, z), of_doc)
    empty = np.diff(of_doc) == 0
    burden[empty] = np.logaddexp(0, bias)  # as one sentence without words
    worst, top = [None] * len(texts), np.full(len(texts), sigmoid(np.array([bias]))[0])
    original = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(original.buffers()[1], np.int64)[original.offset:original.offset + len(original) + 1]
    raw = np.frombuffer(original.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    for r in np.flatnonzero(~empty):
        s = of_doc[r] + int(np.argmax(z[of_doc[r]:of_doc[r + 1]]))
        worst[r] = raw[words.starts[first[s]]:words.ends[first[s + 1] - 1]].tobytes().decode(errors="replace")
        top[r] = sigmoid(z[s:s + 1])[0]
    return -np.expm1(-burden), worst, top


def toxicity(docs: DataFrame, labels: DataFrame, buckets: int = 5, held_out: int = 0, threshold: float = 0.5,
             sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, ``sentence``, ``sentence_score``: one row per input row.

    The model learns from labelled documents whose crc32 of the id as text, modulo ``buckets``,
    is not ``held_out``; nothing but text enters a score. ``sentence`` is the most offending
    sentence of a document predicted toxic, else null. A null or wordless text is scored as
    one empty sentence; a null id is not held out; repeated rows each give a row. A document
    with several labels is toxic if one says so. No rows give no rows.
    """
    bucket = F.crc32(F.col("doc_id").cast("string")) % buckets
    weights, bias = fit(docs, labels, bucket != held_out, sample, id_col, text_col, label_col)
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                score, worst, top = score_texts(part.column("text"), model.value, bias)
                hit = score >= threshold
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array(hit.astype(np.int32)),
                     pa.array([w if h else None for w, h in zip(worst, hit)], pa.string()), pa.array(top)],
                    ["doc_id", "held_out", "score", "predicted", "sentence", "sentence_score"])

    named = columns(docs, id_col, text_col).toDF("doc_id", "text").withColumn(
        "held_out", F.coalesce(bucket == held_out, F.lit(False)))
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int, sentence string, sentence_score double")
