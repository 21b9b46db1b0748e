"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of equal texts are collapsed first; links are sought between different
fingerprints. The 64 bits are dealt into partitions, correlated bits together. If the
thresholds of m partitions add up to ``max_bits - m + 1``, any two fingerprints that differ
in at most ``max_bits`` bits differ in at most t bits within some partition of threshold t
(-1: the partition is left out). How many partitions, and which threshold each gets, is
found by dynamic programming over estimated candidate counts, so the search stays exact
whatever the plan. A fingerprint is filed under its partition with every choice of t bits
blanked; fingerprints filed together are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import columns, stash
from tillwork.llm.components import roots
from tillwork.llm.words import Words, mix, pieces, scan

BITS = 64
SAMPLE = 3000  # fingerprints from which candidate counts are estimated; plans differ, results do not
FILING_COST = 60.0  # of one filed row, in comparisons
SHORT_RUN = 64  # fingerprints under one key that are compared pair by pair
DENSE_RUN = 2048  # beyond this a run is split by further bits
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# Fingerprints ---------------------------------------------------------------------------

def _shingle_bounds(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, last word and row of each shingle; a shorter row is one shingle."""
    counts = words.counts
    n = np.where(counts == 0, 0, np.maximum(counts - size + 1, 1))
    row = np.repeat(np.arange(len(counts)), n)
    first = words.first[:-1][row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return first, first + np.minimum(size, counts[row]) - 1, n


def fingerprint_array(texts: pa.Array, size: int, seed: int) -> np.ndarray:
    """64-bit fingerprints of texts, zero where a text has no word."""
    words = scan(texts)
    out = np.zeros(len(texts), np.uint64)
    if not len(words.starts):
        return out
    text, begin, end = words.joined(_LOWER[words.data])
    first, last, n = _shingle_bounds(words, size)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(text[b:e], seed) for b, e in zip(begin[first].tolist(), end[last].tolist())), np.uint64, len(first))
    some = np.flatnonzero(n)
    at = (np.cumsum(n) - n)[some]
    for lo in range(0, len(some), 256):  # a few texts' bits at once
        rows = some[lo:lo + 256]
        a, b = at[lo], at[lo] + n[rows].sum()
        bits = np.unpackbits(hashes[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, at[lo:lo + 256] - a, axis=0, dtype=np.int64)
        out[rows] = np.packbits(2 * ones > n[rows][:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``fp``, one row per input row; the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                fp = fingerprint_array(part.column("text"), size, seed).view(np.int64)
                yield pa.record_batch([part.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    return named.mapInArrow(run, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, fp long")


# Plan -----------------------------------------------------------------------------------

def group_bits(sample: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m partitions of nearly equal width, correlated bits together."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float)
    bits -= bits.mean(0)
    norm = np.sqrt((bits**2).sum(0)) + 1e-9
    near = np.abs(bits.T @ bits) / np.outer(norm, norm)
    free, groups = set(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [max(free, key=lambda b: (sum(near[b, c] for c in free), -b))]
        free.discard(group[0])
        while len(group) < width:
            nxt = max(free, key=lambda b: (sum(near[b, c] for c in group), -b))
            group.append(nxt)
            free.discard(nxt)
        groups.append(sorted(group))
    return groups


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _shares(sample: np.ndarray, groups: list[list[int]], top: int) -> list[list[float]]:
    """For each partition and t: the estimated share of pairs that differ in t bits of it or fewer.

    The larger of what the sample's pairs show and what independent bits would give.
    """
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    differ = 2 * bits.mean(0) * (1 - bits.mean(0))
    out = []
    for group in groups:
        part = sample & np.uint64(_mask(group))
        seen = np.zeros(BITS + 1)
        for i in range(0, len(part), 256):
            far = np.bitwise_count(part[i:i + 256, None] ^ part[None, :])
            seen += np.bincount(far.ravel(), minlength=BITS + 1)
        seen[0] -= len(part)
        chance = np.array([1.0])
        for b in group:
            chance = np.convolve(chance, [1 - differ[b], differ[b]])
        pairs = max(1, len(part) * (len(part) - 1))
        out.append([max(float(seen[:t + 1].sum()) / pairs, float(chance[:t + 1].sum())) for t in range(top + 1)])
    return out


def plan(sample: np.ndarray, n: int, max_bits: int) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, those left out omitted: the cheapest for n fingerprints."""
    best, best_cost = [], np.inf
    for m in range(2, max_bits + 2):
        groups = group_bits(sample, m)
        shares = _shares(sample, groups, max_bits)
        room = max_bits + 1  # thresholds plus one, added up over the partitions
        cost, choice = [0.0] + [np.inf] * room, [[-1] * m for _ in range(room + 1)]
        for i, group in enumerate(groups):
            new, picked = [np.inf] * (room + 1), [None] * (room + 1)
            for used in range(room + 1):
                for t in range(-1, min(max_bits, len(group) - 1, used - 1) + 1):
                    here = 0.0 if t < 0 else n * comb(len(group), t) * FILING_COST + n * n / 2 * shares[i][t] * comb(len(group), t) ** 0.5
                    if cost[used - t - 1] + here < new[used]:
                        new[used] = cost[used - t - 1] + here
                        picked[used] = choice[used - t - 1][:i] + [t] + [-1] * (m - i - 1)
            cost, choice = new, picked
        if cost[room] < best_cost:
            best_cost = cost[room]
            best = [(g, t) for g, t in zip(groups, choice[room]) if t >= 0]
    return best


def blanks(thresholds: list[tuple[list[int], int]]) -> list[int]:
    """The masks under which a fingerprint is filed."""
    return [_mask(set(group) - set(gone)) for group, t in thresholds for gone in combinations(group, t)]


# Links ----------------------------------------------------------------------------------

def _spanning(v: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what links within distance would; v: different fingerprints."""
    if len(v) > DENSE_RUN:
        varying = int(np.bitwise_or.reduce(v ^ v[0]))
        bits = [b for b in range(BITS) if varying >> b & 1]
        if len(bits) <= max_bits:
            yield np.full(len(v) - 1, v[0]), v[1:]
            return
        for i in range(max_bits + 1):  # two that are near agree in one of these blocks
            part = v & np.uint64(_mask(bits[i::max_bits + 1]))
            order = np.argsort(part, kind="stable")
            cut = np.flatnonzero(np.diff(part[order])) + 1
            for run in np.split(v[order], cut):
                if len(run) > 1:
                    yield from _spanning(run, max_bits)
        return
    left = v
    while len(left) > 1:  # take all that one fingerprint reaches, then go on with the rest
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found = left[near]
                yield np.full(len(found), x), found
                front.extend(found)
                left = left[~near]


def _run_links(key: np.ndarray, fp: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints with equal keys; keys are sorted."""
    cut = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
    size = np.diff(cut)
    for i in np.flatnonzero(size > SHORT_RUN):
        yield from _spanning(np.unique(fp[cut[i]:cut[i + 1]]), max_bits)
    short = np.repeat(size <= SHORT_RUN, size)
    key, fp = key[short], fp[short]
    for d in range(1, min(SHORT_RUN, len(key))):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        a, b = fp[:-d][same], fp[d:][same]
        far = np.bitwise_count(a ^ b)
        near = (far <= max_bits) & (far > 0)
        yield a[near], b[near]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Of these links, as many as connect the same nodes."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kept = ([], [])
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept[0].append(x)
            kept[1].append(y)
    return kept


def near_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints that differ in ``max_bits`` bits or fewer.

    ``fps``: different fingerprints in a column ``fp``, already written. Not every close
    pair is returned, but the same groups are connected.
    """
    n = fps.count()
    if n < 2:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    taken = fps if n <= SAMPLE else fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE)
    sample = np.array([r.fp for r in taken.collect()], np.int64).view(np.uint64)
    masks = np.array(blanks(plan(sample, n, max_bits)), np.uint64)
    tags = mix(np.arange(1, len(masks) + 1, dtype=np.uint64))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column("fp")).view(np.uint64)
            for i, m in enumerate(masks):
                key = mix((fp & m) + tags[i])
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links(key, fp):
            found = list(_run_links(key, fp, max_bits))
            if not found:
                return
            a, b = _forest(*(np.concatenate([f[i] for f in found]).view(np.int64) for i in (0, 1)))
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:  # a run may go on in the next batch
            k, f = np.asarray(batch.column("key")), np.asarray(batch.column("fp")).view(np.uint64)
            if not len(k):
                continue
            held.append((k, f))
            if held[0][0][0] != k[-1]:
                key, fp = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                cut = int(np.searchsorted(key, key[-1]))
                yield from links(key[:cut], fp[:cut])
                held = [(key[cut:], fp[cut:])]
        if held:
            yield from links(*(np.concatenate([x[i] for x in held]) for i in (0, 1)))

    filed = fps.select("fp").mapInArrow(file, "key long, fp long")
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(masks) // 4_000_000 + 1)
    return filed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 4, max_bits: int = 4, seed: int = 42,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id``: one row per input row.

    ``component_id`` is the smallest document id reachable over links between fingerprints
    that differ in at most ``max_bits`` bits. A null or wordless text has fingerprint zero and
    is linked like any other; repeated rows each give a row; a null id is never the smallest
    unless a group has no other, when ``component_id`` is null. No rows give no rows.
    """
    marked = stash(fingerprints(docs, size, seed, id_col, text_col), "fingerprints")
    fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    tree = roots(near_links(fps, max_bits))
    rooted = fps.join(tree, fps.fp == tree.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, size: int = 4, max_bits: int = 4, seed: int = 42,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the smallest id of each group, all columns; repeated rows once.

    Rows that share this id and differ in any column all stay. A document with a null id stands in no
    group and stays.
    """
    found = near_duplicates(docs, size, max_bits, seed, id_col, text_col)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("kept_id")).distinct()
    once = docs.filter(docs[f"`{id_col}`"].isNotNull()).join(kept, docs[f"`{id_col}`"] == kept.kept_id, "left_semi")
    whole = once.withColumn("__row", F.xxhash64(*[once[f"`{c}`"] for c in docs.columns]))
    return whole.dropDuplicates([id_col, "__row"]).drop("__row").unionByName(docs.filter(docs[f"`{id_col}`"].isNull()))
