"""Alignment of two tokenizers over the same texts, as an Arrow pipeline.

Both token lists of a slice of documents are flattened with their parent indices; segmented
running sums of the token lengths give the byte at which each token ends in its document. An
Acero hash join on (document, end) finds the ends that both tokenizers share; these cut the
tokens into groups. Further joins and ``Table.group_by`` give the linked id pairs of each
document and a partial count per slice, which Spark merges over the corpus.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillwork.llm.common import columns, stash
from tillwork.llm.tokens import byte_letters
from tillwork.llm.words import pieces

SLICE_BYTES = 1 << 19  # of text aligned at once; a longer text is aligned alone
KNOWN = 400_000  # words whose ids a worker remembers; then it begins anew
UNIT = 32  # words handed to the encoders as one string
ID_BITS = 20  # an id pair is one long: first id, then the second in this many bits
# Both tokenizers end a token between a character that is no white space and a single space before another one.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACE = "▁"
_ROW_STEP = 1 << 36  # beyond the bytes of any text


_IDS = pa.list_(pa.int32())


class Tokenizers:
    """Both encoders and the bytes of their tokens, opened in the process that uses them."""

    def __init__(self, byte_level: bytes, pieces: bytes):
        import sentencepiece
        from tokenizers import Tokenizer
        self.first = Tokenizer.from_str(byte_level.decode())
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        letters = byte_letters()
        spec = json.loads(byte_level)
        vocab = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        names = [self.second.id_to_piece(i) for i in range(len(self.second))]
        if any(_SPACE in n.lstrip(_SPACE) for n in names if len(n) > 1):
            raise ValueError("pieces with a space behind another character would cross the cuts")
        self.bytes_of = [
            pa.array([vocab.get(i, b"") for i in range(max(vocab) + 1)], pa.large_binary()),
            pa.array([bytes([int(n[1:-1], 16)]) if self.second.is_byte(i) else n.replace(_SPACE, " ").encode()
                      for i, n in enumerate(names)], pa.large_binary())]
        self.length_of = [pc.binary_length(b) for b in self.bytes_of]

        self.known, self.lists = {}, [pa.array([], _IDS)] * 2

    def _ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """By both encoders the ids of all texts end to end, and how many each text has."""
        first = [e.ids for e in self.first.encode_batch_fast(texts, add_special_tokens=False)]
        second = self.second.encode([t[1:] for t in texts], num_threads=1)
        return [(np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int64)) for x in (first, second)]

    def _learn(self, words: list[str], alone: list[str]) -> None:
        """Remember the ids of ``words``, that may stand in one string, and of those to be encoded alone.

        A string is told apart again by the bytes of its tokens; where these do not meet the ends of its
        words, its words are encoded alone.
        """
        units = [words[i:i + UNIT] for i in range(0, len(words), UNIT)]
        size = np.array([len(u) for u in units], np.int64)
        unit = np.repeat(np.arange(len(units)), size)
        end = np.cumsum(np.asarray(pc.binary_length(pa.array(words, pa.large_string()))))
        start = np.r_[0, end][np.r_[0, np.cumsum(size)]]
        good, ids = np.ones(len(units), bool), []
        for (flat, n), length in zip(self._ids(["".join(u) for u in units]), self.length_of):
            widths = np.asarray(length.take(pa.array(flat)))
            told = np.cumsum(widths, dtype=np.int64)
            first = np.r_[0, np.cumsum(n)]
            before = np.r_[0, told][first]
            wanted = end + (before - start)[unit]
            at = np.searchsorted(told, wanted)
            missed = np.r_[told, -1][at] != wanted
            odd = np.bincount(unit, missed, len(units)) + np.bincount(np.repeat(np.arange(len(units)), n), widths == 0, len(units))
            good &= (np.diff(before) == np.diff(start)) & (odd == 0)
            ids.append((flat, np.diff(np.r_[0, at + 1])))
        if not good.all():
            kept = [w for u, g in zip(units, good) if g for w in u]
            return self._learn(kept, alone + [w for u, g in zip(units, good) if not g for w in u])
        self.known.update(zip(chain(words, alone), range(len(self.known), len(self.known) + len(words) + len(alone))))
        for side, ((flat, n), (more, m)) in enumerate(zip(ids, self._ids(alone))):
            offsets = pa.array(np.r_[0, np.cumsum(np.r_[n, m])], pa.int32())
            new = pa.ListArray.from_arrays(offsets, pa.array(np.r_[flat, more], pa.int32()))
            self.lists[side] = pa.concat_arrays([self.lists[side], new])

    def encode(self, words: list[str]) -> tuple[pa.Array, list[pa.Array]]:
        """Places of words that begin with their space, and by both encoders the ids at each place.

        The second encoder adds that space itself.
        """
        if len(self.known) > KNOWN:
            self.known, self.lists = {}, [pa.array([], _IDS)] * 2
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        joins = [not (w[1:2].isspace() or w[-1].isspace()) for w in new]  # a cut on both sides
        if new:
            self._learn([w for w, j in zip(new, joins) if j], [w for w, j in zip(new, joins) if not j])
        return pa.array(np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))), list(self.lists)


_opened: dict[str, Tokenizers] = {}


def tokenizers_of(files: tuple[bytes, bytes]) -> Tokenizers:
    """The encoders of a worker: opened once, so that its tasks share the words that it knows."""
    name = hashlib.sha256(b"".join(files)).hexdigest()
    if name not in _opened:
        _opened.clear()
        _opened[name] = Tokenizers(*files)
    return _opened[name]


def _flat(lists: pa.Array, codes: pa.Array, row_of: pa.Array, length_of: pa.Array, n: int) -> pa.Table:
    """Tokens of all documents end to end: their row, id and the byte at which they end in their document."""
    taken = lists.take(codes)
    ids = pc.list_flatten(taken)
    row = row_of.take(pc.list_parent_indices(taken))
    total = pc.cumulative_sum(length_of.take(ids))
    first = np.searchsorted(np.asarray(row), np.arange(n))
    before = pa.array(np.r_[0, np.asarray(total)][first])
    return pa.table({"row": row, "id": ids, "end": pc.subtract(total, before.take(row))})


def _same_bytes(tokens: pa.Table, bytes_of: pa.Array, texts: list[bytes]) -> np.ndarray:
    """Of each document, whether its tokens' bytes give it back."""
    joined = bytes_of.take(tokens["id"].combine_chunks())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
    data = memoryview(joined.buffers()[2] or b"")
    first = offsets[np.searchsorted(np.asarray(tokens["row"]), np.arange(len(texts) + 1))]
    return np.array([bytes(data[first[i]:first[i + 1]]) == t for i, t in enumerate(texts)], bool)


def _ends(tokens: pa.Table, name: str) -> pa.Table:
    """The key (document, end) of each token as one number, and the token's place."""
    key = np.asarray(tokens["row"]) * _ROW_STEP + np.asarray(tokens["end"])
    return pa.table({"key": key, name: np.arange(len(tokens))})


def _mark(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


def _pair(first: pa.Array, second: pa.Array) -> np.ndarray:
    return (np.asarray(first).astype(np.int64) << ID_BITS) + np.asarray(second)


def _listed(tokens: pa.Table, first: np.ndarray) -> pa.Array:
    """Ids of each group as text, joined by commas."""
    text = pc.cast(tokens["id"].combine_chunks(), pa.large_string())
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first, pa.int32()), text), _mark(","))


def align(texts: list[str], both: Tokenizers) -> tuple[pa.Table, pa.Table, list[str]]:
    """Of texts, none of them empty: a row per text, its linked id pairs, and its groups as text.

    The first table has n_a, n_b, n_groups, n_links; the second row, pair, times, where times is
    the number of linked occurrences.
    """
    n = len(texts)
    spaced = [" " + t for t in texts]
    words, first = [], [0]
    for text in spaced:
        words += _CUT.split(text)
        first.append(len(words))
    row_of = pa.array(np.repeat(np.arange(n), np.diff(first)))
    codes, lists = both.encode(words)
    sides = [_flat(x, codes, row_of, of, n) for x, of in zip(lists, both.length_of)]
    raw = [t.encode() for t in spaced]
    same = _same_bytes(sides[0], both.bytes_of[0], raw) & _same_bytes(sides[1], both.bytes_of[1], raw)
    if not same.all():
        kept = pa.array(same)
        sides = [s.filter(kept.take(s["row"].combine_chunks())) for s in sides]
    ends = _ends(sides[0], "a").join(_ends(sides[1], "b"), keys="key", join_type="inner", use_threads=False).sort_by("a")
    n_groups = len(ends)
    row_of_group = np.asarray(sides[0]["row"])[np.asarray(ends["a"])]
    firsts = [np.r_[0, np.asarray(ends[name]) + 1] for name in "ab"]  # both end with their last token
    groups = [np.repeat(np.arange(n_groups), np.diff(f)) for f in firsts]
    text = pc.binary_join_element_wise(*[_listed(s, f) for s, f in zip(sides, firsts)], _mark("|"))
    of_row = np.searchsorted(row_of_group, np.arange(n + 1))
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(of_row, pa.int32()), text), _mark(";"))
    alone = np.diff(firsts[0]) * np.diff(firsts[1]) == 1
    single = [s["id"].combine_chunks().filter(pa.array(alone[g])) for s, g in zip(sides, groups)]
    rest = [pa.table({"group": g, name: s["id"]}).filter(pa.array(~alone[g])).group_by(["group", name], use_threads=False)
            .aggregate([([], "count_all")]).rename_columns(["group", name, f"n_{name}"])
            for s, g, name in zip(sides, groups, "ab")]
    linked = rest[0].join(rest[1], keys="group", join_type="inner", use_threads=False)
    pair = np.r_[_pair(*single), _pair(linked["a"], linked["b"])]
    group = np.r_[np.flatnonzero(alone), np.asarray(linked["group"])]
    times = np.r_[np.ones(len(single[0]), np.int64), np.asarray(pc.multiply(linked["n_a"], linked["n_b"]))]
    links = pa.table({"row": row_of_group[group], "pair": pair, "times": times})
    links = links.group_by(["row", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(
        ["row", "pair", "times"]).sort_by([("row", "ascending"), ("pair", "ascending")])
    of_side = [np.bincount(np.asarray(s["row"]), minlength=n) for s in sides]
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, np.asarray(links["row"]), np.asarray(links["times"]))
    return pa.table({"n_a": of_side[0], "n_b": of_side[1], "n_groups": np.diff(of_row), "n_links": n_links}), links, text.to_pylist()


def _lists(values: np.ndarray, owner: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)), pa.int32()), pa.array(values, kind))


def _slice_rows(part: pa.RecordBatch, both: Tokenizers, number: int, schema: pa.Schema) -> pa.RecordBatch:
    """A row per document with its pairs as places in the slice's list, and a last row with that list."""
    texts = part.column("text").to_pylist()
    real = np.array([bool(t) for t in texts], bool)
    row_of, n = np.flatnonzero(real), len(texts)
    of_doc, links, text = align([t for t in texts if t], both)
    counted = links.group_by("pair", use_threads=False).aggregate([([], "count_all")])
    pair, n_docs = counted["pair"].combine_chunks(), counted["count_all"].combine_chunks()
    at = pc.index_in(links["pair"].combine_chunks(), pair)
    measures = []
    for name in ("n_a", "n_b", "n_groups", "n_links"):
        full = np.zeros(n + 1, np.int64)
        full[row_of] = np.asarray(of_doc[name])
        measures.append(pa.array(full))
    sha = [""] * (n + 1)
    for row, t in zip(row_of.tolist(), text):
        sha[row] = hashlib.sha256(t.encode()).hexdigest() if t else ""
    owner = row_of[np.asarray(links["row"])]
    last = np.full(len(pair), n)
    ids = pa.concat_arrays([part.column("doc_id"), pa.nulls(1, part.schema.field("doc_id").type)])
    return pa.record_batch([
        pa.array(np.full(n + 1, number)), pa.array(np.r_[np.arange(n), -1], pa.int32()), ids, *measures,
        pa.array(sha, schema.field("groups_sha256").type),
        _lists(np.asarray(at), owner, n + 1, pa.int32()), _lists(np.asarray(links["times"]), owner, n + 1, pa.int64()),
        _lists(np.asarray(pair), last, n + 1, pa.int64()), _lists(np.asarray(n_docs), last, n + 1, pa.int64()),
    ], schema.names)


def aligned(docs: DataFrame, byte_level: str, pieces_model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and one per slice of documents, written to the shared folder.

    ``slice`` numbers the slices. A document's row has ``place`` in its slice, n_a, n_b, n_groups,
    n_links, groups_sha256 and its linked pairs: ``at``, their places in the slice's list, and
    ``times``. The slice's own row has place -1, ``pairs`` and ``n_docs``, its documents with each.
    """
    spark = docs.sparkSession
    with open(byte_level, "rb") as f, open(pieces_model, "rb") as g:
        files = spark.sparkContext.broadcast((f.read(), g.read()))
    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    kind = named.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, number = tokenizers_of(files.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            schema = pa.schema([
                ("slice", pa.int64()), ("place", pa.int32()), ("doc_id", batch.schema.field("doc_id").type),
                ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                ("groups_sha256", pa.string()), ("at", pa.list_(pa.int32())), ("times", pa.list_(pa.int64())),
                ("pairs", pa.list_(pa.int64())), ("n_docs", pa.list_(pa.int64()))])
            for part in pieces(batch, "text", SLICE_BYTES):
                yield _slice_rows(part, both, number, schema)
                pa.default_memory_pool().release_unused()
                number += 1

    return stash(named.mapInArrow(run, (
        f"slice long, place int, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
        "at array<int>, times array<long>, pairs array<long>, n_docs array<long>")), "aligned")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair``, ``n``, ``best``: documents that hold each pair, and whether no pair of its first id is in more.

    A first id has no more pairs than the second vocabulary has ids, which bounds the window.
    """
    listed = rows.filter("place = -1").select(F.explode(F.arrays_zip("pairs", "n_docs")).alias("x"))
    counts = listed.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.n_docs").alias("n"))
    same_first = Window.partitionBy(F.shiftright("pair", ID_BITS))
    return counts.withColumn("best", F.col("n") == F.max("n").over(same_first))


def _score(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of each document of a slice."""
    pairs = pairs.sort_by("spot")
    at, times = docs["at"].combine_chunks(), docs["times"].combine_chunks()
    row, place, times = np.asarray(pc.list_parent_indices(at)), pc.list_flatten(at), pc.list_flatten(times)
    out = {}
    for name, value in (("n_best", pc.cast(pairs["best"], pa.int64())), ("count_sum", pairs["n"])):
        sums = np.zeros(len(docs), np.int64)
        np.add.at(sums, row, np.asarray(pc.multiply(value.combine_chunks().take(place), times)))
        out[name] = pa.array(sums)
    out = {**{c: docs[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, **out}
    return pa.table({**out, "groups_sha256": docs["groups_sha256"]})


def align_documents(docs: DataFrame, byte_level: str, pieces_model: str, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id``, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row per input row.

    The first tokenizer encodes the text behind one space, the second adds that space. Texts that are
    null or empty, and those whose tokens do not give their bytes back, have no tokens: zeros and an
    empty groups_sha256. Rows that repeat a document count as documents of their own; a null id is
    kept; ties for the highest count are all best; no rows give none. Memory follows the longest text.
    """
    rows = aligned(docs, byte_level, pieces_model, id_col, text_col)
    counts = pair_counts(rows)
    listed = rows.filter("place = -1").select(
        F.col("slice").alias("of_slice"), F.posexplode("pairs").alias("spot", "pair"))
    known = listed.join(counts, "pair").select("of_slice", "spot", "n", "best")
    kind = rows.schema["doc_id"].dataType.simpleString()
    of_docs = rows.filter("place >= 0").drop("pairs", "n_docs")
    return of_docs.groupBy("slice").cogroup(known.groupBy("of_slice")).applyInArrow(_score, (
        f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
