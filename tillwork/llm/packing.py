"""Packing of tokenised documents into sequences of bounded length.

Documents longer than a sequence are cut. Pieces are dealt evenly into groups of bounded size,
each packed on its own: first by the dominance reduction of Martello and Toth, which fixes
small sets of pieces that some best packing must contain and so shrinks the group, then best
fit in order of falling length for what is left. A group wastes no more than its last
sequences, so many small groups lose little against one.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwork.llm.common import columns, stash
from tillwork.llm.tokens import Merges
from tillwork.llm.words import pieces

GROUP_PIECES = 1 << 16  # packed together in one task
KNOWN = 300_000  # words whose ids a worker remembers; then it begins anew
_LETTER, _DIGIT, _SIGN, _LINE = range(4)
_KIND = np.full(256, _SIGN, np.uint8)  # of the bytes of plain words in lower case
_KIND[[*range(97, 123), *range(128, 256)]], _KIND[48:58], _KIND[10] = _LETTER, _DIGIT, _LINE


class Tokenizer:
    """Ids of texts as the library gives them, each different word encoded once.

    Holds for vocabularies whose pre-tokens never reach over ASCII white space and do not
    depend on it. Words of Latin letters, digits and ASCII signs without an apostrophe, for which
    lower case, composition and cutting are plain, are cut and merged together as
    arrays, many times faster than one by one; all other words go to the library.
    """

    PLAIN = regex.compile(r"[\x21-\x26\x28-\x7eÀ-ÖØ-öø-ÿ]+")
    #: Fixed value: how the vocabulary cuts words.
    CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer as Library
        self.library = Library.from_str(spec)
        parsed = json.loads(spec)
        steps = [s.get("type") for s in (parsed["normalizer"] or {}).get("normalizers", [])]
        cut = (parsed["pre_tokenizer"].get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        if steps != ["NFC", "Replace", "Lowercase"] or cut != self.CUT:
            raise ValueError("this vocabulary cuts text in another way")
        self.merges = Merges(parsed)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        plain, others = [], []
        for w in words:
            ok = w and "<|" not in w and "'" not in w and (w.isprintable() if w.isascii() else self.PLAIN.fullmatch(w))
            (plain if ok else others).append(w)
        raw = np.frombuffer("\n".join(plain).lower().encode(), np.uint8)
        kind = _KIND[raw]
        new = np.r_[True, (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)][:len(raw)]  # a digit is cut off alone
        begin = np.flatnonzero(new)
        size, line = np.diff(np.r_[begin, len(raw)]), kind[begin] == _LINE
        ids, n = self.merges.symbols(raw[kind != _LINE], size[~line])
        per_word = np.bincount(np.cumsum(line)[~line], n, len(plain)).astype(np.int64)
        rest = [e.ids for e in self.library.encode_batch(others, add_special_tokens=False)]
        for word in (*plain, *others):
            self.place[word] = len(self.place)
        self.size = np.concatenate([self.size, per_word, np.array([len(i) for i in rest], np.int64)])
        self.ids = np.concatenate([self.ids, ids, np.array([x for i in rest for x in i], np.int64)]).astype(np.int32)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and the number of ids of each text."""
        if len(self.place) > KNOWN:
            self._forget()
        words = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = words.flatten().dictionary_encode()
        different = coded.dictionary.to_pylist()
        self._learn([w for w in different if w not in self.place])
        at = np.fromiter(map(self.place.__getitem__, different), np.int64, len(different))[np.asarray(coded.indices)]
        begin = (np.cumsum(self.size) - self.size)[at]
        length = self.size[at]
        upto = np.r_[0, np.cumsum(length)]
        ids = self.ids[np.arange(upto[-1]) + np.repeat(begin - upto[:-1], length)]
        first = np.r_[0, np.cumsum(np.asarray(pc.list_value_length(words)))]
        return ids, np.diff(upto[first])


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, limit: int = 4096, id_col: str = "doc_id",
                  text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``limit`` ids: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``.

    A document is the ids of its text and ``end_id``; a null text is empty. With ``with_ids``
    a column ``ids`` holds the ids themselves.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokenizer(spec.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                ids, size = encode(part.column("text"))
                whole = np.insert(ids, np.cumsum(size), end_id).astype("<u4")
                size = size + 1
                n = -(-size // limit)
                row = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(limit, size[row] - piece * limit)
                at = (np.cumsum(size) - size)[row] + piece * limit
                chunks = [whole[a:a + k] for a, k in zip(at.tolist(), length.tolist())]
                out = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(piece * limit),
                       pa.array(length), pa.array([zlib.crc32(c.tobytes()) for c in chunks], pa.int64())]
                if with_ids:
                    out.append(pa.array([c.astype(np.int32) for c in chunks], pa.list_(pa.int32())))
                yield pa.record_batch(out, names)

    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return named.mapInArrow(run, schema)


class _Sizes:
    """Pieces not yet placed, by size; a bit set tells which sizes there are."""

    def __init__(self, sizes: np.ndarray):
        self.held: dict[int, list[int]] = {}
        for i in np.argsort(sizes, kind="stable")[::-1].tolist():
            self.held.setdefault(int(sizes[i]), []).append(i)
        self.bits = sum(1 << s for s in self.held)

    def take(self, size: int) -> int:
        stack = self.held[size]
        item = stack.pop()
        if not stack:
            del self.held[size]
            self.bits ^= 1 << size
        return item

    def count(self, size: int) -> int:
        return len(self.held.get(size, ()))

    def below(self, size: int, without: dict[int, int]) -> int:
        """The largest size up to ``size`` that is there, ``without`` some pieces; 0 if none."""
        bits = self.bits
        for s, k in without.items():
            if self.count(s) <= k:
                bits &= ~(1 << s)
        return max(0, (bits & ((2 << size) - 1)).bit_length() - 1) if size > 0 else 0

    def two_above(self, size: int, without: dict[int, int]) -> int | None:
        """Sum of the two smallest pieces larger than ``size``; None if there are not two."""
        bits = self.bits >> size + 1 << size + 1
        found = []
        while bits and len(found) < 2:
            s = (bits & -bits).bit_length() - 1
            found += [s] * min(2, self.count(s) - without.get(s, 0))
            bits &= bits - 1
        return sum(found[:2]) if len(found) > 1 else None

    def least_three(self, without: dict[int, int]) -> int | None:
        bits, found = self.bits, []
        while bits and len(found) < 3:
            s = (bits & -bits).bit_length() - 1
            found += [s] * min(3, self.count(s) - without.get(s, 0))
            bits &= bits - 1
        return sum(found[:3]) if len(found) > 2 else None


def dominating(left: _Sizes, j: int, capacity: int) -> list[int] | None:
    """Sizes that may be fixed with a piece of size j, or None if no small set provably dominates.

    ``[k]`` dominates if k fills the rest, or if nothing that fits beside j is more than k in
    one piece or two; ``[k, b]`` dominates if any two that fit can be exchanged for k and b.
    Three more pieces must not fit unless k fills the rest.
    """
    room, own = capacity - j, {j: 1}
    k = left.below(room, own)
    if not k:
        return []
    if k == room:
        return [k]
    three = left.least_three(own)
    if three is not None and three <= room:
        return None
    pair = left.two_above(0, own)
    if pair is None or pair > room:
        return [k]
    used = {j: 1 + (k == j)} if k == j else {j: 1, k: 1}
    b = left.below(min(k, room - k), used)
    rival = left.two_above(b, own)  # two pieces of which the smaller is larger than b
    if rival is None or rival > room:
        return [k, b] if b else [k]
    return None


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each piece, and how many bins the reduction fixed."""
    if len(sizes) and (sizes.min() < 1 or sizes.max() > capacity):
        raise ValueError("a piece must have between 1 and capacity ids")
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    left, bins = _Sizes(sizes), 0
    changed = True
    while changed and left.held:
        changed = False
        for j in sorted(left.held, reverse=True):
            while left.count(j):
                fixed = dominating(left, j, capacity)
                if fixed is None:
                    break
                at = 0
                for s in (j, *fixed):
                    i = left.take(s)
                    bin_of[i], offset[i] = bins, at
                    at += s
                bins += 1
                changed = True
    reduced = bins
    open_bins: dict[int, list[int]] = {}
    bits = 0
    for size in sorted(left.held, reverse=True):
        for i in left.held[size]:
            fits = bits >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                b = open_bins[room].pop()
                if not open_bins[room]:
                    bits ^= 1 << room
            else:
                room, b, bins = capacity, bins, bins + 1
            bin_of[i], offset[i] = b, capacity - room
            rest = room - size
            if rest:
                open_bins.setdefault(rest, []).append(b)
                bits |= 1 << rest
    return bin_of, offset, reduced


def pack_pieces(cut: DataFrame, limit: int = 4096) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that are already written.

    Pieces are dealt to groups in turn, without a key, so that repeated rows and frequent
    lengths spread evenly.
    """
    groups = -(-cut.count() // GROUP_PIECES) or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if rows is None:
            return
        group = TaskContext.get().partitionId()
        bin_of, offset, _ = pack(np.asarray(rows.column("length")), limit)
        rows = rows.append_column("sequence_id", pa.array((np.int64(group) << 32) + bin_of))
        yield from rows.append_column("offset", pa.array(offset)).to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return cut.repartition(groups).mapInArrow(run, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, limit: int = 4096, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id``, ``offset``.

    Pieces of a sequence lie end to end from offset 0. A null or empty text is a document of
    ``end_id`` alone; repeated rows are packed each; null ids are kept. No rows give no rows.
    """
    cut = stash(cut_documents(docs, vocabulary, end_id, limit, id_col, text_col, with_ids), "pieces")
    return pack_pieces(cut, limit)
