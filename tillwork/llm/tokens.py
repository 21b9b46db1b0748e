"""Token counts by rank-synchronous byte-pair merging over ragged numpy arrays.

Texts are cut into pre-tokens; the different pre-tokens of a batch not met before lie end to
end in one array of symbols. In each step every sequence applies its pair of lowest rank, all
sequences at once and all places of that pair at once; a sequence without a known pair is
done, and the symbols that it has left are its tokens.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tillwork.llm.common import columns
from tillwork.llm.words import pieces

KNOWN = 400_000  # pre-tokens whose counts a worker remembers; then it begins anew
NEVER = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The merge rules of a BPE vocabulary over byte letters, as sorted arrays."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix"):
            raise ValueError("not a byte-level BPE vocabulary")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = max(vocab.values()) + 1
        self.of_byte, self.of_last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.of_byte[byte], self.of_last[byte] = vocab[letter], vocab[letter + end]
        key = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = [t["content"] for t in spec["added_tokens"]]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], NEVER)

    def symbols(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pre-tokens end to end, and how many each has.

        ``raw``: the bytes of the pre-tokens end to end; ``size``: how many each has, none of them 0.
        """
        owner = np.repeat(np.arange(len(size)), size)
        sym = self.of_byte[raw]
        last = np.cumsum(size) - 1
        sym[last] = self.of_last[raw[last]]
        rank = np.full(len(sym), NEVER, np.int32)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(sym[:-1], sym[1:]), NEVER)
        ready, ready_owner = [], []
        while len(sym):
            begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            length = np.diff(np.r_[begin, len(sym)])
            lowest = np.minimum.reduceat(rank, begin)
            low = np.repeat(lowest, length)
            done = low == NEVER
            ready.append(sym[done])
            ready_owner.append(owner[done])
            if done.all():
                break
            hit = np.flatnonzero((rank == low) & ~done)
            run = np.r_[True, np.diff(hit) != 1]  # in a chain such as aaa every other place merges
            chain = np.flatnonzero(run)[np.cumsum(run) - 1]
            hit = hit[(np.arange(len(hit)) - chain) % 2 == 0]
            sym[hit] = self.made[rank[hit]]
            stay = ~done
            stay[hit + 1] = False
            place = np.cumsum(stay) - 1
            sym, rank, owner = sym[stay], rank[stay], owner[stay]
            hit = place[hit]
            for at in (hit, hit[hit > 0] - 1):
                right = np.minimum(at + 1, len(sym) - 1)
                inside = (at + 1 < len(sym)) & (owner[at] == owner[right])
                rank[at] = np.where(inside, self.ranks(sym[at], sym[right]), NEVER)
        owner = np.concatenate(ready_owner) if ready else owner
        sym = (np.concatenate(ready) if ready else sym)[np.argsort(owner, kind="stable")]
        return sym, np.bincount(owner, minlength=len(size))

    def counts(self, tokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token."""
        size = np.array([len(t) for t in tokens], np.int64)
        return self.symbols(np.frombuffer(b"".join(tokens), np.uint8), size)[1]


def byte_level(path: str) -> Merges:
    """The rules of a vocabulary without normaliser that cuts by the usual byte-level pattern."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]
    if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level vocabulary")
    return Merges(spec)


class Counter:
    """Tokens of texts; remembers the counts of pre-tokens."""

    def __init__(self, merges: Merges):
        space = r"\p{White_Space}"
        self.pattern = regex.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|{space}+(?!\P{{White_Space}})|{space}+")
        self.special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None
        self.merges, self.known = merges, {}

    def __call__(self, texts: list[str]) -> list[int]:
        if len(self.known) > KNOWN:
            self.known.clear()
        cut, extra = [], []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            extra.append(len(parts) - 1)
            cut.append([t for p in parts for t in self.pattern.findall(p)])
        new = list({t for tokens in cut for t in tokens if t not in self.known})
        if new:
            self.known.update(zip(new, self.merges.counts([t.encode() for t in new]).tolist()))
        of = self.known.__getitem__
        return [sum(map(of, tokens)) + more for tokens, more in zip(cut, extra)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens``, ``over_limit``: one row per input row.

    ``vocabulary``: path of a byte-level BPE tokenizer file, read on the driver. Strings of its
    special tokens inside a text count as that one token. A null or empty text has no bytes
    and no tokens; repeated rows each give a row; no rows give none.
    """
    merges = docs.sparkSession.sparkContext.broadcast(byte_level(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(merges.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = counter(texts)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    named = columns(docs, id_col, text_col).toDF("doc_id", "text")
    kind = named.schema["doc_id"].dataType.simpleString()
    return named.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
