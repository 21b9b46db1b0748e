"""Removal of passages that an earlier document holds, by relative Lempel-Ziv parsing.

The corpus is cut into reference blocks of whole documents. Each block indexes its sequences of
``window`` words; the indexes of all blocks meet bucket by bucket, dealt by sequence hash, and each
block learns for each of its sequences the earliest document that holds it and where. A document is
then factored from left to right: the look-up at a word gives a source, and the words themselves,
not their hashes, are compared along that source in the block that holds it. The first look-up of
each stretch of sequences that occur earlier takes its whole stretch along, so a copy of a whole
document is one factor. Where a source breaks off another look-up begins, and the sequences that cross
the boundary are looked up as well. Of all factors found the parse takes, at each boundary, the one that
reaches furthest, until every word of every earlier sequence is under one.

Later look-ups take their own stretch and as many words again, so what travels stays a small
multiple of the words that are copied. Source blocks that many ask are given to several tasks.

Indexing every sequence would move more than the text. A first exchange moves seeds only: the
least hash of the shorter word sequences within a window. Two equal windows have equal seeds, so a
window whose seed occurs once is in no other document and is not indexed. Sequences meet by 96 bits of
hash; a chance match of these never removes a word, since words are compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwork.llm.common import columns, stash, stash_buckets
from tillwork.llm.words import Words, grams, mix, pieces, scan, whole

BLOCK_BYTES = 1 << 20  # of text in a reference block
BUCKET_BYTES = 8 << 20  # of text whose index entries meet in one bucket
ASKED_BYTES = 32 << 20  # of copied text that one task compares with its source block
DEALT_BYTES = 64 << 20  # of text whose blocks one task works through, one at a time
_SECOND = np.uint64(0xD6E8FEB86659FD93)  # sets the second hash of a sequence apart from the first
SEED_BYTES = 5  # of a seed that are compared; a chance match costs a look-up, no more
NO_ID = np.iinfo(np.int64).min  # a null id, smaller than any other
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_ZSTD) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(table: pa.Table) -> pa.Table:
    """The rows of a block by document id and text, null first: words have the same place in every reading."""
    rows = pa.concat_tables([pa.ipc.open_stream(b.as_buffer()).read_all() for b in table.column("packed")])
    keys = [("doc_id", "ascending"), ("text", "ascending")]
    return rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_start"))


def _seeds(hashes: np.ndarray, size: int, window: int) -> np.ndarray:
    """For each window, the least hash of the ``size`` word sequences in it, spread evenly."""
    short = grams(hashes, size)
    n = len(hashes) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    least = short[:n].copy()
    for j in range(1, window - size + 1):
        np.minimum(least, short[j:j + n], out=least)
    return mix(least)


def _as_bytes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def _seed_bytes(seeds: np.ndarray) -> bytes:
    return _as_bytes(seeds.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SEED_BYTES])


def _read_seeds(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SEED_BYTES, 8), np.uint8)
    out[:, :SEED_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, SEED_BYTES)
    return out.view("<u8")[:, 0]


def _joined(table: pa.Table, name: str) -> bytes:
    return b"".join(x.as_py() for x in table.column(name))


def _by(group: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of a sorted array."""
    cut = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        if b > a:
            yield int(group[a]), slice(a, b)


def _ids(block: pa.Table) -> np.ndarray:
    return np.asarray(block.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NO_ID))


class _Block:
    """The windows of a block's documents, sorted by document id and place."""

    def __init__(self, block: pa.Table, window: int):
        self.words: Words = scan(block.column("text").combine_chunks())
        self.hashes = self.words.hashes()
        self.at = np.flatnonzero(whole(self.words.first, window))
        self.hash = grams(self.hashes, window)[self.at]
        self.row = self.words.rows()[self.at]
        self.doc = _ids(block)[self.row]
        self.window = window

    def second(self) -> np.ndarray:
        """32 further bits of each hash."""
        return (grams(mix(self.hashes ^ _SECOND), self.window)[self.at] >> np.uint64(32)).astype("<u4")


def _exchange(docs: DataFrame, window: int, seed: int, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """The packed blocks, and for each block the sequences that an earlier document holds."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = size // BLOCK_BYTES + 1, size // BUCKET_BYTES + 1
    placed = docs.withColumn("__block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                block = np.asarray(part.column("__block"))
                order = np.argsort(block, kind="stable")
                rows = part.select(names)
                out = [(b, _packed(rows.take(pa.array(order[s])))) for b, s in _by(block[order])]
                yield pa.record_batch([pa.array([b for b, _ in out], pa.int32()),
                                       pa.array([x for _, x in out], pa.binary())], ["block", "packed"])

    def offer_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                words = scan(part.column("text"))
                seeds = _seeds(words.hashes(), seed, window)
                ok = whole(words.first, window)
                block = np.asarray(part.column("__block"))[words.rows()[:len(ok)][ok]].astype(np.uint64)
                seeds, low = seeds[ok], np.uint64((1 << 8 * SEED_BYTES) - 1)
                bucket = (seeds >> np.uint64(8 * SEED_BYTES)) % np.uint64(buckets)
                order = np.lexsort((seeds, block, bucket))
                s, b, k = (seeds & low)[order], block[order], bucket[order]
                new = np.r_[True, (s[1:] != s[:-1]) | (b[1:] != b[:-1]) | (k[1:] != k[:-1])][:len(s)]
                s, b, k = s[new], b[new].astype("<u4"), k[new]
                out = [(i, _seed_bytes(s[r]), _as_bytes(b[r])) for i, r in _by(k)]
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int32()),
                                       *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2))],
                                      ["bucket", "seeds", "blocks"])

    def meet_seeds(table: pa.Table) -> pa.Table:
        s, b = _read_seeds(_joined(table, "seeds")), np.frombuffer(_joined(table, "blocks"), "<u4")
        order = np.argsort(s, kind="stable")
        s, b = s[order], b[order]
        same = s[1:] == s[:-1]
        shared = np.r_[False, same] | np.r_[same, False]
        s, b = s[shared], b[shared]
        order = np.argsort(b, kind="stable")
        out = [(i, _seed_bytes(s[order][r])) for i, r in _by(b[order])]
        return pa.table([pa.array([i for i, _ in out], pa.int32()),
                         pa.array([x for _, x in out], pa.binary())], ["block", "seeds"])

    def offer_windows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names_out = ["bucket", "block", "hashes", "seconds", "docs", "spots"]
        empty = pa.table([pa.array([], pa.int32())] * 2 + [pa.array([], pa.binary())] * 4, names_out)
        index = _Block(_unpacked(texts), window)
        low = np.uint64((1 << 8 * SEED_BYTES) - 1)
        seeds = (_seeds(index.hashes, seed, window) & low)[index.at]
        order = np.lexsort((index.doc, seeds))
        s, d = seeds[order], index.doc[order]
        again = (s[1:] == s[:-1]) & (d[1:] != d[:-1])  # in two documents of this block
        known = np.unique(np.r_[_read_seeds(_joined(answers, "seeds")), s[1:][again]])
        if not len(known):
            return empty
        spot = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
        found = np.flatnonzero(known[spot] == seeds)
        first = np.sort(np.unique(index.hash[found], return_index=True)[1])
        found = found[first]  # of equal sequences, the earliest in the block
        bucket = index.hash[found] % np.uint64(buckets)
        found = found[np.argsort(bucket, kind="stable")]
        second = index.second()
        out = [(k, _as_bytes(index.hash[found[r]]), _as_bytes(second[found[r]]), _as_bytes(index.doc[found[r]]),
                _as_bytes(index.at[found[r]].astype("<u4")))
               for k, r in _by(index.hash[found] % np.uint64(buckets))]
        here = texts.column("block")[0].as_py()
        return pa.table([pa.array([x[0] for x in out], pa.int32()), pa.array([here] * len(out), pa.int32()),
                         *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3, 4))], names_out)

    def meet_windows(table: pa.Table) -> pa.Table:
        h, h2 = (np.frombuffer(_joined(table, c), t) for c, t in (("hashes", np.uint64), ("seconds", "<u4")))
        d = np.frombuffer(_joined(table, "docs"), np.int64)
        p = np.frombuffer(_joined(table, "spots"), "<u4")
        b = np.repeat(np.asarray(table.column("block")), [len(x.as_buffer()) // 8 for x in table.column("hashes")])
        order = np.lexsort((p, b, d, h2, h))
        h, h2, d, p, b = h[order], h2[order], d[order], p[order], b[order]
        run = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])][:len(h)]
        head = np.flatnonzero(run)[np.cumsum(run) - 1] if len(h) else np.empty(0, np.int64)
        later = d > d[head]
        owner, asker = head[later], b[later]
        order = np.argsort(asker, kind="stable")
        own, owner, asker = p[later][order], owner[order], asker[order]
        out = [(i, _as_bytes(own[r]), _as_bytes(b[owner[r]].astype("<u4")), _as_bytes(p[owner[r]])) for i, r in _by(asker)]
        return pa.table([pa.array([x[0] for x in out], pa.int32()),
                         *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2, 3))],
                        ["block", "asked", "homes", "spots"])

    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * BLOCK_BYTES // DEALT_BYTES + 1)
    packed = stash_buckets(placed.mapInArrow(pack, "block int, packed binary"), "blocks", "block", dealt)
    seeds = placed.select("text", "__block").mapInArrow(offer_seeds, "bucket int, seeds binary, blocks binary")
    shared = stash(seeds.groupBy("bucket").applyInArrow(meet_seeds, "block int, seeds binary"), "seeds")
    offered = packed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        offer_windows, "bucket int, block int, hashes binary, seconds binary, docs binary, spots binary")
    owners = offered.groupBy("bucket").applyInArrow(
        meet_windows, "block int, asked binary, homes binary, spots binary")
    return packed, stash(owners, "owners")


_ASKED = np.dtype([("row", "<i4"), ("start", "<i4"), ("length", "<i4"), ("spot", "<u4")])
_FACTOR = np.dtype([("row", "<i4"), ("start", "<i4"), ("length", "<i4"), ("source_start", "<i4"), ("source", "<i8")])


def _stretches(index: _Block, earlier: np.ndarray, home: np.ndarray, spot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The look-ups of a block: their source blocks, and what each asks for.

    A look-up begins wherever the earliest place does not go on in step. The first one of a run of
    sequences that occur earlier asks for the whole run, others for their own words and as many again.
    """
    copied = np.flatnonzero(earlier)
    if not len(copied):
        return np.empty(0, np.int64), np.empty(0, _ASKED)
    near = (np.diff(index.at[copied]) == 1) & (np.diff(index.row[copied]) == 0)
    step = near & (np.diff(spot[copied]) == 1) & (np.diff(home[copied]) == 0)
    begin, end = copied[np.r_[True, ~step]], copied[np.r_[~step, True]]
    leads = np.r_[True, ~near][np.r_[True, ~step]]
    run_end = index.at[copied[np.r_[~near, True]]][np.cumsum(leads) - 1] + index.window
    start, stop = index.at[begin], index.at[end] + index.window
    stop = np.where(leads, run_end, np.minimum(run_end, 2 * stop - start))
    asked = np.empty(len(begin), _ASKED)
    asked["row"], asked["start"], asked["length"] = index.row[begin], start, stop - start
    asked["spot"] = spot[begin]
    return home[begin], asked


def _agreeing(ours: bytes, theirs: bytes, length: int, window: int) -> list[tuple[int, int]]:
    """Runs (first word, words) of at least ``window`` words in which two word sequences agree."""
    if ours == theirs:
        return [(0, length)]
    runs, since = [], None
    for i, same in enumerate([*(x == y for x, y in zip(ours.split(b" "), theirs.split(b" "))), False]):
        if same and since is None:
            since = i
        elif not same and since is not None:
            if i - since >= window:
                runs.append((since, i - since))
            since = None
    return runs


def _longer(found: np.ndarray) -> np.ndarray:
    """Factors that go on along one source, overlapping or end to end, as one."""
    if not len(found):
        return found
    along = found["source_start"] - found["start"]
    order = np.lexsort((found["start"], along, found["source"], found["row"]))
    found, along = found[order], along[order]
    out = [found[0].copy()]
    for i in range(1, len(found)):
        last, this = out[-1], found[i]
        if (this["row"] == last["row"] and this["source"] == last["source"] and along[i] == along[i - 1]
                and this["start"] <= last["start"] + last["length"]):
            last["length"] = max(last["length"], this["start"] + this["length"] - last["start"])
        else:
            out.append(this.copy())
    return np.array(out, _FACTOR)


def _parse(found: np.ndarray) -> np.ndarray:
    """From left to right, at each boundary the factor that begins there or before and reaches furthest.

    The words under the factors taken are the words under all of them.
    """
    found = _longer(found)
    found = found[np.lexsort((found["source"], -found["length"], found["start"], found["row"]))]
    rows, starts = found["row"].tolist(), found["start"].tolist()
    ends = (found["start"] + found["length"]).tolist()
    taken, i = [], 0
    row, reach = -1, -1
    while i < len(rows):
        if rows[i] != row or starts[i] > reach:
            row, best = rows[i], i
            i += 1
        else:
            best = None
            while i < len(rows) and rows[i] == row and starts[i] <= reach:
                if ends[i] > (reach if best is None else ends[best]):
                    best = i
                i += 1
            if best is None:
                continue
        taken.append(best)
        reach = ends[best]
    return found[taken]


def _verified(packed: DataFrame, owners: DataFrame, window: int) -> DataFrame:
    """The factors of each block, every one compared with its source word by word."""
    def ask(texts: pa.Table, answers: pa.Table) -> pa.Table:
        index, here = _Block(_unpacked(texts), window), texts.column("block")[0].as_py()
        _, first, which = np.unique(index.hash, return_index=True, return_inverse=True)
        spot, home, copied = index.at[first], np.full(len(first), here, np.int64), index.doc > index.doc[first][which]
        told = which[np.searchsorted(index.at, np.frombuffer(_joined(answers, "asked"), "<u4"))]
        home[told] = np.frombuffer(_joined(answers, "homes"), "<u4")
        spot[told] = np.frombuffer(_joined(answers, "spots"), "<u4")
        earlier = np.zeros(len(first), bool)  # some other block holds it in an earlier document
        earlier[told] = True
        homes, asked = _stretches(index, copied | earlier[which], home[which], spot[which])
        text, a, b = index.words.joined(index.words.data)
        order = np.argsort(homes, kind="stable")
        out = []
        for source, r in _by(homes[order]):
            some = asked[order[r]]
            stop = b[some["start"] + some["length"] - 1].tolist()
            words = [text[x:y] for x, y in zip(a[some["start"]].tolist(), stop)]
            some["start"] -= index.words.first[some["row"]].astype(np.int32)
            out.append((source, some.tobytes(), words, sum(map(len, words))))
        kinds = [pa.int32(), pa.binary(), pa.list_(pa.binary()), pa.int64()]
        cells = [pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)]
        return pa.table([pa.array([here] * len(out), pa.int32()), *cells], ["asker", "block", "asked", "words", "size"])

    def compare(texts: pa.Table, spans: pa.Table) -> pa.Table:
        block = _unpacked(texts)
        words, ids = scan(block.column("text").combine_chunks()), _ids(block)
        text, a, b = words.joined(words.data)
        out = []
        for raw, ours in zip(spans.column("asked"), spans.column("words")):
            asked = np.frombuffer(raw.as_buffer(), _ASKED)
            row = np.searchsorted(words.first, asked["spot"], "right") - 1
            stop = np.minimum(asked["spot"] + asked["length"].astype(np.int64), words.first[row + 1])
            start = asked["spot"] - words.first[row]
            cells = zip(asked.tolist(), ours.as_py(), a[asked["spot"]].tolist(), b[stop - 1].tolist(),
                        start.tolist(), ids[row].tolist())
            out.append(np.array([(r, s + i, n, at + i, source) for (r, s, length, _), x, y, z, at, source in cells
                                 for i, n in _agreeing(x, text[y:z], length, window)], _FACTOR).tobytes())
        return pa.table([spans.column("asker").combine_chunks(), pa.array(out, pa.binary())], ["block", "factors"])

    spans = stash(packed.groupBy("block").cogroup(owners.groupBy("block")).applyInArrow(
        ask, "asker int, block int, asked binary, words array<binary>, size bigint"), "spans", "zstd")
    parts = F.ceil(F.sum("size") / ASKED_BYTES).cast("int")
    load = stash(spans.groupBy("block").agg(F.greatest(parts, F.lit(1)).alias("parts")), "load")  # Spark sees its size
    dealt = spans.join(load, "block").withColumn("part", F.pmod("asker", "parts"))
    sources = packed.join(load.toDF("asked_block", "copies"), F.col("block") == F.col("asked_block")).select(
        F.col("block").alias("home"), "packed", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    sources = sources.repartition("home", "copy")  # the copies of a block go to tasks of their own
    by_home, by_asker = sources.groupBy("home", "copy"), dealt.groupBy("block", "part")
    return stash(by_home.cogroup(by_asker).applyInArrow(compare, "block int, factors binary"), "factors")


def parse(docs: DataFrame, window: int = 13, seed: int = 8, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row with what earlier documents hold of it.

    ``doc_id``; ``n_words``; ``n_removed``: words under factors; ``kept_sha256``: of the words
    kept, joined by one space; ``factors``: array of (first word, number of words, source
    document, first word there), in order, each equal to its source word by word; neighbours may overlap; ``kept_text``: the text without
    these words and the white space behind each. The columns named in ``keep`` follow as
    keep_0, keep_1 and so on.

    A sequence counts as held before only if a document with a smaller id has it; a null id
    is smaller than any other. Rows that repeat an id do not count against each other. A null
    text has no words and its ``kept_text`` is null. No rows give no rows.
    """
    kinds, seed = {f.name: f.dataType for f in docs.schema}, min(seed, window)
    named = columns(docs, id_col, text_col, *keep).toDF("doc_id", "text", *(f"keep_{i}" for i in range(len(keep))))
    names = named.columns
    packed, owners = _exchange(named, window, seed, names)
    factor = "array<struct<start:int,length:int,source:bigint,source_start:int>>"
    schema = T.StructType.fromDDL(f"doc_id {kinds[id_col].simpleString()}, n_words long, n_removed long, "
                                  f"kept_sha256 string, factors {factor}, kept_text string")
    for i, c in enumerate(keep):
        schema = schema.add(f"keep_{i}", kinds[c])

    def factor_block(texts: pa.Table, answers: pa.Table) -> pa.Table:
        block = _unpacked(texts)
        words = scan(block.column("text").combine_chunks())
        found = _parse(np.frombuffer(_joined(answers, "factors"), _FACTOR))
        begin = words.first[found["row"]] + found["start"]

        cover = np.zeros(len(words.starts) + 1, np.int32)
        np.add.at(cover, begin, 1)
        np.subtract.at(cover, begin + found["length"], 1)
        kept = np.cumsum(cover[:-1]) == 0
        cut = np.r_[0, np.cumsum(~kept)]
        removed = np.diff(cut[words.first])
        text, a, b = words.joined(words.data, kept)
        taken = np.flatnonzero(kept)
        first_taken = np.searchsorted(taken, words.first)
        sha, left = [], []
        original = block.column("text").combine_chunks()
        drop = np.zeros(len(words.data) + 1, np.int32)
        row_end = _row_ends(original)
        after = np.minimum(np.r_[words.starts[1:], len(words.data)], row_end[words.rows()])
        np.add.at(drop, words.starts[~kept], 1)
        np.subtract.at(drop, after[~kept], 1)
        stays = np.cumsum(drop[:-1]) == 0
        edges = np.r_[0, row_end]
        for r in range(block.num_rows):
            some = taken[first_taken[r]:first_taken[r + 1]]
            sha.append(hashlib.sha256(text[a[some[0]]:b[some[-1]]] if len(some) else b"").hexdigest())
            if removed[r]:
                span = slice(edges[r], edges[r + 1])
                left.append(words.data[span][stays[span]].tobytes().decode())
            else:
                left.append(original[r].as_py())
        per_row = np.bincount(found["row"], minlength=block.num_rows)
        source = pa.array(found["source"], mask=found["source"] == NO_ID)
        parts = [pa.array(np.ascontiguousarray(found[c])) for c in ("start", "length", "source_start")]
        flat = pa.StructArray.from_arrays([*parts[:2], source, parts[2]], ["start", "length", "source", "source_start"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per_row)].astype(np.int32)), flat)
        return pa.table([block.column("doc_id").combine_chunks(), pa.array(words.counts.astype(np.int64)),
                         pa.array(removed.astype(np.int64)), pa.array(sha), lists, pa.array(left, pa.string()),
                         *(block.column(c).combine_chunks() for c in names[2:])], schema.names)

    factors = _verified(packed, owners, window)
    return packed.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(factor_block, schema)


def _row_ends(texts: pa.Array) -> np.ndarray:
    return np.cumsum(np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64))


def drop_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                 length_col: str = "n_chars") -> DataFrame:
    """The documents, all columns, without passages that an earlier document holds.

    A document of which nothing is left goes; one without words stays as it is.
    """
    rest = tuple(c for c in docs.columns if c not in (id_col, text_col))
    parsed = parse(docs, window, id_col=id_col, text_col=text_col, keep=rest)
    left = parsed.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    length = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema[length_col].dataType)) if length_col in rest else None
    out = {id_col: F.col("doc_id"), text_col: F.col("kept_text")}
    out |= {c: F.coalesce(length, f"keep_{i}") if c == length_col else F.col(f"keep_{i}") for i, c in enumerate(rest)}
    return left.select(*[out[c].alias(c) for c in docs.columns])
