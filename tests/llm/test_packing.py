import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tillwork.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def fewest(sizes, capacity):
    """The fewest bins, by search."""
    best = len(sizes)

    def place(i, room):
        nonlocal best
        if len(room) >= best:
            return
        if i == len(sizes):
            best = len(room)
            return
        for b in {r: j for j, r in enumerate(room) if r >= sizes[i]}.values():
            room[b] -= sizes[i]
            place(i + 1, room)
            room[b] += sizes[i]
        place(i + 1, room + [capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def check(sizes, capacity):
    bin_of, offset, reduced = packing.pack(np.array(sizes), capacity)
    for b in range(bin_of.max(initial=-1) + 1):
        inside = sorted((offset[i], sizes[i]) for i in np.flatnonzero(bin_of == b))
        assert inside and [o for o, _ in inside] == [sum(s for _, s in inside[:k]) for k in range(len(inside))]
        assert sum(s for _, s in inside) <= capacity
    return int(bin_of.max(initial=-1)) + 1, reduced, bin_of


@pytest.mark.parametrize("seed", range(60))
def test_reduction_is_part_of_a_best_packing(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice((20, 30, 50))
    sizes = [rnd.randrange(capacity // rnd.choice((3, 5, 10)), capacity + 1) for _ in range(rnd.randrange(1, 11))]
    bins, reduced, bin_of = check(sizes, capacity)
    rest = [s for s, b in zip(sizes, bin_of) if b >= reduced]
    assert reduced + fewest(rest, capacity) == fewest(sizes, capacity)


def test_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.minimum(4096, rng.lognormal(6.2, 1.1, 20000).astype(int) + 1)
    bins, reduced, _ = check(sizes.tolist(), 4096)
    assert bins <= np.ceil(sizes.sum() / 4096) * 1.002 and reduced > 0
    with pytest.raises(ValueError):
        packing.pack(np.array([0, 3]), 4)


def test_ids_match_the_library(library):
    rnd = random.Random(4)
    odd = ["a", " ", "  ", "\n", "'s", "É", "ß", "Ж", "中", "🙂", "12", "²", "़", "\x1c", "\x85", "​", "　", "\xa0", "!", "<|endoftext|>",
           "<|startoftext|>", "THE", "ing", "é", "́", "İ", "ΑΣ", "\x0b", "ﬁ", "a'Re", "𝔘"]
    texts = ["".join(rnd.choice(odd) for _ in range(rnd.randrange(40))) for _ in range(3000)] + ["", None, "x" * 5000]
    latin = [*map(chr, range(33, 127)), *map(chr, range(0xC0, 0x100)), "'s", "'LL", "the", "ing", "12", " "]
    texts += ["".join(rnd.choice(latin) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    encode = packing.Tokenizer(open(PATH).read())
    ids, size = encode(pa.array(texts))
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert size.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def brute(library, rows, limit):
    out = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k, start in enumerate(range(0, len(ids), limit)):
            part = ids[start:start + limit]
            out.append((str(i), k, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out)


def test_whole_table(spark, sf_dir, library, monkeypatch):
    from tillwork.llm.common import table
    monkeypatch.setattr(packing, "GROUP_PIECES", 90)
    docs = table(spark, sf_dir, "documents")
    got = packing.pack_documents(docs, PATH).collect()
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(library, rows, 4096)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096


def test_awkward_rows(awkward, nothing, library):
    got = packing.pack_documents(awkward, PATH, limit=100, with_ids=True).collect()
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == brute(library, rows, 100)
    assert all(len(r.ids) == r.length for r in got)
    assert packing.pack_documents(nothing, PATH).count() == 0
