import hashlib
import random
from collections import Counter, defaultdict, deque

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillwork.llm import alignment

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", " ", "  ", "\n", "\t", "'s", "é", "ß", "Ж", "中", "🙂", "1", "\x1c", "\x85", "▁", "　", "\xa0", "!", "<|endoftext|>",
       "<s>", "</s>", "<unk>", "<0x41>", "the", "ing", "\x00", "ٱ", "Ⅷ", "\r\n", "aaa", "123"]


@pytest.fixture(scope="module")
def library():
    """Plain encoders over whole texts, and the bytes of their tokens."""
    import sentencepiece
    from tokenizers import Tokenizer
    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    letters = alignment.byte_letters()

    def encode(text):
        a = [(i, bytes(letters[c] for c in first.id_to_token(i)))
             for i in first.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in second.encode(text):
            piece = second.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()))
        return a, b

    return encode


@pytest.fixture(scope="module")
def both():
    with open(A, "rb") as f, open(B, "rb") as g:
        return alignment.Tokenizers(f.read(), g.read())


def plain_groups(text, encode):
    """Groups as lists of ids, found end by end; no tokens if the bytes differ."""
    if not text:
        return []
    sides = encode(text)
    if any(b"".join(x for _, x in s) != (" " + text).encode() for s in sides):
        return []
    ends = []
    for s in sides:
        at, of = 0, deque()
        for i, x in s:
            at += len(x)
            of.append((at, i))
        ends.append(of)
    shared = sorted({e for e, _ in ends[0]} & {e for e, _ in ends[1]})
    groups = []
    for high in shared:
        group = []
        for of in ends:
            taken = []
            while of and of[0][0] <= high:
                taken.append(of.popleft()[1])
            group.append(taken)
        groups.append(tuple(group))
    return groups


def plain(rows, encode):
    groups = [(i, plain_groups(t, encode)) for i, t in rows]
    count, top = Counter(), defaultdict(int)
    for _, gs in groups:
        count.update({(a, b) for x, y in gs for a in x for b in y})
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for i, gs in groups:
        links = [(a, b) for x, y in gs for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        out.append((i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links),
                    sum(count[p] == top[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, row[1:])


def test_equals_a_plain_version_on_odd_texts(make_docs, library, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 300)
    rnd = random.Random(4)
    rows = [(i, "".join(rnd.choice(ODD) for _ in range(rnd.randrange(1, 30)))) for i in range(300)]
    rows += [(1000, "a" * 700), (1001, "ab " * 300), (1002, " " * 50), (1003, None), (1004, ""), (7, rows[7][1]), (None, "the end")]
    got = alignment.align_documents(make_docs(rows), A, B).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, library), key=key)


def test_awkward_and_empty(awkward, nothing, library):
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    got = alignment.align_documents(awkward, A, B).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(rows, library), key=key)
    assert alignment.align_documents(nothing, A, B).collect() == []


@settings(max_examples=150, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.text(min_size=1, max_size=40), min_size=1, max_size=4))
def test_groups_of_any_text(texts, library, both):
    assert alignment.align(texts, both)[2] == [
        ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in plain_groups(t, library)) for t in texts]


def test_whole_table_equals_a_plain_version(spark, sf_dir, library):
    from tillwork.llm.queries import op11_tokenizer_alignment
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = op11_tokenizer_alignment(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(plain([tuple(r) for r in docs], library))
