import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tillwork.llm import tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
MERGES = tokens.byte_level(PATH)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def library_counts(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


ODD = ["a", " ", "  ", "\n", "\t", "'s", "'re", "é", "ß", "Ж", "中", "🙂", "1", "²", "़", "\x1c", "\x85", "​", "　", "\xa0",
       "!", "<|endoftext|>", "<|endof", "the", "ing", "\x00", "ٱ", "Ⅷ", "_", "\r\n", " ", "aaa"]


def test_matches_the_library(library):
    rnd = random.Random(2)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randrange(60))) for _ in range(4000)]
    texts += ["a" * 3001, "!" * 2000, " " * 999, "ab" * 700, "".join(rnd.choice("abcdefgh") for _ in range(20000))]
    assert tokens.Counter(MERGES)(texts) == library_counts(library, texts)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    from tokenizers import Tokenizer
    if not hasattr(test_any_text, "library"):
        test_any_text.library = Tokenizer.from_file(PATH)
    assert tokens.Counter(MERGES)([text]) == library_counts(test_any_text.library, [text])


def test_memory_of_pretokens_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "KNOWN", 5)
    counter, texts = tokens.Counter(MERGES), ["one two three four five six seven", "eight nine one two", "ten"]
    assert [counter([t])[0] for t in texts] == library_counts(library, texts)
    assert len(counter.known) <= 8


def test_whole_table(spark, sf_dir, library):
    from tillwork.llm.common import table
    docs = table(spark, sf_dir, "documents")
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, PATH).collect()}
    rows = docs.select("doc_id", "text").collect()
    want = library_counts(library, [r.text for r in rows])
    assert got == {r.doc_id: (len(r.text.encode()), n, n > 1024) for r, n in zip(rows, want)}


def test_awkward_rows(awkward, nothing, library):
    got = tokens.token_counts(awkward, PATH, limit=4).collect()
    assert len(got) == 12
    by_id = {r.doc_id: r for r in got}
    assert (by_id[1].n_bytes, by_id[1].n_tokens, by_id[1].over_limit) == (0, 0, False)
    for r in awkward.collect():
        assert by_id[r.doc_id].n_tokens == library_counts(library, [r.text or ""])[0]
    assert tokens.token_counts(nothing, PATH).count() == 0
    assert np.array_equal(MERGES.counts([]), np.zeros(0))
