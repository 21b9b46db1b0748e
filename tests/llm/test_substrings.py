import hashlib
import random
import re

import pytest

from tillwork.llm import substrings


def plain(rows, window=13):
    """(n_words, n_removed, sha) of each (doc_id, text), straight from the definition."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            least[k] = min(least.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def sharing_texts(n=120, seed=5, vocabulary=200):
    rnd = random.Random(seed)
    words = [f"wörd{i}" for i in range(vocabulary)] + ["the", "of", "."]
    fresh = lambda k: [rnd.choice(words) for _ in range(k)]
    passages = [fresh(rnd.choice((12, 13, 14, 20, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        text = fresh(rnd.randrange(0, 80))
        for _ in range(rnd.randrange(4)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            text[(k := rnd.randrange(len(text) + 1)):k] = p if rnd.random() < 0.7 else p[a:] + p[:a]
        sep = rnd.choice([" ", "\n", "  ", "\t "])
        rows.append((i, sep.join(text)))
    rows += [(n + 1, rows[3][1]), (n + 2, rows[7][1]), (n + 3, rows[7][1]), (n + 4, "tick " * 40), (n + 5, "tick " * 30)]
    return rows


@pytest.mark.parametrize("block", [700, 1 << 20])
def test_matches_brute_force(make_docs, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 4 * block)
    rows = sharing_texts()
    got = substrings.parse(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain(rows)
    texts = dict(rows)
    for r in got:  # each factor is in its source, word for word
        words = texts[r.doc_id].split()
        for f in r.factors:
            assert f.source < r.doc_id and f.length >= 13
            source = texts[f.source].split()
            assert words[f.start:f.start + f.length] == source[f.source_start:f.source_start + f.length]
        assert hashlib.sha256(" ".join(r.kept_text.split()).encode()).hexdigest() == r.kept_sha256


def test_few_words_many_repeats(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 300)
    rows = sharing_texts(60, 8, vocabulary=2)
    got = substrings.parse(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain(rows)


def test_awkward_rows(awkward, nothing):
    rows = substrings.parse(awkward, window=3, seed=2).collect()
    assert len(rows) == 12
    of = lambda i: [r for r in rows if r.doc_id == i]
    assert of(1)[0].n_words == 0 and of(1)[0].kept_text is None and of(2)[0].kept_text == ""
    assert [r.n_removed for r in of(5)] == [0, 0] and of(6)[0].n_removed == 5 and of(6)[0].kept_text == ""
    assert of(4)[0].n_words == 60_000
    assert substrings.parse(nothing).count() == 0
    left = substrings.drop_repeats(awkward, window=3)
    assert left.columns == awkward.columns and left.dtypes == awkward.dtypes
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 5, 7, None, 8, 9, 10]))


def test_text_left_keeps_its_lines(make_docs):
    passage = " ".join(f"p{i}" for i in range(20))
    rows = [(1, passage), (2, f"Title\n\n{passage}\nand  more"), (3, passage)]
    left = {r.doc_id: r for r in substrings.drop_repeats(make_docs(rows)).collect()}
    assert left[2].text == "Title\n\nand  more" and left[2].n_chars == len(left[2].text)
    assert left[1].text == passage and 3 not in left


def spans_of(rows):
    return {r.doc_id: [tuple(f) for f in r.factors] for r in rows}


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_copy_of_a_document_is_one_factor(make_docs, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    old = " ".join(f"a{i}" for i in range(400))
    own = [f"b{i}" for i in range(40)]
    mixed = " ".join(own[:20] + old.split()[50:350] + own[20:])  # holds a long passage of document 1
    rows = [(1, old), (2, mixed), (3, mixed), (4, "new " + mixed + " end")]
    found = spans_of(substrings.parse(make_docs(rows)).collect())
    assert found[1] == [] and found[2] == [(20, 300, 1, 50)]
    assert found[3] == [(0, 340, 2, 0)] and found[4] == [(1, 340, 2, 0)]


def test_chance_matches_remove_no_word(make_docs, monkeypatch):
    """With hashes of six bits nearly every look-up is a chance match; only true copies go."""
    good = substrings.grams
    monkeypatch.setattr(substrings, "grams", lambda h, k: good(h, k) & substrings.np.uint64(63))
    rows = sharing_texts(40, 3)
    words = {i: t.split() for i, t in rows}
    truth = {i: n for i, _, n, _ in plain(rows)}
    for r in substrings.parse(make_docs(rows)).collect():
        assert r.n_removed <= truth[r.doc_id]
        for f in r.factors:
            assert words[r.doc_id][f.start:f.start + f.length] == words[f.source][f.source_start:f.source_start + f.length]


def test_source_asked_by_many_is_split(make_docs, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 400)
    monkeypatch.setattr(substrings, "ASKED_BYTES", 500)
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"x{i} {passage} y{i}") for i in range(80)]
    got = substrings.parse(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain(rows)
    assert all(f == ([(1, 30, 0, 1)] if i else []) for i, f in spans_of(got).items())


def test_one_id_with_different_texts(make_docs, monkeypatch):
    """A source is found by its place, not by its id."""
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 300)
    texts = [" ".join(f"t{k}_{i}" for i in range(25)) for k in range(6)]
    rows = [(1, t) for t in texts] + [(2, f"{texts[4]} {texts[1]}"), (2, texts[5])]
    got = substrings.parse(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == plain(rows)
    assert sum(r.n_removed for r in got if r.doc_id == 2) == 75
