import math
import random

import pytest

from tillwork.llm import mixing


def plain_targets(sizes, share, cap, weights):
    """Targets by resharing, from {source: size}."""
    names = sorted(sizes, key=lambda s: (s is None, "" if s is None else s.encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * sizes[s]}
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows_of(seed, n=700, sources=9):
    rnd = random.Random(seed)
    names = [None, "é", "a", "B", "z", "zz", "ab", "_", "0"][:sources]
    return [(i, "w " * (int(rnd.lognormvariate(3, 1.2)) if rnd.random() > 0.05 else 0), "en",
             names[0] if rnd.random() < 0.33 else rnd.choice(names)) for i in range(n)]


@pytest.mark.parametrize("seed,share,weights", [(1, 1.5, (5, 2, 1)), (4, 0.05, (9, 1))])
def test_targets_are_met(make_docs, monkeypatch, seed, share, weights):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 7)
    rows = rows_of(seed)
    got = mixing.mix(make_docs(rows), share=share, cap=2, weights=weights).collect()
    assert {(r.doc_id, r.size, r.source) for r in got} == {(i, len(t.split()), s) for i, t, _, s in rows} and len(got) == len(rows)
    sizes = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    want = plain_targets(sizes, share, 2, weights)
    for s, size in sizes.items():
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size and math.isclose(r.target, want[s], rel_tol=1e-9) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(r.size for r in mine)
        assert abs(sum(r.rate * r.size for r in mine) - want[s]) <= 1e-4 * max(1, want[s])
        assert all(0 <= r.copies <= 2 and r.taken == r.copies * r.size for r in mine)
        tilts = {round(math.log(r.rate) / r.size, 6) for r in mine if r.size > 20 and 1e-6 < r.rate < 1.999}
        assert len(tilts) <= 1 or max(tilts) - min(tilts) < 1e-4  # one exponential tilt per source


def test_reruns_agree(make_docs):
    docs = make_docs(rows_of(7))
    one, two = (sorted((r.doc_id, r.taken) for r in mixing.mix(d).collect()) for d in (docs, docs.repartition(5)))
    assert one == two


def test_repeated_documents(make_docs):
    docs = make_docs(rows_of(8, 200))
    taken = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    again = mixing.repeat(docs)
    assert again.columns == docs.columns
    count = {}
    for r in again.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count == {i: c for i, c in taken.items() if c}


def test_awkward_rows(awkward, nothing, make_docs):
    got = mixing.mix(awkward).collect()
    assert len(got) == 12 and all(r.taken <= 2 * r.size for r in got)
    assert [r.size for r in got if r.doc_id in (1, 2, 3)] == [0, 0, 0]
    assert mixing.mix(nothing).count() == 0 and mixing.repeat(nothing).count() == 0
    assert mixing.repeat(awkward).dtypes == awkward.dtypes
    empty = mixing.mix(make_docs([(1, None), (2, "")])).collect()
    assert [(r.target, r.taken, r.copies) for r in empty] == [(0.0, 0, 1)] * 2
    same = mixing.mix(make_docs([(i, "three words here", "en", "only") for i in range(50)])).collect()
    assert sum(r.taken for r in same) == 225


def test_small_documents_make_up_for_a_long_one(make_docs):
    rows = [(i, "w " * 300, "en", "a") for i in range(1000)] + [(1000, "w " * 1_000_000, "en", "a")]
    got = mixing.mix(make_docs(rows), share=0.5, weights=(1,)).collect()
    assert got[0].target == 650_000 and sum(r.taken for r in got) == 600_000
    assert abs(got[0].miss + 5 / 65) < 1e-9


def test_rows_without_id_follow_the_mix(make_docs):
    rows = [(None if i % 2 else i, " ".join(["w"] * (i % 7 + 1)) + f" {i}", "en", "ab"[i % 3 == 0]) for i in range(400)]
    docs = make_docs(rows)
    assert mixing.repeat(docs).count() == sum(r.copies for r in mixing.mix(docs).collect())
