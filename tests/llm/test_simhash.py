import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tillwork.llm import simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints, max_bits=4):
    up = {i: i for i in prints}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= max_bits:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {i: top(i) for i in prints}


def test_fingerprints_match_the_plain_ones():
    texts = ["", None, "One", "a B c", "A b  c\td\ne É", "x y", " lead and trail ", "Ünï Öde", "q " * 500]
    got = simhash.fingerprint_array(pa.array(texts), 4, 42).tolist()
    assert got == [plain_fingerprint(t) for t in texts]


def near_texts(n=60, seed=3):
    rnd, texts = random.Random(seed), {}
    words = [f"w{i}" for i in range(300)]
    for i in range(n):
        base = [rnd.choice(words) for _ in range(400)]
        for copy in range(3):
            texts[i * 3 + copy] = " ".join(base)
            base[rnd.randrange(400)] = rnd.choice(words)
    return texts


def test_components_match_brute_force(make_docs):
    texts = near_texts()
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id)
           for r in simhash.near_duplicates(make_docs(list(texts.items()))).collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    assert {i: f for i, (f, _) in got.items()} == prints
    assert {i: c for i, (_, c) in got.items()} == plain_classes(prints)
    assert len(set(plain_classes(prints).values())) < len(texts)


@pytest.mark.parametrize("n,spread,short", [(300, 6, 64), (3000, 5, 64), (600, 4, 8)])
def test_links_connect_dense_groups(spark, monkeypatch, n, spread, short):
    """Balls of close fingerprints and lonely ones, with runs above and below every bound."""
    monkeypatch.setattr(simhash, "DENSE_RUN", 200)
    monkeypatch.setattr(simhash, "SHORT_RUN", short)
    rnd = random.Random(n)
    values = {rnd.getrandbits(64) for _ in range(n // 2)}
    centre = rnd.getrandbits(64)
    while len(values) < n:
        v = centre
        for _ in range(spread):
            v ^= 1 << rnd.randrange(40)
        values.add(v)
    v = np.array(sorted(values), np.uint64)
    fps = spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long")
    links = simhash.near_links(fps, 4).collect()
    assert all((r.a ^ r.b).bit_count() <= 4 or ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4 for r in links)
    up = {int(x): int(x) for x in v.view(np.int64)}

    def top(i):
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for r in links:
        p, q = top(r.a), top(r.b)
        up[max(p, q)] = min(p, q)
    want, seen = np.arange(len(v)), np.bitwise_count(v[:, None] ^ v[None, :]) <= 4
    for _ in range(60):
        want = np.where(seen, want[None, :], len(v)).min(1)
    groups = {}
    for x, w in zip(v.view(np.int64), want):
        groups.setdefault(int(w), set()).add(top(int(x)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({g for s in groups.values() for g in s}) == len(groups)


@pytest.mark.parametrize("n", [100, 10**6, 10**9])
def test_plan_finds_every_close_pair(n):
    rng = np.random.default_rng(1)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    thresholds = simhash.plan(sample, n, 4)
    masks = simhash.blanks(thresholds)
    for _ in range(300):
        x = int(rng.integers(0, 2**63))
        y = x
        for b in rng.choice(64, 4, replace=False):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)


def test_awkward_rows(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == 12
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].fingerprint == by_id[2].fingerprint == by_id[3].fingerprint == "0" * 16
    assert by_id[3].component_id == 1 and by_id[6].component_id == 5
    assert by_id[None].component_id is None
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(awkward)
    assert kept.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 4, 5, 7, None, 8, 9, 10]))
