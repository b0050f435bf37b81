import random

import numpy as np
import odd
import pytest

from scatterloom.llm import minhash
from scatterloom.llm.components import components


def shingles(text, k):
    w = text.encode().lower().split()
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent):
    """All pairs, then the smallest id that links reach."""
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(draw, size, words, changed):
    """Copies of a text with some words changed: around the limit, so that some are linked with the first, some with others, some with none."""
    base = [f"w{draw.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(size):
        w = list(base)
        for _ in range(draw.randrange(changed + 1)):
            w[draw.randrange(words)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("k", "cell"), [(4, 512), (5, 7)])
def test_same_as_all_pairs(spark, monkeypatch, k, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    draw = random.Random(k)
    texts = [t for _ in range(6) for t in family(draw, 25, 120, 9)] + [odd.sentence(i, 30) for i in range(20)] * 2
    ids = draw.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.cluster(df, k, 80).collect()}
    want = brute(rows, k, 80)
    assert got == want
    assert len({c for _, c in want.values()}) > 15  # the limit cuts families apart


def test_links_on_the_limit(spark):
    words = [f"w{i}" for i in range(100)]
    a = " ".join(words)  # 97 shingles of four words
    rows = [(1, a), (2, " ".join(words[:-11]) + " " + " ".join(f"y{i}" for i in range(11))), (3, " ".join(words[:-10]) + " " + " ".join(f"y{i}" for i in range(10)))]
    got = {r.doc_id: r.component_id for r in minhash.cluster(spark.createDataFrame(rows, "doc_id bigint, text string"), 4, 80).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 4, 80).items()}


@pytest.mark.parametrize("few", [True, False])
def test_odd_rows(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(minhash, "BROADCAST_ROWS", -1)
    df = odd.documents(spark)
    got = minhash.cluster(df, 4).collect()
    want = brute(odd.plain(df), 4, 80)
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash.cluster(odd.empty(spark)).collect() == []


def test_coordinates_are_minima_of_shifted_permutations():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 900, dtype=np.uint64))
    first = minhash.permuted((h >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    want = [minhash.permuted(first + np.uint32(k), 0x21F0AAAD, 0x735A2D97).min() for k in range(20)]
    assert minhash.signature(h, 20).tolist() == want
    some = np.arange(100_000, dtype=np.uint32)
    assert len(np.unique(minhash.permuted(some, 0x7FEB352D, 0x846CA68B))) == len(some)


def test_share_of_equal_coordinates_estimates_similarity():
    draw = np.random.default_rng(5)
    h = draw.integers(0, 1 << 63, 1200, dtype=np.uint64)
    for common in (300, 600, 800):
        a, b = h[:1000], np.concatenate((h[:common], h[1000:], draw.integers(0, 1 << 63, 800 - common, dtype=np.uint64)))
        true = common / (1000 + len(b) - common)
        equal = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
        assert abs(equal - true) < 0.05


def test_components(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(50, 90)] + [(draw.randrange(100, 400), draw.randrange(100, 400)) for _ in range(150)] + [(7, 7), (9, 3), (3, 9)]
    top = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in range(400):
        for u, v in links:
            if u != v:
                top[u] = top[v] = min(top[u], top[v])
    df = spark.createDataFrame(links, "u bigint, v bigint")
    assert {r.node: r.label for r in components(df).collect()} == top
    assert components(df.limit(0)).collect() == []
