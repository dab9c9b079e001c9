"""Circulant MinHash near-duplicates against all pairs."""

import re
from itertools import combinations

import numpy as np
import pytest

from siltstone.llm import minhash, queries
from siltstone.llm.components import components
from siltstone.llm.scratch import Scratch

from .conftest import ROWS, words


def shingles(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def brute(rows, threshold=minhash.THRESHOLD):
    """doc_id to the least doc_id of its group."""
    ids = sorted({i for i, _ in rows if i is not None})
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and len(x & y) >= threshold * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in ids}


def test_same_as_sql(same_as_sql):
    same_as_sql(queries.op10_minhash_near_dedup, queries.ORACLE_SQL["op10_minhash_near_dedup"])


def test_odd_documents(odd):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(odd).collect()}
    want = brute([(r[0], r[1]) for r in ROWS])
    assert {i: r["group_id"] for i, r in got.items()} == want
    for i, r in got.items():
        assert r["keep"] == (i == want[i]) and r["group_size"] == sum(g == want[i] for g in want.values())


def test_groups_of_every_size(spark):
    rows, n = [], 0
    for k in range(30):
        base = words(100 + k, 80).split()
        for copy in range(1 + 3 * (k % 5)):
            w = list(base)
            for j in range(copy % 4):
                w[(7 * j + k) % len(w)] = f"x{copy}y{j}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n + i, "same words in every copy of this") for i in range(400)]
    shared = words(999, 70)
    rows += [(n + 400 + i, f"{words(2000 + i, 200)} {shared}") for i in range(40)]  # a passage isn't a near copy
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_one_of_each_group_stays(odd):
    left = minhash.drop_near_duplicates(odd)
    assert left.columns == odd.columns
    kept = [r["doc_id"] for r in left.collect()]
    want = brute([(r[0], r[1]) for r in ROWS])
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values())) and kept.count(None) == 2


def test_an_id_with_two_texts_joins_their_groups(spark):
    a, b = words(5, 50), words(6, 50)
    rows = [(1, a), (2, b), (2, a), (3, b), (4, words(7, 50))]
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_empty(none):
    assert minhash.near_duplicates(none).collect() == [] and minhash.drop_near_duplicates(none).collect() == []


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(3)
    size = 126
    for shared in (100, 300, 500):
        a = rng.integers(0, 1 << 62, 600).astype(np.uint64)
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 62, 600 - shared).astype(np.uint64)])
        sig = minhash.signatures(np.concatenate([a, b]), np.array([0, 600, 1200]), size)
        assert np.mean(sig[0] == sig[1]) == pytest.approx(shared / (1200 - shared), abs=0.15)


def test_shift_structure():
    """Coordinate k + 1 of one element is the second permutation read one place further back."""
    _, window = minhash._permutations(8)
    assert np.array_equal(window[5][1:], window[6][:-1])


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (200, 200), (300, 0)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(spark, df, Scratch(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, 300: 0, 100: 100, 101: 100, 102: 100}
