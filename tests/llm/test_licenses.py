"""Patience alignment of license texts against a slow reference."""

import random

import pytest

from siltstone.llm import license_scan as L
from siltstone.llm import queries

from ..conftest import SF
from .conftest import LONG, ROWS, words


def slow_align(a, b):
    """Anchors on words unique to both sides, the longest increasing subsequence by a quadratic table, gaps by recursion."""
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    pairs = sorted((a.index(w), b.index(w)) for w in ca if ca[w] == 1 and cb.get(w) == 1)
    if not pairs:
        return 0
    best = [1] * len(pairs)
    back = [-1] * len(pairs)
    for n in range(len(pairs)):
        for m in range(n):
            if pairs[m][1] < pairs[n][1] and best[m] + 1 > best[n]:
                best[n], back[n] = best[m] + 1, m
    n, chain = max(range(len(pairs)), key=lambda i: best[i]), []
    while n >= 0:
        chain.append(pairs[n])
        n = back[n]
    return len(chain)


def test_longest_chain():
    rng = random.Random(4)
    for _ in range(60):
        b = list(range(rng.randint(0, 30)))
        a = rng.sample(range(40), rng.randint(0, 40))
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and pairs == sorted(pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))
        assert len(pairs) >= slow_align(a, b)


def test_gaps_are_aligned_again():
    # "the" isn't unique until the anchors on either side have split the text
    a, b = "the big cat saw the dog".split(), "the big cat met the dog".split()
    assert [a[i] for i, _ in L.align(a, b)] == ["the", "big", "cat", "the", "dog"]
    assert len(L.align(["x"] * 5, ["x"] * 5)) == 5  # ends of a gap need no anchor
    assert L.align(list("axxxb"), list("cxxxd")) == []  # no anchor, and no equal ends


def found(df):
    return {(r["doc_id"], r["license"]): r for r in df.collect()}


def test_copies_are_found(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for k, (name, template) in enumerate(sorted(L.TEMPLATES.items())):
        rows.append((k, f"{words(k, 300)}\n{template}\n{words(k + 50, 200)}"))
        want.add((k, name))
        w = template.split()
        if len(w) > 40:
            for j in rng.sample(range(len(w)), len(w) // 12):
                w[j] = "zzz"
            rows.append((100 + k, words(k, 5000) + " " + " ".join(w)))
            want.add((100 + k, name))
    got = found(L.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert want <= set(got)
    for k, name in want:
        assert got[k, name]["coverage"] >= L.THRESHOLD and (k >= 100 or got[k, name]["coverage"] == 1.0)
    at = got[0, sorted(L.TEMPLATES)[0]]
    assert at["first_word"] == 300 and at["last_word"] > 300


def test_clean_documents_hold_nothing(spark, odd, none):
    assert L.scan(none).collect() == []
    assert L.scan(odd).where("license not like '%notice'").collect() == []
    assert L.scan(spark.createDataFrame([(1, LONG)], "doc_id long, text string")).collect() == []
    half = " ".join(L.TEMPLATES["MIT"].split()[:60])
    assert L.scan(spark.createDataFrame([(1, half)], "doc_id long, text string")).where("license = 'MIT'").collect() == []
    assert len(ROWS) == odd.count()


def test_nulls_and_repeats(spark):
    line = "All rights reserved."
    docs = spark.createDataFrame([(None, line), (1, line), (1, line), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in L.scan(docs).collect()) == ["1", "1", "None"]
    assert L.scan(docs, {}).collect() == [] and L.scan(docs, {"none": "..."}).collect() == []


def test_every_license_line_of_the_corpus(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"] for r in queries.op2_license_scan(spark, SF).collect()}
    lines = docs.where("text rlike '(?i)licensed under|rights reserved|free of charge'").select("doc_id").collect()
    missed = [r["doc_id"] for r in lines if r["doc_id"] not in got]
    assert len(missed) <= 0.05 * max(1, len(lines)), missed


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_threshold(spark, threshold):
    w = L.TEMPLATES["Apache-2.0-header"].split()
    docs = spark.createDataFrame([(1, " ".join(w[: int(len(w) * 0.7)]))], "doc_id long, text string")
    got = L.scan(docs, {"a": L.TEMPLATES["Apache-2.0-header"]}, threshold).count()
    assert got == (threshold == 0.5)


@pytest.mark.parametrize("changed", [0, 10])
def test_foreign_words_at_every_offset(changed):
    """A copy with as many foreign words inside as it has words is found whole wherever it begins."""
    from siltstone.llm.kernels import word_hashes

    m = 50
    template = [f"t{i}" for i in range(m)]
    matcher = L.Matcher({"a": " ".join(template)}, L.THRESHOLD)
    copy = [w if not changed or i % changed != changed // 2 else "zzz" for i, w in enumerate(template)]
    inside = [w for i, w in enumerate(copy) for w in ((w, f"foreign{i}") if i < m - 1 else (w,))]
    texts = [" ".join(["before"] * (3 * m + k) + inside + ["after"] * 50) for k in range(m)]
    got = {f[0]: f[2:] for f in matcher.find(*word_hashes(L.pa.array(texts)))}
    whole = sum(w != "zzz" for w in copy) / m
    assert got == {k: (whole, 3 * m + k, 3 * m + k + len(inside) - 1) for k in range(m)}
