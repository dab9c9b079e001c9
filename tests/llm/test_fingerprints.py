"""Consistent weighted samples: collisions equal generalised Jaccard similarity."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import fingerprints as fp
from siltstone.llm import queries
from siltstone.llm.kernels import word_hashes

from ..conftest import SF
from .conftest import ROWS, words


def brute(text, size=fp.SAMPLES):
    """The samples of one text, term by term."""
    hashes, _ = word_hashes(pa.array([text]))
    count = Counter(hashes.tolist())
    if not count:
        return None
    best = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for term, n in count.items():
        x = np.array([term], np.uint64)
        r, log_c, b = fp.draws(x, size)
        t = np.floor(np.log(n).astype(np.float32) / r + b)
        best = np.minimum(best, fp.pack(log_c - r * (t - b + 1), x[:, None], t)[0])
    return (best & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32).tolist()


def jaccard(a, b):
    x, y = Counter(a.lower().split()), Counter(b.lower().split())
    keys = set(x) | set(y)
    return sum(min(x[k], y[k]) for k in keys) / sum(max(x[k], y[k]) for k in keys)


@pytest.mark.parametrize("share", [0.1, 0.4, 0.7, 0.9])
def test_collision_rate_is_generalised_jaccard(share):
    rng = np.random.default_rng(7)
    vocabulary = [f"t{i}" for i in range(60)]
    a = [w for w in vocabulary for _ in range(rng.integers(1, 8))]
    b = [w for w in vocabulary for _ in range(rng.integers(1, 8))] if share < 0.3 else [w for i, w in enumerate(vocabulary) for _ in range(int(a.count(w) if rng.random() < share else rng.integers(1, 12)))]
    one, two = " ".join(a), " ".join(b)
    size = 4096
    hashes, offsets = word_hashes(pa.array([one, two]))
    sig = fp.Sampler(size).signatures(hashes, offsets)
    assert np.mean(sig[0] == sig[1]) == pytest.approx(jaccard(one, two), abs=0.035)


def test_same_as_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = queries.op8_fingerprints(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["fingerprint"] == brute(texts[r["doc_id"]])


def test_odd_documents(odd, none):
    got = fp.fingerprints(odd).collect()
    assert len(got) == len(ROWS) and fp.fingerprints(none).collect() == []
    by = {r["doc_id"]: r for r in got}
    for i in (4, 5, 6, 11):
        assert by[i]["fingerprint"] is None and by[i]["n_terms"] == 0
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[7]["fingerprint"] == by[8]["fingerprint"]
    assert len(by[9]["fingerprint"]) == fp.SAMPLES


def test_kept_terms_do_not_matter():
    hashes, offsets = word_hashes(pa.array([words(1, 500), words(2, 500), words(1, 500)]))
    few, many = fp.Sampler(kept=10), fp.Sampler()
    for _ in range(2):
        assert np.array_equal(few.signatures(hashes, offsets), many.signatures(hashes, offsets))
