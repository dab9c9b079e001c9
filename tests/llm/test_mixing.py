"""Mixing to target weights against its SQL and a loop in Python."""

import hashlib
from collections import Counter, defaultdict

import pytest

from siltstone.llm import mixing, queries

from .conftest import ROWS


def brute(rows, weights, budget=None):
    """How often each row is taken; rows are (doc_id, text, source)."""
    key = lambda i: hashlib.md5(f"{mixing.SEED}:{'' if i is None else i}".encode()).hexdigest()
    size = lambda t: len([w for w in __import__("re").split(r"[ \t\n\r\f\x0b]+", t or "") if w])
    entries = defaultdict(lambda: defaultdict(int))
    for i, t, s in rows:
        entries[s][key(i)] += size(t)
    total = {s: sum(e.values()) for s, e in entries.items()}
    weight = {s: weights.get(s, 1.0) if total[s] else 0.0 for s in entries}
    whole = sum(total.values()) if budget is None else budget
    out = Counter()
    for s, e in entries.items():
        share = int(whole * weight[s] / sum(weight.values())) if total[s] else 0
        epochs, room = divmod(share, total[s]) if total[s] else (0, 0)
        run, taken = 0, set()
        for k in sorted(e):
            run += e[k]
            if room <= 0 or run > room:
                break
            taken.add(k)
        for i, t, x in rows:
            if x == s:
                out[i, t, x] += epochs + (key(i) in taken)
    return +out


def test_same_as_sql(same_as_sql):
    same_as_sql(queries.op3_source_mixing, queries.ORACLE_SQL["op3_source_mixing"])


@pytest.mark.parametrize("budget", [None, 0, 1, 500, 700_000])
def test_odd_documents(odd, budget):
    weights = {"a": 4.0, "b": 1.5, "absent": 9.0}
    rows = [(r[0], r[1], r[3]) for r in ROWS]
    got = mixing.mix(odd, weights, budget)
    assert got.columns == odd.columns
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got.collect()) == brute(rows, weights, budget)


def test_weights_are_met(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"s0": 5.0, "s1": 1.0, "s2": 0.0}
    got = Counter()
    for r in mixing.mix(docs, weights).collect():
        got[r["source"]] += len(r["text"].split())
    whole = sum(1 + i % 7 for i in range(3000))
    assert got["s0"] == pytest.approx(whole * 5 / 6, abs=7) and got["s1"] == pytest.approx(whole / 6, abs=7) and got["s2"] == 0
    assert all(got[s] <= whole * w / 6 for s, w in weights.items())


def test_empty(none, spark):
    assert mixing.mix(none, {"a": 2.0}).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "a")], "doc_id long, text string, source string")
    assert mixing.mix(blank).collect() == []
