"""The inverted multi-index against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import ann, queries

from ..conftest import SF


def recall(rows, ids, x, k, every=1):
    got: dict = {}
    for r in rows:
        got.setdefault(r["vec_id"], set()).add(r["neighbour_id"])
    asked = [n for n, i in enumerate(ids) if i % every == 0]
    assert set(got) == {ids[n] for n in asked}
    found = 0
    for n in asked:
        d = ((x - x[n]) ** 2).sum(1)
        d[n] = np.inf
        best = np.lexsort((ids, d.round(9)))[:k]
        found += len(got[ids[n]] & set(ids[best].tolist()))
    at = {v: n for n, v in enumerate(ids.tolist())}
    for r in rows[:300]:
        assert r["distance"] == pytest.approx(((x[at[r["vec_id"]]] - x[at[r["neighbour_id"]]]) ** 2).sum(), rel=1e-5, abs=1e-9)
    return found / (k * len(asked))


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.1")])
def test_recall_of_the_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(table["embedding"]).astype(np.float64), table["vec_id"].to_numpy()
    rows = queries.op4_nearest_neighbours(spark, sf).collect()
    assert len(rows) == ann.NEIGHBOURS * int((ids % ann.EVERY == 0).sum())
    assert recall(rows, ids, x, ann.NEIGHBOURS, ann.EVERY) >= 0.9
    if sf == SF:
        assert recall(ann.neighbours(spark.read.parquet(f"{sf}/embeddings.parquet")).collect(), ids, x, ann.NEIGHBOURS) >= 0.9


def test_clustered_vectors_cost_few_comparisons(spark, monkeypatch):
    """On clusters a tenth of the entries, at most, is compared with a query, one of them rare and one with a third of the rows."""
    rng = np.random.default_rng(5)
    sizes = [2000, *[80] * 49, 80]
    x = np.concatenate([rng.standard_normal(16) * 4 + rng.standard_normal((n, 16)) * 0.3 for n in sizes]).astype(np.float32)
    ids = np.arange(len(x))
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>")
    kept = {}
    reach = ann._reach

    def keep(scratch, queries, directory, index, stretch):
        out = reach(scratch, queries, directory, index, stretch)
        kept["reached"] = out.collect(), index, directory.collect()
        return out

    monkeypatch.setattr(ann, "_reach", keep)
    rows = ann.neighbours(table, every=7).collect()
    assert recall(rows, ids, x.astype(np.float64), ann.NEIGHBOURS, 7) >= 0.95
    reached, index, directory = kept["reached"]
    cells = {r["cell"]: r["n"] for r in directory}
    compared = []
    for r in reached:
        a, b = index.halves(np.array([r["v"]], np.float32))
        compared.append(sum(n for c, n in cells.items() if a[0, c // index.shape[1]] + b[0, c % index.shape[1]] <= r["reach"] * (1 + 1e-5)))
    assert sum(cells.values()) == len(x) and np.mean(compared) <= 0.1 * len(x), np.mean(compared)


def test_only_cells_within_reach_are_compared(monkeypatch):
    """Counts the distances that a bundle's comparison computes."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 8)).astype(np.float32)
    index = ann.MultiIndex.fit(x, 12)
    cell = index.cells(x)
    q = x[:5]
    a, b = index.halves(q)
    limits = [next(t for n, (t, _) in enumerate(index.walk(a[i], b[i])) if n == 4) for i in range(5)]
    want = sum(int((a[i, cell // 12] + b[i, cell % 12] <= limits[i]).sum()) for i in range(5))

    class Shared:
        value = index

    count = []
    real = ann._distances

    def counted(p, r):
        if r.shape[1] == 8:
            count.append(len(p) * len(r))
        return real(p, r)

    monkeypatch.setattr(ann, "_distances", counted)
    lists = lambda v: pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.reshape(-1))
    entries = pa.table({"v": lists(x), "ids": lists(np.arange(len(x))[:, None]), "cell": cell})
    got = ann.comparison(index.shape, Shared, 3)(entries, pa.table({"h": np.arange(5), "g": np.arange(5), "v": lists(q), "reach": limits}))
    assert sum(count) == want < 5 * 4000 / 3
    assert got.column("ids").to_pylist()[::3] == [[i] for i in range(5)]  # each query itself comes first


def test_large_cells_are_cut(spark, monkeypatch):
    """Bundles and pieces far smaller than the data change nothing."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.standard_normal((60, 6)) * 1e-4, rng.standard_normal((240, 6))]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = sorted(map(tuple, ann.neighbours(table, 4, target=1.0).collect()))
    monkeypatch.setattr(ann, "BUNDLE", 8)
    monkeypatch.setattr(ann, "QUERIES", 16)
    got = sorted(map(tuple, ann.neighbours(table, 4, target=1.0).collect()))
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want] and len(got) == 1200


def test_odd_vectors(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0, 0.0], 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, None, 1), (None, [1.0, 1.0, 1.0], 1), (5, [nan, 0.0, 0.0], 1), (6, [1.0, 2.0], 1), (7, [float("inf"), 0.0, 0.0], 1), (8, [None, 1.0, 1.0], 1), (3, [1.0, 0.0, 0.0], 1), (9, [0.0, 2.0, 0.0], None)]
    table = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<float>, label int, cell int, bundle int, id int")
    got = {(r["vec_id"], r["rank"]): (r["neighbour_id"], r["distance"]) for r in ann.neighbours(table).collect()}
    assert {i for i, _ in got} == {1, 2, 3, 9}
    assert got[1, 1] == (2, 0.0) and got[2, 1] == (1, 0.0) and got[3, 1] == (1, 1.0) and got[3, 2] == (2, 1.0)
    assert len(got) == 12  # all three others of each


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert ann.neighbours(spark.createDataFrame([], schema)).collect() == []
    assert ann.neighbours(spark.createDataFrame([(1, [1.0, 2.0], 0)], schema)).collect() == []


def test_many_copies(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [0.5] * 8) for i in range(300)] + [(300 + i, rng.standard_normal(8).tolist()) for i in range(300)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour_id"], r["distance"]))
    assert len(by) == 600 and all(len(v) == 3 for v in by.values())
    assert sorted(by[5]) == [(1, 0, 0.0), (2, 1, 0.0), (3, 2, 0.0)]  # ties by id


def test_heap_order():
    rng = np.random.default_rng(0)
    index = ann.MultiIndex(rng.random((6, 2)).astype(np.float32), rng.random((5, 2)).astype(np.float32))
    for _ in range(20):
        a, b = rng.random(6), rng.random(5)
        total = (a[:, None] + b[None, :]).reshape(-1)
        walked = list(index.walk(a, b))
        assert [c for _, c in walked] == np.argsort(total).tolist()
        assert [t for t, _ in walked] == pytest.approx(np.sort(total))


def test_only_copies(spark):
    got = ann.neighbours(spark.createDataFrame([(i, [0.0, 1.0, 2.0]) for i in range(50)], "vec_id long, embedding array<float>"), 3).collect()
    assert len(got) == 150 and {(r["neighbour_id"], r["distance"]) for r in got if r["vec_id"] == 40} == {(0, 0.0), (1, 0.0), (2, 0.0)}
