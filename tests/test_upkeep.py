"""What stays whole when a writer dies, and stored postings after every kind of change."""

import json

import pytest
from pyspark.sql import functions as F

from siltstone.engine import Engine, QueryLog, top_queries
from siltstone.operators import compressed
from siltstone.operators.compressed import CompressedIndex
from siltstone.operators.index import AdHocIndex
from siltstone.operators.ordering import order, places
from siltstone.plans.compiler import compile_query
from siltstone.plans.dsl import Fuzzy, Match, Phrase, Prefix, SearchRequest, Sort
from siltstone.sources.files import Files
from siltstone.sources.mapping import set_in_body
from siltstone.sources.store import Store
from siltstone.streaming.ingest import apply_batch

FEED = "seq long, op string, id string, body string"


def batch(spark, rows):
    return spark.createDataFrame([(i, k, json.dumps({"t": v})) for i, (k, v) in enumerate(rows)], "seq long, id string, body string")


def scores(df):
    return {r["document_id"]: r["score"] for r in df.collect()}


def test_a_manifest_is_the_old_or_the_new_one(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.create("a")
    store.bulk_add("a", batch(spark, [("x", "one")]))
    real = Files._replace

    def die(self, old, new):
        raise OSError("gone")

    monkeypatch.setattr(Files, "_replace", die)
    for change in (lambda: store.add("a", "y", "{}"), lambda: store.remove("a", "x"), lambda: store.flush("a"), lambda: store.compact("a")):
        with pytest.raises(OSError):
            change()
        assert [r["id"] for r in Store(spark, str(tmp_path / "s")).bodies("a").collect()] == ["x"]
    monkeypatch.setattr(Files, "_replace", real)
    store = Store(spark, str(tmp_path / "s"))
    store.add("a", "y", "{}")
    assert sorted(r["id"] for r in store.bodies("a").collect()) == ["x", "y"] and store.missing_segments("a") == []


def test_a_feed_batch_counts_once_wherever_it_fails(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    store.create("a")
    rows = spark.createDataFrame([(1, "add", "x", "{}"), (2, "add", "y", "{}")], FEED)
    real = Store._save

    def die(self, name, manifest):
        raise OSError("gone")

    monkeypatch.setattr(Store, "_save", die)  # after the log is written, before the manifest
    with pytest.raises(OSError):
        apply_batch(store, "a", rows, 0)
    monkeypatch.setattr(Store, "_save", real)
    assert store.bodies("a").count() == 0
    for _ in range(3):
        apply_batch(store, "a", rows, 0)
    assert store.log("a").count() == 2 and store.feed_batch("a") == 0


def test_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    seen = []
    for _ in range(2):
        store.create("a")
        seen.append(store.version("a"))
        store.add("a", "x", "{}")
        seen.append(store.version("a"))
        store.delete("a")
    assert len(set(seen)) == 4


def test_the_log_keeps_every_query(spark, tmp_path):
    log = QueryLog(spark=spark, folder=str(tmp_path / "log"), keep=3)
    for i in range(8):
        log.add(f"q{i % 5}", 1.0, i, False)
    assert len(log) == 8 and len(log.rows) == 2 and log.table(spark).count() == 8
    assert [tuple(r) for r in top_queries(log.table(spark), 3).collect()] == [("q0", 2), ("q1", 2), ("q2", 2)]
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create_index("a")
    engine.store.bulk_add("a", batch(spark, [("x", "one")]))
    engine.search("a", SearchRequest(Match("", "one"), size=0))
    assert engine.log.rows[0][2] == 1  # all hits, not those of the page


def test_stored_postings_follow_every_change(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create_index("a", buckets=3)
    texts = ["new york city", "york new", "new big york", "the new thing", "theory of york"]
    changes = [
        lambda: engine.store.bulk_add("a", batch(spark, [(f"d{i}", t) for i, t in enumerate(texts)])),
        lambda: engine.store.flush("a"),
        lambda: engine.store.bulk_add("a", batch(spark, [(f"e{i}", t) for i, t in enumerate(texts)])),
        lambda: engine.store.flush("a"),
        lambda: engine.store.bulk_add("a", batch(spark, [("f0", "york york york"), ("f1", "")])),
        lambda: engine.store.bulk_remove("a", spark.createDataFrame([("d0",), ("e4",), ("no",)], "id string")),
        lambda: engine.store._append("a", spark.createDataFrame([(0, "add", "d1", '{"t": "york new york"}')], FEED)),
        lambda: engine.store.compact("a"),
    ]
    for change in changes:
        change()
        mine = engine.index("a")
        plain = AdHocIndex(mine.docs, mine.fields)
        assert mine.collection.collect() == plain.collection.collect()
        for q in (Match("", "new york"), Match("", "new york", operator="and"), Match("t", "big"), Phrase("", "new york", 1), Prefix("", "th"), Fuzzy("", "yorp", 1)):
            assert scores(compile_query(mine, q)) == pytest.approx(scores(compile_query(plain, q))), q
    plan = engine.index("a").counted(["york"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "/postings" in plan and "regexp_replace" in plan and plan.count("FileScan") == 1
    assert len(engine.store.files.names("a/postings")) == 1  # those of segments that are gone went with them


@pytest.mark.parametrize("n", [60, 70])
def test_the_number_of_expansions_changes_nothing(spark, n):
    rows = [(f"d{i}", f"pre{i} word", [f"pre{i}"], i) for i in range(n)]
    docs = AdHocIndex(spark.createDataFrame(rows, "document_id string, t string, tags array<string>, n long"))
    assert len(scores(compile_query(docs, Prefix("t", "pre")))) == n
    assert scores(compile_query(docs, Prefix("tags", "pre"))) == {} and scores(compile_query(docs, Prefix("n", "1"))) == {}
    assert scores(compile_query(docs, Fuzzy("tags", "pre1", 1))) == {} and len(scores(compile_query(docs, Fuzzy("t", "pre1", 1)))) > 10


def test_compressed_lists(spark, monkeypatch):
    monkeypatch.setattr(compressed, "BLOCK", 4)
    docs = lambda rows: AdHocIndex(spark.createDataFrame(rows, "document_id string, t string"))
    made = CompressedIndex.of(docs([(f"d{i:02d}", "all " + ("even" if i % 2 == 0 else "odd odd")) for i in range(11)] + [("e", "")]))
    ids = lambda df: sorted(r[0] for r in df.collect())
    assert ids(made.postings("even")) == [f"d{i:02d}" for i in range(0, 11, 2)] and made.contains("odd") and not made.contains("none")
    assert made.lists.where("term = 'all'").count() == 3 and made.lists.where("term = 'all'").agg(F.sum("n")).first()[0] == 11
    more = made.add(docs([("d00", "again"), ("z", "odd")]))
    assert ids(more.postings("again")) == ["d00"] and "z" in ids(more.postings("odd")) and ids(more.postings("all")) == ids(made.postings("all"))
    less = more.remove(spark.createDataFrame([(f"d{i:02d}",) for i in range(0, 11, 2)], "document_id string"))
    assert not less.contains("even") and len(ids(less.postings("all"))) == 5
    assert sorted(map(tuple, made.inverted().collect())) == sorted([(t, f"d{i:02d}") for i in range(11) for t in ("all", "even" if i % 2 == 0 else "odd")])
    big = CompressedIndex.of(docs([(f"d{i:04d}", "shared two") for i in range(1000)])).sizes().first()
    assert big["compressed_bytes"] < 0.5 * big["raw_bytes"]


def test_places(spark):
    rows = [(f"d{i:03d}", (i * 7919) % 1000) for i in range(1000)]
    docs = spark.createDataFrame(rows, "document_id string, n long").withColumn("score", F.lit(1.0))
    got = {r["document_id"]: r["place"] for r in places(order(docs, (Sort("n"),))).collect()}
    assert got == {k: n + 1 for n, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_set_in_body(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{}",), ("[1]",), ("no",), (None,)], "body string")
    got = [r["b"] and json.loads(r["b"]) for r in df.select(set_in_body(F.col("body"), "a", F.lit("new")).alias("b")).collect()]
    assert got == [{"a": "new", "b": "x"}, {"a": "new"}, None, None, None]
