"""Indexes on disk: catalog, ingest, log, segments, snapshots, streaming."""

import json

import pytest

from siltstone.engine import Engine
from siltstone.errors import DocumentAlreadyExists, DocumentNotFound, IndexAlreadyExists, IndexNotFound, InvalidDocument, SearchError, StorageError
from siltstone.plans.dsl import Aggregation, Match, SearchRequest, Sort, Term
from siltstone.sources.mapping import Field, Mapping
from siltstone.sources.segments import MergePolicy, Registry, Segment
from siltstone.sources.store import Store
from siltstone.streaming.ingest import apply_batch, ingest

MAPPING = Mapping((Field("title", "text", True), Field("price", "float"), Field("n", "integer"), Field("ok", "boolean")))


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    s.create("shop", MAPPING)
    return s


def batch(spark, rows):
    return spark.createDataFrame([(i, k, json.dumps(v) if isinstance(v, dict) else v) for i, (k, v) in enumerate(rows)], "seq long, id string, body string")


def bodies(store, name="shop"):
    return {r["id"]: json.loads(r["body"]) for r in store.bodies(name).collect()}


def test_catalog(store):
    with pytest.raises(IndexAlreadyExists):
        store.create("shop")
    for bad in ("", "a b", "x" * 129, "ä"):
        with pytest.raises(SearchError):
            store.create(bad)
    store.create("alpha")
    assert store.names() == ["alpha", "shop"] and store.mapping("shop") == MAPPING
    store.delete("alpha")
    assert store.names() == ["shop"]
    with pytest.raises(IndexNotFound):
        store.bodies("alpha")


def test_bulk_and_validation(store, spark):
    rows = [("a", {"title": "one", "price": 1}), ("b", {"price": 1}), ("c", {"title": 5}), ("d", {"title": "x", "n": 1.5}), ("e", {"title": "x", "price": None}), ("bad id", {"title": "x"}), ("a", {"title": "again"}), ("f", "not json"), ("g", "[1]"), (None, {"title": "x"}), ("h", {"title": "x", "ok": True, "free": {"deep": 1}}), ("x" * 257, {"title": "x"})]
    got = {r["seq"]: (r["status"], r["error"]) for r in store.bulk_add("shop", batch(spark, rows)).collect()}
    assert [k for k, v in sorted(got.items()) if v[0] == "created"] == [0, 10]
    assert got[1][1] == "field 'title' is required" and "type text" in got[2][1] and "type integer" in got[3][1] and "type float" in got[4][1] and "repeated" in got[6][1]
    assert set(bodies(store)) == {"a", "h"}
    with pytest.raises(DocumentAlreadyExists):
        store.add("shop", "a", '{"title": "y"}')
    with pytest.raises(InvalidDocument):
        store.add("shop", "z", "{}")
    assert store.info("shop")["document_count"] == 2 and store.total_documents() == 2


def test_remove_flush_compact(store, spark):
    store.bulk_add("shop", batch(spark, [(k, {"title": k}) for k in "abc"]))
    assert store.flush("shop") == 1 and store.flush("shop") == 0
    store.add("shop", "d", '{"title": "d"}')
    store.flush("shop")
    store.remove("shop", "a")
    with pytest.raises(DocumentNotFound):
        store.remove("shop", "a")
    assert set(bodies(store)) == {"b", "c", "d"}
    store.add("shop", "a", '{"title": "new"}')
    assert bodies(store)["a"] == {"title": "new"}
    store.flush("shop")
    assert bodies(store)["a"] == {"title": "new"} and len(bodies(store)) == 4
    assert store.log("shop").count() == 0 and store.missing_segments("shop") == []
    for k in "xyz":
        store.add("shop", k, f'{{"title": "{k}"}}')
        store.flush("shop")
    before = bodies(store)
    assert len(store.compact_if_due("shop", MergePolicy(max_segments=2, least=2))) >= 2 and bodies(store) == before
    with pytest.raises(StorageError):
        store.compact("shop", [1])
    with pytest.raises(StorageError):
        store.compact("shop", [998, 999])
    store.compact("shop")
    assert bodies(store) == before and store.segments("shop").select("segment_id").distinct().count() == 1


def test_a_damaged_log_is_read_up_to_the_damage(store, spark, tmp_path):
    for k in "abc":
        store.add("shop", k, f'{{"title": "{k}"}}')
    folder = tmp_path / "store/shop/log/00000002"
    for part in folder.glob("part-*"):
        part.write_text(part.read_text().replace('\\"b\\"', '\\"B\\"'))
    for crc in folder.glob(".part-*.crc"):
        crc.unlink()
    assert set(bodies(store)) == {"a"}
    for part in folder.glob("part-*"):
        part.write_text("{ cut off")
    assert set(bodies(store)) == {"a"}


def test_snapshot(store, spark, tmp_path):
    store.bulk_add("shop", batch(spark, [(k, {"title": k}) for k in "abc"]))
    store.snapshot("shop", str(tmp_path / "copy"))
    assert store.restore(str(tmp_path / "copy"), "again") == "again" and bodies(store, "again") == bodies(store)
    head = tmp_path / "copy/snapshot.json"
    for crc in (tmp_path / "copy").glob(".*.crc"):
        crc.unlink()
    head.write_text(head.read_text().replace('"documents": 3', '"documents": 4'))
    with pytest.raises(StorageError):
        store.restore(str(tmp_path / "copy"), "third")


def test_reopening_and_engine(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "e"))
    engine.create_index("shop", MAPPING)
    engine.store.bulk_add("shop", batch(spark, [("p1", {"title": "electric bike", "price": 799, "kind": "e"}), ("p2", {"title": "mountain bike", "price": 1500, "kind": "s"}), ("p3", {"title": "shoes", "tags": ["bike", "run"]})]))
    again = Engine(spark, str(tmp_path / "e"))
    request = SearchRequest(Match("", "bike"), filters=(), sort=(Sort("price", True),), aggregations=(Aggregation("terms", "kind"),))
    got = again.search("shop", request)
    assert [r["document_id"] for r in got.hits.collect()] == ["p2", "p1", "p3"]
    assert {r["key"]: r["count"] for r in got.aggregations["kind", "terms"].collect()} == {"e": 1, "s": 1}
    assert [r["document_id"] for r in again.search("shop", {"query": {"match": {"title": "bike"}}, "filters": [{"term": {"kind": "s"}}]}).hits.collect()] == ["p2"]
    again.search("shop", request)
    assert again.cache.hits == 1
    engine.store.add("shop", "p4", '{"title": "bike bell"}')
    assert again.search("shop", request).total() == 4  # a write makes a new version
    assert [r["document_id"] for r in again.search_text("shop", "electric bike").collect()] == ["p1"]
    assert again.metrics()["documents"] == 4 and "Limit" in again.explain_plan(request).show()
    assert again.search("shop", SearchRequest(Term("kind", "s"))).total() == 1


def test_merge_policy_and_registry():
    segments = [Segment(i, 1, 10, float(i)) for i in range(1, 13)]
    policy = MergePolicy()
    assert policy.pick(segments) == [1, 2, 3] and policy.pick(segments[:10]) == []
    assert MergePolicy(max_bytes=50).pick(segments[:6]) == [1, 2, 3] and MergePolicy(max_bytes=5).pick(segments[:2]) == []
    r = Registry(segments[:3])
    r.mark([2], "merging")
    assert [s.segment_id for s in r.active()] == [1, 2, 3] and r.next_id() == 4
    r.mark([1], "deleted")
    assert [s.segment_id for s in r.active()] == [2, 3] and r.reconcile([2, 9]) == [9]
    assert Registry.from_json(r.to_json()).to_json() == r.to_json()
    with pytest.raises(StorageError):
        r.add(2, 1, 1)
    with pytest.raises(StorageError):
        r.mark([77], "deleted")


def test_streaming(store, spark, tmp_path):
    rows = [(1, "add", "a", '{"title": "one"}'), (2, "add", "b", '{"title": "two"}'), (3, "remove", "a", None), (4, "add", "c", "{}")]
    schema = "seq long, op string, id string, body string"
    feed = str(tmp_path / "feed")
    run = lambda: ingest(spark.readStream.schema(schema).parquet(feed), store, "shop", str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame(rows, schema).write.parquet(feed)
    run()
    assert bodies(store) == {"b": {"title": "two"}}
    spark.createDataFrame([(5, "add", "b", '{"title": "newer"}')], schema).write.mode("append").parquet(feed)
    run()
    run()
    assert bodies(store) == {"b": {"title": "newer"}}
    store.flush("shop")
    store.add("shop", "z", '{"title": "z"}')
    apply_batch(store, "shop", spark.createDataFrame([(9, "remove", "z", None)], schema), 0)  # an old batch, delivered again
    assert set(bodies(store)) == {"b", "z"}
