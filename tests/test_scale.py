"""Plans whose cost follows the input: long documents, large tables."""

from pyspark.sql import functions as F

from siltstone.engine import Engine
from siltstone.functions.codec import encode_varint
from siltstone.operators.compressed import CompressedIndex, pack, unpack
from siltstone.operators.index import AdHocIndex
from siltstone.operators.segmented import write_postings
from siltstone.plans.compiler import compile_query
from siltstone.plans.dsl import Prefix
from siltstone.sources.mapping import Field, Mapping


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_field_that_is_all_text_isnt_joined(spark):
    rows = spark.createDataFrame([("a", "the then x"), ("b", "y"), ("c", None)], "document_id string, text string")
    found = compile_query(AdHocIndex(rows, ["text"]), Prefix("text", "th"))
    assert "LeftSemi" not in _plan(found)
    assert [r["document_id"] for r in found.collect()] == ["a"]


def test_a_prefix_in_a_field_is_told_in_the_scan(spark):
    rows = spark.createDataFrame([("a", "the", "x"), ("b", "y", "then the"), ("c", "then", "the the")], "document_id string, one string, two string")
    index = AdHocIndex(rows, ["one", "two"])
    found = compile_query(index, Prefix("one", "th"))
    assert "LeftSemi" not in _plan(found)
    every = {r["document_id"]: r["score"] for r in compile_query(index, Prefix("", "th")).collect()}
    assert sorted(every) == ["a", "b", "c"]
    assert {r["document_id"]: r["score"] for r in found.collect()} == {k: every[k] for k in "ac"}


def test_lengths_are_counted_before_tokens_are_rows(spark):
    rows = spark.createDataFrame([("a", "the then x")], "document_id string, text string")
    above = _plan(compile_query(AdHocIndex(rows, ["text"]), Prefix("", "th"))).split("Generate explode")[0]
    assert "Aggregate" in above and "octet_length" not in above


def test_lists_of_a_batch_are_packed_together(spark):
    lists = [[0, 1, 300, 5_000_000], [7], [2**40], [], [5, 6]]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "k int, v array<long>").coalesce(1)
    got = rows.select("k", pack("v").alias("d")).select("k", "d", unpack("d").alias("v")).orderBy("k").collect()
    assert [r["v"] for r in got] == lists
    assert [bytes(r["d"]) for r in got] == [encode_varint([b - a for a, b in zip([0, *v], v, strict=False)]) for v in lists]


def test_compressed_lists_are_made_once(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y"), ("c", "")], "document_id string, text string")
    made = CompressedIndex.of(AdHocIndex(docs, ["text"]))
    assert "Aggregate" not in _plan(made.lists)
    left = made.remove(docs.where("document_id = 'a'").select("document_id"))
    assert sorted(map(tuple, left.inverted().collect())) == [("y", "b")]


def test_postings_of_a_segment_are_shuffled_packed(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"w{i % 7} a a b{i}") for i in range(50)], "document_id string, text string")
    index = AdHocIndex(docs, ["text"])
    write_postings(index, str(tmp_path), 1, 5, 1 << 30)
    got = spark.read.parquet(f"{tmp_path}/postings/segment=1")
    names = ["term", "document_id", "tf", "dl", "positions"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, index.postings.select(*names).collect()))
    assert got.where(got["bucket"] != F.pmod(F.xxhash64("term"), F.lit(5))).isEmpty()


def test_the_logs_text_is_written_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.create_index("shop", Mapping((Field("title"),)))
    engine.store.add("shop", "a", '{"title": "bike", "more": "red"}')
    fresh = engine.index("shop").fresh
    assert fresh is engine.index("shop").fresh and "Window" not in _plan(fresh.docs)
    engine.store.add("shop", "b", '{"title": "bike"}')
    assert engine.index("shop").fresh is not fresh
    assert {r["document_id"] for r in engine.search("shop", {"query": {"match": {"title": "bike"}}}).all_hits.collect()} == {"a", "b"}
