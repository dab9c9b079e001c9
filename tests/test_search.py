"""The engine's queries on small catalogs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from siltstone.engine import QueryLog, ResultCache, execute, top_queries
from siltstone.errors import InvalidQuery
from siltstone.operators import aggregates
from siltstone.operators.index import AdHocIndex, StoredIndex, compact_ids
from siltstone.operators.ordering import order, page
from siltstone.operators.ranking import BM25, explain
from siltstone.plans import logical
from siltstone.plans.compiler import compile_filter, compile_query
from siltstone.plans.dsl import Aggregation, Bool, ConstantScore, DisMax, Exists, Fuzzy, Match, MatchAll, MatchNone, MultiMatch, Phrase, Prefix, Range, SearchRequest, Sort, Term, Terms, parse_query, parse_request

PRODUCTS = [
    ("p1", "electric bike", "electronics", 799.0),
    ("p2", "mountain bike", "sports", 1500.0),
    ("p3", "running shoes", "sports", 120.0),
    ("p4", "wireless mouse", "electronics", 25.0),
    ("p5", "laptop bag", "accessories", 45.0),
]


@pytest.fixture(scope="module")
def products(spark):
    return AdHocIndex(spark.createDataFrame(PRODUCTS, "document_id string, title string, category string, price double").cache())


def ids(df):
    return [r["document_id"] for r in df.collect()]


def scores(df):
    return {r["document_id"]: r["score"] for r in df.collect()}


def test_combined_request(products):
    request = parse_request({"query": {"match": {"title": "bike shoes bag mouse"}}, "filters": [{"range": {"price": {"gte": 20}}}], "sort": [{"field": "price", "order": "desc"}], "aggregations": [{"type": "terms", "field": "category"}, {"type": "avg", "field": "price"}, {"type": "stats", "field": "price"}]})
    got = execute(products, request, name="shop")
    assert ids(got.hits) == ["p2", "p1", "p3", "p5", "p4"] and got.total() == 5
    assert {r["key"]: r["count"] for r in got.aggregations["category", "terms"].collect()} == {"electronics": 2, "sports": 2, "accessories": 1}
    assert got.aggregations["price", "avg"].first()["value"] == pytest.approx(497.8)
    assert got.aggregations["price", "stats"].first().asDict() == {"count": 5, "min": 25.0, "max": 1500.0, "avg": pytest.approx(497.8), "sum": 2489.0}
    assert got.hits.first()["index"] == "shop"


def test_paging_adds_up(products):
    pages = [ids(execute(products, SearchRequest(Match("", "bike shoes bag mouse"), offset=k, size=2)).hits) for k in (0, 2, 4, 6)]
    assert sum(pages, []) == ids(execute(products, SearchRequest(Match("", "bike shoes bag mouse"), size=100)).hits)
    assert pages[-1] == [] and ids(execute(products, SearchRequest(MatchAll(), size=0)).hits) == []


def test_or_holds_and(products):
    some, every = (set(ids(compile_query(products, Match("", "electric bike", operator=o)))) for o in ("or", "and"))
    assert some == {"p1", "p2"} and every == {"p1"}
    assert ids(compile_query(products, Match("", "bike absent", operator="and"))) == []


def test_scores_by_hand(products):
    # "bike" is in 2 of 5 documents; numbers of the price are tokens too
    texts = [len(f"{t} {c} {p}".replace(".", " ").split()) for _, t, c, p in PRODUCTS]
    mean = sum(texts) / 5
    idf = math.log(1 + (5 - 2 + 0.5) / 2.5)
    want = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * texts[0] / mean))
    assert scores(compile_query(products, Match("", "bike")))["p1"] == pytest.approx(want)
    total = explain(products, ["bike", "electric"], BM25()).groupBy("document_id").agg(F.sum("contribution").alias("score"))
    assert scores(total) == pytest.approx(scores(compile_query(products, Match("", "bike electric"))))


def test_zero_guards(spark):
    empty = AdHocIndex(spark.createDataFrame([], "document_id string, title string"))
    for q in (Match("", "bike"), MatchAll(), Phrase("", "a b"), Prefix("", "a"), Fuzzy("", "a"), MultiMatch("a", (("title", 1.0),)), Bool(must=(Match("", "a"),))):
        assert compile_query(empty, q).count() == 0
    blank = AdHocIndex(spark.createDataFrame([("a", ""), ("b", None), ("c", "...")], "document_id string, title string"))
    assert compile_query(blank, Match("", "x")).count() == 0 and compile_query(blank, Match("", "")).count() == 0
    assert compile_query(blank, MatchAll()).count() == 3


def test_field_only_filters(products):
    assert set(ids(compile_query(products, Match("title", "bike sports")))) == {"p1", "p2"}
    assert set(ids(compile_query(products, Match("", "bike sports")))) == {"p1", "p2", "p3"}


def test_boosts(products):
    plain, more = (scores(compile_query(products, q)) for q in (Match("", "bike"), Match("", "bike", {"bike": 3.0}, 2.0)))
    assert more["p1"] == pytest.approx(6 * plain["p1"])


def test_bool(products):
    q = Bool(must=(Match("", "bike"),), should=(Match("", "electric"),), must_not=(Term("category", "sports"),))
    assert ids(compile_query(products, q)) == ["p1"]
    both = scores(compile_query(products, Match("", "bike")))["p1"] + scores(compile_query(products, Match("", "electric")))["p1"]
    assert scores(compile_query(products, q))["p1"] == pytest.approx(both)
    two = Bool(should=(Match("", "bike"), Match("", "electric"), Match("", "sports")), minimum_should_match=2)
    assert set(ids(compile_query(products, two))) == {"p1", "p2"}
    assert set(ids(compile_query(products, Bool(should=(Match("", "bag"), Match("", "mouse")))))) == {"p4", "p5"}
    assert set(ids(compile_query(products, Bool(must_not=(Match("", "bike"),))))) == {"p3", "p4", "p5"}
    assert len(ids(compile_query(products, Bool(filter=(Exists("price"),), should=(Match("", "bike"),))))) == 5


def test_dis_max_with_tie_1_is_the_sum(products):
    a, b = Match("", "bike"), Match("", "electric")
    parts = scores(compile_query(products, a))["p1"], scores(compile_query(products, b))["p1"]
    for tie, want in ((1.0, sum(parts)), (0.0, max(parts)), (0.5, max(parts) + 0.5 * min(parts))):
        assert scores(compile_query(products, DisMax((a, b), tie)))["p1"] == pytest.approx(want)


def test_multi_match_uses_each_fields_statistics(products):
    got = scores(compile_query(products, MultiMatch("bike sports", (("title", 2.0), ("category", 1.0)))))
    title = scores(compile_query(products.only("title"), Match("", "bike")))
    assert got["p1"] == pytest.approx(2 * title["p1"]) and set(got) == {"p1", "p2", "p3"}


def test_constant_score_and_none(products):
    assert scores(compile_query(products, ConstantScore(Term("category", "sports"), 7))) == {"p2": 7.0, "p3": 7.0}
    assert ids(compile_query(products, MatchNone())) == [] and len(ids(compile_query(products, MatchAll()))) == 5


def test_phrases(spark):
    docs = AdHocIndex(spark.createDataFrame([("a", "new york city"), ("b", "york new"), ("c", "new big york"), ("d", "york new york"), ("e", "dog dog")], "document_id string, t string"))
    found = lambda text, slop=0: set(ids(compile_filter(docs, Phrase("t", text, slop))))
    assert found("new york") == {"a", "d"} and found("new york", 1) == {"a", "c", "d"}
    assert found("dog dog") == {"e"} and found("dog dog dog", 5) == set() and found("") == set()
    assert found("york new york") == {"d"}


def test_fuzzy_and_prefix(spark):
    docs = AdHocIndex(spark.createDataFrame([("a", "über alles"), ("b", "uber"), ("c", "aber"), ("d", "overt overdue")], "document_id string, t string"))
    found = lambda q: set(ids(compile_filter(docs, q)))
    assert found(Fuzzy("", "uber", 1)) == {"b", "c"}
    assert found(Fuzzy("", "uber", 2)) == {"a", "b", "c"}  # an umlaut is two bytes
    assert found(Fuzzy("", "uber", 2, 1)) == {"b"}
    assert found(Prefix("", "over the")) == {"d"} and found(Prefix("", "")) == set()
    assert parse_query({"fuzzy": {"t": {"value": "x", "max_edit_distance": 1}}}) == Fuzzy("t", "x", 1)


def test_many_expanded_terms(spark):
    rows = [(f"d{i:03d}", f"aa{i:03d} common") for i in range(100)]
    docs = AdHocIndex(spark.createDataFrame(rows, "document_id string, t string"))
    got = scores(compile_query(docs, Prefix("t", "aa")))
    assert len(got) == 100 and got["d007"] == pytest.approx(scores(compile_query(docs, Match("", "aa007")))["d007"])


def test_filters_never_coerce(spark):
    bodies = [("s", '{"f": "5"}'), ("n", '{"f": 5}'), ("m", '{"f": -2.5}'), ("b", '{"f": true}'), ("z", '{"f": null}'), ("l", '{"f": [5]}'), ("x", "{}")]
    docs = AdHocIndex(spark.createDataFrame(bodies, "document_id string, body string").select("document_id", F.expr("try_variant_get(parse_json(body), '$.f', 'variant')").alias("f")))
    found = lambda q: set(ids(compile_filter(docs, q)))
    assert found(Term("f", "5")) == {"s"} and found(Terms("f", ("5", "6"))) == {"s"} and found(Terms("f", ())) == set()
    assert found(Range("f", gte=5)) == {"n"} and found(Range("f", lt=5)) == {"m"} and found(Range("f")) == set()
    assert found(Exists("f")) == {"s", "n", "m", "b", "l"} and found(Exists("absent")) == set()
    assert found(Bool(must_not=(Term("f", "5"),))) == {"n", "m", "b", "z", "l", "x"}
    assert found(Term("absent", "5")) == set() and found(Range("absent", gt=0)) == set()
    got = ids(order(docs.docs.withColumn("score", F.lit(1.0)), (Sort("f"),)))
    assert got == ["m", "n", "s", "b", "l", "x", "z"]  # numbers, strings, then what is missing, by id
    assert ids(order(docs.docs.withColumn("score", F.lit(1.0)), (Sort("f", True),))) == ["s", "n", "m", "b", "l", "x", "z"]


def test_range_bounds(products):
    found = lambda **k: set(ids(compile_filter(products, Range("price", **k))))
    assert found(gt=45, lte=799) == {"p1", "p3"} and found(gte=45, lt=799) == {"p3", "p5"}
    assert found(gt=100, lt=50) == set() and set(ids(compile_filter(products, Range("title", gt=0)))) == set()


def test_aggregations(spark, products):
    docs = products.docs
    assert [tuple(r) for r in aggregates.terms(docs, "category", 2).collect()] == [("electronics", 2), ("sports", 2)]
    assert aggregates.terms(docs, "category", 0).count() == 0 and aggregates.terms(docs, "price").count() == 0
    row = aggregates.metrics(docs.where("false"), [("price", k) for k in ("count", "min", "max", "avg", "sum")]).first()
    assert tuple(row) == (0, None, None, None, 0.0)
    assert aggregates.metrics(docs, [("title", "count"), ("title", "sum")]).first().asDict() == {"title_count": 0, "title_sum": 0.0}
    assert [tuple(r) for r in aggregates.histogram(docs, "price", 500.0).collect()] == [(0.0, 3), (500.0, 1), (1500.0, 1)]
    both = aggregates.aggregate(docs, (Aggregation("min", "price"), Aggregation("max", "price")))
    assert both["price", "min"].first()["value"] == 25.0 and both["price", "max"].first()["value"] == 1500.0


def test_sorting(spark):
    docs = spark.createDataFrame([("a", "x", 1.0), ("b", "y", None), ("c", "x", 3.0), ("d", None, 3.0)], "document_id string, k string, n double").withColumn("score", F.lit(1.0))
    assert ids(order(docs, (Sort("n"),))) == ["a", "c", "d", "b"] and ids(order(docs, (Sort("n", True),))) == ["c", "d", "a", "b"]
    assert ids(order(docs, (Sort("k"), Sort("n", True)))) == ["c", "a", "b", "d"]
    assert ids(order(docs)) == ["a", "b", "c", "d"] and ids(page(order(docs), 3, 5)) == ["d"]


def test_highlight_and_explain(products):
    got = execute(products, SearchRequest(Match("title", "Bike"), highlight=True, explain=True))
    rows = {r["document_id"]: r["highlighted"] for r in got.hits.collect()}
    assert rows["p1"] == {"title": "electric <em>bike</em>"}  # neither "match" nor "title" is marked
    assert {(r["document_id"], r["term"]) for r in got.explanations.collect()} == {("p1", "bike"), ("p2", "bike")}


def test_stored_index_gives_the_same(spark, products, tmp_path):
    stored = products.save(str(tmp_path / "index"), buckets=4)
    assert isinstance(stored, StoredIndex)
    for q in (Match("", "bike electric sports"), Match("", "bike electric", operator="and"), Phrase("", "electric bike"), Prefix("", "e"), Fuzzy("", "bake", 1)):
        assert scores(compile_query(stored, q)) == pytest.approx(scores(compile_query(products, q)))
    plan = stored.counted(["bike"])[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket#", "bucket#") or "bucket#" in plan.split("PartitionFilters")[1][:200]


def test_compact_ids(spark):
    docs = spark.createDataFrame([(f"id{i % 50:02d}",) for i in range(80)] + [(None,)], "document_id string")
    assert {r[0]: r[1] for r in compact_ids(docs).collect()} == {f"id{i:02d}": i for i in range(50)}


def test_parser_rejects_what_it_does_not_know():
    for body in ({"match": {"a": "b"}, "term": {"a": "b"}}, {"nope": {"a": "b"}}, {"type": "Nope"}, {}, "x", {"match": {"a": "b", "c": "d"}}, {"range": {"a": {"above": 1}}}, {"match": {"a": {"value": "b", "odd": 1}}}):
        with pytest.raises(InvalidQuery):
            parse_query(body)
    for body in ({}, {"query": {"match_all": {}}, "q": "x"}, {"q": "x", "odd": 1}, {"q": "x", "filters": [{"nope": {"a": 1}}]}, {"q": "x", "aggregations": [{"type": "median", "field": "a"}]}, {"q": "x", "size": -1}):
        with pytest.raises(InvalidQuery):
            parse_request(body)


def test_json_round_trip():
    q = Bool(must=(Match("t", "a b", {"a": 2.0}),), should=(DisMax((Term("k", "v"), Prefix("t", "x")), 0.2),), filter=(Range("n", gte=1.0),), must_not=(MultiMatch("w", (("t", 2.0),)),), minimum_should_match=1)
    assert parse_query(q.to_json()) == q
    assert parse_request({"q": "hello"}) == SearchRequest(Match("", "hello"))
    assert SearchRequest(q).key() != SearchRequest(q, filters=(Term("a", "b"),)).key()


def test_logical_plans():
    df = {"rare": 2, "often": 900}
    plan = logical.optimize(logical.build(Match("", "often rare", operator="and"), df))
    assert [c.detail for c in plan.children[0].children] == [("rare",), ("often",)] and plan.cost == 2
    assert logical.optimize(logical.build(Match("", "rare"), df)).children[0].kind == "TermScan"
    assert logical.optimize(logical.union(())) == logical.intersection(())
    assert logical.explain(SearchRequest(MatchNone(), (Term("a", "b"),), size=3)).cost == 0
    assert logical.optimize(logical.build(ConstantScore(Match("", "rare")), df)).children[0].kind == "TermScan"
    text = logical.explain(SearchRequest(Bool(must=(Match("", "rare"),), must_not=(Match("", "often"),))), df).show()
    assert text.startswith("Limit") and "Difference" in text


def test_cache_and_log(spark):
    class Response:
        hits = spark.range(1)

    cache = ResultCache(2)
    for k in "abc":
        cache.put((k,), Response())
    assert cache.get(("a",)) is None and cache.get(("c",)) is not None and cache.rate() == 0.5 and len(cache) == 2
    cache.clear()
    assert len(cache) == 0 and cache.rate() == 0.0
    log = QueryLog(bound=4)
    for i in range(4):
        log.add(f"q{i}", 1.0, i, False)
    log.add("q0", 1.0, 0, True)
    log.add("q9", 1.0, 0, False)
    assert {r[0] for r in log.rows} == {"q0", "q1"}
    assert [tuple(r) for r in top_queries(log.table(spark), 1).collect()] == [("q0", 2)]
