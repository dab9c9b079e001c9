"""Registered queries of what keeps and changes documents: the store, the engine over it, codecs and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.engine import Engine, execute
from siltstone.functions import delta_decode, delta_encode, extract_text, varint_decode, varint_encode
from siltstone.operators import aggregates
from siltstone.operators.compressed import CompressedIndex
from siltstone.operators.index import AdHocIndex
from siltstone.operators.ordering import order, places
from siltstone.plans import logical
from siltstone.plans.compiler import compile_query
from siltstone.plans.dsl import Aggregation, Bool, Fuzzy, Match, Prefix, Range, SearchRequest, Sort, parse_request
from siltstone.queries import PART_TEXT, WORDS, base, holds, matched, parts, register, rounded, scores, simple, table, texts, toks
from siltstone.sources.mapping import Field, Mapping, set_field, set_in_body
from siltstone.sources.scratch import work_folder
from siltstone.sources.segments import MergePolicy, Segment
from siltstone.sources.store import Store

TEXT = Mapping((Field("text"),))


def _batch(rows: DataFrame, key: str, *fields: str) -> DataFrame:
    """A table's rows as a batch of documents."""
    return rows.select(F.col(key).cast("long").alias("seq"), F.col(key).cast("string").alias("id"), F.to_json(F.struct(*fields)).alias("body"))


def _facts(spark: SparkSession, rows: list[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "fact string, value string")


def _thirds(spark: SparkSession, sf_dir: str, segments: int = 2) -> Engine:
    """The documents in an engine by thirds: some flushed as segments, the others in the log; opened again, as after a crash."""
    root = work_folder(spark, "engine")
    engine = Engine(spark, root)
    engine.create_index("docs", TEXT)
    rows = table(spark, sf_dir, "documents")
    for k in range(3):
        engine.store.bulk_add("docs", _batch(rows.where(F.col("doc_id") % 3 == k), "doc_id", "text"))
        if k < segments:
            engine.store.flush("docs")
    return Engine(spark, root)


# the engine over stored postings


@register(f"with {base()} {scores(matched(WORDS))}")
def search_after_crash_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two segments and a log: statistics are those of all documents."""
    return rounded(_thirds(spark, sf_dir).search("docs", {"query": {"match": {"text": WORDS}}}).all_hits)


@register(f"with {base()} {scores(matched('the and of', having='having count(*) = 3'))}")
def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An AND search over three segments, with global statistics."""
    return rounded(_thirds(spark, sf_dir, 3).search_text("docs", "the and of"))


@register(f"with {base('(select * from documents where doc_id % 5 <> 0)')} {scores(matched(WORDS))}")
def stats_after_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removed documents leave postings and statistics at once."""
    engine = _thirds(spark, sf_dir)
    engine.store.bulk_remove("docs", table(spark, sf_dir, "documents").where("doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("id")))
    return rounded(compile_query(engine.index("docs"), Match("", WORDS)))


_prefix_score = "select document_id, sum(part) as score from c where starts_with(term, 'ston') group by 1"


@register(f"with {base()} {scores(_prefix_score)}")
def stored_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compile_query(_thirds(spark, sf_dir).index("docs"), Prefix("", "ston")))


@register(f"""with h as (select *, cast(p_partkey as varchar) as document_id from part where {holds('p_name', 'red blue promo')} and p_retailprice >= 950)
select 'hit' as kind, document_id as key, cast(row_number() over (order by p_retailprice desc, document_id) as double) as value from h qualify value <= 10
union all select 'terms', p_brand, cast(count(*) as double) from h group by 2 union all select 'avg', null, round(avg(p_retailprice), 4) from h union all select 'total', null, cast(count(*) as double) from h""")
def combined_query_filters_sort_aggregations(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, work_folder(spark, "engine"))
    engine.create_index("parts", Mapping((Field("p_name", "text", True), Field("p_brand", "keyword"), Field("p_retailprice", "float"))))
    engine.store.bulk_add("parts", _batch(table(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand", "p_retailprice"))
    engine.store.flush("parts")
    got = engine.search("parts", {"query": {"match": {"p_name": "red blue promo"}}, "filters": [{"range": {"p_retailprice": {"gte": 950}}}], "sort": [{"field": "p_retailprice", "order": "desc"}], "aggregations": [{"type": "terms", "field": "p_brand"}, {"type": "avg", "field": "p_retailprice"}]})
    none = F.lit(None).cast("string")
    page = [(r["document_id"], float(n + 1)) for n, r in enumerate(got.hits.collect())]  # a page of ten
    hits = spark.createDataFrame(page, "key string, value double").select(F.lit("hit").alias("kind"), "key", "value")
    terms = got.aggregations["p_brand", "terms"].select(F.lit("terms"), "key", F.col("count").cast("double"))
    mean = got.aggregations["p_retailprice", "avg"].select(F.lit("avg"), none, F.round("value", 4))
    return hits.union(terms).union(mean).union(got.all_hits.agg(F.count("*").cast("double").alias("n")).select(F.lit("total"), none, "n"))


@register(f"with {base()}, r as ({matched(WORDS)}) select document_id, round(score, 6) as score from r order by r.score desc, document_id limit 7 offset 5")
def legacy_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(execute(texts(spark, sf_dir), parse_request({"q": WORDS, "from": 5, "size": 7})).hits)


@register(f"with {base()} {scores(matched('the electric'))} where document_id in (select cast(doc_id as varchar) from documents where lang = 'en' and n_chars >= 200)")
def dsl_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = {"query": {"match": {"text": "the electric"}}, "filters": [{"term": {"lang": "en"}}, {"range": {"n_chars": {"gte": 200}}}]}
    return rounded(execute(texts(spark, sf_dir), parse_request(body)).all_hits)


@register(f"with {base()}, r as ({matched(WORDS)}), top as (select document_id from r order by score desc, document_id limit 20) select document_id, term, tf, round(part, 6) as contribution from c join top using (document_id) where term in ('the', 'and', 'electric')")
def search_with_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = execute(texts(spark, sf_dir), SearchRequest(Match("", WORDS), size=20, explain=True)).explanations
    return got.select("document_id", "term", "tf", F.round("contribution", 6).alias("contribution"))


@register(f"""with {base()}, a as (select count(*) as n from ({matched('the')})), b as (select count(*) as n from ({matched('eant nton')}))
select 'hits' as fact, '1' as value union all select 'misses', '2' union all select 'rate', '0.333' union all select 'queries', '3' union all select 'top', 'the 2'
union all select 'results the', cast(n as varchar) from a union all select 'results eant nton', cast(n as varchar) from b""")
def query_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline of cache, search and log: the same request again is a hit, whatever its page holds all hits are logged."""
    engine = _thirds(spark, sf_dir)
    for q in ("the", "eant nton", "the"):
        engine.search("docs", SearchRequest(Match("", q), size=1))
    log = engine.log.table(spark)
    top = log.groupBy("query").count().orderBy(F.desc("count")).first()
    results = {r["query"]: r["results"] for r in log.collect()}
    facts = [("hits", engine.cache.hits), ("misses", engine.cache.misses), ("rate", round(engine.cache.rate(), 3)), ("queries", len(engine.log)), ("top", f"{top['query']} {top['count']}")]
    return _facts(spark, facts + [(f"results {q}", n) for q, n in results.items()])


# expansions in a field

_starts = "select document_id, sum(part) as score from c where starts_with(term, '{}') group by 1"
_part_fuzzy = "select document_id, sum(part) as score from c where levenshtein(term, 'promt') <= 1 group by 1"
_in = "{} where document_id in (select cast(p_partkey as varchar) from part where len(list_filter({}, lambda x: {})) > 0)"
simple("prefix_field", Prefix("p_name", "r"), f"with {base('part', 'p_partkey', PART_TEXT)} " + _in.format(scores(_starts.format("r")), toks("p_name"), "starts_with(x, 'r')"), parts)
simple("prefix_field_many_terms", Prefix("text", "th"), f"with {base()} {scores(_starts.format('th'))}")
simple("prefix_number_field", Prefix("p_size", "1"), "select cast(p_partkey as varchar) as document_id, cast(0 as double) as score from part where false", parts)
simple("fuzzy_field", Fuzzy("p_type", "PROMT", 1), f"with {base('part', 'p_partkey', PART_TEXT)} " + _in.format(scores(_part_fuzzy), toks("p_type"), "levenshtein(x, 'promt') <= 1"), parts)


# catalog and documents


@register("select r_regionkey as id, r_name as name, case when r_regionkey = 2 then 'got' else 'there' end as how from region where r_regionkey <> 1")
def add_get_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the first region in bulk, the first alone; one is removed, one is asked for by its id."""
    store = Store(spark, work_folder(spark, "store"))
    store.create("regions")
    rows = table(spark, sf_dir, "region")
    store.bulk_add("regions", _batch(rows.where("r_regionkey > 0"), "r_regionkey", "r_name"))
    first = _batch(rows.where("r_regionkey = 0"), "r_regionkey", "r_name").first()
    store.add("regions", first["id"], first["body"])
    store.remove("regions", "1")
    got = spark.createDataFrame([(2, store.get("regions", "2"))], "id int, body string").withColumn("how", F.lit("got"))
    there = store.bodies("regions").where("id <> '2'").select(F.col("id").cast("int").alias("id"), "body", F.lit("there").alias("how"))
    return there.unionByName(got).select("id", F.get_json_object("body", "$.r_name").alias("name"), "how")


@register("select 'names' as fact, 'nations,regions' as value union all select 'total', cast((select count(*) from nation) + (select count(*) from region) as varchar) union all select 'left', 'nations' union all select 'regions there', 'False' union all select 'nations', (select cast(count(*) as varchar) from nation) || ' n_name:keyword'")
def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, totals and info of two indexes, one of which is deleted."""
    store = Store(spark, work_folder(spark, "store"))
    store.create("regions")
    store.create("nations", Mapping((Field("n_name", "keyword"),)))
    store.bulk_add("regions", _batch(table(spark, sf_dir, "region"), "r_regionkey", "r_name"))
    store.bulk_add("nations", _batch(table(spark, sf_dir, "nation"), "n_nationkey", "n_name"))
    facts = [("names", ",".join(store.names())), ("total", store.total_documents())]
    store.delete("regions")
    info = store.info("nations")
    facts += [("left", ",".join(store.names())), ("regions there", store.exists("regions")), ("nations", f"{info['document_count']} " + ",".join(f"{f['name']}:{f['type']}" for f in info["fields"]))]
    return _facts(spark, facts)


@register("select cast(doc_id as varchar) as id, coalesce(lang, 'none') as lang, source as kind, cast(n_chars as varchar) as n_chars from documents")
def field_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is there is overwritten, a field of a JSON body is added."""
    docs = set_field(table(spark, sf_dir, "documents"), "lang", F.coalesce("lang", F.lit("none")))
    body = set_in_body(F.to_json(F.struct("n_chars", F.lit("old").alias("kind"))), "kind", F.col("source"))
    return docs.select(F.col("doc_id").cast("string").alias("id"), "lang", F.get_json_object(body, "$.kind").alias("kind"), F.get_json_object(body, "$.n_chars").alias("n_chars"))


@register("select cast(event_id as varchar) as document_id, case event_id % 4 when 0 then event_type when 1 then cast(user_id as varchar) when 2 then event_type || ' x' else '' end as text from events")
def extract_text_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings, numbers and the strings of arrays are text; objects aren't."""
    name, user = F.col("event_type"), F.col("user_id")
    value = F.when(F.col("event_id") % 4 == 0, F.to_json(F.array(name))).when(F.col("event_id") % 4 == 1, user.cast("string")).when(F.col("event_id") % 4 == 2, F.concat(F.lit('["'), name, F.lit('", 5, null, "x"]'))).otherwise(F.to_json(F.struct(name)))
    docs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("document_id"), F.try_parse_json(value).alias("v"))
    return docs.select("document_id", extract_text(docs.schema, ["v"]).alias("text"))


# segments


@register("""with s as (select doc_id % 3 + 1 as k, count(*) as n from documents group by 1)
select k as segment_id, n as documents, 'deleted' as state from s union all select 4, sum(n), 'active' from s""")
def flush_and_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after three flushes and a compaction of all."""
    store = _thirds(spark, sf_dir, 3).store
    store.compact("docs")
    return spark.createDataFrame([(s["segment_id"], s["documents"], s["state"]) for s in store.manifest("docs")["registry"]], "segment_id long, documents long, state string")


@register("select case when doc_id % 3 < 2 then 4 else 3 end as segment_id, cast(doc_id as varchar) as id from documents")
def selected_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of three segments are merged, the third isn't touched."""
    store = _thirds(spark, sf_dir, 3).store
    store.compact("docs", [1, 2])
    return store.segments("docs").select("segment_id", "id")


@register("select 3 as segment_id, cast(doc_id as varchar) as id from documents where doc_id % 3 = 2 union all select 4, cast(doc_id as varchar) from documents where doc_id % 6 = 0")
def segment_manager(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment is replaced by half of itself, one is deleted; the manifest agrees with the registry after that."""
    store = _thirds(spark, sf_dir, 3).store
    store.mark_merging("docs", [1])
    store.replace("docs", store.segments("docs", [1]).where("cast(id as long) % 2 = 0"), [1])
    store.delete_segment("docs", 2)
    assert store.sync("docs") == [] and store.missing_segments("docs") == []
    return store.segments("docs").select("segment_id", "id")


@register("""with s as (select p_size as k, count(*) as n from part group by 1), c as (select count(*) as m from s),
p as (select k, n from s order by k limit (select least(20, m, greatest(3, m - 9)) from c))
select cast(k as bigint) as segment_id, cast(sum(n * 100) over () as bigint) as target_bytes from p""")
def merge_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts' sizes as segments, oldest first: those that the policy picks, and the bytes of their merge."""
    rows = table(spark, sf_dir, "part").groupBy("p_size").count().collect()  # metadata: a row a segment
    segments = [Segment(r["p_size"], r["count"], r["count"] * 100, float(r["p_size"])) for r in rows]
    policy = MergePolicy()
    ids = policy.pick(segments)
    return spark.createDataFrame([(i, policy.target_size(segments, ids)) for i in ids], "segment_id long, target_bytes long")


# codecs and compressed lists

_IDS = f"""ids as (select document_id, row_number() over (order by document_id) - 1 as id from (select distinct cast(doc_id as varchar) as document_id from documents)),
l as (select distinct term, id from (select cast(doc_id as varchar) as document_id, unnest({toks("coalesce(text, '')")}) as term from documents) join ids using (document_id))"""


@register(f"with {_IDS}, g as (select term, id - lag(id, 1, 0) over (partition by term order by id) as gap from l) select term, cast(0 as bigint) as block, count(*) as n, cast(sum(greatest(1, ceil(len(bin(gap)) / 7.0))) as bigint) as packed_bytes from g group by 1")
def compressed_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each term's list of document numbers; the tables have fewer documents than a block has numbers."""
    return CompressedIndex.of(texts(spark, sf_dir)).lists.select("term", "block", "n", F.octet_length("data").cast("long").alias("packed_bytes"))


@register(f"with {_IDS} select document_id from l join ids using (id) where term = 'the'")
def compressed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CompressedIndex.of(texts(spark, sf_dir)).postings("the")


@register(f"with {_IDS} select count(distinct term) as terms, count(*) as postings, 8 * count(*) as raw_bytes from l where id in (select id from ids where cast(document_id as bigint) % 4 <> 0)")
def compressed_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter is removed, an eighth added again; terms that no document has are gone."""
    docs = texts(spark, sf_dir).docs
    made = CompressedIndex.of(AdHocIndex(docs, ["text"])).remove(docs.where("doc_id % 4 = 0").select("document_id"))
    back = made.add(AdHocIndex(docs.where("doc_id % 8 = 0"), ["text"])).remove(docs.where("doc_id % 8 = 0").select("document_id"))
    return back.sizes().select("terms", "postings", "raw_bytes")


@register("select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as numbers from orders group by 1")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta and variable-length codes, there and back."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    return lists.select("o_custkey", text(delta_decode(delta_encode(F.col("v")))).alias("keys"), text(varint_decode(varint_encode(F.col("v")))).alias("numbers"))


# aggregations, order, keys and plans


@register("select count(o_totalprice) as count, min(o_totalprice) as min, max(o_totalprice) as max, round(avg(o_totalprice), 4) as avg, round(sum(o_totalprice), 2) as sum from orders")
def agg_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = aggregates.aggregate(table(spark, sf_dir, "orders"), (Aggregation("stats", "o_totalprice"),))["o_totalprice", "stats"]
    return row.withColumns({"avg": F.round("avg", 4), "sum": F.round("sum", 2)})


@register("select l_returnflag, l_linestatus, count(*) as count, round(avg(l_quantity), 6) as l_quantity_avg, max(l_discount) as l_discount_max from lineitem where l_returnflag is not null and l_linestatus is not null group by 1, 2")
def agg_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = aggregates.nested(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], [("l_quantity", "avg"), ("l_discount", "max")])
    return got.withColumn("l_quantity_avg", F.round("l_quantity_avg", 6))


@register("""with e as (select cast(event_id as varchar) as document_id, event_id % 4 as k, event_type as s, user_id as n from events)
select document_id, row_number() over (order by case k when 0 then 0 when 1 then 1 else 2 end, case when k = 0 then n end, case when k = 1 then s end, document_id) as place from e""")
def sort_mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers before strings, what is neither last; the place of every row."""
    k = F.col("event_id") % 4
    value = F.when(k == 0, F.col("user_id").cast("string")).when(k == 1, F.concat(F.lit('"'), "event_type", F.lit('"'))).when(k == 2, "true")
    docs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("document_id"), F.try_parse_json(value).alias("v"))
    return places(order(docs, (Sort("v"),)))


@register("select true as same, true as page_differs, true as filter_differs")
def cache_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys are of the whole request."""
    make = lambda **k: SearchRequest(Match("", "the"), **k).key()
    return spark.createDataFrame([(make() == make(), make() != make(size=3), make() != make(filters=(Range("n_chars", gte=1),)))], "same boolean, page_differs boolean, filter_differs boolean")


_PLAN = Bool(must=(Match("", "the eant", operator="and"),), filter=(Match("", "and"),), must_not=(Match("", "nton"),))


@register(f"""with {base()}, d as (select t, coalesce(max(df), 0) as df from (values ('the'), ('eant'), ('and'), ('nton')) v(t) left join df on term = t group by 1),
x as (select max(df) filter (where t = 'the') as a, max(df) filter (where t = 'eant') as b, max(df) filter (where t = 'and') as c, max(df) filter (where t = 'nton') as n from d)
select kind, sum(cost)::bigint as cost, count(*) as nodes from (
  select unnest(['Limit', 'Filter', 'Difference', 'Intersection', 'Score', 'Score', 'Score', 'Intersection', 'TermScan', 'TermScan', 'TermScan', 'TermScan']) as kind,
    unnest([least(10, least(a, b, c)), least(a, b, c), least(a, b, c), least(a, b, c), least(a, b), c, n, least(a, b), a, b, c, n]) as cost from x) group by 1""")
def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of an optimised plan by kind, with costs from the dictionary."""
    df = {r["term"]: r["df"] for r in texts(spark, sf_dir).dictionary.where(F.col("term").isin("the", "eant", "and", "nton")).collect()}  # four terms
    found: list[tuple[str, int]] = []

    def walk(p: logical.Plan) -> None:
        found.append((p.kind, p.cost))
        for c in p.children:
            walk(c)

    walk(logical.explain(SearchRequest(_PLAN, (Range("n_chars", gte=1),)), df))
    return spark.createDataFrame(found, "kind string, cost long").groupBy("kind").agg(F.sum("cost").alias("cost"), F.count("*").alias("nodes"))
