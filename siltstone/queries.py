"""Registered queries of the search engine, each over whole tables, and their SQL.

Ids are strings; scores are rounded to six digits, so both engines order equal
scores alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.engine import execute, log_summary, top_queries, zero_result_queries
from siltstone.functions import crc32_hex, delta_encode, highlight, highlight_fields, levenshtein_bytes, query_tokens, varint_size
from siltstone.operators import aggregates
from siltstone.operators.index import AdHocIndex, compact_ids
from siltstone.operators.ordering import after, order, page, places
from siltstone.operators.ranking import BM25, best_score, explain, knn, ranked, reciprocal_rank_fusion
from siltstone.plans.compiler import compile_filter, compile_query, expand_fuzzy, expand_prefix
from siltstone.plans.dsl import Aggregation, Bool, ConstantScore, DisMax, Exists, Fuzzy, Match, MatchAll, MatchNone, MultiMatch, Phrase, Prefix, Query, Range, SearchRequest, Sort, Term, Terms
from siltstone.sources.mapping import Field, Mapping
from siltstone.sources.scratch import work_folder
from siltstone.sources.store import Store, apply_log, merge_segments, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"documents": "doc_id", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "pages": "page_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def index(spark: SparkSession, sf_dir: str, name: str, fields: list[str] | None = None) -> AdHocIndex:
    docs = table(spark, sf_dir, name).withColumn("document_id", F.col(KEYS[name]).cast("string"))
    return AdHocIndex(docs, fields)


def texts(spark: SparkSession, sf_dir: str) -> AdHocIndex:
    return index(spark, sf_dir, "documents", ["text"])


def parts(spark: SparkSession, sf_dir: str) -> AdHocIndex:
    return index(spark, sf_dir, "part", ["p_name", "p_brand", "p_type"])


def orders(spark: SparkSession, sf_dir: str) -> AdHocIndex:
    return index(spark, sf_dir, "orders", ["o_orderpriority"])


def register(sql: str | None = None):
    """Adds a function as a query of its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(hits: DataFrame) -> DataFrame:
    return hits.select("document_id", F.round("score", 6).alias("score"))


# SQL parts

SPLIT = r"[\s\x{0b}\x{85}\p{Z}]+"


def toks(expression: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({expression}), '[[:punct:]]', ' ', 'g'), '{SPLIT}'), lambda x: x <> '')"


def base(source: str = "documents", key: str = "doc_id", expression: str = "text", name: str = "", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs: t (document_id, toks), st (n, avgdl), p (document_id, term, tf), df (term, df), c (document_id, term, tf, idf, part)."""
    x = name
    return f"""t{x} as (select cast({key} as varchar) as document_id, {toks(f"coalesce({expression}, '')")} as toks from {source}),
st{x} as (select count(*) as n, avg(len(toks)) as avgdl from t{x}),
p{x} as (select document_id, term, count(*) as tf from (select document_id, unnest(toks) as term from t{x}) group by 1, 2),
df{x} as (select term, count(*) as df from p{x} group by 1),
dl{x} as (select document_id, len(toks) as dl from t{x}),
c{x} as (select p{x}.document_id, p{x}.term, tf, ln(1 + (n - df + 0.5) / (df + 0.5)) as idf, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) as part
  from p{x} join df{x} using (term) join dl{x} using (document_id) cross join st{x})"""


POSITIONS = f"pos as (select document_id, i - 1 as pos, toks[i] as term from (select document_id, toks, unnest(range(1, len(toks) + 1)) as i from (select cast(doc_id as varchar) as document_id, {toks('text')} as toks from documents)))"
PART_TEXT = "concat_ws(' ', p_name, p_brand, p_type)"


def quoted(words: str) -> str:
    return ", ".join(f"'{w}'" for w in dict.fromkeys(words.split()))


def matched(words: str, name: str = "", having: str = "") -> str:
    return f"select document_id, sum(part) as score from c{name} where term in ({quoted(words)}) group by 1 {having}"


def scores(sql: str) -> str:
    return f"select document_id, round(score, 6) as score from ({sql})"


def holds(field: str, words: str) -> str:
    return f"list_has_any({toks(field)}, [{quoted(words)}])"


def simple(name: str, q: Query, sql: str, make=texts, bm25: BM25 | None = None) -> None:
    """Registers a query that compiles ``q`` and returns all its hits."""
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: rounded(compile_query(make(spark, sf_dir), q, bm25))), sql


WORDS = "the and electric"


# tokens, postings and statistics


@register(f"select cast(doc_id as varchar) as document_id, array_to_string({toks('text')}, ' ') as tokens, cast(len({toks('text')}) as bigint) as n from documents")
def tokenize_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).tokens.select("document_id", F.array_join("toks", " ").alias("tokens"), F.size("toks").cast("long").alias("n"))


@register(f"with {POSITIONS} select term, document_id, count(*) as tf, string_agg(cast(pos as varchar), ',' order by pos) as positions from pos group by 1, 2")
def inverted_index_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).postings.select("term", "document_id", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


@register(f"with {POSITIONS}, g as (select term, document_id, pos, pos - lag(pos, 1, 0) over (partition by term, document_id order by pos) as gap from pos) select term, document_id, string_agg(cast(gap as varchar), ',' order by pos) as gaps from g group by 1, 2")
def delta_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).postings.select("term", "document_id", F.array_join(delta_encode(F.col("positions")).cast("array<string>"), ",").alias("gaps"))


@register(f"with {POSITIONS}, g as (select term, pos - lag(pos, 1, 0) over (partition by term, document_id order by pos) as gap from pos) select term, count(*) as n, 8 * count(*) as raw_bytes, cast(sum(greatest(1, ceil(len(bin(gap)) / 7.0))) as bigint) as packed_bytes from g group by 1")
def compressed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each term's positions, as 64-bit integers and as delta + varint."""
    gaps = texts(spark, sf_dir).postings.select("term", F.explode(delta_encode(F.col("positions"))).alias("gap"))
    return gaps.groupBy("term").agg(F.count("*").alias("n"), (F.lit(8) * F.count("*")).alias("raw_bytes"), F.sum(varint_size(F.col("gap"))).cast("long").alias("packed_bytes"))


@register("select cast(doc_id as varchar) as document_id, dense_rank() over (order by cast(doc_id as varchar)) - 1 as compact_id from documents")
def doc_id_mapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact_ids(texts(spark, sf_dir).docs.select("document_id"))


@register(f"with {base()} select cast(n as bigint) as n, cast((select sum(dl) from dl) as bigint) as total_length, round(avgdl, 6) as avgdl from st")
def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).collection.select("n", "total_length", F.round("avgdl", 6).alias("avgdl"))


@register(f"with {base()} select term, count(*) as df, cast(sum(tf) as bigint) as tf from p group by 1")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).dictionary


@register(f"with {base()} select 'indexes' as metric, cast(1 as bigint) as value union all select 'documents', count(*) from t union all select 'fields', 5")
def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and field counts of an index, as the store knows them."""
    store = Store(spark, work_folder(spark, "store"))
    docs = table(spark, sf_dir, "documents")
    store.create("docs", Mapping(tuple(Field(c, "integer" if c in ("doc_id", "n_chars") else "text") for c in docs.columns)))
    store.bulk_add("docs", docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(*docs.columns)).alias("body")))
    info = store.info("docs")
    return spark.createDataFrame([("indexes", len(store.names())), ("documents", info["document_count"]), ("fields", len(info["fields"]))], "metric string, value long")


# BM25

simple("bm25_match_or", Match("", WORDS), f"with {base()} {scores(matched(WORDS))}")
simple("bm25_search_and", Match("", "the and of", operator="and"), f"with {base()} {scores(matched('the and of', having='having count(*) = 3'))}")
simple("bm25_custom_params", Match("", WORDS), f"with {base(k1=1.6, b=0.4)} {scores(matched(WORDS))}", bm25=BM25(1.6, 0.4))
simple("match_boosted", Match("", "the electric eant", {"eant": 3.0}, 2.0), f"with {base()} {scores('''select document_id, sum(part * 2 * case term when 'eant' then 3 else 1 end) as score from c where term in ('the', 'electric', 'eant') group by 1''')}")
simple("match_field_restricted", Match("p_name", "red blue promo"), f"with {base('part', 'p_partkey', PART_TEXT)} {scores(matched('red blue promo'))} where document_id in (select cast(p_partkey as varchar) from part where {holds('p_name', 'red blue promo')})", parts)


@register(f"with {base()} {scores(matched(WORDS))} order by score desc, document_id limit 10")
def bm25_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: the ten best documents of a match, by a top-k and not a full sort."""
    return page(ranked(rounded(compile_query(texts(spark, sf_dir), Match("", WORDS)))))


@register(f"with {base()} select document_id, term, tf, round(idf, 6) as idf, round(part, 6) as contribution from c where term in ({quoted(WORDS)})")
def explain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain(texts(spark, sf_dir), WORDS.split(), BM25()).select("document_id", "term", "tf", F.round("idf", 6).alias("idf"), F.round("contribution", 6).alias("contribution"))


# filters


@register("select cast(doc_id as varchar) as document_id from documents where lang = 'de'")
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_filter(texts(spark, sf_dir), Term("lang", "de"))


@register("select cast(o_orderkey as varchar) as document_id from orders where o_totalprice > 100000 and o_totalprice <= 250000.5 and o_totalprice < 240000")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compile_filter(orders(spark, sf_dir), Range("o_totalprice", gt=100000, lte=250000.5, lt=240000))


@register("select cast(o_orderkey as varchar) as document_id from orders where o_orderstatus in ('F', 'P') and o_orderpriority is not null and o_custkey is not null")
def terms_exists_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Bool(filter=(Terms("o_orderstatus", ("F", "P")), Exists("o_orderpriority"), Exists("o_custkey")))
    return compile_filter(orders(spark, sf_dir), q)


@register("select cast(o_orderkey as varchar) as document_id, cast(1.0 as double) as score from orders where o_orderstatus = 'F' and o_totalprice >= 200000")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = SearchRequest(MatchAll(), (Term("o_orderstatus", "F"), Range("o_totalprice", gte=200000)))
    return execute(orders(spark, sf_dir), request).all_hits.select("document_id", "score")


@register(f"with {base()} {scores(matched('the'))} where document_id in (select document_id from c where term = 'and') and document_id in (select cast(doc_id as varchar) from documents where n_chars between 200 and 2000)")
def filter_by_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A match as a filter is a semi-join; the score stays that of the main query."""
    request = SearchRequest(Match("", "the"), (Match("", "and"), Range("n_chars", gte=200, lte=2000)))
    return rounded(execute(texts(spark, sf_dir), request).all_hits)


# compound queries

simple(
    "bool_full",
    Bool(must=(Match("", "the"),), should=(Match("", "eant"), Match("", "and"), Match("", "bleble")), filter=(Term("lang", "en"), Range("n_chars", gte=100)), must_not=(Match("", "nton"), Term("source", "src8")), minimum_should_match=1),
    f"""with {base()}, s as (select document_id, term, part from c where term in ('the', 'eant', 'and', 'bleble'))
{scores('''select document_id, sum(part) as score from s group by 1 having count(*) filter (where term = 'the') = 1 and count(*) filter (where term <> 'the') >= 1''')}
where document_id in (select cast(doc_id as varchar) from documents where lang = 'en' and n_chars >= 100 and source is distinct from 'src8') and document_id not in (select document_id from c where term = 'nton')""",
)
simple("bool_should", Bool(should=(Match("", "eant"), Match("", "bleble"), Match("", "nton")), minimum_should_match=2), f"with {base()} {scores(matched('eant bleble nton', having='having count(*) >= 2'))}")
simple(
    "bool_optional_should",
    Bool(filter=(Term("lang", "en"),), should=(Match("", "eant"),)),
    f"with {base()} select cast(doc_id as varchar) as document_id, round(coalesce(part, 0), 6) as score from documents left join (select document_id, part from c where term = 'eant') s on s.document_id = cast(doc_id as varchar) where lang = 'en'",
)
simple(
    "multi_match_best_fields",
    MultiMatch("red promo widget", (("p_name", 2.0), ("p_type", 1.0)), 0.3),
    f"""with {base('part', 'p_partkey', 'p_name', '1')}, {base('part', 'p_partkey', 'p_type', '2')},
u as (select document_id, 2 * score as score from ({matched('red promo widget', '1')}) union all select * from ({matched('red promo widget', '2')}))
{scores('select document_id, max(score) + 0.3 * (sum(score) - max(score)) as score from u group by 1')}""",
    parts,
)


def _phrase(slop: int) -> str:
    near = f"select distinct a.document_id from pos a join pos b on a.document_id = b.document_id and a.term = 'of' and b.term = 'the' and b.pos - a.pos - 1 between 0 and {slop}"
    return f"with {base()}, {POSITIONS} {scores(matched('of the', having='having count(*) = 2'))} where document_id in ({near})"


simple("phrase_exact", Phrase("", "of the"), _phrase(0))
simple("phrase_slop", Phrase("text", "Of the", 3), _phrase(3))
simple("prefix_match", Prefix("", "ston rest"), f"with {base()} {scores('''select document_id, sum(part) as score from c where starts_with(term, 'ston') group by 1''')}")
simple("prefix_many_terms", Prefix("", "th"), f"with {base()} {scores('''select document_id, sum(part) as score from c where starts_with(term, 'th') group by 1''')}")
FUZZY = "levenshtein(term, 'that') <= 1 or (levenshtein(term, 'über') <= 1)"
simple("fuzzy_match", Fuzzy("", "That über", 1), f"with {base()} {scores(f'select document_id, sum(part) as score from c where {FUZZY} group by 1')}")


@register(f"with {base()} select term from df where levenshtein(term, 'über') <= 2 and starts_with(term, 'ü')")
def fuzzy_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_fuzzy(texts(spark, sf_dir), Fuzzy("", "über", 2, 2))


@register(f"with {base()} select term from df where starts_with(term, 'onth')")
def prefix_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expand_prefix(texts(spark, sf_dir), Prefix("", "Onth"))


@register(f"with {base()} select term, cast(levenshtein(term, 'électrique') as bigint) as distance from df")
def levenshtein_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).dictionary.select("term", levenshtein_bytes(F.col("term"), F.lit("électrique")).cast("long").alias("distance"))


simple("constant_score", ConstantScore(Match("", "eant nton"), 2.5), f"with {base()} select distinct document_id, cast(2.5 as double) as score from c where term in ('eant', 'nton')")
simple(
    "dis_max",
    DisMax((Match("", "the"), Match("", "eant nton"), ConstantScore(Term("lang", "de"), 0.5)), 0.4),
    f"""with {base()}, u as (select * from ({matched('the')}) union all select * from ({matched('eant nton')}) union all select cast(doc_id as varchar), 0.5 from documents where lang = 'de')
{scores('select document_id, max(score) + 0.4 * (sum(score) - max(score)) as score from u group by 1')}""",
)
simple("match_all", MatchAll(), "select cast(doc_id as varchar) as document_id, cast(1.0 as double) as score from documents")
simple("match_none", MatchNone(), "select cast(doc_id as varchar) as document_id, cast(1.0 as double) as score from documents where false")


@register(f"with {base()}, a as (select document_id from c where term = 'the'), b as (select document_id from c where term = 'eant') select 'intersection' as op, document_id from a where document_id in (from b) union all select 'union', document_id from (select * from a union select * from b) union all select 'difference', document_id from a where document_id not in (from b)")
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir)
    a, b = (compile_filter(found, Match("", t)) for t in ("the", "eant"))
    made = (("intersection", a.join(b, "document_id", "left_semi")), ("union", a.union(b).distinct()), ("difference", a.join(b, "document_id", "left_anti")))
    one, two, three = (df.select(F.lit(op).alias("op"), "document_id") for op, df in made)
    return one.union(two).union(three)


# aggregations


@register("select lang as key, count(*) as count from documents where lang is not null group by 1")
def agg_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.terms(table(spark, sf_dir, "documents"), "lang")


@register("select o_orderpriority as key, count(*) as count from orders where o_orderpriority is not null group by 1 order by 2 desc, 1 limit 2")
def agg_terms_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.terms(table(spark, sf_dir, "orders"), "o_orderpriority", 2)


@register("select count(l_extendedprice) as l_extendedprice_count, min(l_quantity) as l_quantity_min, max(l_discount) as l_discount_max, round(avg(l_extendedprice), 4) as l_extendedprice_avg, round(sum(l_extendedprice), 2) as l_extendedprice_sum, cast(0 as double) as l_comment_sum, cast(0 as bigint) as l_comment_count from lineitem")
def agg_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [("l_extendedprice", "count"), ("l_quantity", "min"), ("l_discount", "max"), ("l_extendedprice", "avg"), ("l_extendedprice", "sum"), ("l_comment", "sum"), ("l_comment", "count")]
    row = aggregates.metrics(table(spark, sf_dir, "lineitem"), wanted)
    return row.withColumns({"l_extendedprice_avg": F.round("l_extendedprice_avg", 4), "l_extendedprice_sum": F.round("l_extendedprice_sum", 2)})


@register("select floor(l_extendedprice / 5000) * 5000 as key, count(*) as count from lineitem group by 1")
def agg_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 5000.0)


@register("select l_returnflag, l_linestatus, count(*) as count from lineitem group by 1, 2")
def agg_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.facets(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"])


@register(f"""with {base()}, h as (select d.* from documents d join ({matched('the eant')}) s on s.document_id = cast(d.doc_id as varchar) where n_chars >= 200)
select 'terms' as kind, lang as key, cast(count(*) as double) as value from h where lang is not null group by 2
union all select 'avg', null, round(avg(n_chars), 4) from h union all select 'max', null, cast(max(n_chars) as double) from h union all select 'total', null, cast(count(*) as double) from h""")
def search_with_aggs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aggregations and the total over all filtered hits, not over the page."""
    request = SearchRequest(Match("", "the eant"), (Range("n_chars", gte=200),), aggregations=(Aggregation("terms", "lang"), Aggregation("avg", "n_chars"), Aggregation("max", "n_chars")), size=3)
    got = execute(texts(spark, sf_dir), request)
    found = got.aggregations
    rows = found["lang", "terms"].select(F.lit("terms").alias("kind"), "key", F.col("count").cast("double").alias("value"))
    for kind in ("avg", "max"):
        rows = rows.union(found["n_chars", kind].select(F.lit(kind), F.lit(None).cast("string"), F.round("value", 4)))
    return rows.union(got.all_hits.agg(F.count("*").cast("double").alias("n")).select(F.lit("total"), F.lit(None).cast("string"), "n"))


# order and pages

_by_status = "order by o_orderstatus asc nulls last, o_totalprice desc nulls last, cast(o_orderkey as varchar)"


@register(f"select cast(o_orderkey as varchar) as document_id, row_number() over ({_by_status}) as place from orders where o_totalprice >= 1000")
def sort_multi_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every row by several fields."""
    request = SearchRequest(MatchAll(), (Range("o_totalprice", gte=1000),), (Sort("o_orderstatus"), Sort("o_totalprice", True)))
    return places(order(execute(orders(spark, sf_dir), request).all_hits, request.sort))


@register("with j as (select cast(o_orderkey as varchar) as document_id, e.value from orders left join events e on e.event_id = o_orderkey * 7) select document_id, row_number() over (order by value desc nulls last, document_id) as place from j")
def sort_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "value")
    docs = orders(spark, sf_dir).docs
    joined = docs.join(events, events["event_id"] == docs["o_orderkey"] * 7, "left")
    return places(order(joined, (Sort("value", True),)))


@register(f"with {base()}, r as ({scores(matched(WORDS))}) select document_id, score from r order by score desc, document_id limit 10 offset 20")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(ranked(rounded(compile_query(texts(spark, sf_dir), Match("", WORDS)))), 20, 10)


@register(f"with {base()}, r as ({scores(matched(WORDS))}) select document_id, score from r where score < 1.5 or (score = 1.5 and document_id > '5') order by score desc, document_id limit 10")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(ranked(after(rounded(compile_query(texts(spark, sf_dir), Match("", WORDS))), 1.5, "5")))


@register(f"with {base()} select count(*) as total from ({matched(WORDS)})")
def total_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return execute(texts(spark, sf_dir), SearchRequest(Match("", WORDS), size=0)).all_hits.agg(F.count("*").alias("total"))


# highlighting

_words = f"list_filter(regexp_split_to_array(text, '{SPLIT}'), lambda x: x <> '')"
_marked = f"array_to_string(list_transform({_words}, lambda w: case when list_contains(['the', 'electric'], regexp_replace(lower(w), '^[[:punct:]]+|[[:punct:]]+$', '', 'g')) then '<em>' || w || '</em>' else w end), ' ')"


@register(f"select cast(doc_id as varchar) as document_id, case when len({_words}) = 0 then text else {_marked} end as highlighted from documents")
def highlight_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir).docs.select("document_id", highlight(F.col("text"), query_tokens("The electric")).alias("highlighted"))


@register(f"with h as (select cast(doc_id as varchar) as document_id, text, case when len({_words}) = 0 then text else {_marked} end as highlighted from documents) select document_id, highlighted from h where highlighted <> text")
def highlight_changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = texts(spark, sf_dir).docs.select("document_id", highlight_fields(["text", "lang"], query_tokens("The electric")).alias("h"))
    return marked.select("document_id", F.col("h")["text"].alias("highlighted")).where("highlighted is not null")


# query log


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a log of queries."""
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("query"), F.col("value").alias("milliseconds"), F.col("user_id").alias("results"), (F.col("user_id") % 2 == 0).alias("cached"))


@register("select event_type as query, count(*) as count from events group by 1 order by 2 desc, 1 limit 3")
def query_analytics_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_queries(_log(spark, sf_dir), 3)


@register("select event_type as query, count(*) as count from events where user_id = 0 group by 1")
def zero_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zero_result_queries(_log(spark, sf_dir))


@register("select count(*) as total, round(avg(value), 6) as avg_milliseconds, round(avg(case when user_id % 2 = 0 then 1.0 else 0.0 end), 6) as cache_rate from events")
def query_log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_summary(_log(spark, sf_dir)).select("total", F.round("avg_milliseconds", 6).alias("avg_milliseconds"), F.round("cache_rate", 6).alias("cache_rate"))


# ingest and storage


@register("select cast(conv_id as varchar) as id, text as body from conversations qualify row_number() over (partition by conv_id order by turn) = 1")
def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What compaction does: the oldest segment wins an id."""
    return merge_segments(table(spark, sf_dir, "conversations").select(F.col("turn").alias("segment_id"), F.col("conv_id").cast("string").alias("id"), F.col("text").alias("body")))


@register("""with r as (select conv_id * 100000 + turn as seq, case when role = 'system' then 'no id' else cast(conv_id as varchar) end as id, role, length(text) as n from conversations),
e as (select seq, id, role = 'system' as bad_id, n % 5 = 0 as bad_body, n from r),
s as (select seq, id, case when bad_id then 'the id has a character that isn''t allowed' when bad_body then 'field ''n'' isn''t of type integer' end as error from e)
select seq, id, case when error is null and row_number() over (partition by id, error is null order by seq) > 1 then 'the id is repeated in the batch' else error end as error from s""")
def bulk_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    n = F.length("text")
    body = F.when(n % 5 == 0, F.to_json(F.struct(n.cast("string").alias("n")))).otherwise(F.to_json(F.struct(n.alias("n"))))
    batch = rows.select((F.col("conv_id") * 100_000 + F.col("turn")).alias("seq"), F.when(F.col("role") == "system", "no id").otherwise(F.col("conv_id").cast("string")).alias("id"), body.alias("body"))
    return validate(batch, Mapping((Field("n", "integer", True),))).select("seq", "id", "error")


@register(f"with {base()}, u as (select * from ({matched('the')}) union all select * from ({matched('the eant')})) {scores('select document_id, max(score) as score from u group by 1')}")
def merge_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir)
    return rounded(best_score(compile_query(found, Match("", "the")).union(compile_query(found, Match("", "the eant")))))


_segmented = "select cast(doc_id as varchar) as document_id, doc_id % 3 as segment_id, text from documents"


@register(" union all ".join(f"select cast({k} as bigint) as segment_id, document_id, score from (with s as (select * from ({_segmented}) where segment_id = {k}), {base('s', 'document_id')} {scores(matched('the and', having='having count(*) = 2'))})" for k in range(3)))
def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An AND search in each segment, by the segment's own statistics."""
    docs, out = texts(spark, sf_dir).docs, None
    for k in range(3):
        own = AdHocIndex(docs.where(F.col("doc_id") % 3 == k), ["text"])
        hits = rounded(compile_query(own, Match("", "the and", operator="and"))).select(F.lit(k).cast("long").alias("segment_id"), "document_id", "score")
        out = hits if out is None else out.union(hits)
    return out


@register("select cast(doc_id as varchar) as id, text as body from documents where doc_id % 5 <> 0 and doc_id % 7 <> 0 union all select cast(doc_id as varchar), lang from documents where doc_id % 7 = 0")
def change_log_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document is removed, every seventh is removed and added again with another body."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("doc_id").cast("string").alias("id"), "text", "lang")
    removed = docs.where("doc_id % 5 = 0 or doc_id % 7 = 0").select(F.lit(1).cast("long").alias("seq"), F.lit("remove").alias("op"), "id", F.lit(None).cast("string").alias("body"))
    added = docs.where("doc_id % 7 = 0").select(F.lit(2).cast("long").alias("seq"), F.lit("add").alias("op"), "id", F.col("lang").alias("body"))
    return apply_log(docs.select("id", F.col("text").alias("body")), removed.union(added))


@register()
def document_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRC-32 of each text; DuckDB has no such function, a test compares it with zlib."""
    return texts(spark, sf_dir).docs.select("document_id", crc32_hex(F.col("text")).alias("crc32"))


@register("select cast(doc_id as varchar) as id, lang, source, n_chars from documents")
def snapshot_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents go into an index, a snapshot of it is taken and restored as another index, which is read."""
    root = work_folder(spark, "snapshot")
    store = Store(spark, f"{root}/store")
    store.create("docs", Mapping((Field("lang", "keyword"), Field("source", "keyword"), Field("n_chars", "integer"))))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct("lang", "source", "n_chars")).alias("body"))
    store.bulk_add("docs", docs)
    store.snapshot("docs", f"{root}/copy")
    store.restore(f"{root}/copy", "again")
    return store.documents("again").select(F.col("document_id").alias("id"), "lang", "source", "n_chars")


@register("select cast(conv_id as varchar) as id, text as body from conversations qualify row_number() over (partition by conv_id order by turn desc) = 1")
def streaming_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations as a change feed, by Structured Streaming; the last turn of each is what stays."""
    from siltstone.streaming.ingest import ingest

    root = work_folder(spark, "ingest")
    store = Store(spark, f"{root}/store")
    store.create("turns")
    rows = table(spark, sf_dir, "conversations").select(F.col("turn").alias("seq"), F.lit("add").alias("op"), F.col("conv_id").cast("string").alias("id"), F.to_json(F.struct("text")).alias("body"))
    rows.write.parquet(f"{root}/feed")
    ingest(spark.readStream.schema(rows.schema).parquet(f"{root}/feed"), store, "turns", f"{root}/checkpoint").awaitTermination()
    return store.bodies("turns").select("id", F.get_json_object("body", "$.text").alias("body"))


# vectors and fusion

VECTOR = [((i * 37) % 64 - 31.5) / 100 for i in range(64)]
_v = "[" + ", ".join(f"cast({x!r} as double)" for x in VECTOR) + "]"
_e = "cast(embedding as double[])"
_dot = f"list_sum(list_transform(list_zip({_e}, {_v}), lambda z: z[1] * z[2]))"
_norm = f"sqrt(list_sum(list_transform({_e}, lambda z: z * z))) * sqrt(list_sum(list_transform({_v}, lambda z: z * z)))"


def _knn(name: str, metric: str, score: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(knn(table(spark, sf_dir, "embeddings"), VECTOR, 10, metric))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"select cast(vec_id as varchar) as document_id, round({score}, 6) as score from embeddings order by {score} desc, document_id limit 10"


_knn("knn_cosine", "cosine", f"{_dot} / ({_norm})")
_knn("knn_dot", "dot", _dot)
_knn("knn_euclidean", "euclidean", f"1 / (1 + sqrt(list_sum(list_transform(list_zip({_e}, {_v}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))))")

_ranks = "select document_id, row_number() over (order by round(score, 6) desc, document_id) as r from ({}) qualify r <= 50"


@register(f"""with {base()}, a as ({_ranks.format(matched('the eant'))}), b as ({_ranks.format(matched('and nton'))})
select document_id, round(sum(s), 6) as score from (select document_id, 1.0 / (60 + r) as s from a union all select document_id, 0.5 / (60 + r) from b) group by 1""")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts(spark, sf_dir)
    lists = [page(ranked(rounded(compile_query(found, Match("", q)))), 0, 50) for q in ("the eant", "and nton")]
    return rounded(reciprocal_rank_fusion(lists, [1.0, 0.5]))
