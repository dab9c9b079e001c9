"""The engine: requests against indexes, with a cache and a query log."""

from __future__ import annotations

import time
from collections import Counter, OrderedDict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import highlight_fields, query_tokens
from siltstone.operators.aggregates import aggregate
from siltstone.operators.index import AdHocIndex
from siltstone.operators.ordering import order, page
from siltstone.operators.ranking import BM25, explain
from siltstone.operators.segmented import SegmentedIndex, write_postings
from siltstone.plans import logical
from siltstone.plans.compiler import compile_filter, compile_query, predicate
from siltstone.plans.dsl import Aggregation, Bool, ConstantScore, DisMax, Match, MatchAll, Query, SearchRequest, parse_request
from siltstone.sources.mapping import Mapping, typed, with_fields
from siltstone.sources.scratch import work_folder
from siltstone.sources.store import BUCKETS, Store, apply_log

#: Bytes of a change log up to which its ids are broadcast; they are a small part of it.
BROADCAST_BYTES = 64 << 20


@dataclass
class SearchResponse:
    """``hits`` is a page of ``(index, document_id, score, ...)``; ``all_hits`` is before paging."""

    hits: DataFrame
    all_hits: DataFrame
    aggregations: dict[tuple[str, str], DataFrame]
    explanations: DataFrame | None = None
    counted: int | None = None

    def total(self) -> int:
        """Hits before paging; counted once."""
        if self.counted is None:
            self.counted = self.all_hits.count()
        return self.counted


def fields_of(request: SearchRequest) -> list[str]:
    """Every field that a request names."""
    found: list[str] = []

    def walk(q: Query) -> None:
        if getattr(q, "field", ""):
            found.append(q.field)
        found.extend(f for f, _ in getattr(q, "fields", ()))
        for name in ("must", "should", "filter", "must_not", "queries"):
            for s in getattr(q, name, ()):
                walk(s)
        if isinstance(getattr(q, "query", None), Query):
            walk(q.query)

    for q in (request.query, *request.filters):
        walk(q)
    found += [s.field for s in request.sort] + [a.field for a in request.aggregations]
    return list(dict.fromkeys(found))


def query_text(q: Query) -> str:
    """The words that a query looks for, without field names: what a log and highlighting need."""
    if isinstance(q, Bool):
        return " ".join(filter(None, map(query_text, q.must + q.should)))
    if isinstance(q, DisMax):
        return " ".join(filter(None, map(query_text, q.queries)))
    if isinstance(q, ConstantScore):
        return query_text(q.query)
    return str(getattr(q, "value", ""))


def execute(index: AdHocIndex, request: SearchRequest, bm25: BM25 | None = None, name: str = "") -> SearchResponse:
    """Run a request. The page is one plan; hits are joined with documents only for what reads fields.

    Filters that are conditions on rows select documents in the scan; others are
    semi-joins. Sorting by score with a limit is a top-k, not a full sort.
    """
    bm25 = bm25 or BM25()
    rows, kept, joins = index.docs, [], []
    for f in request.filters:
        condition = predicate(index, f)
        if condition is None:
            joins.append(compile_filter(index, f, bm25))
        else:
            kept.append(condition)
            rows = rows.where(condition)
    needs_fields = bool(request.sort or request.aggregations or request.highlight)
    if isinstance(request.query, MatchAll):  # every row is a hit: nothing to join
        hits = rows.withColumn("score", F.lit(1.0))
    else:
        # Conditions on rows are told in the scan that counts words, if the index can.
        view = index.among(reduce(lambda a, b: a & b, kept)) if kept and isinstance(request.query, Match) else None
        hits = compile_query(view or index, request.query, bm25)
        if needs_fields:
            hits = rows.join(hits, "document_id")
        elif rows is not index.docs and view is None:
            hits = hits.join(rows.select("document_id"), "document_id", "left_semi")
    for ids in joins:
        hits = hits.join(ids, "document_id", "left_semi")
    out = page(order(hits, request.sort), request.offset, request.size)
    columns = [F.lit(name).alias("index"), F.col("document_id"), F.col("score")]
    if request.highlight:
        strings = [f.name for f in index.docs.schema.fields if f.dataType.typeName() == "string" and f.name != "document_id"]
        columns.append(highlight_fields(strings, query_tokens(query_text(request.query))).alias("highlighted"))
    explanations = explain(index, query_tokens(query_text(request.query)), bm25).join(out.select("document_id"), "document_id", "left_semi") if request.explain else None
    return SearchResponse(out.select(*columns), hits, aggregate(hits, request.aggregations), explanations)


class ResultCache:
    """The latest responses by index version and the whole request; the least recently used goes first."""

    def __init__(self, capacity: int = 1000):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self._kept: OrderedDict[tuple, SearchResponse] = OrderedDict()

    def get(self, key: tuple) -> SearchResponse | None:
        found = self._kept.get(key)
        if found is None:
            self.misses += 1
        else:
            self.hits += 1
            self._kept.move_to_end(key)
        return found

    def put(self, key: tuple, response: SearchResponse) -> None:
        self._kept[key] = response
        self._kept.move_to_end(key)
        while len(self._kept) > self.capacity:
            _, old = self._kept.popitem(last=False)
            old.hits.unpersist()

    def rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0

    def clear(self) -> None:
        for r in self._kept.values():
            r.hits.unpersist()
        self._kept.clear()
        self.hits = self.misses = 0

    def __len__(self) -> int:
        return len(self._kept)


LOG_ROW = "query string, milliseconds double, results long, cached boolean"


@dataclass
class QueryLog:
    """Queries as rows. The latest are kept in memory; at ``keep`` rows they are written to ``folder``, if there is one.

    With a ``bound``, off by default, the less frequent half is forgotten once
    there are so many texts in memory.
    """

    bound: int | None = None
    spark: SparkSession | None = None
    folder: str | None = None
    keep: int = 1000
    rows: list[tuple[str, float, int, bool]] = field(default_factory=list)
    written: int = 0
    _count: Counter[str] = field(default_factory=Counter)

    def add(self, text: str, milliseconds: float, results: int, cached: bool) -> None:
        self.rows.append((text, float(milliseconds), results, cached))
        self._count[text] += 1
        if self.bound is not None and len(self._count) > self.bound:
            keep = sorted(self._count, key=lambda t: (-self._count[t], t))[: self.bound // 2]
            self._count = Counter({t: self._count[t] for t in keep})
            self.rows = [r for r in self.rows if r[0] in self._count]
        if self.folder and len(self.rows) >= self.keep:
            self.flush()

    def flush(self) -> None:
        """Write the rows in memory."""
        if self.folder and self.rows:
            self.spark.createDataFrame(self.rows, LOG_ROW).coalesce(1).write.mode("append").parquet(self.folder)
            self.written += len(self.rows)
            self.rows, self._count = [], Counter()

    def __len__(self) -> int:
        """Queries since the log was opened, forgotten ones left out."""
        return self.written + len(self.rows)

    def table(self, spark: SparkSession) -> DataFrame:
        """All rows, those in memory and those that were written."""
        now = spark.createDataFrame(self.rows, LOG_ROW)
        return now.unionByName(spark.read.schema(LOG_ROW).parquet(self.folder)) if self.written else now


def top_queries(log: DataFrame, n: int = 10) -> DataFrame:
    """``(query, count)`` of the most frequent queries."""
    return log.groupBy("query").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "query").limit(n)


def zero_result_queries(log: DataFrame) -> DataFrame:
    """``(query, count)`` of queries without results."""
    return log.where("results = 0").groupBy("query").agg(F.count("*").alias("count"))


def log_summary(log: DataFrame) -> DataFrame:
    """One row: number of queries, mean latency, share of cached answers."""
    return log.agg(F.count("*").alias("total"), F.avg("milliseconds").alias("avg_milliseconds"), F.coalesce(F.avg(F.col("cached").cast("double")), F.lit(0.0)).alias("cache_rate"))


class Engine:
    """Indexes kept under ``root``, and search over them."""

    def __init__(self, spark: SparkSession, root: str, bm25: BM25 | None = None, cache: int = 1000):
        self.spark, self.store, self.bm25 = spark, Store(spark, root), bm25 or BM25()
        self.cache, self.log = ResultCache(cache), QueryLog(spark=spark, folder=f"{root.rstrip('/')}/_queries")
        self.metrics_started = time.time()
        self._texts: dict[str, tuple[tuple[str, int], AdHocIndex]] = {}

    def create_index(self, name: str, mapping: Mapping | None = None, buckets: int = BUCKETS) -> None:
        """``buckets`` is the number of parts of the postings' terms, of which a query reads those of its own; more for large indexes."""
        self.store.create(name, mapping, buckets)

    def index(self, name: str, fields: list[str] | None = None) -> SegmentedIndex:
        """All of a document is searched: the declared fields, and what else its body has.

        Segments are searched by their stored postings, which are written by the
        first search after a segment; what is only in the log is indexed in the scan.
        """
        manifest, root = self.store.manifest(name), f"{self.store.files.root}/{name}"
        mapping, log = self.store.mapping(name), self.store.log(name)
        for s in manifest["segments"]:
            if not self.store.files.exists(f"{name}/postings/segment={s}/_SUCCESS"):
                own = self._searchable(typed(self.store.segments(name, [s]).select("id", "body"), mapping), name)
                write_postings(own, root, s, manifest["buckets"], self.store.files.size(f"{name}/segments/{s:06d}"))
        changed = None
        if manifest["batches"]:
            changed = log.select(F.col("id").alias("document_id")).distinct()
            changed = F.broadcast(changed) if self.store.files.size(f"{name}/log") <= BROADCAST_BYTES else changed
        fresh = self._fresh(name, log, mapping)
        docs = self._searchable(self.store.documents(name), name, fields)
        return SegmentedIndex(docs.docs, docs.fields, root, manifest["segments"], manifest["buckets"], fresh, changed)

    def _fresh(self, name: str, log: DataFrame, mapping: Mapping) -> AdHocIndex:
        """The documents that the log adds, as an index; their text is written once for a state of the log, since a search reads it several times."""
        version = self.store.version(name)
        if self._texts.get(name, (None,))[0] != version:
            nothing = self.spark.createDataFrame([], "id string, body string")
            own = self._searchable(typed(apply_log(nothing, log), mapping), name)
            path = work_folder(self.spark, "fresh")
            own.docs.select("document_id", own.text().alias("text")).write.parquet(path)
            self._texts[name] = version, AdHocIndex(self.spark.read.schema("document_id string, text string").parquet(path), ["text"])
        return self._texts[name][1]

    def _searchable(self, docs: DataFrame, name: str, fields: list[str] | None = None) -> AdHocIndex:
        """Typed documents as an index of all their text."""
        docs = with_fields(docs, fields or [])
        declared = [f.name for f in self.store.mapping(name).fields]
        # The whole body once; declared fields would count twice.
        others = F.map_filter(F.try_variant_get("extra", "$", "map<string,variant>"), lambda k, v: ~k.isin(*declared) if declared else F.lit(True))
        keys = F.array_sort(F.map_keys(others))
        scalar = F.transform(keys, lambda k: _scalar_text(F.element_at(others, k)))
        docs = docs.withColumn("other_text", F.array_join(F.filter(scalar, lambda s: s.isNotNull()), " "))
        return AdHocIndex(docs.drop("extra"), [*declared, "other_text"])

    def search(self, name: str, request: SearchRequest | dict) -> SearchResponse:
        request = parse_request(request) if isinstance(request, dict) else request
        key = (name, *self.store.version(name), request.key())
        begun = time.time()
        found = self.cache.get(key)
        if found is None:
            response = execute(self.index(name, fields_of(request)), request, self.bm25, name)
            response.hits = response.hits.persist()
            self.cache.put(key, response)
        else:
            response = found
        self.log.add(query_text(request.query), (time.time() - begun) * 1000, response.total(), found is not None)
        return response

    def search_text(self, name: str, text: str) -> DataFrame:
        """Free text: documents that hold every word, best first."""
        return order(compile_query(self.index(name), Match("", text, operator="and"), self.bm25))

    def explain_plan(self, request: SearchRequest | dict) -> logical.Plan:
        return logical.explain(parse_request(request) if isinstance(request, dict) else request)

    def aggregate(self, name: str, wanted: tuple[Aggregation, ...]) -> dict[tuple[str, str], DataFrame]:
        return aggregate(self.index(name, [a.field for a in wanted]).docs, wanted)

    def metrics(self) -> dict[str, float]:
        return {"indexes": len(self.store.names()), "documents": self.store.total_documents(), "queries": len(self.log), "cache_rate": self.cache.rate(), "uptime_seconds": time.time() - self.metrics_started}


def _scalar_text(v):
    kind = F.schema_of_variant(v)
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    joined = F.array_join(F.filter(items, lambda s: s.isNotNull()), " ")
    return F.when(kind.startswith("ARRAY"), joined).when(~kind.startswith("OBJECT") & (kind != "VOID"), F.try_variant_get(v, "$", "string"))
