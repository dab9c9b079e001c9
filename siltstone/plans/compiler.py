"""Queries to DataFrames.

Each variant becomes a plan of ``(document_id, score)`` with one row a
document; what only filters becomes ``(document_id)``. Statistics always come
from the whole collection, so filters never change a score.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import InvalidQuery
from siltstone.functions import levenshtein_bytes, normalize, query_tokens, split_tokens, tokenize
from siltstone.operators import filters as P
from siltstone.operators.index import AdHocIndex
from siltstone.operators.ranking import BM25, Words, combine, evaluate, scored
from siltstone.plans.dsl import Bool, ConstantScore, DisMax, Exists, Fuzzy, Match, MatchAll, MatchNone, MultiMatch, Phrase, Prefix, Query, Range, Term, Terms

#: A condition on terms.
Condition = Callable[[Column], Column]


def predicate(index: AdHocIndex, q: Query) -> Column | None:
    """The query as a condition on a row of the documents, if it is one."""
    schema = index.docs.schema
    if isinstance(q, Term):
        return P.term_filter(schema, q.field, q.value)
    if isinstance(q, Terms):
        return P.terms_filter(schema, q.field, q.values)
    if isinstance(q, Exists):
        return P.exists_filter(schema, q.field)
    if isinstance(q, Range):
        return P.range_filter(schema, q.field, q.gt, q.gte, q.lt, q.lte)
    if isinstance(q, MatchAll):
        return F.lit(True)
    if isinstance(q, MatchNone):
        return F.lit(False)
    if isinstance(q, ConstantScore):
        return predicate(index, q.query)
    return None


def _holds(index: AdHocIndex, field: str, terms: list[str]) -> Column:
    """Whether a string field has one of the terms."""
    return _overlap(normalize(P.string_value(index.docs.schema, field)), terms)


def _overlap(normal: Column, terms: list[str]) -> Column:
    """Whether a normalised text has one of the terms; an empty one splits to an empty word, which is none of them."""
    return F.arrays_overlap(F.split(normal, " "), F.array(*[F.lit(t) for t in terms]))


def _normal_field(index: AdHocIndex, field: str) -> DataFrame:
    """``(document_id, normal)`` of a string field: by a generator, so that a condition on it doesn't read and normalise the field again."""
    made = F.struct(normalize(P.string_value(index.docs.schema, field)).alias("normal"))
    return index.docs.select("document_id", F.inline(F.array(made)))


def near_tokens(q: Fuzzy) -> Condition:
    """Whether a term is near a token of the query."""

    def near(term: Column) -> Column:
        out = []
        for t in dict.fromkeys(query_tokens(q.value)):
            size = len(t.encode())
            start = t.encode()[: q.prefix_length].decode("utf-8", "ignore")
            # Lengths that differ by more than the distance can't be near: a cheap test before the costly one.
            out.append(F.octet_length(term).between(size - q.max_edit_distance, size + q.max_edit_distance) & term.startswith(start) & (levenshtein_bytes(term, F.lit(t)) <= q.max_edit_distance))
        return reduce(lambda a, b: a | b, out, F.lit(False))

    return near


def prefixed(q: Prefix) -> Condition:
    """Whether a term begins with the query's first token; nothing does with an empty one."""
    tokens = query_tokens(q.value)
    return lambda term: term.startswith(tokens[0]) if tokens else F.lit(False)


def expand_fuzzy(index: AdHocIndex, q: Fuzzy) -> DataFrame:
    """Distinct dictionary terms near a token of the query."""
    return index.dictionary.select("term").where(near_tokens(q)(F.col("term")))


def expand_prefix(index: AdHocIndex, q: Prefix) -> DataFrame:
    """Dictionary terms that begin with the query's first token."""
    return index.dictionary.select("term").where(prefixed(q)(F.col("term")))


def _expanded(index: AdHocIndex, wanted: Condition, held: Column | None, bm25: BM25, field: str) -> DataFrame:
    """Match over the terms that meet a condition, one plan however many they are.

    As in a match, scores are of all text, and ``field`` says in which string field one of the terms must be.
    """
    own = None
    if field and not index.is_all_text(field):
        own = F.exists(tokenize(P.string_value(index.docs.schema, field)), wanted)
    view = index if own is None else index.among(own)
    rows = (view or index).matching(wanted, held).crossJoin(F.broadcast(index.collection))  # one row
    part = bm25.idf(F.col("n"), F.col("df")) * bm25.weight(F.col("tf"), F.col("dl"), F.col("avgdl"))
    if "hit" in rows.columns:
        rows = rows.where("hit")
    hits = rows.groupBy("document_id").agg(F.sum(part).alias("score"))
    return hits if view or own is None else hits.join(_normal_field(index, field).where(F.exists(split_tokens(F.col("normal")), wanted)).select("document_id"), "document_id", "left_semi")


def _within(positions: Column, before: Column, slop: int) -> Column:
    """The positions that follow one of ``before`` with at most ``slop`` between them."""
    return F.filter(positions, lambda p: F.exists(before, lambda o: (p > o) & (p - o - 1 <= slop)))


def phrase_documents(index: AdHocIndex, q: Phrase) -> DataFrame:
    """Ids of documents with the tokens in order, at most ``slop`` others between neighbours.

    Positions of the first token are carried along the chain: from each, the
    next token's positions within reach. No join: all positions of a document
    are in one row.
    """
    tokens = query_tokens(q.value)
    where = index.only(q.field) if q.field else index
    if not tokens:
        return index.docs.select("document_id").where(F.lit(False))
    distinct = list(dict.fromkeys(tokens))
    at = {t: F.col(f"at_{i}") for i, t in enumerate(distinct)}
    reached = at[tokens[0]]
    for t in tokens[1:]:
        reached = _within(at[t], reached, q.slop)
    return where.phrase(distinct).where(F.size(reached) > 0).select("document_id")


def compile_query(index: AdHocIndex, q: Query, bm25: BM25 | None = None) -> DataFrame:
    """``(document_id, score)`` of a query."""
    bm25 = bm25 or BM25()
    again = lambda s: compile_query(index, s, bm25)
    if isinstance(q, Match):
        terms = list(dict.fromkeys(query_tokens(q.value)))
        held = _holds(index, q.field, terms) if q.field and terms else None
        view = index if held is None else index.among(held)
        hits = scored(view or index, terms, bm25, q.term_boosts, q.boost, q.operator == "and")
        return hits if view else hits.join(_normal_field(index, q.field).where(_overlap(F.col("normal"), terms)).select("document_id"), "document_id", "left_semi")
    if isinstance(q, MultiMatch):
        terms = query_tokens(q.value)
        parts = [scored(index.only(f), terms, bm25, boost=b) for f, b in q.fields]
        return combine(parts, q.tie_breaker) if parts else again(MatchNone())
    if isinstance(q, Phrase):
        found = phrase_documents(index, q)
        return scored(index, query_tokens(q.value), bm25, require_all=True).join(found, "document_id", "left_semi")
    if isinstance(q, Fuzzy):
        return _expanded(index, near_tokens(q), None, bm25, q.field)
    if isinstance(q, Prefix):
        start = query_tokens(q.value)[:1]
        return _expanded(index, prefixed(q), F.contains("normal", F.lit(start[0])) if start else F.lit(False), bm25, q.field)
    if isinstance(q, ConstantScore):
        return compile_filter(index, q.query, bm25).withColumn("score", F.lit(float(q.score)))
    if isinstance(q, DisMax):
        return combine([again(s) for s in q.queries], q.tie_breaker) if q.queries else again(MatchNone())
    if isinstance(q, Bool):
        return _bool(index, q, bm25)
    condition = predicate(index, q)
    if condition is None:
        raise InvalidQuery(f"no plan for {type(q).__name__}")
    score = 1.0 if isinstance(q, MatchAll | MatchNone) else 0.0
    return index.docs.where(condition).select("document_id", F.lit(score).alias("score"))


def compile_filter(index: AdHocIndex, q: Query, bm25: BM25 | None = None) -> DataFrame:
    """``(document_id)`` of the documents that match, once each."""
    condition = predicate(index, q)
    if condition is not None:
        return index.docs.where(condition).select("document_id")
    if isinstance(q, Phrase):
        return phrase_documents(index, q)
    return compile_query(index, q, bm25).select("document_id")


def words(q: Match) -> Words:
    return Words(tuple(query_tokens(q.value)), tuple(q.term_boosts.items()), q.boost, q.operator == "and")


def _plain(q: Query) -> bool:
    """A match in all text, which needs no more than the counts of its words."""
    return isinstance(q, Match) and not q.field


def _one_scan(index: AdHocIndex, q: Bool, banned: list[Query], required: int, bm25: BM25) -> DataFrame:
    """A bool query of plain matches: all its words are counted in one scan."""
    rows, found = evaluate(index, [words(c) for c in (*q.must, *q.should, *banned)], bm25)
    must, rest = found[: len(q.must)], found[len(q.must) :]
    should, out = rest[: len(q.should)], rest[len(q.should) :]
    good = [m for m, _ in must] + [~m for m, _ in out]
    if required:
        good.append(reduce(lambda a, b: a + b, [m.cast("int") for m, _ in should], F.lit(0)) >= required)
    score = reduce(lambda a, b: a + b, [s for _, s in must] + [F.when(m, s).otherwise(0.0) for m, s in should])
    return rows.where(reduce(lambda a, b: a & b, good)).select("document_id", score.alias("score"))


def _bool(index: AdHocIndex, q: Bool, bm25: BM25) -> DataFrame:
    """Scores of must and should add up; what is a condition on rows stays one and isn't joined."""
    rows, kept = index.docs, []
    joins = []
    required = q.minimum_should_match if (q.must or q.filter) else max(1, q.minimum_should_match) if q.should else 0
    together = all(map(_plain, q.must + q.should)) and bool(q.must or required)
    banned = [p for p in q.must_not if together and _plain(p)]
    for kind, parts in (("left_semi", q.filter), ("left_anti", [p for p in q.must_not if p not in banned])):
        for p in parts:
            condition = predicate(index, p)
            if condition is None:
                joins.append((compile_filter(index, p, bm25), kind))
            else:
                kept.append(condition if kind == "left_semi" else ~F.coalesce(condition, F.lit(False)))
                rows = rows.where(kept[-1])
    sides = [] if together else [compile_query(index, p, bm25).withColumn("m", F.lit(1)).withColumn("s", F.lit(0)) for p in q.must]
    sides += [] if together else [compile_query(index, p, bm25).withColumn("m", F.lit(0)).withColumn("s", F.lit(1)) for p in q.should]
    if not sides and not together:
        out = rows.select("document_id", F.lit(0.0).alias("score"))
    elif together:
        view = index.among(reduce(lambda a, b: a & b, kept)) if kept else index
        out = _one_scan(view or index, q, banned, required, bm25)
        out = out if view else out.join(rows.select("document_id"), "document_id", "left_semi")
    else:
        # One aggregate instead of a join a clause.
        total = reduce(lambda a, b: a.unionByName(b), sides).groupBy("document_id").agg(F.sum("score").alias("score"), F.sum("m").alias("m"), F.sum("s").alias("s"))
        good = (F.coalesce("m", F.lit(0)) == len(q.must)) & (F.coalesce("s", F.lit(0)) >= required)
        if q.must or required:
            out = total.where(good).select("document_id", "score")
            out = out.join(rows.select("document_id"), "document_id", "left_semi") if rows is not index.docs else out
        else:
            out = rows.select("document_id").join(total, "document_id", "left").where(good).select("document_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    for other, kind in joins:
        out = out.join(other, "document_id", kind)
    return out
