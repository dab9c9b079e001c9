"""BM25, explanations, vector distances and rank fusion."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.index import AdHocIndex


@dataclass(frozen=True)
class BM25:
    """``k1`` bounds the weight of repetition, ``b`` that of length."""

    k1: float = 1.2
    b: float = 0.75

    def idf(self, n: Column, df: Column) -> Column:
        return F.when((n > 0) & (df > 0), F.log(1 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)

    def weight(self, tf: Column, dl: Column, avgdl: Column) -> Column:
        part = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * dl / avgdl))
        return F.when((tf > 0) & (dl > 0) & (avgdl > 0), part).otherwise(0.0)


@dataclass(frozen=True)
class Words:
    """Words to look for: any of them, or all; each weighs ``boost`` times its own boost."""

    terms: tuple[str, ...]
    boosts: tuple[tuple[str, float], ...] = ()
    boost: float = 1.0
    require_all: bool = False


def evaluate(index: AdHocIndex, clauses: list[Words], bm25: BM25) -> tuple[DataFrame, list[tuple[Column, Column]]]:
    """Rows of the documents that hold any of the words, and each clause's (match, score) on them.

    All clauses share one scan and one row of statistics, which is broadcast.
    Only positive scores are matches. A match reads the statistics too, so that
    no part of it moves below the exchange that scores and statistics share.
    """
    terms = list(dict.fromkeys(t for c in clauses for t in c.terms))
    if not terms:
        none = index.docs.select("document_id").where(F.lit(False))
        return none, [(F.lit(False), F.lit(0.0)) for _ in clauses]
    rows, statistics = index.counted(terms)
    hit = {t: F.col(f"tf_{i}") > 0 for i, t in enumerate(terms)}
    rows = rows.crossJoin(F.broadcast(statistics))  # one row
    part = {t: bm25.idf(F.col("n"), F.col(f"df_{i}")) * bm25.weight(F.col(f"tf_{i}"), F.col("dl"), F.col("avgdl")) for i, t in enumerate(terms)}
    found = []
    for c in clauses:
        own, boosts = list(dict.fromkeys(c.terms)), dict(c.boosts)
        if not own:
            found.append((F.lit(False), F.lit(0.0)))
            continue
        score = reduce(lambda a, b: a + b, [part[t] * F.lit(c.boost * boosts.get(t, 1.0)) for t in own])
        match = reduce(lambda a, b: a & b if c.require_all else a | b, [hit[t] for t in own])  # noqa: B023
        found.append((F.coalesce(F.when(match & F.col("hit"), score), F.lit(0.0)) > 0, score))
    return rows, found


def scored(index: AdHocIndex, terms: list[str], bm25: BM25, boosts: dict[str, float] | None = None, boost: float = 1.0, require_all: bool = False) -> DataFrame:
    """``(document_id, score)`` of the documents that hold a term, or all of them."""
    rows, [(match, score)] = evaluate(index, [Words(tuple(terms), tuple((boosts or {}).items()), boost, require_all)], bm25)
    return rows.where(match).select("document_id", score.alias("score"))


def explain(index: AdHocIndex, terms: list[str], bm25: BM25) -> DataFrame:
    """``(document_id, term, tf, idf, contribution)`` of each query term in each document; they add up to the score."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return index.docs.sparkSession.createDataFrame([], "document_id string, term string, tf long, idf double, contribution double")
    rows, statistics = index.counted(terms)
    rows = rows.crossJoin(F.broadcast(statistics))  # one row
    each = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"tf_{i}").alias("tf"), bm25.idf(F.col("n"), F.col(f"df_{i}")).alias("idf"), (bm25.idf(F.col("n"), F.col(f"df_{i}")) * bm25.weight(F.col(f"tf_{i}"), F.col("dl"), F.col("avgdl"))).alias("contribution")) for i, t in enumerate(terms)])
    return rows.select("document_id", F.explode(F.filter(each, lambda s: (s["tf"] > 0) & F.col("hit"))).alias("e")).select("document_id", "e.*")


def ranked(hits: DataFrame) -> DataFrame:
    """Score descending, then id ascending."""
    return hits.orderBy(F.desc("score"), F.asc("document_id"))


def best_score(hits: DataFrame) -> DataFrame:
    """One row a document, with its best score."""
    return hits.groupBy("document_id").agg(F.max("score").alias("score"))


def combine(parts: list[DataFrame], tie_breaker: float) -> DataFrame:
    """The best of several scores plus ``tie_breaker`` times the others."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    top, total = F.max("score"), F.sum("score")
    return both.groupBy("document_id").agg((top + tie_breaker * (total - top)).alias("score"))


def vector_distance(metric: str, a: Column, b: Column) -> Column:
    """cosine and dot are similarities; euclidean is ``1 / (1 + distance)``; null for unequal lengths."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    a, b = a.cast("array<double>"), b.cast("array<double>")
    dot = add(F.zip_with(a, b, lambda x, y: x * y))
    if metric == "dot":
        return dot
    if metric == "cosine":
        norm = lambda v: F.sqrt(add(F.transform(v, lambda x: x * x)))
        return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))
    if metric == "euclidean":
        return 1 / (1 + F.sqrt(add(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))))
    raise ValueError(f"unknown metric {metric!r}")


def knn(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """``(document_id, score)`` of the ``k`` vectors nearest to one; exact, in one scan."""
    score = vector_distance(metric, F.col(column), F.array(*[F.lit(float(x)) for x in query]))
    return ranked(vectors.select(F.col(id_column).cast("string").alias("document_id"), score.alias("score")).where("score is not null")).limit(k)


def reciprocal_rank_fusion(rankings: list[DataFrame], weights: list[float] | None = None, k: int = 60, window: int = 1000) -> DataFrame:
    """``(document_id, score)``: the sum over rankings of weight / (k + rank), each ranking down to rank ``window``."""
    order = Window.partitionBy("list").orderBy(F.desc("score"), F.asc("document_id"))
    parts = []
    for n, (r, w) in enumerate(zip(rankings, weights or [1.0] * len(rankings), strict=True)):
        # Only a top list is ranked in one task, whatever is given.
        top = ranked(r).limit(window).withColumn("list", F.lit(n)).withColumn("rank", F.row_number().over(order))
        parts.append(top.select("document_id", (F.lit(w) / (k + F.col("rank"))).alias("score")))
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("document_id").agg(F.sum("score").alias("score"))
