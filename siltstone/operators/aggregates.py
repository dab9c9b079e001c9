"""Aggregations over all hits, not over a page of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.filters import number_value, string_value
from siltstone.plans.dsl import Aggregation


def terms(hits: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """``(key, count)`` of a string field, most frequent first, then by key; null and other types are left out."""
    out = hits.select(string_value(hits.schema, name).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.asc("key"))
    return out if size is None else out.limit(size)


def metrics(hits: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """One row with ``field_kind`` for each (field, kind), all in one pass.

    count, and sum with 0.0 without numbers; min, max and avg with null.
    """
    columns = []
    for name, kind in wanted:
        columns.append(_metric(number_value(hits.schema, name), kind).alias(f"{name}_{kind}"))
    return hits.agg(*columns)


def _metric(v: Column, kind: str) -> Column:
    return {"count": F.count(v), "min": F.min(v), "max": F.max(v), "avg": F.avg(v), "sum": F.coalesce(F.sum(v), F.lit(0.0))}[kind]


def histogram(hits: DataFrame, name: str, interval: float) -> DataFrame:
    """``(key, count)`` of the buckets ``[key, key + interval)`` that hold a number."""
    v = number_value(hits.schema, name)
    return hits.select((F.floor(v / interval) * interval).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("count")).orderBy("key")


def facets(hits: DataFrame, names: list[str]) -> DataFrame:
    """``(*names, count)``: counts of the combinations of several string fields."""
    columns = [string_value(hits.schema, n).alias(n) for n in names]
    return hits.select(*columns).dropna().groupBy(*names).agg(F.count("*").alias("count"))


def nested(hits: DataFrame, names: list[str], wanted: list[tuple[str, str]]) -> DataFrame:
    """Terms in terms: ``(*names, count, field_kind...)``, metrics of the documents of each combination of string fields, in one pass.

    Null and other types are left out, as in ``terms``.
    """
    columns = [string_value(hits.schema, n).alias(f"key_{i}") for i, n in enumerate(names)]
    numbers = {f: number_value(hits.schema, f) for f, _ in wanted}
    rows = hits.select(*columns, *[v.alias(f"value_{i}") for i, v in enumerate(numbers.values())]).dropna(subset=[f"key_{i}" for i in range(len(names))])
    at = {f: F.col(f"value_{i}") for i, f in enumerate(numbers)}
    made = [_metric(at[f], kind).alias(f"{f}_{kind}") for f, kind in wanted]
    found = rows.groupBy(*[F.col(f"key_{i}").alias(n) for i, n in enumerate(names)]).agg(F.count("*").alias("count"), *made)
    return found.orderBy(F.desc("count"), *names)


def aggregate(hits: DataFrame, wanted: tuple[Aggregation, ...]) -> dict[tuple[str, str], DataFrame]:
    """A DataFrame for each (field, kind); metrics share one pass."""
    out: dict[tuple[str, str], DataFrame] = {}
    simple = []
    for a in wanted:
        if a.kind == "terms":
            out[a.field, a.kind] = terms(hits, a.field, a.size)
        elif a.kind == "histogram":
            out[a.field, a.kind] = histogram(hits, a.field, a.interval or 1.0)
        else:
            simple.append(a)
    pairs = [(a.field, k) for a in simple for k in (("count", "min", "max", "avg", "sum") if a.kind == "stats" else (a.kind,))]
    if pairs:
        row = metrics(hits, list(dict.fromkeys(pairs)))
        for a in simple:
            kinds = ("count", "min", "max", "avg", "sum") if a.kind == "stats" else (a.kind,)
            out[a.field, a.kind] = row.select(*[F.col(f"`{a.field}_{k}`").alias("count" if k == "count" else k if a.kind == "stats" else "value") for k in kinds])
    return out
