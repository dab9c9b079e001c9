"""Sorting and paging of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.operators.filters import number_value, string_value
from siltstone.plans.dsl import Sort
from siltstone.sources.scratch import work_folder


def sort_keys(schema: T.StructType, sorts: tuple[Sort, ...]) -> list[Column]:
    """Missing values are last either way; among mixed values numbers come before strings, ascending; ids break ties."""
    keys: list[Column] = []
    kinds = {f.name: f.dataType for f in schema.fields}
    for s in sorts:
        kind = kinds.get(s.field)
        if isinstance(kind, T.VariantType):
            number, text = number_value(schema, s.field), string_value(schema, s.field)
            parts = [F.when(number.isNotNull(), 0).when(text.isNotNull(), 1), number, text]
        elif isinstance(kind, T.NumericType):
            parts = [F.col(f"`{s.field}`")]
        else:
            parts = [string_value(schema, s.field)]
        keys += [p.desc_nulls_last() if s.descending else p.asc_nulls_last() for p in parts]
    return keys


def order(hits: DataFrame, sorts: tuple[Sort, ...] = ()) -> DataFrame:
    """By the fields, then by id; by score if there are none."""
    if not sorts:
        return hits.orderBy(F.desc("score"), F.asc("document_id"))
    return hits.orderBy(*sort_keys(hits.schema, sorts), F.asc("document_id"))


def page(ordered: DataFrame, offset: int = 0, size: int = 10) -> DataFrame:
    """``size`` rows after the first ``offset``; empty past the end."""
    return ordered.offset(offset).limit(size) if offset else ordered.limit(size)


def places(ordered: DataFrame) -> DataFrame:
    """``(document_id, place)``: the place of every row of an ordered table, from 1.

    An ordered table is range-partitioned, so a row's place is its place in its
    partition and the rows of those before; a count a partition is all that is gathered.
    """
    spark = ordered.sparkSession
    path = work_folder(spark, "places")
    ordered.select("document_id", F.monotonically_increasing_id().alias("m")).write.parquet(path)
    rows = spark.read.schema("document_id string, m long").parquet(path).select("document_id", F.shiftright("m", 33).alias("part"), F.col("m").bitwiseAND((1 << 33) - 1).alias("at"))
    counts = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("document_id", (F.col("before") + F.col("at") + 1).alias("place"))  # a row a partition


def after(hits: DataFrame, score: float, document_id: str) -> DataFrame:
    """The hits that follow one in the default order: a page without reading those before."""
    return hits.where((F.col("score") < score) | ((F.col("score") == score) & (F.col("document_id") > document_id)))
