"""Predicates on fields, for ``where``: they never coerce types, and null counts as false.

They are bare comparisons, so those on plain columns are pushed to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _field(schema: T.StructType, name: str) -> T.DataType | None:
    return next((f.dataType for f in schema.fields if f.name == name), None)


def string_value(schema: T.StructType, name: str) -> Column:
    """The field if it is a string, else null."""
    kind, c = _field(schema, name), F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(c) == "STRING", F.try_variant_get(c, "$", "string"))
    return F.lit(None).cast("string")


def number_value(schema: T.StructType, name: str) -> Column:
    """The field as a double if it is a number, else null."""
    kind, c = _field(schema, name), F.col(f"`{name}`")
    if isinstance(kind, T.NumericType):
        return c.cast("double")
    if isinstance(kind, T.VariantType):
        return F.when(F.schema_of_variant(c).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(c, "$", "double"))
    return F.lit(None).cast("double")


def term_filter(schema: T.StructType, name: str, value: str) -> Column:
    return string_value(schema, name) == F.lit(value)


def terms_filter(schema: T.StructType, name: str, values: list[str] | tuple[str, ...]) -> Column:
    return string_value(schema, name).isin(*values) if values else F.lit(False)


def exists_filter(schema: T.StructType, name: str) -> Column:
    kind = _field(schema, name)
    if kind is None:
        return F.lit(False)
    there = F.col(f"`{name}`").isNotNull()
    return there & ~F.is_variant_null(F.col(f"`{name}`")) if isinstance(kind, T.VariantType) else there


def range_filter(schema: T.StructType, name: str, gt: float | None = None, gte: float | None = None, lt: float | None = None, lte: float | None = None) -> Column:
    """All given bounds hold; without any nothing does.

    A number column is compared as it is, so the bounds reach the scan; other
    types of number are compared as doubles.
    """
    if gt is None and gte is None and lt is None and lte is None:
        return F.lit(False)
    kind = _field(schema, name)
    plain = isinstance(kind, T.NumericType) and not isinstance(kind, T.FloatType)
    c = F.col(f"`{name}`") if plain else number_value(schema, name)
    lit = lambda x: F.lit(int(x)) if isinstance(kind, T.IntegralType) and float(x).is_integer() else F.lit(float(x))
    bounds = [b for b in (c > lit(gt) if gt is not None else None, c >= lit(gte) if gte is not None else None, c < lit(lt) if lt is not None else None, c <= lit(lte) if lte is not None else None) if b is not None]
    out = bounds[0]
    for b in bounds[1:]:
        out = out & b
    return out
