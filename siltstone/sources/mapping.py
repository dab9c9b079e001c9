"""Mappings of fields to types, and the validation of documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES = {"text": T.StringType(), "keyword": T.StringType(), "integer": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType()}
_VARIANT = {"text": "^STRING$", "keyword": "^STRING$", "integer": "^(BIGINT|INT|SMALLINT|TINYINT)$", "float": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$"}


@dataclass(frozen=True)
class Field:
    name: str
    type: str = "text"
    required: bool = False

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise ValueError(f"unknown field type {self.type!r}")


@dataclass(frozen=True)
class Mapping:
    """Declared fields, in order; fields that aren't declared are always accepted."""

    fields: tuple[Field, ...] = ()

    def field(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name == name), None)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, TYPES[f.type], not f.required) for f in self.fields])

    def to_json(self) -> list[dict[str, Any]]:
        return [{"name": f.name, "type": f.type, "required": f.required} for f in self.fields]

    @staticmethod
    def from_json(body: list[dict[str, Any]]) -> Mapping:
        return Mapping(tuple(Field(f["name"], f.get("type", "text"), f.get("required", False)) for f in body))

    def error(self, body: Column) -> Column:
        """What is wrong with a document (a variant), by its first failing field; null if nothing is.

        A null value of a declared field is of the wrong type, required or not.
        """
        out = F.when(body.isNull(), F.lit("the body isn't JSON")).when(~F.schema_of_variant(body).startswith("OBJECT"), F.lit("the body isn't an object"))
        for f in self.fields:
            v = F.try_variant_get(body, f"$.{f.name}", "variant")
            if f.required:
                out = out.when(v.isNull(), F.lit(f"field '{f.name}' is required"))
            out = out.when(v.isNotNull() & ~F.schema_of_variant(v).rlike(_VARIANT[f.type]), F.lit(f"field '{f.name}' isn't of type {f.type}"))
        return out


def id_error(document_id: Column) -> Column:
    """What is wrong with an id: 1 to 256 characters of ASCII letters, digits, ``-``, ``_`` and ``.``."""
    trimmed = F.trim(document_id)
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit("the id is empty")).when(F.octet_length(trimmed) > 256, F.lit("the id is longer than 256 bytes")).when(~trimmed.rlike("^[A-Za-z0-9._-]+$"), F.lit("the id has a character that isn't allowed"))


def typed(bodies: DataFrame, mapping: Mapping) -> DataFrame:
    """``(document_id, declared fields..., extra)`` from ``(id, body)``: declared fields typed, the whole body as a variant."""
    v = F.try_parse_json("body")
    columns = [F.try_variant_get(v, f"$.{f.name}", TYPES[f.type].simpleString()).alias(f.name) for f in mapping.fields]
    return bodies.select(F.col("id").alias("document_id"), *columns, v.alias("extra"))


def set_field(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """``docs`` with a field set, whether they had it or not; of documents that aren't saved yet, as saved ones don't change."""
    return docs.withColumn(name, value)


def set_in_body(body: Column, name: str, value: Column) -> Column:
    """A JSON object with a field set; null for what isn't one."""
    fields = F.try_variant_get(F.try_parse_json(body), "$", "map<string,variant>")
    others = F.map_filter(fields, lambda k, _: k != F.lit(name))
    return F.when(fields.isNotNull(), F.to_json(F.map_concat(others, F.create_map(F.lit(name), value.cast("variant")))))


def with_fields(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with undeclared fields of ``extra`` as variant columns."""
    new = [n for n in names if n not in docs.columns]
    return docs.withColumns({n: F.try_variant_get("extra", f"$.{n}", "variant") for n in new}) if new else docs
