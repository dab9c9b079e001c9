"""Tokens, document text, highlighting and edit distance; all inside the JVM."""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PUNCTUATION = re.compile(f"[{re.escape(string.punctuation)}]")


def normalize(text: Column) -> Column:
    """The tokens of a text with one blank between: lower case, split at ASCII punctuation and Unicode white space; null for null."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{Punct}\p{IsWhite_Space}]+", " "))


def split_tokens(normal: Column) -> Column:
    """The tokens of a normalised text. Split at a single character, which takes no regular expression."""
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def tokenize(text: Column) -> Column:
    """Tokens of a text; null for null."""
    return split_tokens(normalize(text))


def token_count(normal: Column) -> Column:
    """How many tokens a normalised text has."""
    return F.when(normal == "", 0).otherwise(F.octet_length(normal) - F.octet_length(F.replace(normal, F.lit(" "), F.lit(""))) + 1).cast("long")


def spaced(normal: Column) -> Column:
    """A normalised text with blanks of its own on either side of each token."""
    return F.concat(F.lit(" "), F.replace(normal, F.lit(" "), F.lit("  ")), F.lit(" "))


def occurrences(spaced_text: Column, token: str) -> Column:
    """How often a token is in a ``spaced`` text, by byte searches alone."""
    left = F.octet_length(F.replace(spaced_text, F.lit(f" {token} "), F.lit("")))
    return ((F.octet_length(spaced_text) - left) / (len(token.encode()) + 2)).cast("long")


def query_tokens(text: str) -> list[str]:
    """The same tokens, of a query on the driver."""
    return _PUNCTUATION.sub(" ", text.lower()).split()


def number_text(value: Column, kind: T.DataType) -> Column:
    """A number as JSON prints it: whole doubles end in .0, without an exponent below 1e16."""
    if not isinstance(kind, T.FractionalType) or isinstance(kind, T.DecimalType):
        return value.cast("string")
    whole = (F.floor(value) == value) & (F.abs(value) < 1e16)
    return F.when(whole, F.concat(value.cast("long").cast("string"), F.lit(".0"))).otherwise(value.cast("string"))


def extract_text(schema: T.StructType, fields: list[str] | None = None) -> Column:
    """All indexable text of a row, in the order of the schema: strings, numbers, booleans and strings in arrays.

    Null values and other types add nothing.
    """
    parts = []
    for f in schema.fields:
        if fields is not None and f.name not in fields:
            continue
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            parts.append(c)
        elif isinstance(f.dataType, T.BooleanType):
            parts.append(c.cast("string"))
        elif isinstance(f.dataType, T.NumericType):
            parts.append(number_text(c, f.dataType))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            parts.append(F.array_join(c, " "))
        elif isinstance(f.dataType, T.VariantType):
            kind = F.schema_of_variant(c)
            text = F.try_variant_get(c, "$", "string")
            items = F.array_join(F.filter(F.try_variant_get(c, "$", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING").cast("array<string>"), " ")
            parts.append(F.when(kind.startswith("ARRAY"), items).when(~kind.startswith("OBJECT") & (kind != "VOID"), text))
    return F.concat_ws(" ", *parts) if parts else F.lit("")


def highlight(text: Column, tokens: list[str], before: str = "<em>", after: str = "</em>") -> Column:
    """The text with each word that is a token of the query marked; words are joined by single spaces.

    A word is compared in lower case and without the punctuation around it. A
    text without words and a query without tokens change nothing.
    """
    if not tokens:
        return text
    wanted = [F.lit(t) for t in dict.fromkeys(tokens)]
    plain = F.trim(F.regexp_replace(text, r"\p{IsWhite_Space}+", " "))
    core = lambda w: F.btrim(F.lower(w), F.lit(string.punctuation))
    marked = F.transform(F.split(plain, " "), lambda w: F.when(core(w).isin(*wanted), F.concat(F.lit(before), w, F.lit(after))).otherwise(w))
    # Texts without any of the tokens need no look at their words.
    held = reduce(lambda a, b: a | b, [F.contains(F.lower(plain), w) for w in wanted])
    return F.when(plain == "", text).when(~held, plain).otherwise(F.array_join(marked, " "))


def highlight_fields(fields: list[str], tokens: list[str]) -> Column:
    """A map of the fields whose highlighted text differs from their text."""
    pairs = []
    for f in fields:
        pairs += [F.lit(f), F.struct(F.col(f"`{f}`").alias("old"), highlight(F.col(f"`{f}`"), tokens).alias("new"))]
    if not pairs:
        return F.create_map().cast("map<string,string>")
    changed = F.map_filter(F.create_map(*pairs), lambda _, v: v["old"] != v["new"])
    return F.transform_values(changed, lambda _, v: v["new"])


def levenshtein_bytes(a: Column, b: Column) -> Column:
    """Edit distance in UTF-8 bytes, not characters: an umlaut counts twice."""
    latin = lambda c: F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")
    return F.levenshtein(latin(a), latin(b))
