"""The query language, its logical plan and its compilation to DataFrames."""

from .dsl import (
    Aggregation,
    Bool,
    ConstantScore,
    DisMax,
    Exists,
    Fuzzy,
    Match,
    MatchAll,
    MatchNone,
    MultiMatch,
    Phrase,
    Prefix,
    Query,
    Range,
    SearchRequest,
    Sort,
    Term,
    Terms,
    parse_query,
    parse_request,
)

__all__ = ["Aggregation", "Bool", "ConstantScore", "DisMax", "Exists", "Fuzzy", "Match", "MatchAll", "MatchNone", "MultiMatch", "Phrase", "Prefix", "Query", "Range", "SearchRequest", "Sort", "Term", "Terms", "parse_query", "parse_request"]
