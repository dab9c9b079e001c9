"""Queries and requests as frozen dataclasses, and their JSON forms.

A query in JSON is either tagged, ``{"type": "Match", "field": ..., ...}``, or a
single clause, ``{"match": {"title": "words"}}``. What isn't known raises
``InvalidQuery``; nothing is dropped in silence.
"""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any

from siltstone.errors import InvalidQuery


class Query:
    """Base of all query variants."""

    def to_json(self) -> dict[str, Any]:
        out: dict[str, Any] = {"type": type(self).__name__}
        for f in dataclasses.fields(self):  # type: ignore[arg-type]
            out[f.name] = _plain(getattr(self, f.name))
        return out


def _plain(value: Any) -> Any:
    if isinstance(value, Query):
        return value.to_json()
    if isinstance(value, tuple | list):
        return [_plain(v) for v in value]
    return dict(value) if isinstance(value, dict) else value


@dataclass(frozen=True)
class Match(Query):
    """Any token of ``value``; scores are BM25 over all fields, ``field`` only says where one token must be."""

    field: str = ""
    value: str = ""
    term_boosts: dict[str, float] = dataclasses.field(default_factory=dict)
    boost: float = 1.0
    operator: str = "or"


@dataclass(frozen=True)
class Term(Query):
    """Exact, case-sensitive equality of a string field."""

    field: str
    value: str


@dataclass(frozen=True)
class Terms(Query):
    """A string field equal to one of several values."""

    field: str
    values: tuple[str, ...]


@dataclass(frozen=True)
class Exists(Query):
    """A field that isn't null."""

    field: str


@dataclass(frozen=True)
class Range(Query):
    """Bounds of a numeric field; without bounds nothing matches."""

    field: str
    gt: float | None = None
    gte: float | None = None
    lt: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class Bool(Query):
    """``must`` scores and is required, ``filter`` is required, ``must_not`` excludes, ``should`` adds.

    ``should`` is required only without must and filter, or by ``minimum_should_match``.
    """

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    filter: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()
    minimum_should_match: int = 0


@dataclass(frozen=True)
class MultiMatch(Query):
    """Match in several fields with their own statistics; the best field plus ``tie_breaker`` times the others."""

    value: str
    fields: tuple[tuple[str, float], ...]
    tie_breaker: float = 0.0


@dataclass(frozen=True)
class Phrase(Query):
    """All tokens in order, at most ``slop`` tokens between neighbours."""

    field: str
    value: str
    slop: int = 0


@dataclass(frozen=True)
class Fuzzy(Query):
    """Match over the dictionary's terms within an edit distance in bytes that share a prefix."""

    field: str
    value: str
    max_edit_distance: int = 2
    prefix_length: int = 0


@dataclass(frozen=True)
class Prefix(Query):
    """Match over the dictionary's terms that begin with the first token."""

    field: str
    value: str


@dataclass(frozen=True)
class ConstantScore(Query):
    query: Query
    score: float = 1.0


@dataclass(frozen=True)
class DisMax(Query):
    """The best sub-query's score plus ``tie_breaker`` times the others'."""

    queries: tuple[Query, ...]
    tie_breaker: float = 0.0


@dataclass(frozen=True)
class MatchAll(Query):
    pass


@dataclass(frozen=True)
class MatchNone(Query):
    pass


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class Aggregation:
    """``kind``: terms, count, min, max, avg, sum, stats or histogram; ``size`` of terms, ``interval`` of histogram."""

    kind: str
    field: str
    size: int | None = None
    interval: float | None = None


@dataclass(frozen=True)
class SearchRequest:
    query: Query
    filters: tuple[Query, ...] = ()
    sort: tuple[Sort, ...] = ()
    aggregations: tuple[Aggregation, ...] = ()
    offset: int = 0
    size: int = 10
    highlight: bool = False
    explain: bool = field(default=False)

    def key(self) -> str:
        """Canonical JSON of the whole request, filters, sort and aggregations included."""
        body = {f.name: getattr(self, f.name) for f in dataclasses.fields(self)}
        body["query"], body["filters"] = self.query.to_json(), [f.to_json() for f in self.filters]
        body["sort"], body["aggregations"] = [dataclasses.asdict(s) for s in self.sort], [dataclasses.asdict(a) for a in self.aggregations]
        return json.dumps(body, sort_keys=True)


_VARIANTS = {c.__name__: c for c in (Match, Term, Terms, Exists, Range, Bool, MultiMatch, Phrase, Fuzzy, Prefix, ConstantScore, DisMax, MatchAll, MatchNone)}
_BOUNDS = ("gt", "gte", "lt", "lte")


def _make(kind: type, **kw: Any) -> Query:
    try:
        return kind(**kw)
    except TypeError as e:
        raise InvalidQuery(f"{kind.__name__}: {e}") from None


def _list(values: Any) -> tuple[Query, ...]:
    return tuple(parse_query(v) for v in (values if isinstance(values, list) else [values]))


def _tagged(body: dict[str, Any]) -> Query:
    rest = {k: v for k, v in body.items() if k != "type"}
    kind = _VARIANTS.get(body["type"])
    if kind is None:
        raise InvalidQuery(f"unknown query type {body['type']!r}")
    for name in ("must", "should", "filter", "must_not", "queries"):
        if name in rest:
            rest[name] = _list(rest[name])
    if "query" in rest:
        rest["query"] = parse_query(rest["query"])
    if kind is MultiMatch:
        rest["fields"] = _fields(rest.get("fields", []))
    if kind is Terms:
        rest["values"] = tuple(rest.get("values", ()))
    if kind is Fuzzy:
        rest["max_edit_distance"] = min(2, rest.get("max_edit_distance", 2))
    return _make(kind, **rest)


def _fields(fields: Any) -> tuple[tuple[str, float], ...]:
    return tuple((f, 1.0) if isinstance(f, str) else (f["field"], float(f.get("boost", 1.0))) if isinstance(f, dict) else (f[0], float(f[1])) for f in fields)


def parse_query(body: Any) -> Query:
    """A query from its tagged or clause form."""
    if isinstance(body, Query):
        return body
    if not isinstance(body, dict):
        raise InvalidQuery("a query is a JSON object")
    if "type" in body:
        return _tagged(body)
    if len(body) != 1:
        raise InvalidQuery("a query has exactly one clause")
    name, arg = next(iter(body.items()))
    if name == "match_all":
        return MatchAll()
    if name == "match_none":
        return MatchNone()
    if not isinstance(arg, dict):
        raise InvalidQuery(f"{name} takes an object")
    if name == "bool":
        return _make(Bool, **{k: _list(v) if k != "minimum_should_match" else v for k, v in arg.items()})
    if name == "constant_score":
        return ConstantScore(parse_query(arg.get("query", arg.get("filter"))), float(arg.get("score", arg.get("boost", 1.0))))
    if name == "dis_max":
        return DisMax(_list(arg.get("queries", [])), float(arg.get("tie_breaker", 0.0)))
    if name == "multi_match":
        return MultiMatch(arg.get("value", arg.get("query", "")), _fields(arg.get("fields", [])), float(arg.get("tie_breaker", 0.0)))
    if name == "exists":
        return _make(Exists, **arg)
    if len(arg) != 1:
        raise InvalidQuery(f"{name} names exactly one field")
    where, what = next(iter(arg.items()))
    if name == "range":
        if not isinstance(what, dict) or not set(what) <= set(_BOUNDS):
            raise InvalidQuery("range takes gt, gte, lt and lte")
        return Range(where, **what)
    if name == "terms":
        return Terms(where, tuple(what))
    kinds = {"match": Match, "term": Term, "phrase": Phrase, "match_phrase": Phrase, "fuzzy": Fuzzy, "prefix": Prefix}
    if name not in kinds:
        raise InvalidQuery(f"unknown clause {name!r}")
    return _make(kinds[name], field=where, **(what if isinstance(what, dict) else {"value": what}))


def parse_request(body: dict[str, Any]) -> SearchRequest:
    """A request: ``{"q": text}`` or ``{"query": ..., "filters": [...], "sort": [...], "aggregations": [...]}``."""
    known = {"q", "query", "filters", "sort", "aggregations", "from", "size", "highlight", "explain"}
    if not isinstance(body, dict) or set(body) - known or ("q" in body) == ("query" in body):
        raise InvalidQuery(f"a request has q or query, and only {sorted(known)}")
    query = Match("", body["q"]) if "q" in body else parse_query(body["query"])
    sorts = tuple(Sort(s["field"], str(s.get("order", "asc")).lower() == "desc") for s in body.get("sort", []))
    aggs = tuple(_aggregation(a) for a in body.get("aggregations", []))
    offset, size = int(body.get("from", 0)), int(body.get("size", 10))
    if offset < 0 or size < 0:
        raise InvalidQuery("from and size aren't negative")
    return SearchRequest(query, _list(body.get("filters", [])), sorts, aggs, offset, size, bool(body.get("highlight", False)), bool(body.get("explain", False)))


def _aggregation(body: dict[str, Any]) -> Aggregation:
    kind = str(body.get("type", "")).lower()
    kind = {"average": "avg"}.get(kind, kind)
    if kind not in ("terms", "count", "min", "max", "avg", "sum", "stats", "histogram") or "field" not in body:
        raise InvalidQuery(f"unknown aggregation {body!r}")
    return Aggregation(kind, body["field"], body.get("size"), body.get("interval"))
