"""Metadata predicates as columns.

A null never matches, in a field or in a list; numbers equal numbers and strings equal strings, never
each other.  Promoted (indexed) fields are typed columns, so their predicates reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Filter:
    """A predicate on metadata; ``column(promoted)`` builds it."""

    build: Callable[[dict[str, str]], Column]

    def column(self, promoted: dict[str, str]) -> Column:
        return self.build(promoted)

    def __and__(self, other: Filter) -> Filter:
        return Filter(lambda p: self.build(p) & other.build(p))

    def __or__(self, other: Filter) -> Filter:
        return Filter(lambda p: self.build(p) | other.build(p))

    def __invert__(self) -> Filter:
        return Filter(lambda p: ~F.coalesce(self.build(p), F.lit(False)))


_TRUE = Filter(lambda p: F.lit(True))


def _path(field: str) -> str:
    return "$['" + field.replace("'", "\\'") + "']"


def _promoted(field: str) -> Column:
    """A promoted field by its exact name, dots included."""
    return F.col("`" + field.replace("`", "``") + "`")


def _same_kind(kind: str, value: object) -> bool:
    """Whether a promoted field of this type can equal the value: numbers, strings and booleans keep to themselves."""
    if isinstance(value, bool):
        return kind == "boolean"
    return kind == "string" if isinstance(value, str) else kind not in ("string", "boolean")


def _typed(field: str, like: object) -> Column:
    """A field of the metadata as a column comparable with ``like``; null where its JSON kind is another."""
    number = isinstance(like, (int, float)) and not isinstance(like, bool)
    value = F.try_variant_get("metadata", _path(field), "variant")
    kind = F.schema_of_variant(value)
    if isinstance(like, bool):
        return F.when(kind == "BOOLEAN", F.try_variant_get("metadata", _path(field), "boolean"))
    if number:
        return F.when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("metadata", _path(field), "double"))
    return F.when(kind == "STRING", F.try_variant_get("metadata", _path(field), "string"))


def eq(field: str | None, value: object) -> Filter:
    """Field equals value; a null field name matches everything, a null value nothing."""
    if field is None:
        return _TRUE
    if value is None:
        return Filter(lambda p: F.lit(False))
    return Filter(lambda p: _compare(field, value, p, lambda c, v: c == v))


def _compare(field: str, value: object, promoted: dict[str, str], op: Callable[[Column, Column], Column]) -> Column:
    if field in promoted:
        return op(_promoted(field), F.lit(value)) if _same_kind(promoted[field], value) else F.lit(False)
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return op(_typed(field, value), F.lit(float(value)) if number else F.lit(value))


def in_(field: str | None, values: list | None) -> Filter:
    """Field is among values; nulls in the list are skipped, an empty or null list matches nothing."""
    if field is None:
        return _TRUE
    some = [v for v in values or [] if v is not None]
    if not some:
        return Filter(lambda p: F.lit(False))

    def build(p: dict[str, str]) -> Column:
        if field in p:  # one typed list, which the scan can take; values of other kinds never match
            same = [v for v in some if _same_kind(p[field], v)]
            return _promoted(field).isin(same) if same else F.lit(False)
        return reduce(lambda a, b: a | b, [eq(field, v).build(p) for v in some])

    return Filter(build)


def _ordered(op: Callable[[Column, Column], Column]) -> Callable[[str, object], Filter]:
    return lambda field, value: Filter(lambda p: _compare(field, value, p, op))


gt = _ordered(lambda c, v: c > v)
ge = _ordered(lambda c, v: c >= v)
lt = _ordered(lambda c, v: c < v)
le = _ordered(lambda c, v: c <= v)


def between(field: str, low: object, high: object) -> Filter:
    """Inclusive range."""
    return ge(field, low) & le(field, high)


def prefix(field: str, start: str) -> Filter:
    return Filter(lambda p: _compare(field, start, p, lambda c, v: c.startswith(v)))


def contains(needle: str) -> Column:
    """Case-insensitive substring of id, text or metadata JSON."""
    n = F.lit(needle.lower())
    return F.coalesce(F.lower("id").contains(n), F.lit(False)) | F.coalesce(F.lower("text").contains(n), F.lit(False)) | F.coalesce(F.lower(F.to_json("metadata")).contains(n), F.lit(False))
