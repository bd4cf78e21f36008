"""Declarative filters: a nested dict becomes one Column, relation filters become semi and anti joins."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsons

_COMPARE = {
    "equals": lambda c, v: c.isNull() if v is None else c == v,
    "not": lambda c, v: c.isNotNull() if v is None else c != v,
    "in": lambda c, v: c.isin(list(v)),
    "notIn": lambda c, v: ~c.isin(list(v)),
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "contains": lambda c, v: F.contains(c, v),
    "startsWith": lambda c, v: F.startswith(c, v),
    "endsWith": lambda c, v: F.endswith(c, v),
    "has": lambda c, v: F.array_contains(c, v),
    "hasEvery": lambda c, v: F.size(F.array_except(v, c)) == 0,
    "hasSome": lambda c, v: F.arrays_overlap(c, v),
    "isEmpty": lambda c, v: (F.size(c) == 0) == F.lit(v),
}
_TEXT = {"equals", "contains", "startsWith", "endsWith"}


def _value(v):
    if isinstance(v, Column) or v is None:
        return v
    return F.array(*[F.lit(x) for x in v]) if isinstance(v, (list, tuple)) else F.lit(v)


def _field(column: Column, tests) -> Column:
    if not isinstance(tests, dict):
        tests = {"equals": tests}
    fold = tests.get("mode") == "insensitive"
    if "path" in tests or any(t.startswith(("array_", "string_")) for t in tests):
        return _json(column, tests, fold)
    out = []
    for name, v in tests.items():
        if name == "mode":
            continue
        if name == "not" and isinstance(v, dict):
            out.append(~_field(column, v))
            continue
        c, w = column, v if name in ("in", "notIn") else _value(v)
        if fold and name in _TEXT:
            c, w = F.lower(c), F.lower(w)
        out.append(_COMPARE[name](c, w))
    return reduce(and_, out, F.lit(True))


def _json(column: Column, tests: dict, fold: bool) -> Column:
    """Tests of the value at a path of JSON text, of its whole value without one; a value that isn't there meets none."""
    found = jsons.value(column, tests.get("path"))
    out = [jsons.TESTS[t](found, v) if t in jsons.TESTS else jsons.TEXT_TESTS[t](found, v, fold) for t, v in tests.items() if t not in ("path", "mode")]
    return reduce(and_, out, F.lit(True))


def where(tree: dict) -> Column:
    """Column of a filter tree with AND, OR, NOT (each a tree or a list) over field tests; an empty OR is false."""
    out = []
    for name, v in tree.items():
        if name in ("AND", "OR", "NOT"):
            parts = [where(t) for t in (v if isinstance(v, list) else [v])]
            if name == "OR":
                out.append(reduce(or_, parts, F.lit(False)))
            else:
                out += [~p for p in parts] if name == "NOT" else parts
        else:
            out.append(_field(F.col(name), v))
    return reduce(and_, out, F.lit(True))


def some(parents: DataFrame, children: DataFrame, on: tuple[str, str], test: Column) -> DataFrame:
    """Parents with a child that meets the test."""
    return _related(parents, children.where(test), on, "left_semi")


def none(parents: DataFrame, children: DataFrame, on: tuple[str, str], test: Column) -> DataFrame:
    return _related(parents, children.where(test), on, "left_anti")


def every(parents: DataFrame, children: DataFrame, on: tuple[str, str], test: Column) -> DataFrame:
    """Parents all of whose children meet the test, childless ones too."""
    return _related(parents, children.where(~F.coalesce(test, F.lit(False))), on, "left_anti")


def is_(parents: DataFrame, other: DataFrame, on: tuple[str, str], test: Column) -> DataFrame:
    """Rows whose one related row meets the test."""
    return _related(parents, other.where(test), on, "left_semi")


def is_not(parents: DataFrame, other: DataFrame, on: tuple[str, str], test: Column) -> DataFrame:
    """Rows whose one related row doesn't meet the test, or that have none."""
    return _related(parents, other.where(test), on, "left_anti")


def null_or_not_in(column: Column, values: list) -> Column:
    """Null, or none of the values: keeps what a plain NOT IN drops."""
    return column.isNull() | ~column.isin(values)


def _related(parents: DataFrame, children: DataFrame, on: tuple[str, str], how: str) -> DataFrame:
    keys = children.select(F.col(on[1]).alias("_key"))
    return parents.join(keys, parents[on[0]] == keys["_key"], how)
