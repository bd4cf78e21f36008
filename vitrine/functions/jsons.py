"""JSON values as VARIANT: deep equality, paths, array ends and typed order, as Column expressions.

Values are compared in a canonical form with sorted keys and numbers without trailing zeros; inside arrays and
objects a number written with an exponent equals only one written so. Text that isn't JSON has no value.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of schema_of_variant by JSON type; others are arrays and objects.
_KINDS = {"null": "VOID", "boolean": "BOOLEAN", "string": "STRING"}
_NUMBERS = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(.*)$"


def path(parts: list[str | int] | None) -> str:
    """A path of names (text) and places in arrays (numbers); a name with both kinds of quotes can't be told."""
    out = "$"
    for p in parts or []:
        if isinstance(p, str) and "'" in p and '"' in p:
            raise ValueError(f"no path for the name {p}")
        out += f"[{p}]" if isinstance(p, int) else f".{p}" if re.fullmatch(r"[A-Za-z_]\w*", p) else f'["{p}"]' if "'" in p else f"['{p}']"
    return out


def value(text: Column, parts: list[str | int] | None = None) -> Column:
    """The VARIANT at a path of JSON text; null if there is none or the text isn't JSON."""
    return F.try_variant_get(F.try_parse_json(text), path(parts), "variant")


def canonical(variant: Column) -> Column:
    return F.to_json(variant)


def _literal(v) -> Column:
    """Canonical text of a Python value, or of a column of JSON text."""
    text = v if isinstance(v, Column) else F.lit(json.dumps(v, ensure_ascii=False))
    return canonical(F.try_parse_json(text))


def kind(variant: Column) -> Column:
    """null, boolean, number, string, array or object; null where there is no value."""
    said = F.schema_of_variant(variant)
    out = F.when(variant.isNull(), None).when(said.rlike(_NUMBERS), "number")
    for name, shown in _KINDS.items():
        out = out.when(said == shown, name)
    return out.when(F.startswith(said, F.lit("ARRAY")), "array").otherwise("object")


def number(variant: Column) -> Column:
    return F.when(kind(variant) == "number", F.try_variant_get(variant, "$", "double"))


def string(variant: Column) -> Column:
    return F.when(kind(variant) == "string", F.try_variant_get(variant, "$", "string"))


def elements(variant: Column) -> Column:
    """Canonical texts of an array's elements; null for anything else."""
    return F.transform(F.try_variant_get(variant, "$", "array<variant>"), lambda e: F.coalesce(canonical(e), F.lit("null")))


def _ordered(test):
    """A comparison within numbers or within strings; values of other kinds aren't comparable, so it doesn't hold."""

    def run(variant: Column, v) -> Column:
        text = isinstance(v, str)
        return F.coalesce(test(string(variant) if text else number(variant), F.lit(v) if text else F.lit(float(v))), F.lit(False))

    return run


def _equals(variant: Column, v) -> Column:
    """Deep equality; numbers by value. None: the JSON value null."""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return F.coalesce(number(variant) == F.lit(float(v)), F.lit(False))
    return F.coalesce(canonical(variant) == _literal(v), F.lit(False))


def _holds(variant: Column, v) -> Column:
    """Whether an array has every element of a list, or the one value."""
    wanted = F.array(*[_literal(x) for x in (v if isinstance(v, (list, tuple)) else [v])])
    return F.coalesce(F.size(F.array_except(wanted, elements(variant))) == 0, F.lit(False))


def _end(at: int):
    return lambda variant, v: F.coalesce(F.try_element_at(elements(variant), F.lit(at)) == _literal(v), F.lit(False))


def _text(test):
    """A test of a string value; `fold`: without regard to case."""
    return lambda variant, v, fold: F.coalesce(test(F.lower(string(variant)), F.lit(v.lower())) if fold else test(string(variant), F.lit(v)), F.lit(False))


TESTS = {
    "equals": _equals,
    "not": lambda variant, v: variant.isNotNull() & ~_equals(variant, v),
    "array_contains": _holds,
    "array_starts_with": _end(1),
    "array_ends_with": _end(-1),
    "lt": _ordered(lambda c, v: c < v),
    "lte": _ordered(lambda c, v: c <= v),
    "gt": _ordered(lambda c, v: c > v),
    "gte": _ordered(lambda c, v: c >= v),
}
TEXT_TESTS = {"string_contains": _text(F.contains), "string_starts_with": _text(F.startswith), "string_ends_with": _text(F.endswith)}


def body(text: Column) -> Column:
    """Struct (is_json, data): a response's body in canonical form, or as it came where it isn't JSON."""
    parsed = F.try_parse_json(text)
    return F.struct(parsed.isNotNull().alias("is_json"), F.coalesce(canonical(parsed), F.when(parsed.isNotNull(), "null"), text).alias("data"))
