"""Numbers as they are written in shops, discounts and price comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOLERANCE = 0.009


def parse_number(text: Column) -> Column:
    """Locale-tolerant number. Of two kinds of separator the later is decimal; one kind is decimal only with
    exactly two digits after it, and else groups thousands. Anything that then isn't a number is null."""
    kept = F.regexp_replace(text, r"[^\d,.\-]", "")
    comma, dot = F.contains(kept, F.lit(",")), F.contains(kept, F.lit("."))
    comma_last = F.locate(",", F.reverse(kept)) < F.locate(".", F.reverse(kept))
    decimal_comma = F.translate(F.regexp_replace(kept, r"\.", ""), ",", ".")
    value = (
        F.when(comma & dot & comma_last, decimal_comma)
        .when(comma & dot, F.regexp_replace(kept, ",", ""))
        .when(comma & kept.rlike(r",\d{2}$"), F.translate(kept, ",", "."))
        .when(comma, F.regexp_replace(kept, ",", ""))
        .when(dot & ~kept.rlike(r"\.\d{2}$"), F.regexp_replace(kept, r"\.", ""))
        .otherwise(kept)
    )
    return F.when(value.rlike(r"^-?\d+(\.\d+)?$"), value.try_cast("double"))


def int_digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "").try_cast("bigint")


def discount_pct(old: Column, price: Column) -> Column:
    """Rounded percentage off, null unless the old price is the higher; may be 0."""
    return F.when(old > price, F.round((old - price) / old * 100).cast("int"))


def discount_or(old: Column, price: Column, declared: Column) -> Column:
    return F.coalesce(discount_pct(old, price), F.when((declared > 0) & (declared < 100), F.round(declared).cast("int")))


def display_discount(old: Column, price: Column, declared: Column) -> Column:
    return F.when(declared > 0, F.round(declared).cast("int")).otherwise(F.coalesce(discount_pct(old, price), F.lit(0)))


def price_changed(price: Column, before: Column) -> Column:
    return before.isNull() | (F.abs(price - before) > TOLERANCE)


def brl(value: Column) -> Column:
    """R$ with two decimals, the sign before the currency; null stays null."""
    shown = F.concat(F.lit("R$\u00a0"), F.translate(F.format_number(F.abs(value), 2), ",.", ".,"))
    return F.when(value < 0, F.concat(F.lit("-"), shown)).otherwise(shown)


def fixed(value: Column, digits: int = 1) -> Column:
    """The number with so many decimals, a point before them."""
    return F.format_string(f"%.{digits}f", value.cast("double"))
