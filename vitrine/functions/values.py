"""JSON values, hashes, times and small predicates as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions import money
from vitrine.functions.text import blank_to_null


def json_ids(text: Column) -> Column:
    """The trimmed, non-blank, distinct strings of a JSON array, in order; empty for anything else."""
    listed = F.from_json(F.when(F.startswith(F.trim(text), F.lit("[")), text), "array<string>")
    kept = F.array_distinct(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""))
    return F.coalesce(kept, F.array().cast("array<string>"))


def without(values: Column, value: Column) -> Column:
    """The list without each occurrence of a value."""
    return F.array_remove(values, value)


def first_match(values: Column, **wanted: Column) -> Column:
    """First element of an array of structs whose fields equal the wanted values, else null."""

    def meets(x: Column) -> Column:
        out = F.lit(True)
        for name, value in wanted.items():
            out = out & (x[name] == value)
        return out

    return F.get(F.filter(values, meets), F.lit(0))


def base64url(data: Column) -> Column:
    """Base64 with the letters of URLs and no padding."""
    return F.rtrim(F.translate(F.base64(data), "+/=", "-_ "))


def iso(at: Column) -> Column:
    """A UTC time with milliseconds and Z."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def short_time(text: Column) -> Column:
    """dd/MM/yyyy, HH:mm of a written time; a dash if it isn't one."""
    return F.coalesce(F.date_format(F.try_to_timestamp(text), "dd/MM/yyyy, HH:mm"), F.lit("—"))


def expired(obtained: Column, seconds: Column, now: Column, skew: int = 60) -> Column:
    """Whether what was valid for `seconds` is within `skew` seconds of its end, or past it."""
    return F.unix_timestamp(now) + skew >= F.unix_timestamp(obtained) + seconds


def shown(json: Column) -> Column:
    """A JSON value for readers: Sim or Não, lists with commas, objects as they are written, null as not informed."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    listed = F.array_join(F.from_json(json, "array<string>"), ", ")
    return (
        F.when(kind.isNull() | (kind == "VOID"), "Não informado")
        .when(kind == "BOOLEAN", F.when(F.trim(json) == "true", "Sim").otherwise("Não"))
        .when(F.startswith(kind, F.lit("ARRAY")), listed)
        .when(kind == "STRING", F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v"))
        .otherwise(json)
    )


def null_kind(json: Column) -> Column:
    """DbNull for a missing value, JsonNull for the value null, else null."""
    return F.when(json.isNull(), "DbNull").when(F.is_variant_null(F.try_parse_json(json)), "JsonNull")


def card(old: Column, price: Column, declared: Column, rating: Column, sales: Column, stock: Column) -> Column:
    """What a product card shows; unknown values show nothing."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.struct(
        yes(old > price).alias("has_old_price"),
        (money.display_discount(old, price, declared) > 0).alias("has_discount"),
        yes(rating > 0).alias("has_rating"),
        yes(sales > 0).alias("has_sales"),
        yes((stock > 0) & (stock <= 5)).alias("low_stock"),
    )


def main_link(legacy: Column, store: Column, offers: Column) -> Column:
    """Struct (link, store): the product's own link and store, else those of its first active, available offer with a link.

    offers: array of structs (link, marketplace, status, available) in their order.
    """
    own = blank_to_null(legacy)
    good = F.get(F.filter(offers, lambda o: blank_to_null(o["link"]).isNotNull() & (o["status"] == "ACTIVE") & o["available"]), F.lit(0))
    return F.struct(F.coalesce(own, F.trim(good["link"]), F.lit("")).alias("link"), F.when(own.isNotNull(), F.coalesce(blank_to_null(store), F.lit("Loja parceira"))).otherwise(good["marketplace"]).alias("store"))
