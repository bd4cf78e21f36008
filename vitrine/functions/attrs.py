"""Product attributes held as array<struct<key, value>>, in their order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitrine.functions.text import attribute_key, blank_to_null, numeric_code, product_code

# Attribute names of each identifier.
NAMES = {"ean": ("EAN", "CODIGO_EAN"), "gtin": ("GTIN", "CODIGO_UNIVERSAL_DE_PRODUTO"), "mpn": ("MPN", "NUMERO_DE_PECA"), "model": ("MODELO", "NUMERO_DO_MODELO", "MODEL")}


def lookup(attributes: Column, names: tuple[str, ...]) -> Column:
    """First non-blank value of a key that, normalised, is or contains one of the names."""
    wanted = F.array(*[F.lit(n) for n in names])
    hits = F.filter(attributes, lambda a: F.exists(wanted, lambda n: F.contains(attribute_key(a["key"]), n)) & blank_to_null(a["value"]).isNotNull())
    return F.trim(F.get(hits, F.lit(0))["value"])


def identifiers(attributes: Column) -> dict[str, Column]:
    found = {k: lookup(attributes, names) for k, names in NAMES.items()}
    return {k: (numeric_code if k in ("ean", "gtin") else product_code)(v) for k, v in found.items()}


def canonical_key(brand: Column, gtin: Column, ean: Column, mpn: Column, model: Column) -> Column:
    """gtin:<code>, else brand-model:<BRAND>:<CODE>, else null; gtin before ean, mpn before model."""
    code, named = F.coalesce(gtin, ean), F.coalesce(mpn, model)
    # The brand is cleaned only where it is part of a key.
    return F.when(code.isNotNull(), F.concat(F.lit("gtin:"), code)).when(named.isNotNull(), F.concat(F.lit("brand-model:"), product_code(brand), F.lit(":"), named))


def union_distinct(*arrays: Column, most: int | None = None) -> Column:
    """Trimmed non-blank elements of the arrays in order, each once."""
    joined = F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])
    out = F.array_distinct(F.filter(F.transform(joined, lambda x: F.trim(x)), lambda x: x != ""))
    return F.slice(out, 1, most) if most else out
