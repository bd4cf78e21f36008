"""Text normalisation as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accented() -> tuple[str, str]:
    """Letters that canonical decomposition splits into one letter and marks U+0300 to U+036F, and those letters."""
    marked, plain = [], []
    for code in range(0xC0, 0x10000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all("\u0300" <= c <= "\u036f" for c in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _accented()

# Marketplaces and their labels.
MARKETPLACE_LABELS = {"MERCADO_LIVRE": "Mercado Livre", "AMAZON": "Amazon", "SHOPEE": "Shopee", "MAGAZINE_LUIZA": "Magazine Luiza", "CASAS_BAHIA": "Casas Bahia", "KABUM": "KaBuM!", "TERABYTE": "Terabyte", "ALIEXPRESS": "AliExpress", "CARREFOUR": "Carrefour"}

# Words of category names and the icon of the first rule that has one.
CATEGORY_ICONS = [
    ("💻", ("notebook", "computador", "informática")),
    ("📱", ("celular", "smartphone", "telefone")),
    ("📺", ("televis", "tv", "áudio")),
    ("🍳", ("eletro", "cozinha", "air fryer")),
    ("🏠", ("casa", "móvel", "decoração")),
    ("🛠️", ("ferramenta", "construção")),
    ("🧸", ("bebê", "infantil", "criança")),
    ("✨", ("beleza", "cuidado")),
]
OTHER_ICON = "🏷️"


def clean(text: Column) -> Column:
    """No-break space to space, runs of white space to one, trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), " ", " "), r"\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def plain(text: Column) -> Column:
    """Letters without accents, and no combining marks U+0300 to U+036F."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), "[̀-ͯ]", "")


def key_of(text: Column) -> Column:
    """Cleaned label without the colons at its end, trimmed."""
    return F.trim(F.regexp_replace(clean(text), ":+$", ""))


def identifier(text: Column) -> Column:
    """Upper-case, accent-free, single-spaced."""
    return F.upper(clean(plain(text)))


def attribute_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(identifier(text), "[^A-Z0-9]+", "_"), "^_+|_+$", "")


def numeric_code(text: Column) -> Column:
    """The digits, if there are 8 to 14 of them."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits).between(8, 14), digits)


def product_code(text: Column) -> Column:
    return F.nullif(F.substring(F.regexp_replace(identifier(text), "[^A-Z0-9._/-]", ""), 1, 100), F.lit(""))


def slug(title: Column, store: Column, code: Column) -> Column:
    """URL part of title (90 characters), store and code (50), dashes for the rest."""

    def dashed(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(F.lower(plain(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")

    return F.concat_ws("-", F.substring(dashed(title), 1, 90), dashed(store), F.substring(dashed(code), 1, 50))


def brand(text: Column) -> Column:
    """Brand name without a leading shop or brand label."""
    out = clean(text)
    for lead in (r"(?i)^visite a loja d[ea]\s+", r"(?i)^marca:\s*", r"(?i)^brand:\s*"):
        out = F.regexp_replace(out, lead, "")
    return F.nullif(F.trim(out), F.lit(""))


def share_text(text: Column, most: int = 180) -> Column:
    one = clean(text)
    return F.when(F.length(one) > most, F.concat(F.rtrim(F.substring(one, 1, most - 3)), F.lit("..."))).otherwise(one)


def short_code(uuid: Column) -> Column:
    """First 12 hexadecimal digits of an id."""
    return F.substring(F.regexp_replace(uuid, "-", ""), 1, 12)


def code_prefix(code: Column) -> Column:
    """The id prefix that a short code stands for; null if it isn't one."""
    return F.when(code.rlike("^[0-9a-f]{12}$"), F.concat(F.substring(code, 1, 8), F.lit("-"), F.substring(code, 9, 4)))


def marketplace_label(key: Column) -> Column:
    pairs = [F.lit(x) for pair in MARKETPLACE_LABELS.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.initcap(F.lower(F.translate(key, "_", " "))))


def classify(text: Column, rules: list[tuple[str, tuple[str, ...]]], other: str) -> Column:
    """Name of the first rule of which the lower-cased text contains a word."""
    low, out = F.lower(text), F.lit(other)
    for name, words in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out
