"""URL validation, normalisation and identifiers in URLs, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domains by marketplace, in the order of the check.
MARKETPLACE_DOMAINS = (
    ("MERCADO_LIVRE", ("mercadolivre.com.br", "mercadolivre.com", "meli.la")),
    ("AMAZON", ("amazon.com.br", "amazon.com", "amzn.to")),
    ("SHOPEE", ("shopee.com.br", "shopee.com", "shope.ee")),
    ("MAGAZINE_LUIZA", ("magazineluiza.com.br", "magalu.com.br", "magalu.com")),
    ("CASAS_BAHIA", ("casasbahia.com.br",)),
    ("KABUM", ("kabum.com.br",)),
    ("TERABYTE", ("terabyteshop.com.br",)),
    ("ALIEXPRESS", ("aliexpress.com", "aliexpress.us")),
    ("CARREFOUR", ("carrefour.com.br",)),
)
# Domains of links that may be put in the queue, and of pages that may be loaded.
QUEUE_DOMAINS = ("mercadolivre.com.br", "mercadolibre.com", "meli.la")
PAGE_DOMAINS = ("amazon.com.br", "amzn.to", "a.co")


def host(url: Column) -> Column:
    """Lower-case host of an http or https URL, else null; without www."""
    found = F.lower(F.nullif(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@\s]*@)?([^/?#:@\s]+)", 1), F.lit("")))
    return F.regexp_replace(found, r"^www\.", "")


def on_domain(name: Column, domain: str) -> Column:
    return (name == domain) | F.endswith(name, F.lit(f".{domain}"))


def on_any(name: Column, domains) -> Column:
    """Whether the host is one of the domains or below one: one pattern, so that the host is worked out once."""
    if not domains:
        return F.lit(False)
    ends = "|".join(re.escape(d) for d in domains)
    return F.coalesce(name.rlike(rf"(?:^|\.)(?:{ends})\z"), F.lit(False))


def marketplace(url: Column, table=MARKETPLACE_DOMAINS) -> Column:
    """Key of the first marketplace whose domain the URL is on; null if none."""
    name, out = host(url), F.lit(None).cast("string")
    for key, domains in reversed(table):
        out = F.when(on_any(name, domains), F.lit(key)).otherwise(out)
    return out


def normalise(url: Column, domains) -> Column:
    """The URL without its fragment, scheme and host in lower case; null unless http(s) and on a domain."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"(?i)^https?://[^/?]+", "")
    front = F.lower(F.regexp_extract(bare, r"(?i)^(https?://[^/?]+)", 1))
    return F.when(on_any(host(bare), domains), F.concat(front, F.when(rest == "", F.lit("/")).otherwise(rest)))


def link_problem(url: Column, domains) -> Column:
    """Why an affiliate link is refused, null if it isn't."""
    decoded = F.coalesce(F.try_url_decode(url), url)
    nested = F.regexp_replace(decoded, r"(?i)^https?://[^/?#]*", "").rlike("(?i)https?://")
    return (
        F.when(F.trim(F.coalesce(url, F.lit(""))) == "", "blank")
        .when(host(url).isNull(), "not a URL")
        .when(url.rlike(r"(?i)^https?://[^/?#]*@"), "user information")
        .when(nested, "link within a link")
        .when(~on_any(host(url), domains), "other host")
    )


def unwrap(url: Column) -> Column:
    """The last of links put one into another behind the short-link host."""
    return F.regexp_replace(url, r"(?i)^(?:https?://(?:www\.)?meli\.la/)+(?=https?://.)", "")


def links_in(text: Column) -> Column:
    """http(s) links of a free text, without closing marks at their end."""
    found = F.regexp_extract_all(text, F.lit(r"(?i)(https?://[^\s,;]+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[)\]}>.,;]+$", ""))


def asin(url: Column) -> Column:
    """Ten-character product code in the path, else in the query."""
    path = F.regexp_extract(url, r"(?i)/(?:dp|gp/product|gp/aw/d|product)/([A-Z0-9]{10})(?:[/?#]|$)", 1)
    query = F.regexp_extract(url, r"[?&](?:asin|ASIN)=([A-Za-z0-9]{10})(?:&|#|$)", 1)
    return F.upper(F.coalesce(F.nullif(path, F.lit("")), F.nullif(query, F.lit(""))))


def catalog_id(url: Column) -> Column:
    """Catalog code of the path /p/, else of the query."""
    decoded = F.coalesce(F.try_url_decode(url), url)
    found = [F.nullif(F.regexp_extract(decoded, p, 1), F.lit("")) for p in (r"(?i)/p/(MLB-?\d+)", r"(?i)[?&](?:catalog_product_id|product_id)=(MLB-?\d+)")]
    return F.upper(F.regexp_replace(F.coalesce(*found), "-", ""))


def shop_item(url: Column) -> Column:
    """Struct (shop, item) of the three URL shapes, else null."""
    shapes = (r"-i\.(\d+)\.(\d+)", r"/product/(\d+)/(\d+)", r"[?&]shop_?[iI]d=(\d+).*[?&]item_?[iI]d=(\d+)")
    return F.coalesce(*[F.when(url.rlike(p), F.struct(F.regexp_extract(url, p, 1).alias("shop"), F.regexp_extract(url, p, 2).alias("item"))) for p in shapes])


def image(url: Column) -> Column:
    """Image address without the size mark before its extension."""
    return F.regexp_replace(url, r"\._[^./]+_(?=\.[A-Za-z]+(?:\?|$))", "")


def https(url: Column) -> Column:
    return F.when(F.startswith(url, F.lit("//")), F.concat(F.lit("https:"), url)).otherwise(F.regexp_replace(url, "^http://", "https://"))


def item_id(url: Column) -> Column:
    """Item code of wid or item_id in the query, else of the path /MLB-123; such links are known, but not imported."""
    decoded = F.coalesce(F.try_url_decode(url), url)
    found = [F.nullif(F.regexp_extract(decoded, p, 1), F.lit("")) for p in (r"(?i)[?&#](?:wid|item_id)=(MLB-?\d+)", r"(?i)/(MLB-?\d+)(?:[-/?#]|$)")]
    return F.upper(F.regexp_replace(F.coalesce(*found), "-", ""))
