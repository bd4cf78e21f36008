"""Pictures listed in the landed page of an affiliate product."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.attrs import union_distinct
from vitrine.functions.text import blank_to_null

# The picture host, keys of picture lists, the longest list, most pictures of a product.
HOST = "https://cf.shopee.com.br/file/"
KEYS = ("images", "image_list", "imageList")
LONGEST, MOST = 20000, 12
ESCAPES = (("(?i)&quot;", '"'), ("&#34;", '"'), (r"(?i)\\u002f", "/"), (r"\\/", "/"), (r'\\"', '"'))


def image_id(value: Column) -> Column:
    """Picture code: after /file/ in an address, else the value itself if it looks like a code, else null."""
    plain = F.trim(value)
    named = F.nullif(F.regexp_extract(plain, r"(?i)/file/([^?&#/\"']+)", 1), F.lit(""))
    return F.coalesce(named, F.when(plain.rlike(r"(?i)^[a-z0-9][a-z0-9._-]{15,}$"), plain))


def image_url(value: Column) -> Column:
    """Address of a picture: one on the picture host without query and fragment, else the host's with the code; null without a code."""
    plain = F.trim(value)
    front = F.regexp_extract(plain, r"(?i)^(https?://[^/]*)", 1)
    own = F.concat(F.lower(front), F.regexp_replace(F.substr(plain, F.length(front) + 1), "[?#].*$", ""))
    return F.when(plain.rlike(r"(?i)^https?://cf\.shopee\.com\.br/file/"), own).otherwise(F.concat(F.lit(HOST), image_id(plain)))


def listed(html: Column, main: Column) -> Column:
    """The main picture, then those of the first list of the page that holds it; without such a list the main one; empty without it."""
    page = html
    for found, put in ESCAPES:
        page = F.regexp_replace(page, found, put)
    blocks = F.regexp_extract_all(page, F.lit(rf'(?i)"(?:{"|".join(KEYS)})"\s*:\s*\[([^\]]{{0,{LONGEST}}})\]'), F.lit(1))
    pictures = F.transform(blocks, lambda b: F.filter(F.transform(F.regexp_extract_all(b, F.lit("[\"']([^\"']+)[\"']"), F.lit(1)), image_url), lambda u: u.isNotNull()))
    own = image_url(main)
    holds = lambda urls: F.exists(urls, lambda u: image_id(u) == image_id(own))
    return F.when(own.isNull(), F.array().cast("array<string>")).otherwise(union_distinct(F.array(own), F.get(F.filter(pictures, holds), F.lit(0)), most=MOST))


def with_gallery(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Records (url, image, ...) with images from the landed page of their url; where none was landed, the main picture alone.

    pages (url, html) may hold an address more than once: the least html counts. Records stay as many as they are.
    """
    found = pages.where(blank_to_null(F.col("html")).isNotNull()).groupBy("url").agg(F.min("html").alias("_html"))
    images = listed(F.coalesce("_html", F.lit("")), F.col("image"))
    return records.join(found, "url", "left").withColumn("images", images).drop("_html")
