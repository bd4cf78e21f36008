"""Discovery of opportunities: the highlights of categories in a seeded order, scanned in batches until enough are eligible."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.text import blank_to_null
from vitrine.operators.query import clamp

#: Where a product is shown if its offer has no address.
PRODUCT_PAGE = "https://www.mercadolivre.com.br/p/"


def best_discounts(offers: DataFrame) -> DataFrame:
    """(external_id, offer): of each product's priced, open offers under their old price that with the highest discount, the first of equals.

    offers: external_id, place (its number in the list), item_id, price, original_price, status, permalink, image.
    """
    open_ = ~F.coalesce(F.col("status"), F.lit("")).isin("inactive", "closed")
    valid = offers.where(F.col("item_id").isNotNull() & (F.col("price") > 0) & (F.col("original_price") > F.col("price")) & open_)
    rank = F.struct((F.col("original_price") - F.col("price")) / F.col("original_price"), -F.col("place"))
    return valid.groupBy("external_id").agg(F.max_by(F.struct("item_id", "price", "original_price", "permalink", "image"), rank).alias("offer"))


def discover(highlights: DataFrame, offers: DataFrame, details: DataFrame, categories: DataFrame, existing: DataFrame, wanted: int, seed: int = 0, batch: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows to add, accounting: category_id, category_name, requested, scanned, eligible, added, ignored) of every category's discovery.

    highlights: category_id, position, external_id, type; details: external_id, title, image; categories: id, name; existing:
    external_id. Only highlights of type PRODUCT with an id count; known ids fall out first, whatever their marketplace.
    The rest is scanned in an order fixed by the seed, `batch` at a time, until `wanted` (1 to 10) are eligible: those
    with a title and an offer whose discount rounds to 1 or more. An id chosen twice is added once, the other is ignored.

    The last scanned position follows from the order key of the wanted-th eligible row and a count of the keys up to it, so no
    category is sorted whole.
    """
    limit = clamp(wanted)
    fresh = highlights.where("type = 'PRODUCT' and external_id is not null").join(existing.select("external_id").where("external_id is not null").distinct(), "external_id", "left_anti")
    key = F.md5(F.concat_ws(":", "category_id", "external_id", F.col("position").cast("string"), F.lit(str(seed))))
    placed = fresh.withColumn("_key", key)
    rated = placed.join(best_discounts(offers), "external_id").join(details.select("external_id", blank_to_null(F.col("title")).alias("title"), F.col("image").alias("_picture")), "external_id")
    discount = F.round((F.col("offer.original_price") - F.col("offer.price")) / F.col("offer.original_price") * 100).cast("int")
    eligible = rated.withColumn("discount", discount).where("discount > 0 and title is not null")
    top = Window.partitionBy("category_id").orderBy("_key")
    chosen = eligible.withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= limit)
    limits = chosen.groupBy("category_id").agg(F.count("*").alias("eligible"), F.count_distinct("external_id").alias("added"), F.max("_key").alias("_last"))
    seen = placed.join(limits, "category_id", "left").groupBy("category_id").agg(F.count("*").alias("_total"), F.count_if(F.col("_key") <= F.col("_last")).alias("_rank"))
    named = categories.select(F.col("id").alias("category_id"), blank_to_null(F.col("name")).alias("name"))
    tally = highlights.select("category_id").distinct().join(seen, "category_id", "left").join(limits, "category_id", "left").join(named, "category_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    scanned = F.when(F.col("eligible") >= limit, F.least("_total", F.ceil(F.col("_rank") / batch) * batch)).otherwise(F.col("_total"))
    accounting = tally.select(
        "category_id", F.coalesce("name", "category_id").alias("category_name"), F.lit(limit).alias("requested"), zero(scanned).alias("scanned"), zero(F.col("eligible")).alias("eligible"), zero(F.col("added")).alias("added"), (zero(F.col("eligible")) - zero(F.col("added"))).alias("ignored")
    )
    once = chosen.groupBy("external_id").agg(F.min_by(F.struct("category_id", "title", "discount", "offer", "_picture"), F.struct("category_id", "_n")).alias("c"))
    added = once.select(
        "external_id",
        F.lit("PRODUCT").alias("source_type"),
        F.coalesce(blank_to_null(F.col("c.offer.permalink")), F.concat(F.lit(PRODUCT_PAGE), "external_id")).alias("source_url"),
        F.col("c.title").alias("title"),
        F.coalesce("c._picture", "c.offer.image").alias("image"),
        F.col("c.category_id").alias("category_id"),
        F.col("c.offer.price").alias("price"),
        F.col("c.offer.original_price").alias("old_price"),
        F.col("c.discount").alias("discount"),
        F.lit(None).cast("string").alias("affiliate_link"),
        F.lit("WAITING_AFFILIATE").alias("status"),
        F.lit(0).alias("attempts"),
    )
    return added, accounting
