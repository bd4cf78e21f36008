"""Landed catalog and affiliate JSON, brought to the canonical import record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import jsons, money, text, url
from vitrine.functions.attrs import union_distinct
from vitrine.sources.redirects import follow

#: Schemas of the landed files; a reader given them never infers.
CATALOG_PRODUCT = "id string, name string, family_name string, status string, url string, pictures array<struct<id: string, url: string, secure_url: string>>, attributes array<struct<id: string, name: string, value_name: string, value_struct: struct<number: double, unit: string>>>, buy_box_winner struct<item_id: string>"
CATALOG_OFFERS = "product_id string, results array<struct<item_id: string, price: double, original_price: double, category_id: string, seller_id: bigint, available_quantity: int, sold_quantity: int, condition: string, warranty: string, status: string>>"
ITEM_DESCRIPTION = "item_id string, plain_text string"
ITEM_REVIEWS = "item_id string, rating_average double, paging struct<total: bigint>"
CATEGORIES = "id string, name string"
AFFILIATE_OFFER = "itemId bigint, shopId bigint, productName string, shopName string, price string, priceMin string, imageUrl string, productLink string, offerLink string, ratingStar string, sales int, priceDiscountRate double"

#: Columns of the canonical import record.
RECORD = ("marketplace", "external_id", "url", "affiliate_link", "title", "brand", "image", "images", "price", "old_price", "discount", "rating", "sales", "stock", "seller", "attributes", "error")
#: Columns that records of pages have besides.
DETAILS = ("description", "category", "reviews")


def attribute_value(a: Column) -> Column:
    """value_name, else number and unit."""
    number = F.regexp_replace(a["value_struct"]["number"].cast("string"), r"\.0$", "")
    return F.coalesce(text.blank_to_null(a["value_name"]), F.nullif(F.concat_ws(" ", number, a["value_struct"]["unit"]), F.lit("")))


def specs(attributes: Column) -> Column:
    """array<struct<key, value>> of the attributes that have both, in order."""
    pairs = F.transform(attributes, lambda a: F.struct(F.trim(a["name"]).alias("key"), attribute_value(a).alias("value")))
    return F.filter(pairs, lambda p: (p["key"] != "") & p["value"].isNotNull())


def winning_offer(results: Column, winner: Column) -> Column:
    """The buy-box winner among the active priced offers, else the cheapest; null without any."""
    live = F.filter(results, lambda o: (o["price"] > 0) & (F.coalesce(o["status"], F.lit("active")) == "active"))
    keyed = F.transform(live, lambda o: F.struct(F.coalesce(o["item_id"] != winner, F.lit(True)).alias("other"), o["price"].alias("p"), o["item_id"].alias("i"), o.alias("offer")))
    return F.get(F.transform(F.array_sort(F.transform(keyed, lambda k: F.struct(k["other"], k["p"], k["i"], F.to_json(k["offer"]).alias("offer")))), lambda k: k["offer"]), F.lit(0))


def _problem(*tests: tuple[Column, str]) -> Column:
    """Text of the first test that holds, else null."""
    return F.coalesce(*[F.when(t, F.lit(m)) for t, m in tests], F.lit(None).cast("string"))


def catalog_records(products: DataFrame, offers: DataFrame) -> DataFrame:
    """Canonical records of catalog products with the offer that wins; rows that fail a rule carry its text in error."""
    one = "item_id string, price double, original_price double, seller_id bigint, available_quantity int, sold_quantity int"
    rows = products.join(offers.withColumnRenamed("product_id", "id"), "id", "left").withColumn("o", F.from_json(winning_offer(F.col("results"), F.col("buy_box_winner.item_id")), one))
    pictures = F.transform("pictures", lambda p: url.https(F.coalesce(p["secure_url"], p["url"])))
    brand = F.get(F.filter("attributes", lambda a: (a["id"] == "BRAND") | (F.upper(a["name"]) == "MARCA")), F.lit(0))["value_name"]
    out = rows.select(
        F.lit("MERCADO_LIVRE").alias("marketplace"),
        F.upper(F.col("id")).alias("external_id"),
        F.col("url"),
        F.lit(None).cast("string").alias("affiliate_link"),
        F.coalesce(text.blank_to_null(F.col("name")), text.blank_to_null(F.col("family_name"))).alias("title"),
        text.brand(brand).alias("brand"),
        union_distinct(pictures).alias("images"),
        F.col("o.price").alias("price"),
        F.when(F.col("o.original_price") > F.col("o.price"), F.col("o.original_price")).alias("old_price"),
        money.discount_pct(F.col("o.original_price"), F.col("o.price")).alias("discount"),
        F.lit(None).cast("double").alias("rating"),
        F.col("o.sold_quantity").alias("sales"),
        F.col("o.available_quantity").alias("stock"),
        F.col("o.seller_id").cast("string").alias("seller"),
        specs(F.col("attributes")).alias("attributes"),
    ).withColumn("image", F.get("images", F.lit(0)))
    error = _problem((F.col("title").isNull(), "no title"), (F.col("price").isNull(), "no valid offer"), (F.col("image").isNull(), "no image"))
    return out.withColumn("error", error).select(*RECORD)


def affiliate_records(offers: DataFrame) -> DataFrame:
    """Canonical records of affiliate offers; prices come as text."""
    price, lowest = F.col("price").try_cast("double"), F.col("priceMin").try_cast("double")
    paid = F.coalesce(price, lowest)
    rate = F.col("priceDiscountRate")
    rating = F.col("ratingStar").try_cast("double")
    out = offers.select(
        F.lit("SHOPEE").alias("marketplace"),
        F.concat_ws(".", F.col("shopId").cast("string"), F.col("itemId").cast("string")).alias("external_id"),
        F.col("productLink").alias("url"),
        text.blank_to_null(F.col("offerLink")).alias("affiliate_link"),
        text.blank_to_null(F.col("productName")).alias("title"),
        F.lit(None).cast("string").alias("brand"),
        url.https(F.col("imageUrl")).alias("image"),
        union_distinct(F.array(url.https(F.col("imageUrl"))), most=12).alias("images"),
        paid.alias("price"),
        F.when((rate > 0) & (rate < 100), F.round(paid / (1 - rate / 100), 2)).alias("old_price"),
        F.when((rate > 0) & (rate < 100), F.round(rate).cast("int")).alias("discount"),
        F.when(rating.between(0, 5), rating).alias("rating"),
        F.col("sales"),
        F.lit(None).cast("int").alias("stock"),
        text.blank_to_null(F.col("shopName")).alias("seller"),
        F.array().cast("array<struct<key: string, value: string>>").alias("attributes"),
    )
    error = _problem((F.col("price").isNull() | (F.col("price") <= 0), "no price"), (F.col("affiliate_link").isNull(), "no affiliate link"))
    return out.withColumn("error", error).select(*RECORD)


def page_records(products: DataFrame) -> DataFrame:
    """Canonical records of parsed product pages (see pages.read_products)."""
    from vitrine.sources.pages import first_price, rating, stock

    rows = products.withColumns({"_price": first_price(F.col("prices"), F.col("offered")), "_old": first_price(F.col("old_prices"))})
    price, old = F.col("_price"), F.col("_old")
    out = rows.select(
        F.lit("AMAZON").alias("marketplace"),
        F.coalesce(url.asin(F.col("url")), url.asin(F.col("canonical")), url.asin(F.col("shared_url")), F.col("code")).alias("external_id"),
        F.col("url"),
        F.lit(None).cast("string").alias("affiliate_link"),
        text.blank_to_null(F.col("title")).alias("title"),
        text.brand(F.col("brand")).alias("brand"),
        url.image(F.col("image")).alias("image"),
        union_distinct(F.transform("images", url.image)).alias("images"),
        price.alias("price"),
        F.when(old > price, old).alias("old_price"),
        money.discount_pct(old, price).alias("discount"),
        rating(F.col("rating_text"), F.col("ld_rating")).alias("rating"),
        F.lit(None).cast("int").alias("sales"),
        stock(F.col("availability")).alias("stock"),
        text.blank_to_null(F.col("seller")).alias("seller"),
        F.col("attributes"),
        F.col("description"),
        text.blank_to_null(F.col("category")).alias("category"),
        F.coalesce(money.int_digits(F.col("reviews_text")), money.int_digits(F.col("ld_reviews"))).cast("int").alias("reviews"),
    )
    error = _problem((F.col("title").isNull(), "no title"), (F.col("price").isNull() | (F.col("price") <= 0), "no price"), (F.col("image").isNull(), "no image"), (F.col("external_id").isNull(), "no product code"))
    return out.withColumn("error", error).select(*RECORD, *DETAILS)


def resolve_links(rows: DataFrame, redirects: DataFrame, link: str = "url") -> DataFrame:
    """Links replaced by where landed redirects (url, final_url) lead, hop by hop; unknown ones, and those that don't end, stay."""
    return follow(rows, redirects, link).withColumn(link, F.coalesce("destination", link)).select(*rows.columns)


def pasted_links(texts: DataFrame, column: str) -> DataFrame:
    """(position, url): the non-blank lines of pasted texts, each once, where it stood first."""
    lines = texts.select(F.posexplode(F.split(column, r"\r?\n")).alias("position", "url")).withColumn("url", F.trim("url")).where("url <> ''")
    return lines.groupBy("url").agg(F.min("position").alias("position"))


def destinations(rows: DataFrame, redirects: DataFrame, domains, link: str = "url") -> DataFrame:
    """Rows with destination_ok: whether the landed end of the link is on a domain; unknown ones pass, loops don't."""
    ended = follow(rows, redirects, link)
    known = (F.col("hops") > 0) | F.col("redirect_error").isNotNull()
    ok = ~known | (F.col("destination").isNotNull() & url.on_any(url.host(F.col("destination")), domains))
    return ended.withColumn("destination_ok", ok).select(*rows.columns, "destination_ok")


def condition_and_warranty(attributes: Column, condition: Column, warranty: Column) -> Column:
    """Attributes with the condition and the warranty after them; of keys that come twice the last value counts."""
    named = F.array(F.struct(F.lit("Condição").alias("key"), F.when(condition == "new", "Novo").otherwise(condition).alias("value")), F.struct(F.lit("Garantia").alias("key"), warranty.alias("value")))
    listed = F.filter(F.concat(attributes, named), lambda p: text.blank_to_null(p["value"]).isNotNull())
    later = lambda p, i: F.exists(F.slice(listed, i + 2, F.size(listed)), lambda q: q["key"] == p["key"])
    return F.filter(listed, lambda p, i: ~later(p, i))


def with_details(items: DataFrame, descriptions: DataFrame, reviews: DataFrame, categories: DataFrame) -> DataFrame:
    """Items (item_id, category_id, ...) with description, rating, n_reviews and category where they were landed, else null."""
    told = descriptions.groupBy("item_id").agg(F.min("plain_text").alias("description"))
    rated = reviews.groupBy("item_id").agg(F.max_by(F.struct(F.col("rating_average").alias("rating"), F.col("paging.total").alias("n_reviews")), F.col("paging.total")).alias("_rated"))
    kinds = category_list(categories).withColumnsRenamed({"id": "category_id", "name": "category"})
    out = items.join(told, "item_id", "left").join(rated, "item_id", "left").join(kinds, "category_id", "left")
    return out.select(*items.columns, "description", "_rated.rating", "_rated.n_reviews", "category")


def category_list(categories: DataFrame) -> DataFrame:
    """(id, name): categories that have both, each id once, names trimmed."""
    rows = categories.where("id is not null and name is not null")
    return rows.groupBy("id").agg(F.min(F.trim("name")).alias("name"))


def multiget(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """(request_id, item_id, success, is_json, data, error) of requests (request_id, item_id) against landed responses (item_id, status, body).

    Item ids are trimmed and upper-cased; what isn't MLB and digits is refused and asks for nothing. A body that isn't
    JSON is kept as the text it is; an item without a response, or with a status from 400 on, is an error with its
    body kept. Of several responses to an item the one with the least status, then body, counts.
    """
    asked = requests.withColumn("item_id", F.upper(F.trim(F.coalesce("item_id", F.lit("")))))
    told = responses.groupBy(F.upper(F.trim("item_id")).alias("item_id")).agg(F.min(F.struct("status", "body")).alias("r"))
    valid = F.col("item_id").rlike(r"^MLB\d+$")
    rows = asked.join(told, "item_id", "left").withColumn("b", jsons.body(F.col("r.body")))
    error = F.when(~valid, "invalid item").when(F.col("r").isNull(), "no response").when(F.col("r.status") >= 400, F.concat(F.lit("status "), F.col("r.status").cast("string")))
    there = valid & F.col("r.body").isNotNull()
    return rows.select("request_id", "item_id", error.isNull().alias("success"), F.when(there, F.col("b.is_json")).alias("is_json"), F.when(there, F.col("b.data")).alias("data"), error.alias("error"))


def exact_offers(responses: DataFrame) -> DataFrame:
    """Of each response (shop, item, nodes: array of AFFILIATE_OFFER) the node of that shop and item, or the reason why there is none in error."""
    node = F.get(F.filter("nodes", lambda n: (n["shopId"].cast("string") == F.col("shop")) & (n["itemId"].cast("string") == F.col("item"))), F.lit(0))
    error = _problem((F.col("node").isNull(), "not in the affiliate programme"), (text.blank_to_null(F.col("node.offerLink")).isNull(), "no affiliate link"))
    return responses.withColumn("node", node).select("shop", "item", "node", error.alias("error"))


def signature(app: Column, at: Column, payload: Column, secret: Column) -> Column:
    """SHA-256 of the parts of a signed request, end to end."""
    return F.sha2(F.concat(app, at.cast("string"), payload, secret), 256)
