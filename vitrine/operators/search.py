"""Requests answered from the catalog, or imported and saved, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import url
from vitrine.functions.text import blank_to_null


def search_or_import(requests: DataFrame, offers: DataFrame, load: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(answers, to_save) of requests (request_id, url, external_id) against offers (marketplace, external_id, product_id).

    A request with a known code is answered at once; the others go through `load`, which keeps their columns and adds
    external_id and affiliate_link of what it found; a code known then is an answer too. What is left is to be saved:
    with its link, discovery source and auto_created, one row for each request. Codes of no found page stay null and are saved by nobody.
    """
    known = offers.groupBy("marketplace", "external_id").agg(F.min("product_id").alias("product_id"))
    asked = requests.withColumn("marketplace", url.marketplace(F.col("url"))).withColumn("external_id", blank_to_null(F.col("external_id")))
    first = asked.join(known, ["marketplace", "external_id"], "left")
    answered = first.where("product_id is not null").select("request_id", "product_id", F.lit(False).alias("imported"))
    loaded = load(first.where("product_id is null").select("request_id", "url", "marketplace"))
    second = loaded.where("external_id is not null").join(known, ["marketplace", "external_id"], "left")
    again = second.where("product_id is not null").select("request_id", "product_id", F.lit(True).alias("imported"))
    new = second.where("product_id is null").select("request_id", "url", "marketplace", "external_id", blank_to_null(F.col("affiliate_link")).alias("affiliate_link"), F.lit("ON_DEMAND_SEARCH").alias("discovery_source"), F.lit(True).alias("auto_created"))
    return answered.unionByName(again), new
