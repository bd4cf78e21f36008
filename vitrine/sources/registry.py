"""Adapters by marketplace: each turns landed rows into canonical records; keys without one give error rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.functions import url
from vitrine.functions.text import marketplace_label

Adapter = Callable[[DataFrame], DataFrame]


def dispatch(links: DataFrame, adapters: dict[str, Adapter], column: str = "url") -> tuple[DataFrame, DataFrame]:
    """(records of all adapters, refused links with an error).

    An adapter gets the links of its marketplace. Refused are blank and unknown hosts and marketplaces
    without an adapter.
    """
    marked = links.withColumn("marketplace", url.marketplace(F.col(column)))
    records = reduce(DataFrame.unionByName, [run(marked.where(F.col("marketplace") == key)) for key, run in adapters.items()])
    error = F.when(F.trim(F.coalesce(column, F.lit(""))) == "", "blank URL").when(F.col("marketplace").isNull(), "unsupported URL").otherwise(F.concat(marketplace_label(F.col("marketplace")), F.lit(": not implemented")))
    refused = marked.where(F.col("marketplace").isNull() | ~F.col("marketplace").isin(list(adapters))).withColumn("error", error)
    return records, refused
