"""Offers of a product: best offer, publication status, price log, recommendations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions.money import TOLERANCE
from vitrine.operators.ordered import listed
from vitrine.operators.query import best_per_key


def best_offers(offers: DataFrame, product: str = "product_id", price: str = "price", id: str = "id", eligible: Column | None = None) -> DataFrame:
    """The cheapest active offer of each product that is available, else the cheapest active one; ties by id."""
    good = eligible if eligible is not None else F.col("available") & ~F.col("status").isin("UNAVAILABLE", "ERROR")
    return best_per_key(offers.where("active"), [product], F.desc(F.coalesce(good, F.lit(False))), F.col(price), F.col(id))


def best_first(price: str = "price", id: str = "id") -> tuple[Column, Column, Column]:
    """What active offers of a product are ordered by: whether they can't be had, price, id."""
    return ~F.coalesce(F.col("available") & ~F.col("status").isin("UNAVAILABLE", "ERROR"), F.lit(False)), F.col(price), F.col(id)


def flag_best(offers: DataFrame, product: str = "product_id", price: str = "price", id: str = "id", distinct_ids: bool = False) -> DataFrame:
    """All offers with is_best recomputed: the least by availability, price and id of each product, by partial aggregates.

    Of several offers alike in all three one is the best, so these are numbered apart, which ids that are distinct within
    a product don't need.
    """
    late, *rest = best_first(price, id)
    place = F.struct(late.alias("late"), *[c.alias(n) for n, c in zip(("price", "id"), rest, strict=True)])
    best = offers.where("active").groupBy(product).agg(F.min(place).alias("_best"))
    first = F.coalesce(F.col("active") & place.eqNullSafe(F.col("_best")), F.lit(False))
    rows = offers.join(best, product, "left").withColumn("is_best", first).select(*[c for c in offers.columns if c != "is_best"], "is_best")
    if distinct_ids:
        return rows
    one = F.row_number().over(Window.partitionBy(product).orderBy(id)) == 1
    return rows.where("not is_best").unionByName(rows.where("is_best").withColumn("is_best", one))


def publication_status(offers: DataFrame, product: str = "product_id") -> DataFrame:
    """LIVE_PARTIAL while an active offer is pending or none is active with a link, else LIVE_COMPLETE."""
    linked = (F.col("status") == "ACTIVE") & (F.trim(F.coalesce("affiliate_link", F.lit(""))) != "")
    waiting = F.col("status").isin("PENDING_AFFILIATE", "DISCOVERED", "UNDER_REVIEW")
    seen = offers.where("active").groupBy(product).agg(F.bool_or(waiting).alias("pending"), F.bool_or(linked).alias("linked"))
    return seen.select(product, F.when(F.col("pending") | ~F.col("linked"), "LIVE_PARTIAL").otherwise("LIVE_COMPLETE").alias("publication_status"))


def offer_status(stock: Column, link: Column, before: Column) -> Column:
    """Status after an import: no stock, then a link, then a review under way, else waiting for a link."""
    return (
        F.when(stock <= 0, "UNAVAILABLE")
        .when(F.trim(F.coalesce(link, F.lit(""))) != "", "ACTIVE")
        .when(before == "UNDER_REVIEW", "UNDER_REVIEW")
        .otherwise("PENDING_AFFILIATE")
    )


def price_log(observations: DataFrame, keys: list[str], at: str, price: str, tolerance: float = TOLERANCE, also: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(keys, at, price, also) of the observations that differ from the last one kept, in order of time.

    The fold compares with what was kept, so a slow drift is logged once it exceeds the tolerance.
    """
    moment = F.col(at) if dict(observations.dtypes)[at] in ("int", "bigint") else F.col(at).cast("timestamp_ntz")
    rows = observations.select(*keys, moment.alias(at), F.col(price).cast("double").alias(price), *also)
    schema = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    # By a hash of the keys: Spark leaves out an exchange by keys that the rows are already dealt by, and may then split or merge those tasks.
    return rows.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, at, price).mapInArrow(_kept(len(keys), tolerance), schema)


def _kept(keys: int, tolerance: float):
    """Of rows (keys, time, price, ...) in order those that differ from the last one kept; only that one is held.

    Only a key's first row and rows whose price isn't that of the row before can be kept; the others aren't looked at.
    """

    def run(batches):
        key = last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            price = batch.column(keys + 1)
            value = price.to_numpy(zero_copy_only=False)
            change = np.ones(n, dtype=bool)
            change[1:] = (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
            for k in range(keys):
                # Equal keys lie together: a key changes where its code does.
                code = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= code[1:] != code[:-1]
            keep = np.zeros(n, dtype=bool)
            at = np.flatnonzero(change)
            changed = batch.select(range(keys + 2)).take(pa.array(at))
            for i, p, *row in zip(at.tolist(), listed(changed.column(keys + 1)), *(listed(c) for c in changed.columns[:keys]), strict=True):
                row = ["NaN" if x != x else x for x in row]
                if row != key:
                    key, last = row, p
                    keep[i] = True
                elif last is not None and p is not None and not abs(last - p) <= tolerance:
                    keep[i], last = True, p
            yield batch.filter(pa.array(keep))

    return run


def recommend(products: DataFrame, anchor: dict, k: int = 8, id: str = "id") -> DataFrame:
    """k products for an anchor (id, category, brand): of its category or brand first, each part newest featured first."""
    alike = F.col("category") == anchor["category"]
    if (anchor.get("brand") or "").strip():
        alike = alike | (F.col("brand") == anchor["brand"])
    return products.where(F.col(id) != anchor["id"]).withColumn("is_similar", F.coalesce(alike, F.lit(False))).orderBy(F.desc("is_similar"), F.desc("featured"), F.desc("updated_at"), F.col(id)).limit(k)


def scan_until(candidates: DataFrame, position: str, eligible: str, wanted: int, batch: int = 4) -> DataFrame:
    """(found, scanned): how far a scan in batches goes until enough candidates are eligible.

    The wanted-th eligible position is a top-k over eligible rows, so no row order is computed over all.
    """
    hits = candidates.where(eligible).orderBy(position).limit(wanted).agg(F.count("*").alias("found"), F.max(position).alias("last"))
    total = candidates.agg(F.count("*").alias("n"))
    scanned = F.when(F.col("found") >= wanted, F.least("n", (F.ceil(F.col("last") / batch) * batch))).otherwise(F.col("n"))
    return hits.join(F.broadcast(total)).select("found", scanned.cast("long").alias("scanned"))
