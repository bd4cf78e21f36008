"""Favorites: a user's account table, local lists, and bringing the two together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BLANK = "trim(coalesce(product_id, '')) = ''"


def apply(account: DataFrame, actions: DataFrame) -> DataFrame:
    """The account table (user_id, product_id, created_at) after actions (user_id, product_id, seq, at, add: boolean) in order of seq.

    Adding what is there changes nothing; removing deletes the row of that user and product; what is added after its
    last removal has the time of that first adding. Blank products and null users fall out. The same actions again change nothing
    but where they end on a removal followed by an adding, which takes the adding's time.
    """
    done = actions.where(f"user_id is not null and not ({_BLANK})").withColumn("product_id", F.trim("product_id"))
    removed = done.where("not add").groupBy("user_id", "product_id").agg(F.max("seq").alias("_removed"))
    rest = done.where("add").join(removed, ["user_id", "product_id"], "left").where("_removed is null or seq > _removed")
    added = rest.groupBy("user_id", "product_id").agg(F.min_by("at", "seq").alias("_at"))
    keys = ["user_id", "product_id"]
    rows = account.join(removed, keys, "left").withColumn("created_at", F.when(F.col("_removed").isNull(), F.col("created_at"))).drop("_removed")
    both = rows.join(added, keys, "full_outer")
    return both.select(*keys, F.coalesce("created_at", "_at").alias("created_at")).where("created_at is not null")


def sync(account: DataFrame, local: DataFrame, now: Column, removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the account table with the local favorites, the merged local lists: user_id, ids) of users with local lists (user_id, ids).

    Local ids that the account lacks are added at `now`. A merged list has the account's products first, the newest first and
    those of one time by their place in the local list, then by id; what the account doesn't take stays after them in local
    order. Ids are trimmed, each once, blank ones fall out. removed: (user_id, product_id, removed_at) of products deleted
    elsewhere: they aren't taken up again, and leave the local list. Syncing again changes nothing. Users without a local
    list keep their account as it is, and have no merged list.
    """
    keys = ["user_id", "product_id"]
    told = local.where("user_id is not null").select("user_id", F.posexplode("ids").alias("place", "product_id"))
    told = told.where(f"not ({_BLANK})").groupBy("user_id", F.trim("product_id").alias("product_id")).agg(F.min("place").alias("place"))
    if removed is not None:
        told = told.join(account.select(*keys, F.lit(True).alias("_kept")), keys, "left").join(removed.select(*keys, F.lit(True).alias("_gone")).distinct(), keys, "left").where("_kept or _gone is null").drop("_kept", "_gone")
    both = account.join(told, keys, "full_outer")
    after = both.select(*keys, F.coalesce("created_at", now).alias("created_at"))
    mine = both.join(local.select("user_id").distinct(), "user_id", "left_semi")
    last = F.lit(2**31 - 1)
    order = F.struct((-F.unix_micros(F.coalesce("created_at", now).cast("timestamp"))).alias("newest"), F.coalesce("place", last).alias("place"), "product_id")
    lists = mine.groupBy("user_id").agg(F.sort_array(F.collect_list(order)).alias("_l"))  # a user's favorites: one list by nature
    merged = local.select("user_id").where("user_id is not null").distinct().join(lists, "user_id", "left")
    return after, merged.select("user_id", F.coalesce(F.transform("_l", lambda x: x["product_id"]), F.array().cast("array<string>")).alias("ids"))


def favorite_products(lists: DataFrame, products: DataFrame, most: int = 100) -> DataFrame:
    """(user_id, position, product columns) of the listed products that there are, in the list's order, at most so many each."""
    places = lists.select("user_id", F.posexplode(F.slice("ids", 1, most)).alias("place", "id"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("place"))
    return places.join(products, "id").withColumn("position", rank).drop("place")
