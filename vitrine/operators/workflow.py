"""Import queue and opportunities as set-based state transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.query import clamp

#: Characters that are kept of a message.
MESSAGE = 2000


def claim(queue: DataFrame, limit=5, created: str = "created_at", id: str = "id") -> DataFrame:
    """The queue with its oldest pending rows in processing, one attempt more and no error."""
    chosen = queue.where("status = 'PENDING'").orderBy(created, id).limit(clamp(limit)).select(id, F.lit(True).alias("_claimed"))
    taken = F.col("_claimed").isNotNull() & (F.col("status") == "PENDING")
    rows = queue.join(F.broadcast(chosen), id, "left")
    return rows.withColumns({"attempts": F.col("attempts") + F.when(taken, 1).otherwise(0), "error_message": F.when(~taken, F.col("error_message")), "status": F.when(taken, "PROCESSING").otherwise(F.col("status"))}).select(*queue.columns)


def _ended(results: DataFrame, id: str) -> DataFrame:
    """Results (id, product_id, error) to be joined, messages cut first; by shuffle, since Spark takes texts for short ones and would broadcast them."""
    return results.select(id, F.col("product_id").alias("_product"), F.substring("error", 1, MESSAGE).alias("_error"), F.lit(True).alias("_done")).hint("merge")


def finish(queue: DataFrame, results: DataFrame, id: str = "id", now: Column | None = None) -> DataFrame:
    """Rows in processing with a result (id, product_id, error) become SUCCESS or ERROR; messages keep 2000 characters.

    processed_at, where the queue has it, is set to `now`.
    """
    rows = queue.join(_ended(results, id), id, "left")
    done, failed = F.coalesce("_done", F.lit(False)) & (F.col("status") == "PROCESSING"), F.col("_error").isNotNull()
    stamp = {"processed_at": F.when(done, F.current_timestamp() if now is None else now).otherwise(F.col("processed_at"))} if "processed_at" in queue.columns else {}
    return rows.withColumns(
        stamp
        | {
            "product_id": F.when(done & ~failed, F.col("_product")).otherwise(F.col("product_id")),
            "error_message": F.when(done & failed, F.col("_error")).when(~done, F.col("error_message")),
            "status": F.when(done & failed, "ERROR").when(done, "SUCCESS").otherwise(F.col("status")),
        }
    ).select(*queue.columns)


def retry(queue: DataFrame, ids: Column) -> DataFrame:
    """Failed rows that `ids` marks wait again, without message, product and time of processing; their attempts stay."""
    again = ids & (F.col("status") == "ERROR")
    cleared = [c for c in ("error_message", "product_id", "processed_at") if c in queue.columns]
    return queue.withColumns({c: F.when(~again, F.col(c)) for c in cleared} | {"status": F.when(again, "PENDING").otherwise(F.col("status"))})


def delete(queue: DataFrame, ids: Column) -> DataFrame:
    """The queue without the marked rows, but for those in processing."""
    return queue.where(~ids | (F.col("status") == "PROCESSING"))


def affected(queue: DataFrame, ids: Column, allowed: Column) -> DataFrame:
    """(requested, affected): rows that `ids` marks, and those of them that the guard allows."""
    return queue.agg(F.count_if(ids).alias("requested"), F.count_if(ids & allowed).alias("affected"))


def queue_results(opportunities: DataFrame, results: DataFrame, now: Column, id: str = "id") -> DataFrame:
    """Opportunities after their queue rows ended (id, product_id, error): PUBLISHED with product and time, or ERROR with one attempt more."""
    hit = F.coalesce("_done", F.lit(False)) & F.col("status").isin("QUEUED", "READY_TO_QUEUE", "ERROR")
    good, bad = hit & F.col("_error").isNull(), hit & F.col("_error").isNotNull()
    changed = {
        "product_id": F.when(good, F.col("_product")).otherwise(F.col("product_id")),
        "published_at": F.when(good, now).otherwise(F.col("published_at")),
        "error_message": F.when(bad, F.col("_error")).when(~good, F.col("error_message")),
        "attempts": F.col("attempts") + F.when(bad, 1).otherwise(0),
        "status": F.when(good, "PUBLISHED").when(bad, "ERROR").otherwise(F.col("status")),
    }
    return opportunities.join(_ended(results, id), id, "left").withColumns(changed).select(*opportunities.columns)


def batch_problems(items: DataFrame, existing: DataFrame, most: int = 10) -> DataFrame:
    """Items (id, link) of a batch publication with the first reason to refuse each, null if it may go on.

    Checked are the batch's size, ids and links given twice, unknown and dismissed opportunities, and links
    that another opportunity outside the batch has.
    """
    link = F.lower(F.trim("link"))
    per_id = items.groupBy("id").agg(F.count("*").alias("_ids"))
    per_link = items.groupBy(link.alias("_link")).agg(F.count("*").alias("_links"))
    known = existing.select("id", F.col("status").alias("_status"))
    taken = conflicts(items.select("id", link.alias("_link")), existing.select("id", F.lower(F.trim("affiliate_link")).alias("_link")), "_link", "id").select("_link", F.lit(True).alias("_taken")).distinct()
    rows = items.withColumn("_link", link).join(F.broadcast(items.agg(F.count("*").alias("_size")))).join(per_id, "id").join(per_link, "_link", "left").join(known, "id", "left").join(taken, "_link", "left")
    reason = (
        F.when(F.col("_size") > most, "too many items")
        .when(F.coalesce("_link", F.lit("")) == "", "no link")
        .when(F.col("_ids") > 1, "repeated item")
        .when(F.col("_links") > 1, "repeated link")
        .when(F.col("_status").isNull(), "not found")
        .when(F.col("_status") == "DISMISSED", "dismissed")
        .when(F.col("_taken"), "link in use")
    )
    return rows.select(*items.columns, reason.alias("problem"))


def relink(status: Column, product: Column, batch: bool) -> Column:
    """Status of an existing queue row when its opportunity is queued again."""
    stale = (status == "ERROR") | (F.lit(batch) & (status == "SUCCESS") & product.isNull())
    return F.when(stale, "PENDING").otherwise(status)


def save_link(status: Column) -> Column:
    """Opportunity status after a link is saved; null where that isn't allowed."""
    return F.when(status.isin("WAITING_AFFILIATE", "READY_TO_QUEUE", "ERROR"), "READY_TO_QUEUE")


def enqueue(status: Column, has_link: Column, queue_status: Column, queue_product: Column) -> Column:
    """Opportunity status after it is put in the queue; null where that is refused."""
    published = (queue_status == "SUCCESS") & queue_product.isNotNull()
    return F.when(status.isin("QUEUED", "PUBLISHED"), status).when((status == "READY_TO_QUEUE") & has_link, F.when(F.coalesce(published, F.lit(False)), "PUBLISHED").otherwise("QUEUED"))


def publish(status: Column, queue_status: Column, queue_product: Column) -> Column:
    """Opportunity status after a batch publication; null for dismissed ones."""
    published = F.coalesce((queue_status == "SUCCESS") & queue_product.isNotNull(), F.lit(False))
    return F.when(status == "DISMISSED", None).when((status == "PUBLISHED") | published, "PUBLISHED").otherwise("QUEUED")


def duplicates(df: DataFrame, column: str) -> DataFrame:
    """(value, n) of the values, without regard to case and outer blanks, that occur more than once."""
    return df.groupBy(F.lower(F.trim(column)).alias("value")).agg(F.count("*").alias("n")).where("n > 1")


def conflicts(batch: DataFrame, existing: DataFrame, link: str, id: str) -> DataFrame:
    """Rows of a batch whose link another row outside the batch has."""
    outside = existing.join(batch.select(id), id, "left_anti").select(link)
    return batch.join(outside, link, "left_semi")
