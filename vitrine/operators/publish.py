"""Batch publication: batches are checked whole, then each item changes opportunity, queue, product and offer, or fails alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.functions import url
from vitrine.functions.text import blank_to_null
from vitrine.storage import save

MOST_ITEMS = 10
MARKET = "MERCADO_LIVRE"
#: Columns of the tables that a publication reads and writes.
OPPORTUNITY = ("id", "status", "source_url", "affiliate_link", "product_id", "error_message", "queued_at", "published_at")
QUEUE = ("id", "url", "marketplace", "affiliate_link", "opportunity_id", "status", "error_message", "product_id", "processed_at")


def _yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _placed(items: DataFrame, opportunities: DataFrame, queue: DataFrame, products: DataFrame, redirects: DataFrame | None, most: int) -> DataFrame:
    """What `checked` gives, with the opportunity's status (was), source_url and old_product.

    Links are taken apart once, in tasks by rows: items are read in few tasks, since they are compressed. For the same reason Spark
    takes the sides of joins for few rows; they are joined by shuffle.
    """
    id, link = blank_to_null(F.col("id")), blank_to_null(F.col("link"))
    dealt = items.where("batch is not null").select("batch", "position", "id", "link").repartition(F.xxhash64("batch", "position"))
    rows = dealt.select("batch", "position", id.alias("id"), url.normalise(link, url.QUEUE_DOMAINS).alias("link"), url.link_problem(link, url.QUEUE_DOMAINS).alias("_format"))
    rows = save(rows.withColumn("_low", F.lower("link")), "items")
    sizes = rows.groupBy("batch").agg(F.count("*").alias("_size")).hint("merge")
    ids = rows.groupBy("batch", "id").agg(F.min("position").alias("_id_at"))
    batches = ids.groupBy("id").agg(F.min("batch").alias("_batch")).hint("merge")
    links = rows.groupBy("batch", "_low").agg(F.min("position").alias("_link_at")).hint("merge")
    known = opportunities.select("id", F.col("status").alias("was"), "source_url", F.col("product_id").alias("old_product")).hint("merge")
    rows = rows.join(sizes, "batch").join(links, ["batch", "_low"], "left").join(ids.hint("merge"), ["batch", "id"], "left").join(batches, "id", "left").join(known, "id", "left")
    rows = save(rows, "placed")

    # Who else has the link: an owner outside the batch is one that none of the batch's items names; a null owner never is.
    asked = rows.where("link is not null").select("batch", "link").distinct()
    held = lambda table, owner, by: table.where("affiliate_link is not null").select(F.col("affiliate_link").alias("link"), F.col(owner).alias("owner"), F.lit(by).alias("by"))
    owners = held(opportunities, "id", "o").unionByName(held(queue, "opportunity_id", "q")).unionByName(held(products, "id", "p"))
    named = F.explode(F.array(F.struct(F.col("id").alias("owner"), F.lit("o").alias("by")), F.struct(F.col("id").alias("owner"), F.lit("q").alias("by")), F.struct(F.col("old_product").alias("owner"), F.lit("p").alias("by"))))
    own = rows.select("batch", named.alias("n")).select("batch", "n.*").where("owner is not null").distinct()
    outside = asked.join(owners.hint("merge"), "link").join(own.hint("merge"), ["batch", "owner", "by"], "left_anti")
    taken = outside.groupBy("batch", "link").agg(*[F.bool_or(F.col("by") == by).alias(name) for by, name in (("o", "_other"), ("q", "_queued"), ("p", "_sold"))])
    rows = rows.join(taken.hint("merge"), ["batch", "link"], "left")
    strays = F.lit(False)
    if redirects is not None:
        ends = redirects.groupBy(F.col("url").alias("link")).agg(F.min("final_url").alias("_final"))
        ends = ends.where(~url.on_any(url.host(F.col("_final")), url.QUEUE_DOMAINS) & F.col("_final").isNotNull())
        rows = rows.join(asked.join(ends.hint("merge"), "link").select("batch", "link", F.lit(True).alias("_stray")).hint("merge"), ["batch", "link"], "left")
        strays = F.col("_stray")
    problem = (
        F.when(F.col("_size") > most, "too many items")
        .when(F.col("id").isNull(), "no id")
        .when(F.col("_id_at") < F.col("position"), "repeated item")
        .when(F.col("_format").isNotNull(), F.col("_format"))
        .when(F.col("_link_at") < F.col("position"), "repeated link")
        .when(F.col("_batch") < F.col("batch"), "item of an earlier batch")
        .when(F.col("was").isNull(), "not found")
        .when(F.col("was") == "DISMISSED", "dismissed")
        .when(strays, "leads elsewhere")
        .when(F.col("_other"), "link of another opportunity")
        .when(F.col("_queued"), "link of another import")
        .when(F.col("_sold"), "link of another product")
    )
    rows = save(rows.select("batch", "position", "id", "link", problem.alias("problem"), "was", "source_url", "old_product"), "problems")
    bad = rows.where("problem is not null").select("batch").distinct().withColumn("_bad", F.lit(True))
    return rows.join(bad.hint("merge"), "batch", "left").withColumn("ready", F.col("_bad").isNull()).drop("_bad")


def checked(items: DataFrame, opportunities: DataFrame, queue: DataFrame, products: DataFrame, redirects: DataFrame | None = None, most: int = MOST_ITEMS) -> DataFrame:
    """Items (batch, position, id, link) with the normalised link, the first reason against each (problem), and whether their batch may go on (ready).

    A batch may go on if it has 1 to `most` items and none has a problem: no id, a link that is blank, no URL, with user
    information, within another link or of another host, an id or a link given twice in the batch, an id that an earlier
    batch has, an opportunity that isn't there or is dismissed, a link that leads to another host by the landed redirects
    (url, final_url), or that another opportunity, another opportunity's queue row or another product has.
    """
    return _placed(items, opportunities, queue, products, redirects, most).select("batch", "position", "id", "link", "problem", "ready")


def publish(items: DataFrame, opportunities: DataFrame, queue: DataFrame, products: DataFrame, offers: DataFrame, now: Column, redirects: DataFrame | None = None, most: int = MOST_ITEMS) -> dict[str, DataFrame]:
    """results (batch, position, id, success, queue_id, status, error) and the next opportunities, queue, products and offers.

    Items of a batch that may not go on fail with its problem, or because of the others', and change nothing. Of the others: a published
    opportunity passes its link on to its product and the product's offer; else its queue row is its own, or the one of
    its source URL, or a new one. A queue row that failed, or succeeded without a product, waits again. A queue row of
    another opportunity, or that an earlier item takes, a published opportunity without a product, and a product that
    isn't there fail that item alone. Queue rows have distinct urls and opportunities; ids of new ones are made from the opportunity's.
    """
    seen = save(_placed(items, opportunities, queue, products, redirects, most), "checked")
    rows = seen.where("ready").drop("problem", "ready")
    held = F.struct("id", "status", "product_id", "opportunity_id")
    own = queue.where("opportunity_id is not null").select(F.col("opportunity_id").alias("id"), held.alias("own")).hint("merge")
    by_url = queue.where("url is not null").select(F.col("url").alias("source_url"), held.alias("by_url")).hint("merge")
    rows = rows.join(own, "id", "left").join(by_url, "source_url", "left")
    taking = (F.col("was") != "PUBLISHED") & F.col("own").isNull()
    first = F.min(F.when(taking, F.struct("batch", "position"))).over(Window.partitionBy("source_url"))
    rows = rows.withColumn("_first", F.when(F.col("source_url").isNotNull(), first))
    foreign = taking & (_yes(F.col("by_url.opportunity_id") != F.col("id")) | _yes(F.struct("batch", "position") > F.col("_first")))
    row = F.when(F.col("was") != "PUBLISHED", F.coalesce("own", "by_url"))
    reset = _yes((row["status"] == "ERROR") | ((row["status"] == "SUCCESS") & row["product_id"].isNull()))
    queue_status = F.when(row.isNull() | reset, "PENDING").otherwise(row["status"])
    imported = _yes((row["status"] == "SUCCESS") & row["product_id"].isNotNull())
    synced = F.when(F.col("was") == "PUBLISHED", F.col("old_product")).when(imported, row["product_id"])
    rows = rows.withColumns({"row": row, "reset": reset, "queue_status": queue_status, "imported": imported, "foreign": foreign, "_synced": synced})
    # Rows without a product are dealt by their id, so they don't meet in one task.
    there = products.select(F.col("id").alias("_product"), F.lit(True).alias("_there")).hint("merge")
    rows = rows.withColumn("_product", F.coalesce("_synced", F.concat(F.lit("\u0001"), "id"))).join(there, "_product", "left")
    error = F.when((F.col("was") == "PUBLISHED") & F.col("old_product").isNull(), "published without a product").when(F.col("foreign"), "queue row of another opportunity").when(F.col("_synced").isNotNull() & F.col("_there").isNull(), "product not found")
    steps = save(rows.withColumn("error", error), "steps")

    done = steps.where("error is null")
    made = F.concat(F.lit("queue:"), F.col("id"))
    queued = F.col("was") != "PUBLISHED"
    ended = done.select("batch", "position", "id", F.lit(True).alias("success"), F.when(queued, F.coalesce("row.id", made)).alias("queue_id"), F.when(~queued | F.col("imported"), "PUBLISHED").otherwise(F.col("queue_status")).alias("status"), F.lit(None).cast("string").alias("error"))
    failed = steps.where("error is not null").select("batch", "position", "id", F.lit(False).alias("success"), F.lit(None).cast("string").alias("queue_id"), F.lit(None).cast("string").alias("status"), "error")
    refused = seen.where("not ready").select("batch", "position", "id", F.lit(False).alias("success"), F.lit(None).cast("string").alias("queue_id"), F.lit(None).cast("string").alias("status"), F.coalesce("problem", F.lit("batch refused")).alias("error"))
    results = ended.unionByName(failed).unionByName(refused)

    change = done.select("id", F.struct("link", "was", "row", "imported").alias("c")).hint("merge")
    o = opportunities.join(change, "id", "left")
    hit, again = F.col("c").isNotNull(), F.col("c.was") != "PUBLISHED"
    next_opportunities = o.withColumns(
        {
            "affiliate_link": F.when(hit, F.col("c.link")).otherwise(F.col("affiliate_link")),
            "error_message": F.when(~hit, F.col("error_message")),
            "status": F.when(hit & again, F.when(F.col("c.imported"), "PUBLISHED").otherwise("QUEUED")).otherwise(F.col("status")),
            "product_id": F.when(hit & again, F.col("c.row.product_id")).otherwise(F.col("product_id")),
            "queued_at": F.when(hit & again, F.coalesce("queued_at", now)).otherwise(F.col("queued_at")),
            "published_at": F.when(hit & again, F.when(F.col("c.imported"), F.coalesce("published_at", now))).otherwise(F.col("published_at")),
        }
    ).select(*opportunities.columns)

    with_row = done.where(queued & F.col("row").isNotNull()).select(F.col("row.id").alias("id"), F.struct("link", F.col("id").alias("opportunity_id"), "reset", "queue_status").alias("c")).hint("merge")
    q = queue.join(with_row, "id", "left")
    hit = F.col("c").isNotNull()
    kept = ~_yes(F.col("c.reset"))
    updated = q.withColumns(
        {
            "affiliate_link": F.when(hit, F.col("c.link")).otherwise(F.col("affiliate_link")),
            "opportunity_id": F.when(hit, F.col("c.opportunity_id")).otherwise(F.col("opportunity_id")),
            "status": F.when(hit, F.col("c.queue_status")).otherwise(F.col("status")),
            "error_message": F.when(kept, F.col("error_message")),
            "processed_at": F.when(kept, F.col("processed_at")),
        }
    ).select(*queue.columns)
    new = done.where(queued & F.col("row").isNull()).select(made.alias("id"), F.col("source_url").alias("url"), F.lit(MARKET).alias("marketplace"), F.col("link").alias("affiliate_link"), F.col("id").alias("opportunity_id"), F.lit("PENDING").alias("status"), now.alias("created_at"), F.lit(0).alias("attempts"))
    new = new.select(*[c for c in new.columns if c in queue.columns])
    next_queue = updated.unionByName(new, allowMissingColumns=True)

    # Two items may name one product: the later one's link stays.
    links = done.where("_synced is not null").groupBy(F.col("_synced").alias("id")).agg(F.max_by("link", F.struct("batch", "position")).alias("_link")).hint("merge")
    p = products.join(links, "id", "left")
    hit = F.col("_link").isNotNull()
    next_products = p.withColumns({"affiliate_link": F.when(hit, F.col("_link")).otherwise(F.col("affiliate_link")), "active": F.col("active") | hit}).select(*products.columns)
    told = p.where(hit).select(F.col("id").alias("product_id"), F.lit(MARKET).alias("marketplace"), F.struct("_link", "price", "old_price", "installments", "stock").alias("n")).hint("merge")
    f = offers.join(told, ["product_id", "marketplace"], "full_outer")
    hit = F.col("n").isNotNull()
    fields = {"id": F.coalesce("id", F.concat_ws(":", "product_id", "marketplace")), "affiliate_link": F.when(hit, F.col("n._link")).otherwise(F.col("affiliate_link")), "active": F.coalesce("active", F.lit(False)) | hit}
    fields |= {c: F.when(hit, F.col(f"n.{c}")).otherwise(F.col(c)) for c in ("price", "old_price", "installments", "stock")}
    next_offers = f.withColumns(fields).select(*offers.columns)
    return {"results": results, "opportunities": next_opportunities, "queue": next_queue, "products": next_products, "offers": next_offers}
