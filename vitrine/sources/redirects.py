"""Landed redirects followed to their ends by pointer doubling, with a host rule on every hop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import url as urls
from vitrine.functions.url import PAGE_DOMAINS
from vitrine.storage import save

MOST_HOPS = 20
#: Hosts where a product page may be; its links may also be short ones.
PAGE_HOSTS = ("amazon.com.br",)
#: What is known of a jump: it may go on, it is at its end, it goes round.
MOVES, ENDED, LOOPS = "moves", "ended", "loops"
LOOP, FAR, STRAY, WRONG_END = "redirect loop", "too many redirects", "redirect to another host", "ends on another host"


def ends(redirects: DataFrame, domains: tuple[str, ...] | None = None) -> DataFrame:
    """(url, end, hops, stray) of every landed redirect (url, final_url): where following it leads, in how many hops, and the
    first address on the way, or at its end, that isn't on `domains`, null if there is none; end is null for loops.

    Each round joins what still moves with the jumps of all and doubles its own, so chains of up to 2**k hops take k joins;
    what has come to its end is set aside. `low` is the least address that a jump passes; if the jump onward has the same, that address is
    passed twice and the way goes round, which takes about as many rounds as the loop's length doubles. Of several targets the least counts;
    an address that leads to itself is an end. Joins are by shuffle: stored addresses are compressed, so Spark takes them for few.
    """
    off = (lambda c: F.when(~urls.on_any(urls.host(c), domains), c)) if domains else (lambda c: F.lit(None).cast("string"))
    known = redirects.where("url is not null and final_url is not null and url <> final_url").groupBy("url").agg(F.min("final_url").alias("end"))
    moving = save(known.withColumns({"hops": F.lit(1).cast("long"), "stray": off(F.col("end")), "low": F.col("end"), "state": F.lit(MOVES)}), "jumps")
    count, settled = moving.count(), None
    while not moving.isEmpty():
        every = moving if settled is None else moving.unionByName(settled)
        onward = every.select(F.col("url").alias("end"), *[F.col(c).alias(f"_{c}") for c in ("end", "hops", "stray", "low", "state")])
        joined = moving.join(onward.hint("merge"), "end", "left")
        last = F.col("_state").isNull()
        state = F.when(last, ENDED).when((F.col("_state") == MOVES) & (F.col("low") == F.col("_low")), LOOPS).otherwise(F.col("_state"))
        told = {"state": state, "hops": F.col("hops") + F.coalesce("_hops", F.lit(0)), "stray": F.coalesce("stray", "_stray"), "low": F.least("low", "_low"), "end": F.coalesce("_end", "end")}
        # Loops have more hops than there are addresses.
        rows = save(joined.select("url", *[c.alias(k) for k, c in told.items()]).withColumn("hops", F.when(F.col("state") == LOOPS, count + 1).otherwise(F.col("hops"))), "jumps")
        done, moving = rows.where(F.col("state") != MOVES), rows.where(F.col("state") == MOVES)
        settled = done if settled is None else settled.unionByName(done)
    found = moving if settled is None else settled
    return found.select("url", F.when(F.col("state") == ENDED, F.col("end")).alias("end"), "hops", "stray")


def follow(links: DataFrame, redirects: DataFrame, link: str = "url", domains: tuple[str, ...] | None = None, end_domains: tuple[str, ...] | None = None, most: int = MOST_HOPS) -> DataFrame:
    """The rows with destination, hops and redirect_error of their link; a link that isn't landed leads to itself.

    Refused, with a null destination: loops, more than `most` hops, a link or a hop that isn't on `domains`, an end that isn't on
    `end_domains`. Rows with a null link stay, with a null destination.
    """
    found = ends(redirects, domains).select(F.col("url").alias(link), F.struct("end", "hops", "stray").alias("_to"))
    rows = links.join(found.hint("merge"), link, "left")
    end = F.when(F.col("_to").isNull(), F.col(link)).otherwise(F.col("_to.end"))

    def outside(c: Column, hosts) -> Column:
        return ~urls.on_any(urls.host(c), hosts) if hosts else F.lit(False)

    error = (
        F.when(F.col(link).isNull(), F.lit(None).cast("string"))
        .when(outside(F.col(link), domains) | F.col("_to.stray").isNotNull(), STRAY)
        .when(F.col("_to").isNotNull() & F.col("_to.end").isNull(), LOOP)
        .when(F.col("_to.hops") > most, FAR)
        .when(outside(end, end_domains), WRONG_END)
    )
    out = rows.withColumns({"redirect_error": error, "hops": F.coalesce("_to.hops", F.lit(0).cast("long"))})
    return out.withColumn("destination", F.when(F.col("redirect_error").isNull(), end)).select(*links.columns, "destination", "hops", "redirect_error")


def load_pages(links: DataFrame, redirects: DataFrame, landed: DataFrame, link: str = "url") -> tuple[DataFrame, DataFrame]:
    """(pages: the links' columns with final_url and html, refused: the links' columns with error) of product links.

    A link and each hop must be on the page hosts or their short ones, the end on a page host; what isn't landed (url, html),
    or without text, couldn't be loaded.
    """
    there = landed.where("url is not null and trim(html) <> ''").groupBy(F.col("url").alias("destination")).agg(F.min("html").alias("html"))
    rows = follow(links, redirects, link, PAGE_DOMAINS, PAGE_HOSTS).join(there.hint("merge"), "destination", "left")
    error = F.when(F.trim(F.coalesce(F.col(link), F.lit(""))) == "", "blank URL").when(F.col("redirect_error").isNotNull(), F.col("redirect_error")).when(F.col("html").isNull(), "page not landed")
    marked = save(rows.withColumn("error", error), "loaded")
    pages = marked.where("error is null").select(*links.columns, F.col("destination").alias("final_url"), "html")
    return pages, marked.where("error is not null").select(*links.columns, "error")
