"""Named queries over the driver tables, each with the SQL that gives the same rows.

The catalog is read off the star schema: part is the product, lineitem the offer (supplier: marketplace),
events the import queue, orders the opportunities.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine.functions import attrs, money, text, url
from vitrine.operators import merge, offers, query, workflow
from vitrine.operators import where as rel
from vitrine.operators.where import where
from vitrine.plans.registry import QUERIES, SQL, Query, named, table

def _offers(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as offers."""
    return table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("marketplace"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.col("l_extendedprice").alias("old_price"),
        (F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100) / 100).alias("price"),
        (F.col("l_returnflag") != "R").alias("available"),
        F.col("l_linestatus").alias("status"),
        F.lit(True).alias("active"),
        F.col("l_shipdate").alias("seen_at"),
    )


_OFFERS = "(SELECT l_partkey product_id, l_suppkey marketplace, l_orderkey*10+l_linenumber id, l_extendedprice old_price, floor(l_extendedprice*(1-l_discount)*100)/100 price, l_returnflag<>'R' available, l_linestatus status, l_shipdate seen_at FROM lineitem)"
_CLEAN = "trim(regexp_replace(replace({0},chr(160),' '),'\\s+',' ','g'))"
_SLUG = "regexp_replace(regexp_replace(lower(strip_accents({0})),'[^a-z0-9]+','-','g'),'^-+|-+$','','g')"


# Scans, filters, sorting


@named("SELECT p_partkey, p_name, p_brand FROM part WHERE p_retailprice > 0 AND p_name <> '' AND (contains(lower(p_name),'ar') OR contains(lower(p_brand),'#1') OR contains(lower(p_type),'steel'))")
def catalog_search_ci(spark, d):
    """Catalog search: priced products with a term in name, brand or category, case aside."""
    terms = [{c: {"contains": v, "mode": "insensitive"}} for c, v in (("p_name", "AR"), ("p_brand", "#1"), ("p_type", "Steel"))]
    tree = {"p_retailprice": {"gt": 0}, "p_name": {"not": ""}, "OR": terms}
    return query.find_many(table(spark, d, "part"), tree, select=["p_partkey", "p_name", "p_brand"])


@named("SELECT p_partkey, p_size > 25 AS featured, p_retailprice FROM part ORDER BY featured DESC, p_retailprice DESC, p_partkey LIMIT 100")
def catalog_list_featured(spark, d):
    rows = table(spark, d, "part").select("p_partkey", (F.col("p_size") > 25).alias("featured"), "p_retailprice")
    return query.find_many(rows, order=[("featured", "desc"), ("p_retailprice", "desc"), ("p_partkey", "asc")], take=100)


@named("SELECT trim(p_type) AS category, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY 1")
def category_histogram(spark, d):
    return table(spark, d, "part").groupBy(F.trim("p_type").alias("category")).agg(F.count("*").alias("n")).where("category <> ''")


@named("SELECT trim(p_type) AS category, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY 1 ORDER BY n DESC, category LIMIT 8")
def category_top8(spark, d):
    return category_histogram(spark, d).orderBy(F.desc("n"), F.collate("category", "pt")).limit(8)


@named("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O','F') AND o_orderpriority NOT IN ('1-URGENT') AND NOT (o_totalprice < 1000) AND starts_with(o_orderpriority,'3') AND o_totalprice >= 1000 AND o_totalprice <= 200000")
def filter_tree(spark, d):
    tree = {"o_orderstatus": {"in": ["O", "F"]}, "o_orderpriority": {"notIn": ["1-URGENT"], "startsWith": "3"}, "NOT": {"o_totalprice": {"lt": 1000}}, "AND": [{"o_totalprice": {"gte": 1000}}, {"o_totalprice": {"lte": 200000}}]}
    return query.find_many(table(spark, d, "orders"), tree, select=["o_orderkey", "o_orderstatus"])


@named("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount < l_tax")
def compare_columns(spark, d):
    return query.find_many(table(spark, d, "lineitem"), {"l_discount": {"lt": F.col("l_tax")}}, select=["l_orderkey", "l_linenumber"])


@named("SELECT event_id FROM events WHERE CAST(json_extract_string(props,'$.k') AS INTEGER) >= 50 AND event_type <> 'error'")
def json_props_filter(spark, d):
    return query.find_many(table(spark, d, "events"), {"props": {"path": ["k"], "gte": 50}, "event_type": {"not": "error"}}, select=["event_id"])


@named("SELECT p_partkey FROM part WHERE list_has_all(string_split(p_name,' '), ['small','ring']) OR list_has_all(string_split(lower(p_type),' '), ['steel'])")
def list_has_every(spark, d):
    words = table(spark, d, "part").withColumns({"words": F.split("p_name", " "), "kinds": F.split(F.lower("p_type"), " ")})
    return words.where(where({"OR": [{"words": {"hasEvery": ["small", "ring"]}}, {"kinds": {"hasEvery": ["steel"]}}]})).select("p_partkey")


@named("SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type,' '), ['SMALL','ECONOMY'])")
def list_has_some(spark, d):
    return table(spark, d, "part").withColumn("kinds", F.split("p_type", " ")).where(where({"kinds": {"hasSome": ["SMALL", "ECONOMY"]}})).select("p_partkey")


@named("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def distinct_on(spark, d):
    return query.find_many(table(spark, d, "orders"), distinct=["o_custkey"], order=[("o_totalprice", "desc"), ("o_orderkey", "asc")], select=["o_custkey", "o_orderkey", "o_totalprice"])


@named("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR (o_totalprice = 150000 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 10")
def keyset_page(spark, d):
    after = (F.col("o_totalprice") < 150000) | ((F.col("o_totalprice") == 150000) & (F.col("o_orderkey") > 0))
    return query.find_many(table(spark, d, "orders"), cursor=after, order=[("o_totalprice", "desc"), ("o_orderkey", "asc")], skip=10, take=50, select=["o_orderkey", "o_totalprice"])


@named("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 5")
def last_rows(spark, d):
    return query.find_many(table(spark, d, "orders"), order=[("o_totalprice", "asc"), ("o_orderkey", "asc")], take=-5, select=["o_orderkey"])


# Joins


@named(f"SELECT p_partkey AS product_id, count(o.id) AS offers, min(o.price) AS lowest, coalesce(string_agg(CAST(o.id AS VARCHAR), ',' ORDER BY o.price, o.id),'') AS offer_ids FROM part LEFT JOIN (SELECT * FROM {_OFFERS} WHERE available) o ON o.product_id = p_partkey GROUP BY p_partkey")
def product_offers_nested(spark, d):
    """Products with their available offers nested by price, told here by number, lowest price and ids."""
    nested = _offers(spark, d).where("available").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("price", "id"))).alias("o"))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("product_id")).join(nested, "product_id", "left")
    ids = F.array_join(F.transform("o", lambda x: x["id"].cast("string")), ",")
    return rows.select("product_id", F.coalesce(F.size("o"), F.lit(0)).cast("long").alias("offers"), F.get("o", F.lit(0))["price"].alias("lowest"), F.coalesce(ids, F.lit("")).alias("offer_ids"))


@named("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey=p_partkey JOIN supplier ON l_suppkey=s_suppkey WHERE l_quantity > 45")
def offer_product_lookup(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity > 45")
    part, supplier = table(spark, d, "part"), table(spark, d, "supplier")
    return big.join(part, big.l_partkey == part.p_partkey).join(supplier, big.l_suppkey == supplier.s_suppkey).select("l_orderkey", "l_linenumber", "p_name", "s_name")


@named("WITH page AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) SELECT o_orderkey, o_orderstatus, coalesce(c_name,'—') AS name FROM page LEFT JOIN customer ON c_custkey=o_custkey AND c_acctbal > 0")
def queue_panel_join(spark, d):
    """The newest hundred rows with a name looked up for each, a dash where there is none."""
    page = query.find_many(table(spark, d, "orders"), order=[("o_orderdate", "desc"), ("o_orderkey", "asc")], take=100)
    names = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return page.join(names, "o_custkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("c_name", F.lit("—")).alias("name"))


_FAVORITES = [17, 3, 99, 3, 45, 8, 123456789, 1]


@named("SELECT p.position, p_partkey, p_name FROM (VALUES (0,17),(1,3),(2,99),(3,45),(4,8),(5,123456789),(6,1)) p(position,k) JOIN part ON p_partkey=k")
def favorites_ordered_lookup(spark, d):
    ids = spark.range(1).select(F.array(*[F.lit(x).cast("long") for x in _FAVORITES]).alias("ids"))
    return query.ordered_lookup(ids, table(spark, d, "part"), "ids", "p_partkey").select("position", "p_partkey", "p_name")


@named("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 400000)")
def new_candidates_anti(spark, d):
    orders = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(orders, "c_custkey", "left_anti").select("c_custkey")


@named("SELECT a.o_orderkey FROM orders a WHERE a.o_orderstatus='P' AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey=a.o_custkey AND b.o_orderstatus<>'P')")
def link_conflict_semi(spark, d):
    """Rows of a batch whose link a row outside the batch has."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return workflow.conflicts(orders.where("o_orderstatus = 'P'"), orders, "o_custkey", "o_orderkey").select("o_orderkey")


@named(
    """WITH a AS (SELECT p_type, p_brand FROM part WHERE p_partkey=1),
    r AS (SELECT p_partkey, p_type=(SELECT p_type FROM a) OR p_brand=(SELECT p_brand FROM a) AS is_similar, p_size>25 AS featured, p_retailprice FROM part WHERE p_partkey<>1),
    x AS (SELECT * FROM r WHERE is_similar ORDER BY featured DESC, p_retailprice DESC, p_partkey LIMIT 8),
    y AS (SELECT * FROM r WHERE NOT is_similar ORDER BY featured DESC, p_retailprice DESC, p_partkey LIMIT 8)
    SELECT p_partkey, is_similar FROM (SELECT *, 0 AS phase FROM x UNION ALL SELECT *, 1 AS phase FROM y) ORDER BY phase, featured DESC, p_retailprice DESC, p_partkey LIMIT 8"""
)
def recommend_top8(spark, d):
    part = table(spark, d, "part")
    anchor = part.where("p_partkey = 1").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand")).first().asDict()
    products = part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), (F.col("p_size") > 25).alias("featured"), F.col("p_retailprice").alias("updated_at"))
    return offers.recommend(products, anchor).select(F.col("id").alias("p_partkey"), "is_similar")


@named("WITH a AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS n FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS n FROM nation) SELECT s_suppkey, n_name FROM a JOIN b USING (n)")
def positional_zip(spark, d):
    """The n-th of one list with the n-th of another."""
    left = query.numbered(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    right = query.numbered(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return left.join(right, "_number").select("s_suppkey", "n_name")


@named(
    f"""SELECT c_custkey, coalesce(x.m, y.m) AS product_id FROM customer
    LEFT JOIN (SELECT o_custkey k, min(o_orderkey) m FROM orders WHERE o_orderstatus='F' GROUP BY 1) x ON x.k=c_custkey
    LEFT JOIN (SELECT o_custkey k, min(o_orderkey) m FROM orders WHERE o_orderstatus='O' GROUP BY 1) y ON y.k=c_custkey"""
)
def resolve_chain(spark, d):
    """Id of the first lookup that knows the record."""
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    steps = [(orders.where(f"o_orderstatus = '{s}'"), ["c_custkey"], "o_orderkey") for s in ("F", "O")]
    return merge.resolve(table(spark, d, "customer").select("c_custkey"), steps).select("c_custkey", "product_id")


@named("SELECT s_suppkey, coalesce(n_name, 'none') AS found FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey = 1")
def find_with_fallback(spark, d):
    nation = table(spark, d, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, d, "supplier").join(nation, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("found"))


@named("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_totalprice > 200000)")
def relation_some(spark, d):
    return rel.some(table(spark, d, "customer"), table(spark, d, "orders"), ("c_custkey", "o_custkey"), F.col("o_totalprice") > 200000).select("c_custkey")


@named("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND NOT coalesce(o_totalprice > 20000, false))")
def relation_every(spark, d):
    return rel.every(table(spark, d, "customer"), table(spark, d, "orders"), ("c_custkey", "o_custkey"), F.col("o_totalprice") > 20000).select("c_custkey")


@named("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey=c_custkey AND o_orderstatus='P')")
def relation_none(spark, d):
    return rel.none(table(spark, d, "customer"), table(spark, d, "orders"), ("c_custkey", "o_custkey"), F.col("o_orderstatus") == "P").select("c_custkey")


@named("SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY 1")
def relation_count(spark, d):
    counts = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "customer").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


# Aggregation


@named("SELECT count(*) AS total, count(*) FILTER (event_type='click') AS clicks, count(*) FILTER (event_type='view') AS views, count(*) FILTER (event_type='purchase') AS purchases, count(*) FILTER (event_type='none such') AS nothing FROM events")
def status_counts_events(spark, d):
    return query.count_by(table(spark, d, "events"), "event_type", {"clicks": "click", "views": "view", "purchases": "purchase", "nothing": "none such"})


@named("SELECT count(*) AS total, count(*) FILTER (o_orderstatus='O') AS waiting, count(*) FILTER (o_orderstatus='F') AS published, count(*) FILTER (o_orderstatus='P') AS failed FROM orders")
def status_counts_orders(spark, d):
    return query.count_by(table(spark, d, "orders"), "o_orderstatus", {"waiting": "O", "published": "F", "failed": "P"})


@named("SELECT count(*) AS count_all, count(o_totalprice) AS count_o_totalprice, round(avg(o_totalprice),2) AS avg_o_totalprice, round(sum(o_totalprice),2) AS sum_o_totalprice, min(o_totalprice) AS min_o_totalprice, max(o_orderdate) AS max_o_orderdate FROM orders")
def agg_all(spark, d):
    got = query.aggregate(table(spark, d, "orders"), count=["*", "o_totalprice"], avg=["o_totalprice"], sum=["o_totalprice"], min=["o_totalprice"], max=["o_orderdate"])
    return got.withColumns({c: F.round(c, 2) for c in ("avg_o_totalprice", "sum_o_totalprice")})


@named("SELECT o_custkey, count(*) AS count_all, max(o_totalprice) AS max_o_totalprice FROM orders GROUP BY 1 HAVING count(*) > 5 ORDER BY max_o_totalprice DESC, o_custkey LIMIT 20 OFFSET 5")
def groupby_having_page(spark, d):
    return query.group_by(table(spark, d, "orders"), ["o_custkey"], having=F.col("count_all") > 5, order=[("max_o_totalprice", "desc"), ("o_custkey", "asc")], skip=5, take=20, count=["*"], max=["o_totalprice"])


@named("SELECT lower(trim(p_brand)) AS value, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_links(spark, d):
    return workflow.duplicates(table(spark, d, "part"), "p_brand")


@named("SELECT (SELECT count(*) FROM orders) AS received, count(DISTINCT o_custkey) AS added, (SELECT count(*) FROM orders) - count(DISTINCT o_custkey) AS ignored FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def insert_accounting(spark, d):
    stored = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return merge.insert_new(stored, table(spark, d, "orders"), ["o_custkey"])[1].select("received", "added", "ignored")


# Offers


@named(f"SELECT product_id, id, price FROM {_OFFERS} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY (available AND status NOT IN ('UNAVAILABLE','ERROR')) DESC, price, id) = 1")
def best_offer(spark, d):
    """The cheapest available offer of every product, else the cheapest."""
    return offers.best_offers(_offers(spark, d)).select("product_id", "id", "price")


@named(f"SELECT id, row_number() OVER (PARTITION BY product_id ORDER BY available DESC, price, id) = 1 AS is_best FROM {_OFFERS}")
def best_offer_flag(spark, d):
    return offers.flag_best(_offers(spark, d)).select("id", "is_best")


@named(f"SELECT product_id, CASE WHEN bool_or(status='O') OR NOT bool_or(status='F' AND available) THEN 'LIVE_PARTIAL' ELSE 'LIVE_COMPLETE' END AS publication_status FROM {_OFFERS} GROUP BY 1")
def publication_status(spark, d):
    rows = _offers(spark, d).withColumns({"affiliate_link": F.when(F.col("available"), "x"), "status": F.when(F.col("status") == "O", "PENDING_AFFILIATE").otherwise("ACTIVE")})
    return offers.publication_status(rows)


@named(f"SELECT product_id, id, price FROM {_OFFERS} QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY marketplace <> 7, price, id) = 1")
def buybox_winner_or_cheapest(spark, d):
    return query.best_per_key(_offers(spark, d), ["product_id"], F.col("marketplace") != 7, F.col("price"), F.col("id")).select("product_id", "id", "price")


@named(f"SELECT product_id, id FROM {_OFFERS} WHERE old_price > price QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY (old_price-price)/old_price DESC, id) = 1")
def max_discount_offer(spark, d):
    ratio = (F.col("old_price") - F.col("price")) / F.col("old_price")
    return query.best_per_key(_offers(spark, d).where("old_price > price"), ["product_id"], F.desc(ratio), F.col("id")).select("product_id", "id")


@named(f"SELECT product_id, marketplace, price, seen_at FROM {_OFFERS} QUALIFY row_number() OVER (PARTITION BY product_id, marketplace ORDER BY seen_at DESC, id DESC) = 1")
def latest_price_per_offer(spark, d):
    return query.best_per_key(_offers(spark, d), ["product_id", "marketplace"], F.desc("seen_at"), F.desc("id")).select("product_id", "marketplace", "price", "seen_at")


@named(f"SELECT product_id, seen_at, price FROM (SELECT product_id, seen_at, price, lag(price) OVER (PARTITION BY product_id ORDER BY seen_at, price) AS p FROM {_OFFERS}) WHERE p IS NULL OR abs(price-p) > 0.009")
def price_change_log(spark, d):
    return offers.price_log(_offers(spark, d), ["product_id"], "seen_at", "price").select("product_id", "seen_at", "price")


@named("WITH c AS (SELECT row_number() OVER (ORDER BY p_partkey) AS pos, p_size > 45 AS ok FROM part), h AS (SELECT pos FROM c WHERE ok ORDER BY pos LIMIT 10) SELECT count(*) AS found, CASE WHEN count(*) >= 10 THEN least((SELECT count(*) FROM c), CAST(ceil(max(pos)/4.0)*4 AS BIGINT)) ELSE (SELECT count(*) FROM c) END AS scanned FROM h")
def discovery_scan_accounting(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("position"), (F.col("p_size") > 45).alias("ok"))
    return offers.scan_until(rows, "position", "ok", 10)


@named(f"SELECT id, CAST(CASE WHEN old_price > price THEN round((old_price-price)/old_price*100) END AS INTEGER) AS pct FROM {_OFFERS}")
def discount_pct(spark, d):
    return _offers(spark, d).select("id", money.discount_pct(F.col("old_price"), F.col("price")).alias("pct"))


@named("SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_tax > 0.04 THEN round(l_tax*100) WHEN l_extendedprice > l_quantity*1000 THEN round((l_extendedprice-l_quantity*1000)/l_extendedprice*100) ELSE 0 END AS INTEGER) AS pct FROM lineitem")
def display_discount(spark, d):
    declared = F.when(F.col("l_tax") > 0.04, F.col("l_tax") * 100)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money.display_discount(F.col("l_extendedprice"), F.col("l_quantity") * 1000, declared).alias("pct"))


# Workflows


@named("SELECT event_id, CASE WHEN n <= 10 THEN 'PROCESSING' ELSE 'PENDING' END AS status, CASE WHEN n <= 10 THEN 1 ELSE 0 END AS attempts FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events WHERE event_type='click') UNION ALL SELECT event_id, 'DONE', 0 FROM events WHERE event_type <> 'click'")
def queue_fifo_claim(spark, d):
    queue = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "click", "PENDING").otherwise("DONE").alias("status"), F.lit(0).alias("attempts"), F.lit("x").alias("error_message"))
    return workflow.claim(queue, 99).select(F.col("id").alias("event_id"), "status", "attempts")


def _queue(spark, d) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "PROCESSING").otherwise("SUCCESS")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), status.alias("status"), F.col("event_id").cast("string").alias("product_id"), F.lit("boom").alias("error_message"))


@named("SELECT event_id AS id, CASE WHEN event_type='error' AND event_id%2=0 THEN 'PENDING' WHEN event_type='error' THEN 'ERROR' WHEN event_type='click' THEN 'PROCESSING' ELSE 'SUCCESS' END AS status, CASE WHEN event_type='error' AND event_id%2=0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS product_id FROM events")
def queue_retry(spark, d):
    return workflow.retry(_queue(spark, d), F.col("id") % 2 == 0).select("id", "status", "product_id")


@named("SELECT event_id AS id FROM events WHERE event_id%2<>0 OR event_type='click'")
def queue_delete(spark, d):
    return workflow.delete(_queue(spark, d), F.col("id") % 2 == 0).select("id")


@named(
    """SELECT o_orderkey, CASE WHEN s IN ('WAITING_AFFILIATE','READY_TO_QUEUE','ERROR') THEN 'READY_TO_QUEUE' END AS saved,
    CASE WHEN s IN ('QUEUED','PUBLISHED') THEN s WHEN s='READY_TO_QUEUE' AND o_custkey%2=0 THEN CASE WHEN o_custkey%3=0 THEN 'PUBLISHED' ELSE 'QUEUED' END END AS queued,
    CASE WHEN s='DISMISSED' THEN NULL WHEN s='PUBLISHED' OR o_custkey%3=0 THEN 'PUBLISHED' ELSE 'QUEUED' END AS published
    FROM (SELECT o_orderkey, o_custkey, CASE o_orderkey%6 WHEN 0 THEN 'WAITING_AFFILIATE' WHEN 1 THEN 'READY_TO_QUEUE' WHEN 2 THEN 'QUEUED' WHEN 3 THEN 'PUBLISHED' WHEN 4 THEN 'ERROR' ELSE 'DISMISSED' END AS s FROM orders)"""
)
def opportunity_transition(spark, d):
    """Every opportunity's status after saving a link, queueing and batch publication."""
    names = F.array(*[F.lit(x) for x in ("WAITING_AFFILIATE", "READY_TO_QUEUE", "QUEUED", "PUBLISHED", "ERROR", "DISMISSED")])
    rows = table(spark, d, "orders").withColumn("s", F.element_at(names, (F.col("o_orderkey") % 6 + 1).cast("int")))
    status, done, product = F.col("s"), F.when(F.col("o_custkey") % 3 == 0, "SUCCESS"), F.lit("p")
    return rows.select("o_orderkey", workflow.save_link(status).alias("saved"), workflow.enqueue(status, F.col("o_custkey") % 2 == 0, done, product).alias("queued"), workflow.publish(status, done, product).alias("published"))


@named("SELECT coalesce(n.k, s.s_suppkey) AS s_suppkey, CASE WHEN n.k IS NOT NULL THEN coalesce(s.s_name, n.s_name) ELSE s.s_name END AS s_name, CASE WHEN n.k IS NOT NULL THEN n.s_acctbal ELSE s.s_acctbal END AS s_acctbal FROM supplier s FULL JOIN (SELECT c_custkey*3 AS k, c_name AS s_name, c_acctbal AS s_acctbal FROM customer) n ON n.k = s.s_suppkey")
def offer_upsert_snapshot(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    changes = table(spark, d, "customer").select((F.col("c_custkey") * 3).alias("s_suppkey"), F.col("c_name").alias("s_name"), F.col("c_acctbal").alias("s_acctbal"))
    return merge.upsert(supplier, changes, ["s_suppkey"], {"s_name": merge.first_writer("s_name")})


@named("SELECT code, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, substr(md5(CAST(p_partkey AS VARCHAR)),1,3) AS code FROM part) GROUP BY code HAVING count(*) = 1")
def shortcode_unique_prefix(spark, d):
    codes = table(spark, d, "part").select("p_partkey", F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 3).alias("code"))
    return codes.groupBy("code").agg(F.min("p_partkey").alias("p_partkey"), F.count("*").alias("n")).where("n = 1").drop("n")


# Scalars


@named(f"SELECT doc_id, {_CLEAN.format('text')} AS cleaned FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean(F.col("text")).alias("cleaned"))


@named("SELECT p_partkey, concat_ws('-', substr(" + _SLUG.format("p_name") + ",1,90), " + _SLUG.format("p_brand") + ", substr(" + _SLUG.format("CAST(p_partkey AS VARCHAR)") + ",1,50)) AS slug FROM part")
def slugify(spark, d):
    return table(spark, d, "part").select("p_partkey", text.slug(F.col("p_name"), F.col("p_brand"), F.col("p_partkey").cast("string")).alias("slug"))


@named("SELECT doc_id, md5(upper(" + _CLEAN.format("strip_accents(replace(text, chr(223), 's'))") + ")) AS norm FROM documents")
def identifier_norm(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.identifier(F.translate("text", "ß", "s")).cast("binary")).alias("norm"))


@named("SELECT c_custkey, CASE WHEN length(c) BETWEEN 8 AND 14 THEN c END AS code FROM (SELECT c_custkey, regexp_replace(c_name,'\\D','','g') AS c FROM customer)")
def numeric_code(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.numeric_code(F.col("c_name")).alias("code"))


@named("SELECT page_id, h AS host, h = 'example.com' OR ends_with(h,'.example.com') OR h = 'example.org' OR ends_with(h,'.example.org') AS allowed FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url,'^https?://([^/?#:]+)',1)),'^www\\.','') AS h FROM pages)")
def url_host_allowlist(spark, d):
    name = url.host(F.col("url"))
    return table(spark, d, "pages").select("page_id", name.alias("host"), url.on_any(name, ("example.com", "example.org")).alias("allowed"))


@named("SELECT page_id, CASE WHEN regexp_matches(url,'^https?://([^/?#]*\\.)?example\\.(com|net)([/?#]|$)') THEN regexp_replace(url,'#.*$','') END AS clean_url FROM pages")
def url_normalize(spark, d):
    return table(spark, d, "pages").select("page_id", url.normalise(F.col("url"), ("example.com", "example.net")).alias("clean_url"))


@named("SELECT page_id, CASE WHEN h='example.com' OR ends_with(h,'.example.com') THEN 'COM' WHEN h='example.net' OR ends_with(h,'.example.net') THEN 'NET' END AS marketplace FROM (SELECT page_id, regexp_extract(url,'^https?://([^/?#:]+)',1) AS h FROM pages)")
def marketplace_detect(spark, d):
    domains = (("COM", ("example.com",)), ("NET", ("example.net",)))
    return table(spark, d, "pages").select("page_id", url.marketplace(F.col("url"), domains).alias("marketplace"))


@named(
    """SELECT l_orderkey, l_linenumber, TRY_CAST(CASE WHEN k=0 THEN replace(replace(replace(s,',','_'),'.',''),'_','.') WHEN k=1 THEN replace(s,',','') WHEN k=2 THEN CASE WHEN regexp_matches(s,'\\.\\d\\d$') THEN s ELSE replace(s,'.','') END ELSE s END AS DOUBLE) AS value FROM
    (SELECT l_orderkey, l_linenumber, (l_orderkey+l_linenumber)%4 AS k, CASE (l_orderkey+l_linenumber)%4 WHEN 0 THEN '1.' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),3,'0') || ',50' WHEN 1 THEN '2,' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),3,'0') || '.25' WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '.' || CAST(l_linenumber AS VARCHAR) ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS s FROM lineitem)"""
)
def parse_locale_number(spark, d):
    """Numbers written in four ways, read back."""
    whole, line = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string")
    shapes = [F.concat(F.lit("R$ 1."), F.lpad(whole, 3, "0"), F.lit(",50")), F.concat(F.lit("2,"), F.lpad(whole, 3, "0"), F.lit(".25 ")), F.concat(whole, F.lit("."), line), F.concat(whole, F.lit("-"), line)]
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    written = F.when(kind == 0, shapes[0]).when(kind == 1, shapes[1]).when(kind == 2, shapes[2]).otherwise(shapes[3])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", money.parse_number(written).alias("value"))


@named("SELECT o_orderkey, 'R$' || chr(160) || translate(format('{:,.2f}', o_totalprice), ',.', '.,') AS shown FROM orders")
def brl_format(spark, d):
    return table(spark, d, "orders").select("o_orderkey", money.brl(F.col("o_totalprice")).alias("shown"))


@named("SELECT conv_id, turn, link FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text || ' see https://a.example/x).', 'https?://[^\\s,;]+')) AS raw, regexp_replace(raw,'[)\\]}>.,;]+$','') AS link FROM conversations)")
def extract_links(spark, d):
    rows = table(spark, d, "conversations").withColumn("text", F.concat("text", F.lit(" see https://a.example/x).")))
    return rows.select("conv_id", "turn", F.explode(url.links_in(F.col("text"))).alias("link"))


_RULES = [("metal", ("steel", "brass", "copper")), ("small", ("small", "mini")), ("cheap", ("economy",))]


@named("SELECT p_partkey, CASE WHEN contains(lower(p_type),'steel') OR contains(lower(p_type),'brass') OR contains(lower(p_type),'copper') THEN 'metal' WHEN contains(lower(p_type),'small') OR contains(lower(p_type),'mini') THEN 'small' WHEN contains(lower(p_type),'economy') THEN 'cheap' ELSE 'other' END AS icon FROM part")
def category_classifier(spark, d):
    return table(spark, d, "part").select("p_partkey", text.classify(F.col("p_type"), _RULES, "other").alias("icon"))


@named("SELECT p_partkey, string_agg(x, '|' ORDER BY pos) AS images FROM (SELECT p_partkey, x, min(pos) AS pos FROM (SELECT p_partkey, unnest([trim(p_brand), p_type, trim(p_brand), p_name, p_type]) AS x, unnest([1,2,3,4,5]) AS pos FROM part) WHERE x <> '' GROUP BY 1, 2) GROUP BY 1")
def image_union_distinct(spark, d):
    own = F.array(F.concat(F.lit(" "), F.col("p_brand")), F.col("p_type"), F.lit(" "))
    return table(spark, d, "part").select("p_partkey", F.array_join(attrs.union_distinct(own, F.array("p_brand"), F.array("p_name", "p_type")), "|").alias("images"))


@named("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'gtin:' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') WHEN p_brand IS NOT NULL THEN 'brand-model:' || upper(regexp_replace(p_brand,'[^A-Za-z0-9._/-]','','g')) || ':M-' || CAST(p_partkey AS VARCHAR) END AS canonical_key FROM part")
def canonical_keys(spark, d):
    """Canonical product keys from attributes in their order."""
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    listed = F.array(pair("Código EAN:", F.when(F.col("p_size") % 2 == 0, F.lpad(F.col("p_partkey").cast("string"), 8, "0"))), pair("Modelo", F.concat(F.lit("m-"), F.col("p_partkey").cast("string"))))
    rows = table(spark, d, "part").withColumn("attributes", listed)
    found = attrs.identifiers(F.col("attributes"))
    return rows.select("p_partkey", attrs.canonical_key(F.col("p_brand"), found["gtin"], found["ean"], found["mpn"], found["model"]).alias("canonical_key"))


# Pages


@named("SELECT page_id, coalesce(regexp_extract(html,'<title>([^<]*)',1),'') AS title, len(regexp_extract_all(html,'<a href')) AS links FROM pages")
def html_title_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.coalesce(F.regexp_extract("html", "<title>([^<]*)", 1), F.lit("")).alias("title"), F.size(F.regexp_extract_all("html", F.lit("<a href"), F.lit(0))).cast("long").alias("links"))


@named("SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")
def distinct_counts(spark, d):
    return table(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("kinds"))


@named("SELECT event_id, strftime(ts, '%d/%m/%Y, %H:%M') AS shown FROM events")
def date_format_br(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "dd/MM/yyyy, HH:mm").alias("shown"))


@named("SELECT conv_id, string_agg(role, ' • ' ORDER BY turn) AS roles FROM conversations GROUP BY 1")
def text_sink_join(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["role"]), " • ").alias("roles"))


@named("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 40 AND p_brand = 'Brand#12'")
def raw_sql(spark, d):
    """Parameterised SQL over a table."""
    return spark.sql("SELECT p_partkey AS id, p_name AS name FROM {part} WHERE p_size > :least AND p_brand = :brand", args={"least": 40, "brand": "Brand#12"}, part=table(spark, d, "part"))


from vitrine.plans import flows, scalars, sources, workflows  # noqa: E402, F401  their queries join the registry


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
