"""Named queries of discovery and batch publication over many categories and batches at once.

The SQL of discovery simulates the scan batch by batch; that of publication tells each rule by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators import detail, discovery, favorites, publish
from vitrine.operators.nested import Plan, ToMany, ToOne, nested_write
from vitrine.plans.registry import named, table

_text = lambda c: F.col(c).cast("string")
_NOW = "2030-01-01"


def _mlb(number) -> F.Column:
    return F.concat(F.lit("MLB"), number.cast("string"))


def _discovered(spark, d) -> tuple[DataFrame, DataFrame]:
    """Parts are the highlights of their type, every fourth one twice; lineitems their offers; ordering customers' numbers, doubled, are known."""
    part, size = table(spark, d, "part"), F.col("p_size")
    once = part.select(F.col("p_type").alias("category_id"), F.col("p_partkey").alias("position"), _mlb(F.col("p_partkey")).alias("external_id"), F.when(size % 7 == 0, "ITEM").otherwise("PRODUCT").alias("type"))
    twice = part.where("p_partkey % 4 = 0").select(F.col("p_type").alias("category_id"), (F.col("p_partkey") + 1000000).alias("position"), _mlb(F.col("p_partkey")).alias("external_id"), F.when(size % 7 == 0, "ITEM").otherwise("PRODUCT").alias("type"))
    line, price = F.col("l_linenumber"), F.col("l_extendedprice")
    offers = table(spark, d, "lineitem").select(
        _mlb(F.col("l_partkey")).alias("external_id"), (F.col("l_orderkey") * 10 + line).alias("place"), F.when(line < 7, _text("l_orderkey")).alias("item_id"), (F.floor(price * (1 - F.col("l_discount")) * 100) / 100).alias("price"), F.when(F.col("l_quantity") < 2, price).alias("original_price"),
        F.when(F.col("l_returnflag") == "R", "closed").when(line < 3, "active").alias("status"), F.when(line % 2 == 1, F.concat(F.lit("http://x/"), _text("l_orderkey"))).alias("permalink"), F.lit(None).cast("string").alias("image"),
    )
    details = part.select(_mlb(F.col("p_partkey")).alias("external_id"), F.when(size % 11 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.lit("http://i/").alias("image"))
    categories = part.select(F.col("p_type").alias("id"), F.when(~F.col("p_type").startswith("S"), F.concat(F.lit(" "), "p_type", F.lit(" A "))).alias("name")).distinct()
    existing = table(spark, d, "orders").select(_mlb(F.col("o_custkey") * 2).alias("external_id"))
    return discovery.discover(once.unionByName(twice), offers, details, categories, existing, 10, seed=7)


_DISCOVERED = """WITH h AS (SELECT p_type AS c, p_partkey AS pos, 'MLB' || p_partkey AS id, p_size%7<>0 AS product, p_size%11<>0 AS titled, p_name FROM part UNION ALL SELECT p_type, p_partkey+1000000, 'MLB' || p_partkey, p_size%7<>0, p_size%11<>0, p_name FROM part WHERE p_partkey%4=0),
o AS (SELECT 'MLB' || l_partkey AS id, l_orderkey*10+l_linenumber AS place, floor(l_extendedprice*(1-l_discount)*100)/100 AS price, l_extendedprice AS old, CASE WHEN l_linenumber%2=1 THEN 'http://x/' || l_orderkey END AS link FROM lineitem WHERE l_quantity<2 AND l_linenumber<7 AND l_returnflag<>'R'),
b AS (SELECT * FROM o WHERE price>0 AND old>price QUALIFY row_number() OVER (PARTITION BY id ORDER BY (old-price)/old DESC, place)=1),
f AS (SELECT h.*, md5(c || ':' || h.id || ':' || pos || ':7') AS key, price, old, link, CAST(round((old-price)/old*100) AS INTEGER) AS discount, coalesce(titled AND round((old-price)/old*100)>0, false) AS good FROM h LEFT JOIN b ON b.id=h.id WHERE product AND h.id NOT IN (SELECT 'MLB' || o_custkey*2 FROM orders)),
n AS (SELECT *, (row_number() OVER (PARTITION BY c ORDER BY key)-1)//4 AS batch FROM f),
per AS (SELECT c, batch, count(*) AS n, count(*) FILTER (good) AS e FROM n GROUP BY 1, 2),
before AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY c ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS had FROM per),
scan AS (SELECT c, sum(n) AS scanned FROM before WHERE had<10 GROUP BY 1),
chosen AS (SELECT * FROM f WHERE good QUALIFY row_number() OVER (PARTITION BY c ORDER BY key)<=10)
"""


@named(_DISCOVERED + "SELECT c AS category_id, CASE WHEN starts_with(c,'S') THEN c ELSE c || ' A' END AS category_name, 10 AS requested, CAST(coalesce(scanned,0) AS BIGINT) AS scanned, count(chosen.id) AS eligible, count(DISTINCT chosen.id) AS added, count(chosen.id)-count(DISTINCT chosen.id) AS ignored FROM (SELECT DISTINCT p_type AS c FROM part) LEFT JOIN scan USING (c) LEFT JOIN chosen USING (c) GROUP BY 1, 2, 3, 4")
def discovery_accounting(spark, d):
    """What every category's discovery requests, scans, finds, adds and ignores."""
    return _discovered(spark, d)[1]


@named(_DISCOVERED + "SELECT DISTINCT id AS external_id, coalesce(link, 'https://www.mercadolivre.com.br/p/' || id) AS source_url, p_name AS title, c AS category_id, price, old AS old_price, discount, 'WAITING_AFFILIATE' AS status FROM chosen")
def discovery_added(spark, d):
    """The opportunities that the discoveries add."""
    return _discovered(spark, d)[0].select("external_id", "source_url", "title", "category_id", "price", "old_price", "discount", "status")


_STATES = ["WAITING_AFFILIATE", "READY_TO_QUEUE", "QUEUED", "PUBLISHED", "ERROR", "PUBLISHED", "QUEUED", "ERROR", "READY_TO_QUEUE", "WAITING_AFFILIATE", "PUBLISHED", "QUEUED", "WAITING_AFFILIATE", "ERROR", "READY_TO_QUEUE", "QUEUED", "DISMISSED"]


def _published(spark, d) -> dict[str, DataFrame]:
    """Customers ask for batches of four of every third order, some batches of twelve; orders are opportunities, events the queue, parts the products."""
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    key = F.col("c_custkey")
    link = (
        F.when(key % 97 == 1, "https://other.example/x").when(key % 97 == 2, say("https://meli.la/old", key * 3 + 1)).when(key % 97 == 3, say("https://meli.la/n", key - 1)).when(key % 97 == 4, " ")
        .when(key % 97 == 5, say("https://meli.la/q", key)).when(key % 97 == 6, say("https://meli.la/p", key % 50)).otherwise(say(" HTTPS://meli.la/n", key, "#x"))
    )
    items = table(spark, d, "customer").select(F.when(key % 100 < 12, -F.floor(key / 100) - 1).otherwise(F.floor(key / 4)).cast("long").alias("batch"), key.alias("position"), F.when(key % 89 == 7, say("o", key * 3 - 3)).otherwise(say("o", key * 3)).alias("id"), link.alias("link"))
    order = F.col("o_orderkey")
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (order % 17 + 1).cast("int"))
    none = lambda t: F.lit(None).cast(t)
    when = F.lit("2020-01-01").cast("timestamp_ntz")
    opportunities = table(spark, d, "orders").select(
        say("o", order).alias("id"), state.alias("status"), F.when(F.col("o_custkey") % 5 == 0, say("u", F.floor(order / 6))).otherwise(say("v", order)).alias("source_url"), F.when(order % 3 > 0, say("https://meli.la/old", order)).alias("affiliate_link"),
        F.when(F.col("o_custkey") % 4 > 0, say("p", F.col("o_custkey") % 250)).alias("product_id"), F.lit("old").alias("error_message"), F.when(order % 2 == 0, when).alias("queued_at"), F.when(order % 4 == 0, when).alias("published_at"),
    )
    event, third = F.col("event_id"), F.floor(F.col("event_id") / 3)
    kind = event % 3
    status = F.when(F.col("event_type") == "click", "PENDING").when(F.col("event_type") == "view", "ERROR").when(F.col("event_type") == "purchase", "SUCCESS").otherwise("PROCESSING")
    queue = table(spark, d, "events").select(
        say("e", event).alias("id"), F.when((kind == 1) & (third % 4 < 2), say("v", event - 1)).when((kind == 2) & (third % 4 == 2), say("v", event - 2)).otherwise(say("w", event)).alias("url"), F.lit("MERCADO_LIVRE").alias("marketplace"),
        F.when(kind == 1, say("https://meli.la/q", event)).alias("affiliate_link"), F.when((kind == 0) & (event % 2 == 0), say("o", event)).when((kind == 2) & (third % 4 == 2), say("o", event - 1)).alias("opportunity_id"),
        status.alias("status"), F.lit("old").alias("error_message"), F.when((F.col("event_type") == "purchase") & (event % 5 > 0), say("p", event % 150)).alias("product_id"), when.alias("processed_at"),
    )
    products = table(spark, d, "part").select(say("p", F.col("p_partkey")).alias("id"), say("https://meli.la/p", F.col("p_partkey")).alias("affiliate_link"), (F.col("p_size") > 5).alias("active"), F.col("p_retailprice").alias("price"), none("double").alias("old_price"), none("string").alias("installments"), none("int").alias("stock"))
    market = F.when(F.col("l_suppkey") % 3 == 0, "MERCADO_LIVRE").otherwise(say("S", F.col("l_suppkey") % 3))
    offers = table(spark, d, "lineitem").where("l_partkey % 2 = 0 or l_suppkey % 3 > 0").groupBy(say("p", F.col("l_partkey")).alias("product_id"), market.alias("marketplace")).agg(F.min("l_extendedprice").alias("price"))
    offers = offers.select("product_id", "marketplace", F.concat_ws("-", "product_id", "marketplace").alias("id"), "price", none("double").alias("old_price"), none("string").alias("installments"), F.lit(3).alias("stock"), F.lit("https://meli.la/f").alias("affiliate_link"), F.lit(False).alias("active"))
    redirects = table(spark, d, "customer").where("c_custkey % 41 = 8").select(say("https://meli.la/n", key).alias("url"), F.when(key % 2 == 0, "https://other.example/").otherwise("https://www.mercadolivre.com.br/").alias("final_url"))
    return publish.publish(items, opportunities, queue, products, offers, F.lit(_NOW).cast("timestamp_ntz"), redirects)


_PUBLISHED = (
    "WITH i AS (SELECT c_custkey AS k, CASE WHEN c_custkey%100<12 THEN -(c_custkey//100)-1 ELSE c_custkey//4 END AS batch, c_custkey AS position, CASE WHEN c_custkey%89=7 THEN 'o' || (c_custkey*3-3) ELSE 'o' || (c_custkey*3) END AS id, CASE c_custkey%97 WHEN 1 THEN 'https://other.example/x' WHEN 2 THEN 'https://meli.la/old' || (c_custkey*3+1) WHEN 3 THEN 'https://meli.la/n' || (c_custkey-1) WHEN 4 THEN NULL WHEN 5 THEN 'https://meli.la/q' || c_custkey WHEN 6 THEN 'https://meli.la/p' || (c_custkey%50) ELSE 'https://meli.la/n' || c_custkey END AS link FROM customer),"
    + "o AS (SELECT 'o' || o_orderkey AS id, CASE o_orderkey%17 " + " ".join(f"WHEN {n} THEN '{s}'" for n, s in enumerate(_STATES)) + " END AS status, CASE WHEN o_custkey%5=0 THEN 'u' || (o_orderkey//6) ELSE 'v' || o_orderkey END AS url, CASE WHEN o_orderkey%3>0 THEN 'https://meli.la/old' || o_orderkey END AS link, CASE WHEN o_custkey%4>0 THEN 'p' || (o_custkey%250) END AS product, o_orderkey%2=0 AS queued, o_orderkey%4=0 AS published FROM orders),"
    + """q AS (SELECT 'e' || event_id AS id, CASE WHEN event_id%3=1 AND event_id//3%4<2 THEN 'v' || (event_id-1) WHEN event_id%3=2 AND event_id//3%4=2 THEN 'v' || (event_id-2) ELSE 'w' || event_id END AS url, CASE WHEN event_id%3=1 THEN 'https://meli.la/q' || event_id END AS link, CASE WHEN event_id%3=0 AND event_id%2=0 THEN 'o' || event_id WHEN event_id%3=2 AND event_id//3%4=2 THEN 'o' || (event_id-1) END AS owner,
  CASE event_type WHEN 'click' THEN 'PENDING' WHEN 'view' THEN 'ERROR' WHEN 'purchase' THEN 'SUCCESS' ELSE 'PROCESSING' END AS status, CASE WHEN event_type='purchase' AND event_id%5>0 THEN 'p' || (event_id%150) END AS product FROM events),
p AS (SELECT 'p' || p_partkey AS id, 'https://meli.la/p' || p_partkey AS link, p_size>5 AS active, p_retailprice AS price FROM part),
x AS (SELECT i.*, o.status, o.url, o.product, o.queued, o.published, CASE WHEN count(*) OVER (PARTITION BY batch)>10 THEN 'too many items'
  WHEN row_number() OVER (PARTITION BY batch, i.id ORDER BY position)>1 THEN 'repeated item' WHEN i.link IS NULL THEN 'blank' WHEN i.link LIKE 'https://other%' THEN 'other host'
  WHEN row_number() OVER (PARTITION BY batch, i.link ORDER BY position)>1 THEN 'repeated link' WHEN min(batch) OVER (PARTITION BY i.id)<batch THEN 'item of an earlier batch' WHEN o.id IS NULL THEN 'not found' WHEN o.status='DISMISSED' THEN 'dismissed'
  WHEN k%41=8 AND k%2=0 AND i.link='https://meli.la/n' || k THEN 'leads elsewhere'
  WHEN EXISTS (SELECT 1 FROM o z WHERE z.link=i.link AND z.id NOT IN (SELECT j.id FROM i j WHERE j.batch=i.batch)) THEN 'link of another opportunity'
  WHEN EXISTS (SELECT 1 FROM q z WHERE z.link=i.link AND (z.owner IS NULL OR z.owner NOT IN (SELECT j.id FROM i j WHERE j.batch=i.batch))) THEN 'link of another import'
  WHEN EXISTS (SELECT 1 FROM p z WHERE z.link=i.link AND NOT EXISTS (SELECT 1 FROM i j JOIN o oo ON oo.id=j.id WHERE j.batch=i.batch AND oo.product=z.id)) THEN 'link of another product' END AS problem FROM i LEFT JOIN o ON o.id=i.id),
r AS (SELECT *, count(problem) OVER (PARTITION BY batch)=0 AS ready FROM x),
t AS (SELECT r.*, a.id AS own, b.id AS other, b.owner AS holder, CASE WHEN a.id IS NOT NULL THEN a.status ELSE b.status END AS qs, CASE WHEN a.id IS NOT NULL THEN a.product ELSE b.product END AS qp, CASE WHEN a.id IS NULL AND r.status<>'PUBLISHED' THEN row_number() OVER (PARTITION BY r.url, a.id IS NULL AND r.status<>'PUBLISHED' ORDER BY batch, position) END AS turn FROM r LEFT JOIN q a ON a.owner=r.id LEFT JOIN q b ON b.url=r.url WHERE ready),
e AS (SELECT *, CASE WHEN status='PUBLISHED' AND product IS NULL THEN 'published without a product' WHEN status<>'PUBLISHED' AND own IS NULL AND (turn>1 OR coalesce(holder<>id, false)) THEN 'queue row of another opportunity'
  WHEN CASE WHEN status='PUBLISHED' THEN product WHEN qs='SUCCESS' THEN qp END NOT IN (SELECT id FROM p) THEN 'product not found' END AS error FROM t),
g AS (SELECT *, status='PUBLISHED' AS was, status<>'PUBLISHED' AND qs='SUCCESS' AND qp IS NOT NULL AS imported, CASE WHEN status<>'PUBLISHED' THEN coalesce(own, other, 'queue:' || id) END AS row, CASE WHEN qs IS NULL OR qs='ERROR' OR (qs='SUCCESS' AND qp IS NULL) THEN 'PENDING' ELSE qs END AS becomes FROM e WHERE error IS NULL),
s AS (SELECT CASE WHEN was THEN product ELSE qp END AS id, arg_max(link, (batch, position)) AS link FROM g WHERE was OR coalesce(imported,false) GROUP BY 1)
"""
)


@named(_PUBLISHED + "SELECT batch, position, id, true AS success, row AS queue_id, CASE WHEN was OR coalesce(imported,false) THEN 'PUBLISHED' ELSE becomes END AS status, NULL AS error FROM g UNION ALL SELECT batch, position, id, false, NULL, NULL, error FROM e WHERE error IS NOT NULL UNION ALL SELECT batch, position, id, false, NULL, NULL, coalesce(problem,'batch refused') FROM r WHERE NOT ready")
def publish_results(spark, d):
    """What came of every item of every batch."""
    return _published(spark, d)["results"].select("batch", "position", "id", "success", "queue_id", "status", "error")


@named(_PUBLISHED + "SELECT o.id, CASE WHEN g.id IS NULL OR g.was THEN o.status WHEN coalesce(g.imported,false) THEN 'PUBLISHED' ELSE 'QUEUED' END AS status, coalesce(g.link, o.link) AS affiliate_link, CASE WHEN g.id IS NULL OR g.was THEN o.product ELSE g.qp END AS product_id, g.id IS NULL AS error_kept, CASE WHEN o.queued THEN 2020 WHEN g.id IS NOT NULL AND NOT g.was THEN 2030 END AS queued, CASE WHEN g.id IS NULL OR g.was THEN CASE WHEN o.published THEN 2020 END WHEN coalesce(g.imported,false) THEN CASE WHEN o.published THEN 2020 ELSE 2030 END END AS published FROM o LEFT JOIN g ON g.id=o.id")
def publish_opportunities(spark, d):
    """Opportunities after the batches."""
    return _published(spark, d)["opportunities"].select("id", "status", "affiliate_link", "product_id", F.col("error_message").isNotNull().alias("error_kept"), F.year("queued_at").alias("queued"), F.year("published_at").alias("published"))


@named(_PUBLISHED + "SELECT q.id, q.url, coalesce(g.becomes, q.status) AS status, coalesce(g.link, q.link) AS affiliate_link, coalesce(g.id, q.owner) AS opportunity_id, g.id IS NULL OR g.becomes=q.status AND q.status<>'PENDING' OR q.status='PENDING' AS error_kept FROM q LEFT JOIN g ON g.row=q.id UNION ALL SELECT row, url, 'PENDING', link, id, false FROM g WHERE row LIKE 'queue:%'")
def publish_queue(spark, d):
    """The import queue after the batches: rows that wait again, that change hands, and new ones."""
    return _published(spark, d)["queue"].select("id", "url", "status", "affiliate_link", "opportunity_id", F.col("error_message").isNotNull().alias("error_kept"))


@named(_PUBLISHED + "SELECT p.id, coalesce(s.link, p.link) AS affiliate_link, p.active OR s.id IS NOT NULL AS active FROM p LEFT JOIN s ON s.id=p.id")
def publish_products(spark, d):
    """Products after the batches: published ones have their item's link."""
    return _published(spark, d)["products"].select("id", "affiliate_link", "active")


@named(
    _PUBLISHED
    + """SELECT coalesce(f.product_id, n.id) AS product_id, coalesce(f.m, 'MERCADO_LIVRE') AS marketplace, coalesce(f.product_id || '-' || f.m, n.id || ':MERCADO_LIVRE') AS id, CASE WHEN n.id IS NULL THEN f.price ELSE n.price END AS price, CASE WHEN n.id IS NULL THEN 3 END AS stock, CASE WHEN n.id IS NULL THEN 'https://meli.la/f' ELSE n.link END AS affiliate_link, n.id IS NOT NULL AS active
    FROM (SELECT 'p' || l_partkey AS product_id, CASE WHEN l_suppkey%3=0 THEN 'MERCADO_LIVRE' ELSE 'S' || (l_suppkey%3) END AS m, min(l_extendedprice) AS price FROM lineitem WHERE l_partkey%2=0 OR l_suppkey%3>0 GROUP BY 1, 2) f FULL JOIN (SELECT s.id, s.link, p.price FROM s JOIN p ON p.id=s.id) n ON n.id=f.product_id AND f.m='MERCADO_LIVRE'"""
)
def publish_offers(spark, d):
    """Offers after the batches: a published product's offer takes link, price and stock from it, or is made."""
    return _published(spark, d)["offers"].select("product_id", "marketplace", "id", "price", "stock", "affiliate_link", "active")


def _account(spark, d) -> DataFrame:
    """What users bought are their account's favorites since the first time."""
    item = F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string"))
    return table(spark, d, "events").where("event_type = 'purchase'").groupBy("user_id", item.alias("product_id")).agg(F.min("ts").alias("created_at"))


def _clicked(spark, d) -> DataFrame:
    """Clicks add, errors remove, of ten products; some ids are blank."""
    item = F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.concat(F.lit(" p"), (F.col("event_id") % 10).cast("string")))
    rows = table(spark, d, "events").where("event_type in ('click', 'error')")
    return rows.select("user_id", item.alias("product_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_type") == "click").alias("add"))


_FAVORED = """WITH a AS (SELECT user_id, 'p' || (event_id%50) AS product_id, min(ts) AS created_at FROM events WHERE event_type='purchase' GROUP BY 1, 2),
c AS (SELECT user_id, 'p' || (event_id%10) AS product_id, event_id, ts, event_type='click' AS plus FROM events WHERE event_type IN ('click','error') AND event_id%13<>0),
r AS (SELECT user_id, product_id, max(event_id) FILTER (NOT plus) AS gone FROM c GROUP BY 1, 2),
n AS (SELECT c.user_id, c.product_id, arg_min(ts, event_id) AS at FROM c JOIN r USING (user_id, product_id) WHERE plus AND (gone IS NULL OR event_id>gone) GROUP BY 1, 2),
f AS (SELECT user_id, product_id, created_at FROM (SELECT coalesce(a.user_id, n.user_id) AS user_id, coalesce(a.product_id, n.product_id) AS product_id, CASE WHEN a.user_id IS NOT NULL AND r.gone IS NULL THEN a.created_at ELSE n.at END AS created_at FROM a FULL JOIN n ON n.user_id=a.user_id AND n.product_id=a.product_id LEFT JOIN r ON r.user_id=a.user_id AND r.product_id=a.product_id) WHERE created_at IS NOT NULL)
"""


@named(_FAVORED + "SELECT user_id, product_id, created_at FROM f")
def favorites_account(spark, d):
    """Accounts after products were added and removed in order."""
    return favorites.apply(_account(spark, d), _clicked(spark, d)).select("user_id", "product_id", "created_at")


def _synced(spark, d):
    events = table(spark, d, "events").where("event_type = 'view'")
    item = F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("p"), (F.col("event_id") % 37).cast("string"), F.lit(" ")))
    local = events.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("i")))), lambda x: x["i"]).alias("ids"))
    removed = _clicked(spark, d).where("not add and trim(product_id) <> ''").select("user_id", F.trim("product_id").alias("product_id"))
    account = favorites.apply(_account(spark, d), _clicked(spark, d))
    return favorites.sync(account, local, F.lit(_NOW).cast("timestamp_ntz"), removed)


_LOCAL = _FAVORED + """, l AS (SELECT user_id, 'p' || (event_id%37) AS product_id, min(event_id) AS place FROM events WHERE event_type='view' AND event_id%11<>0 GROUP BY 1, 2),
m AS (SELECT coalesce(f.user_id, l.user_id) AS user_id, coalesce(f.product_id, l.product_id) AS product_id, coalesce(f.created_at, TIMESTAMP '2030-01-01') AS created_at, l.place FROM f FULL JOIN l ON l.user_id=f.user_id AND l.product_id=f.product_id WHERE f.user_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM r WHERE r.user_id=l.user_id AND r.product_id=l.product_id AND r.gone IS NOT NULL))
"""


@named(_LOCAL + "SELECT user_id, product_id, created_at FROM m")
def favorites_synced(spark, d):
    """Accounts with their users' local favorites, but for those removed from the account."""
    return _synced(spark, d)[0]


@named(_LOCAL + "SELECT user_id, string_agg(product_id, ',' ORDER BY created_at DESC, place NULLS LAST, product_id) AS ids FROM m WHERE user_id IN (SELECT user_id FROM events WHERE event_type='view') GROUP BY 1")
def favorites_merged(spark, d):
    """Merged local lists: the account's first, the newest first, then the local ones."""
    return _synced(spark, d)[1].select("user_id", F.array_join("ids", ",").alias("ids"))


def _detailed(spark, d) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    market = F.when(F.col("l_suppkey") % 2 == 0, "AMAZON").otherwise("MERCADO_LIVRE")
    number = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10**9 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000) * 100 + F.col("l_quantity").cast("int")
    products = table(spark, d, "part").select(
        key.alias("id"), F.col("p_name").alias("name"), F.when(size % 9 == 0, "").otherwise("i1").alias("image"), F.array(F.lit("i2"), F.lit("i1"), F.lit(" ")).alias("images"), F.when(size % 4 == 0, " ").otherwise(F.col("p_brand")).alias("brand"), F.col("p_type").alias("category"), F.when(size % 3 > 0, F.lit(" Loja ")).otherwise("").alias("store"),
        F.when(size % 5 == 0, F.lit(" http://own ")).otherwise("").alias("affiliate_link"), F.col("p_retailprice").alias("price"), F.when(size % 2 == 0, F.col("p_retailprice") * 1.25).alias("old_price"), F.when(size % 8 == 0, 33).alias("discount"), F.lit(None).cast("double").alias("rating"), F.lit(None).cast("int").alias("sales"), (size % 10).cast("int").alias("stock"),
        (size > 25).alias("featured"), (size % 7 > 0).alias("active"), F.col("p_retailprice").alias("updated_at"),
    )
    lines = table(spark, d, "lineitem")
    offers = lines.select(F.col("l_partkey").alias("product_id"), number.alias("id"), market.alias("marketplace"), F.col("l_extendedprice").alias("price"), F.when(F.col("l_tax") > 0.03, F.concat(F.lit("http://"), number.cast("string"))).alias("affiliate_link"), F.when(F.col("l_linestatus") == "O", "ACTIVE").otherwise("ERROR").alias("status"), (F.col("l_returnflag") != "R").alias("available"), (F.col("l_linenumber") < 5).alias("active"))
    seen = lines.where("l_quantity > 20").select(F.col("l_partkey").alias("product_id"), number.alias("offer_id"), F.col("l_shipdate").alias("recorded_at"), F.col("l_extendedprice").alias("price"))
    earlier = seen.withColumns({"recorded_at": F.col("recorded_at") - F.expr("interval 1 day"), "price": F.col("price") + 1})
    return detail.product_details(products, offers, seen.unionByName(earlier))


@named(
    """WITH o AS (SELECT l_partkey AS p, ((l_orderkey*10+l_linenumber)*1000000000+l_partkey*1000+l_suppkey%1000)*100+CAST(l_quantity AS INTEGER) AS id, l_extendedprice AS price, CASE WHEN l_suppkey%2=0 THEN 'Amazon' ELSE 'Mercado Livre' END AS label, l_tax>0.03 AND l_linestatus='O' AND l_returnflag<>'R' AS good, l_quantity>20 AS known FROM lineitem WHERE l_linenumber<5),
    q AS (SELECT p_partkey AS id, p_type AS c, CASE WHEN p_size%4<>0 THEN p_brand END AS b, row_number() OVER (ORDER BY p_size>25 DESC, p_retailprice DESC, p_partkey) AS place FROM part WHERE p_size%7>0 AND p_retailprice>0 AND p_size%9<>0),
    pairs AS (SELECT p_partkey AS id, q.id AS other, place, q.c=p_type OR coalesce(q.b = CASE WHEN p_size%4<>0 THEN p_brand END, false) AS direct FROM part JOIN q ON q.id<>p_partkey),
    s AS (SELECT id, string_agg(CAST(other AS VARCHAR), ',' ORDER BY direct DESC, place) AS alike, bool_or(direct) AS has FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY direct DESC, place)<=8) GROUP BY 1),
    n AS (SELECT p, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY price, id) AS ids, 2*count(*) FILTER (known) AS seen, arg_min(id, (price, id)) FILTER (good) AS main, arg_min(label, (price, id)) FILTER (good) AS label FROM o GROUP BY 1)
    SELECT p_partkey AS id, CASE WHEN p_size%9=0 THEN 'i2|i1' ELSE 'i1|i2' END AS images, CASE WHEN p_size%8=0 THEN 33 WHEN p_size%2=0 THEN 20 ELSE 0 END AS discount, p_size%10 BETWEEN 1 AND 5 AS low_stock, CASE WHEN p_size%5=0 THEN 'http://own' WHEN main IS NOT NULL THEN 'http://' || main ELSE '' END AS main_link,
      CASE WHEN p_size%5=0 OR main IS NULL THEN CASE WHEN p_size%3>0 THEN 'Loja' ELSE 'Loja parceira' END ELSE label END AS sold_by, coalesce(n.n,0) AS n_offers, coalesce(ids,'') AS offer_ids, coalesce(seen,0) AS n_history, coalesce(alike,'') AS alike, coalesce(has,false) AS has_similar
    FROM part LEFT JOIN n ON n.p=p_partkey LEFT JOIN s ON s.id=p_partkey WHERE p_size%7>0"""
)
def product_details(spark, d):
    """Everything the page of every active product shows."""
    got = _detailed(spark, d)
    seen = F.aggregate("offers", F.lit(0).cast("long"), lambda n, o: n + F.size(o["history"]))
    return got.select("id", F.array_join("images", "|").alias("images"), "discount", "card.low_stock", "main_link", "sold_by", F.size("offers").cast("long").alias("n_offers"), F.array_join(F.transform("offers", lambda o: o["id"].cast("string")), ",").alias("offer_ids"), seen.alias("n_history"), F.array_join(F.transform("similar", lambda i: i.cast("string")), ",").alias("alike"), "has_similar")


_PLAN = Plan("product", "slug", ("name", "price"), one=(ToOne("category", "category", "name", "category_id"), ToOne("store", "store", "name", "store_id", connect=True)), many=(ToMany("offers", "offer", ("market",), "product_id", upsert=True), ToMany("tags", "tag", ("tag",), "product_id")))


def _written(spark, d) -> dict[str, DataFrame]:
    """Every part is created, upserted or updated, some twice, with its category, its store, its offers and its tags; every third is stored already."""
    key, part = F.col("p_partkey"), table(spark, d, "part")
    say = lambda a, b: F.concat(F.lit(a), b.cast("string"))
    seen = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set(F.struct(say("m", F.col("l_suppkey") % 4).alias("market"), F.col("l_extendedprice").alias("price")))).alias("offers"))
    rows = part.join(seen, "p_partkey", "left")
    once = rows.select(
        (key * 2).alias("request_id"), F.element_at(F.array(F.lit("create"), F.lit("upsert"), F.lit("update"), F.lit("upsert")), (key % 4 + 1).cast("int")).alias("action"), F.when(key % 23 > 0, say("s", key)).alias("slug"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        F.when(key % 5 > 0, F.struct(F.col("p_type").alias("name"), say("made by ", key).alias("note"))).alias("category"), F.when(key % 3 > 0, F.struct(say("store", key % 7).alias("name"))).alias("store"), F.when(key % 6 > 0, F.col("offers")).alias("offers"), F.array(F.struct(F.col("p_brand").alias("tag"), F.lit(1).alias("n")), F.struct(F.when(key % 2 == 0, "even").alias("tag"), F.lit(2).alias("n")), F.struct(F.col("p_brand").alias("tag"), F.lit(3).alias("n"))).alias("tags"),
    )
    again = once.where("request_id % 7 = 0").withColumns({"request_id": F.col("request_id") + 10**9, "action": F.lit("update"), "name": F.concat("name", F.lit(" again")), "tags": F.array(F.struct(F.lit("more").alias("tag"), F.lit(4).alias("n")))})
    tables = {
        "product": part.where("p_partkey % 3 = 0").select(say("old", key).alias("id"), say("s", key).alias("slug"), F.lit("stored").alias("name"), F.lit(0.5).alias("price"), F.lit("c0").alias("category_id"), F.lit(None).cast("string").alias("store_id")),
        "category": part.where("p_type like 'S%'").select("p_type").distinct().select(say("c", F.col("p_type")).alias("id"), F.col("p_type").alias("name"), F.lit("stored").alias("note")),
        "store": table(spark, d, "nation").where("n_nationkey < 5").select(say("t", F.col("n_nationkey")).alias("id"), say("store", F.col("n_nationkey")).alias("name")),
        "offer": part.where("p_partkey % 3 = 0").select(say("o", key).alias("id"), say("old", key).alias("product_id"), F.lit("m1").alias("market"), F.lit(9.5).alias("price")),
        "tag": part.where("p_partkey % 6 = 0").select(say("g", key).alias("id"), say("old", key).alias("product_id"), F.lit("even").alias("tag"), F.lit(0).alias("n")),
    }
    return nested_write(once.unionByName(again), tables, _PLAN)


_WRITTEN = """WITH q AS (SELECT p_partkey AS k, p_partkey*2 AS r, CASE p_partkey%4 WHEN 0 THEN 'create' WHEN 2 THEN 'update' ELSE 'upsert' END AS action, p_name AS name FROM part UNION ALL SELECT p_partkey, p_partkey*2+1000000000, 'update', p_name || ' again' FROM part WHERE p_partkey*2%7=0),
e AS (SELECT *, p_partkey%3=0 AS there, k%23=0 AS unkeyed, k%3>0 AND k%7>4 AS astray FROM q JOIN part ON p_partkey=k),
w AS (SELECT *, min(CASE WHEN action<>'update' AND NOT unkeyed AND NOT astray THEN r END) OVER (PARTITION BY k) AS begun FROM e),
v AS (SELECT *, CASE WHEN unkeyed THEN 'no key' WHEN astray THEN 'related row not found' WHEN action='create' AND (there OR r>begun) THEN 'exists already' WHEN action='update' AND NOT there AND NOT coalesce(begun<r, false) THEN 'not found' END AS error, CASE WHEN there THEN 'old' || k ELSE substr(sha256('product|s' || k),1,32) END AS id FROM w),
g AS (SELECT * FROM v WHERE error IS NULL),
c AS (SELECT 'c' || p_type AS id, p_type AS name, 'stored' AS note FROM part WHERE p_type LIKE 'S%' GROUP BY p_type UNION ALL SELECT substr(sha256('category|' || p_type),1,32), p_type, arg_min('made by ' || k, r) FROM g WHERE k%5>0 AND p_type NOT LIKE 'S%' GROUP BY p_type)
"""


@named(_WRITTEN + "SELECT r AS request_id, error FROM v WHERE error IS NOT NULL")
def nested_refused(spark, d):
    """Requests that are refused whole."""
    return _written(spark, d)["refused"]


@named(_WRITTEN + "SELECT coalesce(n.id, s.id) AS id, coalesce(n.slug, s.slug) AS slug, coalesce(n.name, s.name) AS name, coalesce(n.price, 0.5) AS price, CASE WHEN n.id IS NOT NULL AND n.k%5>0 THEN (SELECT c.id FROM c WHERE c.name=n.p_type) WHEN s.id IS NOT NULL THEN 'c0' END AS category_id, CASE WHEN n.k%3>0 THEN 't' || (n.k%7) END AS store_id FROM (SELECT id, 's' || k AS slug, arg_max(name, r) AS name, any_value(p_retailprice) AS price, k, p_type FROM g GROUP BY id, k, p_type) n FULL JOIN (SELECT 'old' || p_partkey AS id, 's' || p_partkey AS slug, 'stored' AS name FROM part WHERE p_partkey%3=0) s ON s.id=n.id")
def nested_products(spark, d):
    """Parents after the requests, with the ids of their category and store."""
    return _written(spark, d)["product"]


@named(_WRITTEN + "SELECT id, name, note FROM c")
def nested_categories(spark, d):
    """Related rows that were there or that the first request made."""
    return _written(spark, d)["category"]


@named(_WRITTEN + "SELECT coalesce(s.id, substr(sha256('offer|' || n.id || '|' || n.market),1,32)) AS id, coalesce(n.id, s.product_id) AS product_id, coalesce(n.market, 'm1') AS market, coalesce(n.price, 9.5) AS price FROM (SELECT g.id, 'm' || (l_suppkey%4) AS market, max(l_extendedprice) AS price FROM g JOIN lineitem ON l_partkey=k WHERE k%6>0 GROUP BY 1, 2) n FULL JOIN (SELECT 'o' || p_partkey AS id, 'old' || p_partkey AS product_id FROM part WHERE p_partkey%3=0) s ON s.product_id=n.id AND n.market='m1'")
def nested_offers(spark, d):
    """Children that are replaced or made: the last of each market counts."""
    return _written(spark, d)["offer"]


@named(_WRITTEN + ", t AS (SELECT id, p_brand AS tag, 1 AS n FROM g WHERE r<1000000000 UNION ALL SELECT id, 'even', 2 FROM g WHERE r<1000000000 AND k%2=0 UNION ALL SELECT id, 'more', 4 FROM g WHERE r>=1000000000) SELECT coalesce(s.id, substr(sha256('tag|' || t.id || '|' || t.tag),1,32)) AS id, coalesce(t.id, s.product_id) AS product_id, coalesce(t.tag, 'even') AS tag, coalesce(s.n, t.n) AS n FROM t FULL JOIN (SELECT 'g' || p_partkey AS id, 'old' || p_partkey AS product_id, 0 AS n FROM part WHERE p_partkey%6=0) s ON s.product_id=t.id AND t.tag='even'")
def nested_tags(spark, d):
    """Children that are made only where there are none."""
    return _written(spark, d)["tag"]
