"""Named queries of the landed sources: galleries, nodes, item details, page fields and search or import."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import url
from vitrine.operators.search import search_or_import
from vitrine.plans.registry import named, table
from vitrine.sources import gallery, landed, pages, redirects

_MAIN = "br-11134207-7r98o-main"


@named(
    f"SELECT page_id, array_to_string(CASE page_id % 4 WHEN 0 THEN ['{gallery.HOST}{_MAIN}', '{gallery.HOST}br-11134207-7r98o-two0'] "
    f"WHEN 1 THEN ['{gallery.HOST}{_MAIN}'] WHEN 2 THEN ['{gallery.HOST}{_MAIN}'] ELSE CAST([] AS VARCHAR[]) END, '|') AS images FROM pages"
)
def gallery_images(spark, d):
    """Pictures of the list that holds the main one; other lists, pages not landed and values that are no code."""
    n = F.col("page_id") % 4
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://s/"), "page_id").alias("url"), F.when(n == 3, "short").otherwise(_MAIN).alias("image"))
    other = '{"images":["br-11134207-7r98o-else","br-11134207-7r98o-more"]}'
    holding = '{&quot;image_list&quot;: [&quot;' + _MAIN + r"&quot;, &quot;https:\/\/cf.shopee.com.br\/file\/br-11134207-7r98o-two0?x=1&quot;, &quot;no&quot;]}"
    landed_pages = rows.where("page_id % 4 <> 2").select("url", F.when(F.col("page_id") % 4 == 1, other).otherwise(other + holding).alias("html"))
    return gallery.with_gallery(rows, landed_pages).select("page_id", F.array_join("images", "|").alias("images"))


@named(
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE 'name' || p_partkey END AS name, "
    "CASE WHEN p_size % 3 = 0 THEN 'not in the affiliate programme' WHEN p_size % 3 = 1 THEN 'no affiliate link' END AS error FROM part"
)
def exact_offer_nodes(spark, d):
    """The node of the asked shop and item among those answered."""
    size = F.col("p_size")
    schema = f"struct<{landed.AFFILIATE_OFFER}>"
    node = lambda item: F.from_json(F.to_json(F.struct(item.alias("itemId"), F.lit(5).alias("shopId"), F.concat(F.lit("name"), "p_partkey").alias("productName"), F.when(size % 3 == 2, "https://l").otherwise(" ").alias("offerLink"))), schema)
    key = F.col("p_partkey")
    answers = table(spark, d, "part").select("p_partkey", F.lit("5").alias("shop"), key.cast("string").alias("item"), F.array(node(key + 1), node(F.when(size % 3 == 0, key + 2).otherwise(key))).alias("nodes"))
    return landed.exact_offers(answers).select(F.col("item").cast("long").alias("p_partkey"), F.col("node.productName").alias("name"), "error")


@named("SELECT o_orderkey, sha256('app' || o_custkey || '{\"q\":' || o_orderkey || '}' || 'secret') AS signed FROM orders")
def request_signature(spark, d):
    payload = F.concat(F.lit('{"q":'), F.col("o_orderkey").cast("string"), F.lit("}"))
    return table(spark, d, "orders").select("o_orderkey", landed.signature(F.lit("app"), F.col("o_custkey"), payload, F.lit("secret")).alias("signed"))


@named(
    "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'text of ' || p_partkey END AS description, CASE WHEN p_size % 3 = 0 THEN p_size / 10.0 END::DOUBLE AS rating, "
    "CASE WHEN p_size % 3 = 0 THEN p_size END::BIGINT AS n_reviews, n_name AS category FROM part LEFT JOIN nation ON n_nationkey = p_size"
)
def item_details(spark, d):
    """Items with their landed descriptions, reviews and categories; what wasn't landed is null."""
    parts = table(spark, d, "part").withColumn("item_id", F.concat(F.lit("MLB"), "p_partkey"))
    items = parts.select("p_partkey", "item_id", F.concat(F.lit("C"), F.col("p_size")).alias("category_id"))
    told = parts.where("p_size % 2 = 0").select("item_id", F.concat(F.lit("text of "), "p_partkey").alias("plain_text"))
    rated = parts.where("p_size % 3 = 0").select("item_id", (F.col("p_size") / 10.0).cast("double").alias("rating_average"), F.struct(F.col("p_size").cast("long").alias("total")).alias("paging"))
    kinds = table(spark, d, "nation").select(F.concat(F.lit("C"), "n_nationkey").alias("id"), F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("name"))
    return landed.with_details(items, told, rated, kinds).select("p_partkey", "description", "rating", "n_reviews", "category")


@named("SELECT n_nationkey AS id, trim(n_name) AS name FROM nation WHERE n_regionkey <> 2")
def category_list(spark, d):
    """Categories that have an id and a name, trimmed."""
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") != 2, F.concat(F.lit("  "), "n_name")).alias("name"))
    return landed.category_list(rows)


@named(
    "SELECT p_partkey, concat_ws('|', 'Cor=' || CASE WHEN p_size % 2 = 0 THEN 'azul' ELSE 'preto' END, 'Condição=' || CASE WHEN p_size % 3 = 0 THEN 'Novo' WHEN p_size % 3 = 1 THEN 'used' END, CASE WHEN p_size % 5 = 0 THEN 'Garantia=1 ano' END) AS specs FROM part"
)
def specs_last_wins(spark, d):
    """Attributes, condition and warranty; the last of equal keys counts."""
    size = F.col("p_size")
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), F.lit(v).alias("value"))
    given = F.when(size % 2 == 0, F.array(pair("Cor", "preto"), pair("Cor", "azul"))).otherwise(F.array(pair("Cor", "preto")))
    shown = landed.condition_and_warranty(given, F.when(size % 3 == 0, "new").when(size % 3 == 1, "used"), F.when(size % 5 == 0, "1 ano"))
    return table(spark, d, "part").select("p_partkey", F.array_join(F.transform(shown, lambda p: F.concat(p["key"], F.lit("="), p["value"])), "|").alias("specs"))


_PAGE = """<html><head><link rel="canonical" href="https://www.amazon.com.br/x/dp/%s"><meta property="og:image" content="https://m/I/og.jpg"></head><body data-asin="B0BODYCODE">
<ul id="wayfinding-breadcrumbs_container"><li><a>Casa</a></li><li>&gt;</li><li><a>Luz</a></li></ul><span id="productTitle">Lamp</span>
<div id="corePrice_feature_div"><span class="a-price a-text-price"><span class="a-offscreen">R$ 250,00</span></span><span class="a-price"><span class="a-offscreen">R$ 199,90</span></span></div>
<img id="landingImage" src="https://m/I/main.jpg" data-a-dynamic-image='{"https://m/I/dyn.jpg":[1,2]}'><div id="altImages"><img src="https://m/I/alt._AC_US40_.jpg"></div><img src="https://m/I/advert.jpg">
<div id="detailBullets_feature_div"><ul><li><span><span class="a-text-bold">Fabricante :</span> <span>Lux</span></span></li></ul></div>
<table id="productDetails_techSpec_section_1"><tr><th>Cor</th><td>azul</td></tr></table><div id="merchant-info">Vendido por Loja Boa e enviado por outra.</div></body></html>"""


@named(
    "SELECT CAST(page_id AS VARCHAR) AS page, CASE WHEN page_id % 2 = 0 THEN 'B0CANONICA' ELSE 'B0BODYCODE' END AS code, 199.9::DOUBLE AS price, 250.0::DOUBLE AS old_price, 'Loja Boa' AS seller, 'Fabricante=Lux|Cor=azul' AS specs, "
    "'https://m/I/main.jpg|https://m/I/og.jpg|https://m/I/dyn.jpg|https://m/I/alt.jpg' AS images FROM pages"
)
def page_fields(spark, d):
    """Code, prices, seller, attributes and pictures of product pages from the places where they may stand."""
    html = F.when(F.col("page_id") % 2 == 0, _PAGE % "B0CANONICA").otherwise(_PAGE % "none")
    rows = table(spark, d, "pages").select(F.concat(F.lit("https://www.amazon.com.br/s/"), "page_id").alias("url"), html.alias("html"))
    got = landed.page_records(pages.read_products(rows))
    specs = F.array_join(F.transform("attributes", lambda a: F.concat(a["key"], F.lit("="), a["value"])), "|")
    return got.select(F.regexp_extract("url", r"(\d+)$", 1).alias("page"), F.col("external_id").alias("code"), "price", "old_price", "seller", specs.alias("specs"), F.array_join("images", "|").alias("images"))


def _searched(spark, d):
    orders = table(spark, d, "orders")
    key = F.col("o_orderkey")
    code = lambda c: F.concat(F.lit("MLB"), c)
    asked = orders.select(key.alias("request_id"), F.lit("https://www.mercadolivre.com.br/p").alias("url"), F.when(key % 3 == 0, code(F.col("o_custkey"))).when(key % 3 == 1, "  ").alias("external_id"))
    known = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.lit("MERCADO_LIVRE").alias("marketplace"), code(F.col("c_custkey")).alias("external_id"), F.col("c_custkey").alias("product_id"))
    found = orders.where("o_orderkey % 7 <> 0").select(key.alias("request_id"), code(F.col("o_custkey")).alias("external_id"), F.when(key % 2 == 0, " l ").alias("affiliate_link"))
    return search_or_import(asked, known, lambda rows: rows.join(found, "request_id"))


_KNOWN = "c_custkey % 2 = 0"


@named(f"SELECT o_orderkey AS request_id, o_custkey AS product_id, o_orderkey % 3 <> 0 AS imported FROM orders JOIN customer ON c_custkey = o_custkey WHERE {_KNOWN} AND (o_orderkey % 3 = 0 OR o_orderkey % 7 <> 0)")
def search_answers(spark, d):
    """Requests answered from the catalog, at once or after the import told the code."""
    return _searched(spark, d)[0]


@named(f"SELECT o_orderkey AS request_id, 'MLB' || o_custkey AS external_id, CASE WHEN o_orderkey % 2 = 0 THEN 'l' END AS affiliate_link, 'ON_DEMAND_SEARCH' AS discovery_source FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND {_KNOWN} WHERE c_custkey IS NULL AND o_orderkey % 7 <> 0")
def search_imports(spark, d):
    """Imported records of requests that the catalog doesn't know yet."""
    return _searched(spark, d)[1].select("request_id", "external_id", "affiliate_link", "discovery_source")


def _chains(spark, d):
    """Events lead from one to the next, fifty to a chain; every fourth chain is of eight, some go round, some pass by another host."""
    n = F.col("event_id")
    chain, at = F.floor(n / 50), n % 50
    address = lambda c: F.concat(F.when((F.floor(c / 50) % 5 == 2) & (c % 50 == 20), "https://other.example/").otherwise("https://amzn.to/"), c.cast("string"))
    last = (at == 49) | ((chain % 4 == 0) & (at % 8 == 7))
    goal = F.when(chain % 7 == 3, address(chain * 50)).when(chain % 11 == 4, "https://shop.example/").otherwise(F.concat(F.lit("https://www.amazon.com.br/dp/"), chain.cast("string")))
    links = table(spark, d, "events").select(n.alias("id"), address(n).alias("url"))
    return links, table(spark, d, "events").select(address(n).alias("url"), F.when(last, goal).otherwise(address(n + 1)).alias("final_url"))


_CHAINS = """SELECT event_id AS id, chain, CASE WHEN chain%5=2 AND place<=20 AND NOT (chain%4=0 AND place//8<2) OR chain%7<>3 AND chain%11=4 OR chain%7=3 AND chain%5=2 AND chain%4<>0 THEN 'redirect to another host' WHEN chain%7=3 THEN 'redirect loop' WHEN hops>20 THEN 'too many redirects' END AS error, hops FROM (SELECT event_id, event_id//50 AS chain, event_id%50 AS place, CASE WHEN event_id//50%4=0 THEN least(8-event_id%50%8, 50-event_id%50) ELSE 50-event_id%50 END AS hops FROM events)"""


@named(f"SELECT id, error AS redirect_error, CASE WHEN error IS NULL THEN 'https://www.amazon.com.br/dp/' || chain END AS destination, CASE WHEN error IS NULL OR error='too many redirects' THEN hops END AS hops FROM ({_CHAINS})")
def redirect_ends(spark, d):
    """Where chains of redirects lead, and why some don't: loops, too many hops, another host on the way or at the end."""
    links, known = _chains(spark, d)
    got = redirects.follow(links, known, domains=url.PAGE_DOMAINS, end_domains=redirects.PAGE_HOSTS)
    counted = F.col("redirect_error").isNull() | (F.col("redirect_error") == redirects.FAR)
    return got.select("id", "redirect_error", "destination", F.when(counted, F.col("hops")).alias("hops"))


@named(f"SELECT error, count(*) AS n FROM (SELECT CASE WHEN error IS NOT NULL THEN error WHEN chain%3=0 THEN 'page not landed' ELSE 'loaded' END AS error FROM ({_CHAINS})) GROUP BY 1")
def pages_loaded(spark, d):
    """How many links load their page, and why others don't."""
    links, known = _chains(spark, d)
    landed_pages = links.select(F.floor(F.col("id") / 50).alias("chain")).distinct().select(F.concat(F.lit("https://www.amazon.com.br/dp/"), "chain").alias("url"), F.when(F.col("chain") % 3 == 0, " ").otherwise("<p>page</p>").alias("html"))
    loaded, refused = redirects.load_pages(links, known, landed_pages)
    return loaded.select(F.lit("loaded").alias("error")).unionByName(refused.select("error")).groupBy("error").agg(F.count("*").alias("n"))


@named(
    "SELECT page_id AS request_id, upper(trim(item)) AS item_id, ok AND shape<>3 AND shape<>4 AS success, CASE WHEN ok AND shape<>3 THEN shape IN (0,4) END AS is_json, CASE WHEN NOT ok THEN NULL WHEN shape IN (0,4) THEN '{\"id\":' || page_id || ',\"price\":' || (page_id+0.5) || ',\"url\":\"' || url || '\"}' WHEN shape<>3 THEN html END AS data, CASE WHEN NOT ok THEN 'invalid item' WHEN shape=3 THEN 'no response' WHEN shape=4 THEN 'status 404' END AS error "
    "FROM (SELECT *, CASE WHEN page_id%7=2 THEN 'MLB' || page_id || 'x' WHEN page_id%7=3 THEN '' ELSE ' mlb' || page_id END AS item, page_id%7 NOT IN (2,3) AS ok, page_id%5 AS shape FROM pages)"
)
def multiget_bodies(spark, d):
    """Items asked for at once: JSON bodies in canonical form, pages kept as text, refused ids, missing and failed answers."""
    n, say = F.col("page_id"), F.col("page_id").cast("string")
    rows = table(spark, d, "pages")
    item = F.when(n % 7 == 2, F.concat(F.lit("MLB"), say, F.lit("x"))).when(n % 7 == 3, "").otherwise(F.concat(F.lit(" mlb"), say))
    told = F.concat(F.lit('{ "url": "'), "url", F.lit('", "price": '), (n + 0.5).cast("string"), F.lit('0, "id": '), say, F.lit("}"))
    responses = rows.where(n % 5 != 3).select(F.concat(F.lit("MLB"), say).alias("item_id"), F.when(n % 5 == 4, 404).otherwise(200).alias("status"), F.when((n % 5).isin(0, 4), told).otherwise(F.col("html")).alias("body"))
    return landed.multiget(rows.select(n.alias("request_id"), item.alias("item_id")), responses)
