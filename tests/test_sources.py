import json

from vitrine.sources import gallery, landed, pages, registry

PAGE = """<html><head><title>Lamp | Shop</title><script type="application/ld+json">{"@graph": [{"@type": ["Product"], "name": "Lamp",
"image": ["http://i/1.jpg"], "brand": {"name": "Marca: Lux"}, "offers": {"price": "1.899,00"}}]}</script></head>
<body><b class="basisPrice"><i class="a-offscreen">R$ 2.000,00</i></b><table><tr><th>EAN:</th><td>7891234567890</td></tr></table><div id="availability">Somente 3 em estoque</div></body></html>"""


def test_pages_become_records(spark):
    rows = [("https://www.amazon.com.br/dp/B0ABCDEFGH", PAGE), ("https://www.amazon.com.br/dp/B0ABCDEFGX", "<title>Robot check</title>"), ("https://www.amazon.com.br/x", "<title>Nothing</title>")]
    parsed = pages.read_products(spark.createDataFrame(rows, "url string, html string"))
    got = {r.url[-10:]: r for r in landed.page_records(parsed).collect()}
    assert len(got) == 2
    lamp = got["B0ABCDEFGH"]
    assert (lamp.title, lamp.price, lamp.old_price, lamp.discount, lamp.brand, lamp.stock, lamp.error) == ("Lamp", 1899.0, 2000.0, 5, "Lux", 3, None)
    assert [tuple(a) for a in lamp.attributes] == [("EAN", "7891234567890")]
    assert got["com.br/x"[-10:] if "com.br/x" in got else "n.com.br/x"].error == "no price"


def test_catalog_records_take_winner_else_cheapest(spark, tmp_path):
    offer = lambda i, p: {"item_id": i, "price": p, "original_price": 2 * p, "status": "active"}
    product = lambda i, w: {"id": i, "name": " Lamp ", "pictures": [{"url": "http://x/1.jpg"}], "attributes": [{"id": "BRAND", "name": "Marca", "value_name": "Lux"}], "buy_box_winner": {"item_id": w}}
    (tmp_path / "p.json").write_text("\n".join(json.dumps(p) for p in (product("mlb1", "b"), product("mlb2", "none"), product("mlb3", None))))
    (tmp_path / "o.json").write_text("\n".join(json.dumps({"product_id": p, "results": [offer("a", 5.0), offer("b", 7.0)]}) for p in ("mlb1", "mlb2")))
    products = spark.read.schema(landed.CATALOG_PRODUCT).json(str(tmp_path / "p.json"))
    offers = spark.read.schema(landed.CATALOG_OFFERS).json(str(tmp_path / "o.json"))
    got = {r.external_id: r for r in landed.catalog_records(products, offers).collect()}
    assert (got["MLB1"].price, got["MLB2"].price, got["MLB3"].error) == (7.0, 5.0, "no valid offer")
    assert got["MLB1"].image == "https://x/1.jpg" and got["MLB1"].discount == 50


def test_registry_refuses_what_it_does_not_know(spark):
    links = spark.createDataFrame([("https://shopee.com.br/a",), ("https://www.kabum.com.br/b",), ("https://x.y/c",), (" ",)], "url string")
    records, refused = registry.dispatch(links, {"SHOPEE": lambda df: df.select("url")})
    assert records.count() == 1
    assert sorted(r.error for r in refused.collect()) == ["KaBuM!: not implemented", "blank URL", "unsupported URL"]


def test_pasted_links_and_redirects(spark):
    got = landed.pasted_links(spark.createDataFrame([("a\r\n b \n\na",)], "t string"), "t").collect()
    assert sorted((r.position, r.url) for r in got) == [(0, "a"), (1, "b")]
    rows = landed.resolve_links(spark.createDataFrame([("s",), ("t",)], "url string"), spark.createDataFrame([("s", "long")], "url string, final_url string"))
    assert sorted(r.url for r in rows.collect()) == ["long", "t"]


def test_galleries_take_the_list_that_holds_the_main_picture(spark):
    code = "0123456789abcdef"
    rows = spark.createDataFrame([(1, "u", code), (2, "v", code), (3, "w", "no"), (4, None, None)], "id int, url string, image string")
    html = r'{"images":["ffffffffffffffff"],"imageList":["' + code + r'","https:\/\/cf.shopee.com.br\/file\/eeeeeeeeeeeeeeee?x"]}'
    got = {r.id: r.images for r in gallery.with_gallery(rows, spark.createDataFrame([("u", html), ("u", html), (None, html)], "url string, html string")).collect()}
    assert got == {1: [gallery.HOST + code, gallery.HOST + "e" * 16], 2: [gallery.HOST + code], 3: [], 4: []}


def test_page_prices_skip_struck_amounts_and_bad_markup():
    struck = '<div id="apex_desktop"><span class="a-price a-text-price"><b class="a-offscreen">R$ 9,00</b></span></div><p id="kindle-price">R$ 0,00</p><p id="priceblock_ourprice">R$ 7,00'
    got = pages.page_record("u", struck)
    assert (got["prices"], got["old_prices"], got["images"], got["code"]) == (["R$ 7,00"], ["R$ 9,00"], [], None)
    assert pages.page_record("u", None)["attributes"] == []


def test_page_rules_of_description_stock_rating_and_price(spark):
    page = lambda body, ld=None: f'<body><span id="productTitle">T</span>{body}<script type="application/ld+json">{json.dumps({"@type": "Product", "sku": "B0ABCDEFGH", "image": "i", **(ld or {})})}</script></body>'
    bullets = '<div id="feature-bullets"><ul><li><span> One <b>two</b></span></li><li><span>One two</span><span>Clique aqui para informações gerais</span></li><li><span><span>In</span>ner</span></li></ul><span>out</span></div><div id="productDescription">no</div>'
    cases = {
        "bullets": page(bullets + '<p id="price_inside_buybox">R$ 5,00</p>'),
        "blocks": page('<div id="productDescription"> </div><div id="aplus_feature_div">A\n plus</div><div id="availability"> </div><div id="outOfStock">Não disponível.</div>', {"offers": [{"price": 0}, {"lowPrice": 199.9}], "description": "ld"}),
        "told": page('<div id="availability">Restam\u00a0 12 unidades</div><i id="acrPopover" title="4 de 5 estrelas"></i><b id="acrCustomerReviewText">1.234 avaliações</b>', {"offers": {"price": "12,50"}, "description": " l  d ", "aggregateRating": {"ratingValue": 3.5, "reviewCount": 7}}),
        "far": page('<div id="availability">Somente hoje: envio em 3 dias</div><i id="averageCustomerReviews">4,5 de 5</i>', {"offers": {"price": "9,00"}, "aggregateRating": {"ratingValue": 3.5, "ratingCount": "70"}}),
        "rated": page('<div id="availability">Currently unavailable</div>', {"offers": {"price": 9}, "aggregateRating": {"ratingValue": 3.5, "ratingCount": "70"}}),
    }
    rows = spark.createDataFrame([(f"https://www.amazon.com.br/{k}", v) for k, v in cases.items()], "url string, html string")
    got = {r.url.rsplit("/", 1)[1]: (r.description, r.price, r.stock, r.rating, r.reviews) for r in landed.page_records(pages.read_products(rows)).collect()}
    assert got == {
        "bullets": ("One two • In • Inner", 5.0, None, None, None),
        "blocks": ("A plus", 199.9, 0, None, None),
        "told": ("l d", 12.5, 12, 4.0, 1234),
        "far": (None, 9.0, None, None, 70),
        "rated": (None, 9.0, 0, 3.5, 70),
    }
