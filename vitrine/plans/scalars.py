"""Named queries of the scalar functions: written cases dealt to the rows of a table, with the values expected of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitrine.functions import money, text, url, values
from vitrine.operators import query
from vitrine.operators import where as rel
from vitrine.operators.where import where
from vitrine.plans.registry import named, table
from vitrine.sources import landed, pages


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _expected(cases: dict[str, list[tuple]], kinds: dict[str, str] | None = None) -> str:
    columns = [f"CAST(CASE p_partkey % {len(rows)} " + " ".join(f"WHEN {k} THEN {_sql(want)}" for k, (_, want) in enumerate(rows)) + f" END AS {(kinds or {}).get(name, 'VARCHAR')}) AS {name}" for name, rows in cases.items()]
    return f"SELECT p_partkey, {', '.join(columns)} FROM part"


def _given(rows: list[tuple]):
    return F.element_at(F.array(*[F.lit(x) for x, _ in rows]), (F.col("p_partkey") % len(rows) + 1).cast("int"))


def _run(spark, d, cases, makers):
    return table(spark, d, "part").select("p_partkey", *[makers[name](_given(rows)).alias(name) for name, rows in cases.items()])


_TEXTS = {
    "key": [("  Cor :: ", "Cor"), ("Marca:::", "Marca"), ("a  b:", "a b"), ("", "")],
    "attribute": [("Código  EAN:", "CODIGO_EAN"), ("--Número de peça", "NUMERO_DE_PECA"), ("x", "X")],
    "brand": [("Visite a loja da Sony", "Sony"), ("Marca: LG", "LG"), ("BRAND:  Acme ", "Acme"), ("  ", None), ("Dell", "Dell")],
    "share": [("a  b\n c", "a b c"), ("w" * 181, "w" * 177 + "..."), ("v" * 180, "v" * 180), ("y" * 176 + " zzzzzz", "y" * 176 + "...")],
    "code": [("24b34afb-8143-4000-8000-000000000000", "24b34afb8143"), ("00000000-0000-4000-8000-00000000000a", "000000000000")],
    "prefix": [("24b34afb8143", "24b34afb-8143"), ("24B34AFB8143", None), ("24b34afb814", None)],
    "blank": [("  ", None), (" a ", "a"), ("", None)],
}


@named(_expected(_TEXTS))
def text_cases(spark, d):
    """Labels, brands, share texts and short codes."""
    return _run(spark, d, _TEXTS, {"key": text.key_of, "attribute": text.attribute_key, "brand": text.brand, "share": text.share_text, "code": text.short_code, "prefix": text.code_prefix, "blank": text.blank_to_null})


_URLS = {
    "asin": [("https://www.amazon.com.br/dp/b0abcdefgh?x=1", "B0ABCDEFGH"), ("https://a.b/gp/product/B0ABCDEFG1/ref", "B0ABCDEFG1"), ("https://a.b/x?asin=B0ABCDEFG2&y", "B0ABCDEFG2"), ("https://a.b/dp/short", None)],
    "catalog": [("https://www.mercadolivre.com.br/x/p/MLB-123?y", "MLB123"), ("https://a.b/?catalog_product_id=mlb77", "MLB77"), ("https://a.b/p%2FMLB9", "MLB9"), ("https://a.b/", None)],
    "item": [("https://a.b/x?wid=MLB-5", "MLB5"), ("https://produto.a.b/MLB-987-nome_JM", "MLB987"), ("https://a.b/?item_id=mlb8&z", "MLB8"), ("https://a.b/c", None)],
    "picture": [("https://m/I/71x._AC_SL500_.jpg", "https://m/I/71x.jpg"), ("https://m/I/71x.jpg", "https://m/I/71x.jpg")],
    "secure": [("//i/x", "https://i/x"), ("http://i/x", "https://i/x"), ("https://i/x", "https://i/x")],
    "unwrapped": [("https://meli.la/https://meli.la/abc", "https://meli.la/abc"), ("https://meli.la/abc", "https://meli.la/abc")],
    "problem": [(" ", "blank"), ("abc", "not a URL"), ("https://u@meli.la/a", "user information"), ("https://meli.la/https://meli.la/b", "link within a link"), ("https://other.com/a", "other host"), ("https://x.meli.la/a", None)],
    "shop": [("https://shopee.com.br/nome-i.12.34", "12.34"), ("https://shopee.com.br/product/5/6", "5.6"), ("https://a.b/?shopid=7&x&itemid=8", "7.8"), ("https://a.b", None)],
}


@named(_expected(_URLS))
def url_cases(spark, d):
    """Codes in links, pictures, unwrapped links and why links are refused."""
    shop = lambda c: (lambda s: F.when(s.isNotNull(), F.concat_ws(".", s["shop"], s["item"])))(url.shop_item(c))
    return _run(spark, d, _URLS, {"asin": url.asin, "catalog": url.catalog_id, "item": url.item_id, "picture": url.image, "secure": url.https, "unwrapped": url.unwrap, "problem": lambda c: url.link_problem(c, ("meli.la",)), "shop": shop})


_VALUES = {
    "whole": [("1.234 avaliações", 1234), ("abc", None), ("(12)", 12)],
    "stock": [("Indisponível no momento", 0), ("Somente 3 em estoque", 3), ("Em estoque", None), ("https://schema.org/OutOfStock", None), ("Temporariamente sem estoque.", 0), ("Não disponível", 0), ("Currently unavailable.", 0), ("Restam apenas 7 unidades", 7), ("Somente hoje: em 3 dias", None)],
    "shown": [("true", "Sim"), ("false", "Não"), ('["a","b"]', "a, b"), ("null", "Não informado"), ("12.5", "12.5"), ('"x y"', "x y"), ('{"a":1}', '{"a":1}')],
    "null_kind": [("null", "JsonNull"), (None, "DbNull"), ("1", None)],
    "ids": [('[" a","b","a",""]', "a|b"), ("nothing", ""), ('{"a":1}', ""), (None, "")],
    "keys": [('{"u1":[1,2],"u2":[3]}', "u1|u2"), ("{}", ""), ("x", None)],
    "time": [("2024-05-06 07:08:09", "06/05/2024, 07:08"), ("soon", "—"), (None, "—")],
    "hash": [("abc", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")],
    "encoded": [("a?>~", "YT8-fg"), ("ab", "YWI"), ("", "")],
    "rest": [("a,b,a,c", "b,c"), ("a", "")],
}


@named(_expected(_VALUES, {"whole": "BIGINT", "stock": "INTEGER"}))
def value_cases(spark, d):
    """Numbers in texts, stock, JSON values, hashes, encodings and times."""
    return _run(
        spark,
        d,
        _VALUES,
        {
            "whole": money.int_digits,
            "stock": pages.stock,
            "shown": values.shown,
            "null_kind": values.null_kind,
            "ids": lambda c: F.array_join(values.json_ids(c), "|"),
            "keys": lambda c: F.array_join(F.json_object_keys(c), "|"),
            "time": values.short_time,
            "hash": lambda c: F.sha2(c, 256),
            "encoded": lambda c: values.base64url(c.cast("binary")),
            "rest": lambda c: F.array_join(values.without(F.split(c, ","), F.lit("a")), ","),
        },
    )


@named("SELECT p_partkey, CAST(CASE WHEN p_size > 25 AND p_retailprice*1.1 > p_retailprice THEN round((p_retailprice*1.1-p_retailprice)/(p_retailprice*1.1)*100) WHEN p_size%7 > 0 AND p_size*3 < 100 THEN p_size*3 END AS INTEGER) AS pct FROM part")
def declared_discount(spark, d):
    """Computed discount, else the declared one between 0 and 100."""
    old, declared = F.when(F.col("p_size") > 25, F.col("p_retailprice") * 1.1), F.when(F.col("p_size") % 7 > 0, F.col("p_size") * 3)
    return table(spark, d, "part").select("p_partkey", money.discount_or(old, F.col("p_retailprice"), declared).alias("pct"))


@named("SELECT p_partkey, coalesce(p_size%4=1, false) AS has_old_price, CASE WHEN p_size%5=0 THEN true ELSE p_size%4=1 END AS has_discount, p_size%3=1 AS has_rating, p_size%2=1 AS has_sales, p_size BETWEEN 1 AND 5 AS low_stock FROM part")
def card_predicates(spark, d):
    size, price = F.col("p_size"), F.col("p_retailprice")
    shown = values.card(F.when(size % 4 == 1, price * 2).when(size % 4 == 2, price), price, F.when(size % 5 == 0, 10), F.when(size % 3 == 1, 4.5), F.when(size % 2 == 1, size), size)
    return table(spark, d, "part").select("p_partkey", shown.alias("c")).select("p_partkey", "c.*")


@named("SELECT p_partkey, CASE WHEN p_size%3=0 THEN 'own' ELSE coalesce(o.link, '') END AS link, CASE WHEN p_size%3=0 THEN CASE WHEN p_size%2=0 THEN 'Loja' ELSE 'Loja parceira' END ELSE o.market END AS store FROM part LEFT JOIN (SELECT l_partkey, 'l' || l_orderkey AS link, CAST(l_suppkey AS VARCHAR) AS market FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus = 'F' AND l_quantity > 10 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) = 1) o ON o.l_partkey = p_partkey")
def product_detail_link(spark, d):
    """A product's main link and store: its own, else those of the first active, available offer with a link by price."""
    offer = F.struct("l_extendedprice", "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.concat(F.lit(" l"), "l_orderkey")).alias("link"), F.col("l_suppkey").cast("string").alias("marketplace"), F.when(F.col("l_linestatus") == "F", "ACTIVE").otherwise("ERROR").alias("status"), (F.col("l_returnflag") != "R").alias("available"))
    nested = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_list(offer)).alias("offers"))
    size = F.col("p_size")
    chosen = values.main_link(F.when(size % 3 == 0, " own ").otherwise(" "), F.when(size % 2 == 0, "Loja"), F.col("offers"))
    return table(spark, d, "part").join(nested, "p_partkey", "left").select("p_partkey", chosen.alias("m")).select("p_partkey", "m.*")


@named("SELECT c_custkey, related FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS related FROM orders GROUP BY 1) o ON o_custkey = c_custkey ORDER BY related DESC NULLS LAST, c_custkey LIMIT 25")
def order_by_relation_count(spark, d):
    return query.order_by_related(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), ("c_custkey", "o_custkey"), F.count("*"), take=25)


@named("SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 5000")
def relation_is(spark, d):
    return rel.is_(table(spark, d, "orders"), table(spark, d, "customer"), ("o_custkey", "c_custkey"), F.col("c_acctbal") > 5000).select("o_orderkey")


@named("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def relation_is_not(spark, d):
    return rel.is_not(table(spark, d, "orders"), table(spark, d, "customer"), ("o_custkey", "c_custkey"), F.col("c_acctbal") > 5000).select("o_orderkey")


@named("SELECT event_id FROM events WHERE event_id % 5 = 0 OR event_type NOT IN ('click', 'view')")
def null_or_not_in(spark, d):
    kind = F.when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return table(spark, d, "events").where(rel.null_or_not_in(kind, ["click", "view"])).select("event_id")


@named("SELECT DISTINCT c_custkey*2 AS o_custkey FROM customer WHERE c_custkey*2 NOT IN (SELECT o_custkey FROM orders)")
def lacking_ids(spark, d):
    """Requested ids that aren't there."""
    wanted = table(spark, d, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"))
    return query.lacking(wanted, table(spark, d, "orders"), "o_custkey")


@named("SELECT page_id, page_id % 4 <> 1 AS destination_ok FROM pages")
def link_destinations(spark, d):
    """Links whose final address is on an allowed domain, or unknown."""
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("https://meli.la/"), "page_id").alias("url"))
    final = F.when(F.col("page_id") % 4 == 1, "https://elsewhere.com/x").when(F.col("page_id") % 4 == 2, "https://www.mercadolivre.com.br/p")
    redirects = rows.where("page_id % 4 in (1, 2)").select("url", final.alias("final_url"))
    return landed.destinations(rows, redirects, ("mercadolivre.com.br", "meli.la")).select("page_id", "destination_ok")


@named("SELECT event_id, key, CAST(value AS VARCHAR) AS value FROM (SELECT event_id, unnest(['k', 'twice']) AS key, unnest([CAST(json_extract_string(props,'$.k') AS INTEGER), 2*CAST(json_extract_string(props,'$.k') AS INTEGER)]) AS value FROM events)")
def map_entries(spark, d):
    """The entries of an object, a row each."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, d, "events").select("event_id", F.create_map(F.lit("k"), k, F.lit("twice"), k * 2).alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value")).select("event_id", "key", F.col("value").cast("string").alias("value"))


@named("SELECT event_id, epoch_us(ts)//1000000 AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, event_id % 7200 <= 3660 AS expired FROM events")
def times_and_expiry(spark, d):
    """Epoch seconds, ISO text, and whether what was obtained so long ago for an hour is about to end."""
    at = F.col("ts").cast("timestamp_ntz")
    utc = at.cast("timestamp")
    life = F.col("event_id") % 7200
    return table(spark, d, "events").select("event_id", F.unix_timestamp(utc).alias("seconds"), values.iso(utc).alias("iso"), values.expired(utc, life, utc + F.expr("INTERVAL 3600 SECONDS")).alias("expired"))


@named("SELECT l_orderkey, CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS succeeded, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) AS processed FROM lineitem GROUP BY 1")
def run_tallies(spark, d):
    """Successes, failures and totals of each run."""
    failed = F.col("l_returnflag") == "R"
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.count("*").alias("processed"))


@named("SELECT o_custkey, '{\"items\":[' || string_agg('{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}', ',' ORDER BY o_orderkey) || '],\"total\":' || count(*) || '}' AS json FROM orders GROUP BY 1")
def json_result(spark, d):
    """A JSON text of a summary and its items for each customer."""
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count("*").alias("total"))
    return rows.select("o_custkey", F.to_json(F.struct("items", "total")).alias("json"))


@named("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def first_in_list(spark, d):
    """Of each customer's listed orders the first with a wanted status."""
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))).alias("listed"))
    return rows.select("o_custkey", values.first_match(F.col("listed"), status=F.lit("O"))["id"].alias("first_open")).where("first_open is not null")


_JSON_TESTS = {
    "contains_kind": ({"path": ["tags"], "array_contains": ["click"]}, "event_type='click'"),
    "contains_object": ({"path": ["tags"], "array_contains": [{"b": 1, "a": [2.0]}, "x"]}, "event_id%3=0"),
    "starts": ({"path": ["tags"], "array_starts_with": "view"}, "event_type='view'"),
    "ends": ({"path": ["tags"], "array_ends_with": 2}, "event_id%5=2"),
    "first": ({"path": ["tags", 0], "equals": "error"}, "event_type='error'"),
    "deep": ({"path": ["in", "k"], "lt": 30}, "k<30"),
    "between": ({"path": ["in", "k"], "gte": 10, "lte": 20}, "k BETWEEN 10 AND 20"),
    "of_kind": ({"path": ["mixed"], "gt": 50}, "event_id%4=1 AND k>50"),
    "as_text": ({"path": ["mixed"], "gt": "k5"}, "event_id%4=0 AND 'k' || k > 'k5'"),
    "is_null": ({"path": ["mixed"], "equals": None}, "event_id%4=2"),
    "differs": ({"path": ["mixed"], "not": True}, "event_id%4<>3"),
    "text": ({"path": ["kind"], "string_contains": "LI", "mode": "insensitive"}, "contains(event_type,'li')"),
    "whole": ({"array_contains": 1}, "false"),
}


@named("SELECT event_id, " + ", ".join(f"{test} AS {name}" for name, (_, test) in _JSON_TESTS.items()) + " FROM (SELECT event_id, event_type, CAST(json_extract_string(props,'$.k') AS INTEGER) AS k FROM events)")
def json_filters(spark, d):
    """Filters on values inside JSON: array contents and ends, deep equality, order within a kind, null, text."""
    n, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
    mixed = F.when(n % 4 == 0, F.concat(F.lit('"k'), k.cast("string"), F.lit('"'))).when(n % 4 == 1, F.concat(k.cast("string"), F.lit(".0"))).when(n % 4 == 2, "null").otherwise("true")
    tags = F.concat(F.lit('["'), "event_type", F.lit('", '), F.when(n % 3 == 0, '{"a": [2], "b": 1.00}, "x", ').otherwise('"y", '), (n % 5).cast("string"), F.lit("]"))
    doc = F.concat(F.lit('{"tags": '), tags, F.lit(', "mixed": '), mixed, F.lit(', "in": '), "props", F.lit(', "kind": "'), "event_type", F.lit('"}'))
    return table(spark, d, "events").select("event_id", doc.alias("doc")).select("event_id", *[where({"doc": test}).alias(name) for name, (test, _) in _JSON_TESTS.items()])
