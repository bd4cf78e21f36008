import pytest
from pyspark.sql import functions as F

from vitrine.functions import attrs, money, text, url


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("given, expected", [("R$ 1.899,00", 1899.0), ("1,234.56", 1234.56), ("12,50", 12.5), ("12,5", 125.0), ("12.50", 12.5), ("12.5", 125.0), ("1.234", 1234.0), ("1.234.567", 1234567.0), ("1.234.56", None), ("10-20", None), ("abc", None), (None, None)])
def test_parse_number(spark, given, expected):
    assert one(spark, given, money.parse_number) == expected


@pytest.mark.parametrize("old, price, expected", [(200.0, 150.0, 25), (100.0, 100.0, None), (None, 5.0, None), (1000.0, 999.0, 0)])
def test_discount(spark, old, price, expected):
    row = spark.createDataFrame([(old, price)], "o double, p double").select(money.discount_pct(F.col("o"), F.col("p")).alias("r")).first()
    assert row.r == expected


@pytest.mark.parametrize(
    "make, given, expected",
    [
        (text.numeric_code, "789-1234567890", "7891234567890"),
        (text.numeric_code, "1234567", None),
        (money.int_digits, "1.234 avaliações", 1234),
        (money.int_digits, "abc", None),
        (url.unwrap, "https://meli.la/https://meli.la/abc", "https://meli.la/abc"),
        (text.short_code, "24b34afb-8143-4000-8000-000000000000", "24b34afb8143"),
        (text.code_prefix, "24b34afb8143", "24b34afb-8143"),
        (text.code_prefix, "xyz", None),
        (url.marketplace, "https://www.amazon.com.br/dp/X", "AMAZON"),
        (url.marketplace, "https://x.meli.la/1", "MERCADO_LIVRE"),
        (url.marketplace, "https://notamazon.com", None),
        (url.asin, "https://www.amazon.com.br/dp/b0abcdefgh?x=1", "B0ABCDEFGH"),
        (url.catalog_id, "https://www.mercadolivre.com.br/x/p/MLB-123?y", "MLB123"),
        (url.image, "https://m/I/71x._AC_SL500_.jpg", "https://m/I/71x.jpg"),
        (text.brand, "Visite a loja da Sony", "Sony"),
    ],
)
def test_values(spark, make, given, expected):
    assert one(spark, given, make) == expected


def test_slug_and_links(spark):
    row = spark.createDataFrame([("Áudio & Vídeo!", "AMAZON", "B0ABCDEFGH")], "t string, s string, c string")
    assert row.select(text.slug(F.col("t"), F.col("s"), F.col("c")).alias("r")).first().r == "audio-video-amazon-b0abcdefgh"
    assert one(spark, "see https://a.b/c). and http://d,e", url.links_in) == ["https://a.b/c", "http://d"]
    assert one(spark, "https://meli.la/https://meli.la/abc", lambda c: url.link_problem(c, ("meli.la",))) == "link within a link"


def test_attribute_lookup_and_key(spark):
    kind = "array<struct<key: string, value: string>>"
    assert one(spark, [("OCEANO", "1"), ("EAN", "7891234567890")], lambda a: attrs.lookup(a, ("EAN",)), kind) == "1"
    row = spark.createDataFrame([("Sony", None, None, "X-1", None)], "b string, g string, e string, m string, o string")
    assert row.select(attrs.canonical_key(*map(F.col, "bgemo")).alias("r")).first().r == "brand-model:SONY:X-1"
