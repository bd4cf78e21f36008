import pytest
from pyspark.sql import functions as F

from vitrine.llm import html
from vitrine.llm.html import extract

ARTICLE = "<article><h1>Title here</h1><p>" + "long words of the text go on " * 6 + "</p>{}<p>" + "and so they end at last " * 5 + "</p></article>"
BODY = " ".join(("Title here " + "long words of the text go on " * 6 + "and so they end at last " * 5).split())


@pytest.mark.parametrize(
    "extra",
    [
        '<article class="comment"><p>reader says</p></article>',
        '<ul><li class="comment">reader says</li></ul>',
        '<section class="replies"><p>reader says</p></section>',
        '<p class="advert">buy now</p>',
        '<span class="ad">buy now</span>',
        '<div class="cookie-message">we use cookies</div>',
        '<div class="share-this">share</div>',
        '<aside>more</aside>',
    ],
)
def test_comments_adverts_and_notices_go_from_any_element(extra):
    for page in (ARTICLE.format(extra), ARTICLE.format("") + extra):
        assert html.main_text(html.parse(page)) == BODY


def test_teasers_go_and_equal_articles_stay():
    teaser = "<article><h3>Other story</h3></article>"
    assert html.main_text(html.parse(ARTICLE.format("") + teaser)) == BODY
    assert html.main_text(html.parse(ARTICLE.format("") * 2)) == f"{BODY} {BODY}"


def test_names_that_only_look_like_furniture_stay():
    page = '<article><h1 class="page-header">Kept</h1><p class="commentary">also kept text</p><table><tr><td class="ad">cell</td></tr></table></article>'
    assert html.main_text(html.parse(page)) == "Kept also kept text cell"


@pytest.mark.parametrize("rows", [html.BROADCAST_ROWS, 0])
def test_headings_that_recur_stay_and_notices_go(spark, monkeypatch, rows):
    """Seventy pages of one host with other texts, a few headings and one long notice in common; marks by broadcast, and with salted pages."""
    monkeypatch.setattr(html, "BROADCAST_ROWS", rows)
    notice = "<p>This notice stands on each and every page</p>"
    own = [" ".join(f"w{(n * 17 + k * k) % 501}" for k in range(40)) for n in range(70)]
    pages = [(n, "https://host.example/x", f"<body><div>Menu of the site</div><article><h2>Part one</h2><p>{t}</p><p>Chapter {n % 3}</p><p>{t[::-1]}</p>{notice}</article></body>") for n, t in enumerate(own)]
    pages += [(100, None, None), (101, "https://alone.example/", f"<article><p>alone</p>{notice}</article>")]
    got = {r.page_id: r.main_text for r in extract(spark.createDataFrame(pages, "page_id int, url string, html string").repartition(3)).collect()}
    assert got == {n: f"Part one {t} Chapter {n % 3} {t[::-1]}" for n, t in enumerate(own)} | {100: "", 101: "alone This notice stands on each and every page"}


def test_columns_stay(spark):
    rows = spark.createDataFrame([(1, "https://a/", "<p>x</p>", "k", 5)], "page_id int, url string, html string, host string, marks int")
    got = extract(rows)
    assert got.columns == ["page_id", "url", "host", "marks", "main_text", "removed"] and got.select("main_text", "marks", F.col("removed.name")).first()[:2] == ("x", 5)
