"""Landed product pages: bot walls, JSON-LD and selector families, parsed in Arrow batches."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import money

# Marks of pages that ask for proof of a human reader: an element, a form's target, titles and phrases.
WALL_ID, WALL_FORM = "captchacharacters", "validateCaptcha"
WALL_TITLES = ("robot check", "verificação de robô")
WALL_PHRASES = ("digite os caracteres que você vê abaixo", "enter the characters you see below", "api-services-support@amazon.com")
#: Prices are texts, or numbers where JSON-LD has them as such, in the order of their places; an offer has its price, then its lowest.
AMOUNT = "struct<text: string, number: double>"
RECORD = f"url string, title string, prices array<string>, old_prices array<string>, offered array<struct<price: {AMOUNT}, low: {AMOUNT}>>, rating_text string, ld_rating {AMOUNT}, reviews_text string, ld_reviews string, currency string, image string, images array<string>, brand string, category string, description string, availability string, seller string, canonical string, shared_url string, code string, attributes array<struct<key: string, value: string>>"


def bot_wall(html: Column) -> Column:
    """Whether a page is a wall: its input element, its form, its title or a phrase of its text."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " ")))
    title = plain(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1))
    body = plain(F.regexp_replace(html, r"(?is)<head\b.*?</head\s*>", ""))
    out = html.rlike(rf"(?is)<[a-z][^>]*\sid\s*=\s*[\"']?{WALL_ID}(?![\w-])") | html.rlike(rf"(?s)<[fF][oO][rR][mM]\b[^>]*\s[aA][cC][tT][iI][oO][nN]\s*=\s*(\"[^\"]*|'[^']*|[^\s>\"']*){WALL_FORM}")
    for t in WALL_TITLES:
        out = out | F.contains(title, F.lit(t))
    for t in WALL_PHRASES:
        out = out | F.contains(body, F.lit(t))
    return out


# Places of the paid price and of the former one, first wins; (container, class around, class that must not be around).
PRICE_BOXES = ("corePrice_feature_div", "corePriceDisplay_desktop_feature_div", "apex_desktop")
PRICES = (*[(box, "a-price", "a-text-price") for box in PRICE_BOXES], ("tp_price_block_total_price_ww", None, None), (None, "priceToPay", None))
OLD_PRICES = (*[(box, "a-text-price", None) for box in PRICE_BOXES], (None, "basisPrice", None))
PRICE_IDS = ("price_inside_buybox", "priceblock_dealprice", "priceblock_ourprice", "kindle-price")
OLD_PRICE_IDS = ("priceblock_listprice", "listPrice")
# Places of the description, of what is said about stock, of the rating and of the number of reviews.
FEATURES, NO_FEATURE = "feature-bullets", "clique aqui para informações"
DESCRIPTIONS = ("productDescription", "aplus_feature_div", "bookDescription_feature_div")
AVAILABILITY = ("availability", "outOfStock", "availabilityInsideBuyBox_feature_div")
GONE = ("indisponível", "temporariamente sem estoque", "não disponível", "currently unavailable")
LEFT = r"(?:apenas|somente|restam)\s+(\d+)"
RATING_TITLE, RATING_TEXT, REVIEWS = "acrPopover", "averageCustomerReviews", "acrCustomerReviewText"
CRUMBS, BULLETS, CODE_HOLDERS = "wayfinding-breadcrumbs_container", "detailBullets_feature_div", ("dp-container", "ppd")
LONGEST_KEY, LONGEST_VALUE = 150, 1500
_VOID = ("meta", "link", "img", "br", "input", "hr")


class _Page(HTMLParser):
    """Collects title, meta and link values, JSON-LD blocks, table rows, bullets, breadcrumbs, pictures, prices and codes of a page."""

    def __init__(self):
        super().__init__()
        self.title, self.meta, self.scripts, self.rows, self.crumbs, self.marked = "", {}, [], [], [], {}
        self.pictures: dict[str, list[str]] = {"main": [], "block": [], "dynamic": [], "small": []}
        self.prices: list[tuple[int, str]] = []
        self.old_prices: list[tuple[int, str]] = []
        self.codes: dict[str, str] = {}
        self._open: list[tuple[str, str, str, frozenset]] = []
        self._cells: list[str] = []
        self._bullet: tuple[list[str], list[str]] | None = None
        self.features: list[str] = []
        self.rating_title = ""
        self._spans: dict[int, list[str]] = {}  # by depth: texts of the open spans of a feature

    def _within(self, id: str) -> bool:
        return any(o[2] == id for o in self._open)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        id, classes = a.get("id", ""), frozenset(a.get("class", "").split())
        if tag == "meta" and (name := a.get("property") or a.get("name")):
            self.meta.setdefault(name.lower(), a.get("content", ""))
        elif tag == "link" and a.get("rel") == "canonical":
            self.meta.setdefault("canonical", a.get("href", ""))
        elif tag == "img":
            self._picture(id, a)
        elif tag == "input" and (id == "ASIN" or a.get("name") in ("ASIN", "asin")):
            self.codes.setdefault("id" if id == "ASIN" else a["name"], a.get("value", ""))
        if "data-asin" in a and (id in CODE_HOLDERS or tag == "body"):
            self.codes.setdefault(id if id in CODE_HOLDERS else "body", a["data-asin"])
        if id == RATING_TITLE and not self.rating_title:
            self.rating_title = a.get("title", "")
        if tag == "span" and self._within(FEATURES) and any(o[0] == "li" for o in self._open):
            self._spans[len(self._open)] = []
        if tag == "tr":
            self._cells = []
        if tag == "li" and self._within(BULLETS):
            self._bullet = ([], [])
        if tag not in _VOID:
            ld = tag == "script" and a.get("type") == "application/ld+json"
            kind = "ld" if ld else "crumb" if id == CRUMBS else id or a.get("itemprop") or ("crumb" if "breadcrumb" in a.get("class", "") else "")
            self._open.append((tag, kind, id, classes))
            if ld:
                self.scripts.append("")

    def _picture(self, id: str, a: dict) -> None:
        place = {"landingImage": "main", "imgBlkFront": "block"}.get(id) or ("small" if self._within("altImages") else None)
        if place:
            self.pictures[place] += [a[k] for k in ("data-old-hires", "src") if a.get(k)]
        if id == "landingImage":
            try:
                told = json.loads(a.get("data-a-dynamic-image") or "{}")
            except ValueError:
                told = {}
            self.pictures["dynamic"] += list(told) if isinstance(told, dict) else []

    def handle_endtag(self, tag):
        if tag == "tr" and len(self._cells) > 1:
            self.rows.append((self._cells[0].strip(), self._cells[-1].strip()))
        if tag == "li" and self._bullet:
            key, whole = (" ".join("".join(part).split()) for part in self._bullet)
            if key:
                self.rows.append((key, whole[whole.find(key) + len(key) :].lstrip(": ")))
            self._bullet = None
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                for depth in sorted(d for d in self._spans if d >= k):
                    self.features.append(" ".join("".join(self._spans.pop(depth)).split()))
                del self._open[k:]
                break

    def handle_data(self, data):
        if not self._open:
            return
        tag, kind = self._open[-1][:2]
        for texts in self._spans.values():
            texts.append(data)
        if kind == "ld":
            self.scripts[-1] += data
        elif tag == "title":
            self.title += data
        elif tag in ("th", "td"):
            self._cells.append(data)
        if self._bullet is not None:
            self._bullet[1].append(data)
            if any("a-text-bold" in o[3] for o in self._open):
                self._bullet[0].append(data)
        self._price(data)
        linked = any(o[0] == "a" for o in self._open)
        for _, name, id, _ in self._open:
            if name == "crumb" and data.strip() and (linked or id != CRUMBS):
                self.crumbs.append(data.strip())
            elif name and name not in ("ld", "crumb"):
                self.marked[name] = self.marked.get(name, "") + data

    def _price(self, data: str) -> None:
        """Keep a text that names an amount with the rank of its place."""
        if not re.search("[1-9]", data):
            return
        ids, classes = {o[2] for o in self._open}, frozenset().union(*[o[3] for o in self._open])
        for found, places, last in ((self.prices, PRICES, PRICE_IDS), (self.old_prices, OLD_PRICES, OLD_PRICE_IDS)):
            hidden = [k for k, (box, around, never) in enumerate(places) if "a-offscreen" in classes and (box is None or box in ids) and (around is None or around in classes) and never not in classes]
            found += [(k, data.strip()) for k in hidden] + [(len(places) + k, data.strip()) for k, id in enumerate(last) if id in ids]


def seller_of(direct: str | None, told: str | None) -> str | None:
    """Name of the seller's own element, else who sells by the sentence about it."""
    if direct:
        return direct
    said = re.search(r"(?i)vendid[oa]\s+por\s+(.+?)(?:\s+e\s+enviad[oa]|\.$|$)", told or "")
    return said.group(1).strip() or None if said else None


def product_ld(value):
    """First object of type product in JSON-LD, through lists and @graph."""
    if isinstance(value, list):
        return next((p for v in value if (p := product_ld(v))), None)
    if not isinstance(value, dict):
        return None
    kinds = value.get("@type")
    if "product" in [str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])]:
        return value
    return product_ld(value.get("@graph"))


def _text(value):
    if isinstance(value, dict):
        value = value.get("name") or value.get("url")
    if isinstance(value, list):
        value = _text(value[0]) if value else None
    return None if value is None else str(value)


def _amount(value) -> dict:
    """A value of JSON-LD as text or number; neither for other kinds."""
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    return {"text": value if isinstance(value, str) else None, "number": float(value) if number else None}


def page_record(url: str, html: str) -> dict:
    page = _Page()
    page.feed(html or "")
    found = None
    for script in page.scripts:
        try:
            found = found or product_ld(json.loads(script))
        except ValueError:
            continue
    ld = found or {}
    told = ld.get("offers")
    offers = [o for o in (told if isinstance(told, list) else [told]) if isinstance(o, dict)]
    rated = ld.get("aggregateRating") if isinstance(ld.get("aggregateRating"), dict) else {}
    count = rated.get("reviewCount") if rated.get("reviewCount") is not None else rated.get("ratingCount")
    pictures = ld.get("image") or []
    pictures = [_text(i) for i in (pictures if isinstance(pictures, list) else [pictures])]
    images = [*page.pictures["main"], *page.pictures["block"], page.meta.get("og:image"), *page.pictures["dynamic"], *page.pictures["small"], *pictures]
    marked = lambda *names: next((" ".join(page.marked[n].split()) for n in names if page.marked.get(n, "").strip()), None)
    title = marked("productTitle") or _text(ld.get("name")) or re.sub(r"(?i)\s*[:|-]\s*Amazon\.com\.br.*$", "", " ".join(page.title.split())).strip() or None
    ordered = lambda ranked: [text for _, text in sorted(ranked, key=lambda p: p[0])]
    features = " • ".join(dict.fromkeys(x for x in page.features if x and NO_FEATURE not in x.lower()))
    written = ld.get("description")
    codes = [page.codes.get(k) for k in ("id", "ASIN", "asin")] + [_text(ld.get("sku"))] + [page.codes.get(k) for k in (*CODE_HOLDERS, "body")]
    cleaned = ((k.rstrip(": "), v[:LONGEST_VALUE]) for k, v in page.rows)
    attributes = {k: v for k, v in cleaned if k and v and len(k) <= LONGEST_KEY}
    return {
        "url": url,
        "title": title,
        "prices": ordered(page.prices),
        "old_prices": ordered(page.old_prices),
        "offered": [{"price": _amount(o.get("price")), "low": _amount(o.get("lowPrice"))} for o in offers],
        "rating_text": " ".join((page.rating_title or page.marked.get(RATING_TEXT, "")).split()) or None,
        "ld_rating": _amount(rated.get("ratingValue")),
        "reviews_text": marked(REVIEWS),
        "ld_reviews": str(count) if isinstance(count, (int, float, str)) and not isinstance(count, bool) else None,
        "currency": next((_text(o["priceCurrency"]) for o in offers if o.get("priceCurrency")), None),
        "image": next((i for i in images if i), None),
        "images": list(dict.fromkeys(i for i in images if i)),
        "brand": marked("bylineInfo") or _text(ld.get("brand")),
        "category": page.crumbs[-1] if page.crumbs else None,
        "description": features or marked(*DESCRIPTIONS) or (" ".join(written.split()) or None if isinstance(written, str) else None),
        "availability": marked(*AVAILABILITY),
        "seller": seller_of(marked("sellerProfileTriggerId"), marked("merchant-info")),
        "canonical": page.meta.get("canonical"),
        "shared_url": page.meta.get("og:url"),
        "code": next((c.strip().upper() for c in codes if c and re.fullmatch("[A-Za-z0-9]{10}", c.strip())), None),
        "attributes": [{"key": k, "value": v} for k, v in attributes.items()],
    }


def read_products(pages: DataFrame) -> DataFrame:
    """Product fields of every page (url, html) that isn't a bot wall."""

    def run(batches):
        for frame in batches:
            yield pd.DataFrame([page_record(u, h) for u, h in zip(frame["url"], frame["html"], strict=True)], columns=names)

    names = list(page_record("", ""))
    return pages.where(~F.coalesce(bot_wall(F.col("html")), F.lit(False))).select("url", "html").mapInPandas(run, RECORD)


def _number(amount: Column) -> Column:
    return F.coalesce(amount["number"], money.parse_number(amount["text"]))


def first_price(texts: Column, offered: Column | None = None) -> Column:
    """The first number above 0 of the texts, else of the offers: an offer's price, or its lowest where it has none."""
    read = F.get(F.filter(F.transform(texts, money.parse_number), lambda p: p > 0), F.lit(0))
    if offered is None:
        return read
    told = F.transform(offered, lambda o: F.coalesce(_number(o["price"]), _number(o["low"])))
    return F.coalesce(read, F.get(F.filter(told, lambda p: p > 0), F.lit(0)))


def rating(text: Column, told: Column) -> Column:
    """The first number of the text, as numbers are written in shops, else the told one; null unless from 0 to 5."""
    found = F.nullif(F.regexp_extract(F.regexp_replace(text, "^([^,]*),", "$1."), r"\d+(?:\.\d+)?", 0), F.lit(""))
    value = F.coalesce(money.parse_number(found), _number(told))
    return F.when(value.between(0, 5), value)


def stock(availability: Column) -> Column:
    """0 for what is said to be gone, the number said to be left, else null."""
    low = F.lower(availability)
    gone = F.lit(False)
    for phrase in GONE:
        gone = gone | F.contains(low, F.lit(phrase))
    return F.when(gone, 0).otherwise(F.nullif(F.regexp_extract(low, LEFT, 1), F.lit("")).cast("int"))
