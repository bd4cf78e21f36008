"""The save flow against records saved one after another in plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrine.operators import save as flow
from vitrine.operators import components as component_module
from vitrine.operators import identity
from vitrine.operators import offers as offers_rules
from vitrine.operators.components import components
from vitrine.operators.ordered import with_previous

ML, NOW = "MERCADO_LIVRE", datetime(2030, 1, 1)
LABELS = {ML: "Mercado Livre", "AMAZON": "Amazon", "SHOPEE": "Shopee"}
TOL = 0.009
RECORD = "seq long, marketplace string, external_id string, url string, title string, price double, old_price double, discount double, stock int, affiliate_link string, gtin string, target_product_id string, category string, brand string, description string, image string, images array<string>, auto_created boolean, discovery_source string, source_query string"
PRODUCT = "id string, name string, ml_id string, canonical_key string, category string, brand string, description string, auto_created boolean, price double, store string, publication_status string, images array<string>, extra int"
OFFER = "id string, product_id string, marketplace string, external_id string, price double, affiliate_link string, status string, active boolean, available boolean, review_reason string"


def pct(old, price):
    return None if old is None or not old > price else int((old - price) / old * 100 + 0.5)


def one_by_one(records, products, offers, history):
    """The rules, a record at a time."""
    products = {p["id"]: dict(p) for p in products}
    offers = {(o["product_id"], o["marketplace"]): dict(o) for o in offers}
    last = {}
    for h in sorted(history, key=lambda h: h[2]):
        last[h[0]] = h[1]
    added, refused = [], []
    for r in sorted(records, key=lambda r: r["seq"]):
        key = f"gtin:{r['gtin']}" if r["gtin"] else None
        m, x = r["marketplace"], r["external_id"]
        link = (r["affiliate_link"] or "").strip() or None
        by_code = next((o for o in offers.values() if (o["marketplace"], o["external_id"]) == (m, x)), None)
        owner = next((p for p in products.values() if key and p["canonical_key"] == key), None)
        saved = products[by_code["product_id"]] if by_code else None
        if saved is None and m == ML:
            saved = next((p for p in products.values() if p["ml_id"] == x), None)
        if saved is None and r["target_product_id"]:
            saved = products.get(r["target_product_id"])
        saved = saved or owner
        if saved is None:
            id = f"new:{m}:{x}:{r['seq']}"
            saved = products[id] = {"id": id, "name": r["title"], "ml_id": x if m == ML else None, "canonical_key": key, "category": r["category"] or "Ofertas", "brand": r["brand"], "description": r["description"], "auto_created": bool(r["auto_created"]), "gtin": r["gtin"], "images": union([], r), "source_query": (r["source_query"] or "").strip() or None, "searched": r["discovery_source"] == "ON_DEMAND_SEARCH", "extra": None}
        else:
            if m == ML and any(p["ml_id"] == x and p is not saved for p in products.values()):
                refused.append(r["seq"])
                continue
            main = (by_code is not None) or (m == ML and saved["ml_id"] == x) or saved["auto_created"]
            if m == ML:
                saved["ml_id"] = x
            if key and (owner is None or owner is saved):
                saved["canonical_key"] = key
            if main:
                saved["name"], saved["description"] = r["title"], r["description"]
            elif saved["description"] is None:
                saved["description"] = r["description"]
            saved["brand"] = saved["brand"] if saved["brand"] is not None else r["brand"]
            saved["gtin"] = saved.get("gtin") or r["gtin"]
            if saved["category"] == "Ofertas":
                saved["category"] = r["category"] or saved["category"]
            saved["images"] = union(saved["images"] or [], r)
            saved["source_query"] = (r["source_query"] or "").strip() or saved.get("source_query")
            saved["searched"] = saved.get("searched", False) or r["discovery_source"] == "ON_DEMAND_SEARCH"
            saved["auto_created"] = saved["auto_created"] or bool(r["auto_created"])
        k = (saved["id"], m)
        now = offers.get(k)
        link = link or ((now and (now["affiliate_link"] or "").strip()) or None)
        there = r["stock"] is None or r["stock"] > 0
        status = "UNAVAILABLE" if not there else "ACTIVE" if link else "UNDER_REVIEW" if now and now["status"] == "UNDER_REVIEW" else "PENDING_AFFILIATE"
        offers[k] = {"id": now["id"] if now else ":".join(k), "product_id": saved["id"], "marketplace": m, "external_id": x, "price": r["price"], "old_price": r["old_price"], "stock": r["stock"], "affiliate_link": link, "status": status, "active": True, "available": there, "match_status": "EXACT" if by_code or owner is saved else "HIGH", "review_reason": None if link else (now and now["review_reason"]) or flow.REASON, "changed": not now or abs(now["price"] - r["price"]) > TOL or now.get("changed", False)}
        offer = offers[k]
        if offer["id"] not in last or abs(last[offer["id"]] - r["price"]) > TOL:
            last[offer["id"]] = r["price"]
            added.append((offer["id"], r["seq"], r["price"]))
        mine = sorted((o for o in offers.values() if o["product_id"] == saved["id"] and o["active"]), key=lambda o: (o["price"], o["id"]))
        best = next((o for o in mine if o["available"] and o["status"] not in ("UNAVAILABLE", "ERROR")), mine[0])
        saved |= {"store": LABELS[best["marketplace"]], "affiliate_link": (best["affiliate_link"] or "").strip(), "price": best["price"], "old_price": best.get("old_price"), "stock": best.get("stock"), "best": best["id"]}
        declared = round(r["discount"]) if r["discount"] and 0 < r["discount"] < 100 else None
        known = pct(r["old_price"], r["price"])
        saved["discount"] = (known if known is not None else declared) if best is offer else pct(best.get("old_price"), best["price"])
        waiting = any(o["status"] in ("DISCOVERED", "PENDING_AFFILIATE", "UNDER_REVIEW") for o in mine)
        linked = any(o["status"] == "ACTIVE" and (o["affiliate_link"] or "").strip() for o in mine)
        saved["publication_status"] = "LIVE_PARTIAL" if waiting or not linked else "LIVE_COMPLETE"
    return products, offers, added, refused


def union(have, r):
    return list(dict.fromkeys(x.strip() for x in [*have, *(r["images"] or []), r["image"] or ""] if x.strip()))


def frame(spark, rows, schema):
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], schema)


def run(spark, records, products, offers, history):
    stored = spark.createDataFrame(history, "offer_id string, price double, recorded_at timestamp_ntz")
    return flow.save_products(frame(spark, records, RECORD), frame(spark, products, PRODUCT), frame(spark, offers, OFFER), stored, F.lit(NOW).cast("timestamp_ntz"))


def record(seq, market, code, **more):
    return {"seq": seq, "marketplace": market, "external_id": code, "url": "http://x", "title": f"t{seq}", "price": 5.0, "auto_created": False} | more


def scene(seed, groups=40):
    r = random.Random(seed)
    records, products, offers, history, seq = [], [], [], [], 0
    for g in range(groups):
        keys = [f"{g:04d}{k:04d}" for k in range(r.choice([1, 1, 2, 3]))]
        codes = [f"{g}-{k}" for k in range(r.choice([1, 2, 4]))]
        mine = [f"p{g}.{k}" for k in range(r.choice([0, 1, 2, 3]))]
        for n, p in enumerate(mine):
            products.append({"id": p, "name": "old", "ml_id": f"{g}-{n}" if r.random() < 0.4 else None, "canonical_key": f"gtin:{keys[n]}" if n < len(keys) and r.random() < 0.6 else None, "category": r.choice(["Ofertas", "TV"]), "brand": r.choice([None, "B"]), "description": r.choice([None, "d"]), "auto_created": r.random() < 0.2, "price": 1.0, "store": "Loja", "publication_status": "LIVE_COMPLETE", "images": r.choice([None, [" a ", "b"]]), "extra": n})
            for m in LABELS:
                if r.random() < 0.5:
                    used = {o["external_id"] for o in offers if o["marketplace"] == m}
                    code = r.choice([c for c in [*codes, f"z{p}"] if c not in used])
                    offers.append({"id": f"o{p}{m}", "product_id": p, "marketplace": m, "external_id": code, "price": r.choice([1.0, 2.0, 9.0]), "affiliate_link": r.choice([None, " ", "http://l"]), "status": r.choice(["ACTIVE", "UNDER_REVIEW", "ERROR", "PENDING_AFFILIATE"]), "active": r.random() < 0.9, "available": r.random() < 0.8, "review_reason": r.choice([None, "why"])})
                    if r.random() < 0.7:
                        history += [(f"o{p}{m}", 4.0, datetime(2020, 1, 1)), (f"o{p}{m}", offers[-1]["price"], datetime(2020, 1, 2))]
        for _ in range(r.randrange(1, 9)):
            seq += r.randrange(1, 3)
            price = r.choice([1.0, 2.0, 2.005, 2.012, 7.0])
            records.append(record(seq, r.choice([ML, ML, "AMAZON", "SHOPEE"]), r.choice(codes), price=price, old_price=r.choice([None, 4.0]), discount=r.choice([None, 12.0, 120.0]), stock=r.choice([None, 0, 5]), affiliate_link=r.choice([None, "", " http://n "]), gtin=r.choice([None, *keys]), target_product_id=r.choice([None, None, "none", *mine]), category=r.choice([None, "Ofertas", "Som"]), brand=r.choice([None, "X"]), description=r.choice([None, f"d{seq}"]), image=r.choice([None, "i", "b"]), images=r.choice([None, ["c", " "], ["b", "e"]]), auto_created=r.random() < 0.15, discovery_source=r.choice([None, "ON_DEMAND_SEARCH"]), source_query=r.choice([None, " ", f"q{seq}"])))
    r.shuffle(records)
    return records, products, offers, history


@pytest.mark.parametrize("seed", [1, 2])
def test_batches_equal_one_by_one(spark, seed):
    given = scene(seed)
    products, offers, added, refused = one_by_one(*given)
    got = run(spark, *given)
    assert sorted((r.offer_id, r.seq, r.price) for r in got["history"].collect()) == sorted(added)
    assert sorted(r.seq for r in got["refused"].collect()) == sorted(refused)
    rows = got["offers"].collect()
    assert {(r.product_id, r.marketplace) for r in rows} == set(offers) and len(rows) == len(offers)
    best = {p["best"] for p in products.values() if "best" in p}
    for r in rows:
        want = offers[r.product_id, r.marketplace]
        for c in ("id", "external_id", "price", "affiliate_link", "status", "active", "available", "review_reason"):
            assert getattr(r, c) == want[c], (c, r)
        if "match_status" in want:
            assert r.match_status == want["match_status"], r
            assert (r.price_changed_at == NOW) == want["changed"], r
        if "best" in products[r.product_id]:
            assert r.is_best == (r.id in best)
    rows = got["products"].collect()
    assert {r.id for r in rows} == set(products) and len(rows) == len(products)
    for r in rows:
        want = products[r.id]
        for c in ("name", "ml_id", "canonical_key", "category", "brand", "description", "auto_created", "price", "store", "publication_status", "extra"):
            assert getattr(r, c) == want[c], (c, r, want)
        if "best" in want:
            for c in ("affiliate_link", "old_price", "stock", "discount", "source_query", "gtin", "images"):
                assert getattr(r, c) == want.get(c), (c, r, want)
            assert (r.last_searched_at == NOW) == want["searched"]
    for c in ("canonical_key", "ml_id"):
        held = [getattr(r, c) for r in rows if getattr(r, c) is not None]
        assert len(held) == len(set(held))


def test_one_key_has_one_owner(spark):
    products = [{"id": p, "name": p, "category": "TV", "auto_created": False, "price": 1.0, "store": "Loja"} for p in ("p1", "p2")]
    offers = [{"id": f"o{p}", "product_id": p, "marketplace": "AMAZON", "external_id": c, "price": 1.0, "status": "ACTIVE", "active": True, "available": True} for p, c in (("p1", "A"), ("p2", "B"))]
    records = [record(n, "AMAZON" if c != "C" else "SHOPEE", c, gtin="12345678", price=2.0) for n, c in enumerate("ABC")]
    got = run(spark, records, products, offers, [])
    assert {r.id: (r.canonical_key, r.price) for r in got["products"].collect()} == {"p1": ("gtin:12345678", 2.0), "p2": (None, 2.0)}
    assert {(r.product_id, r.marketplace) for r in got["offers"].collect()} == {("p1", "AMAZON"), ("p2", "AMAZON"), ("p1", "SHOPEE")}


def test_empty_batch_and_empty_catalog(spark):
    products, offers = scene(3)[1:3]
    same = run(spark, [], products, offers, [])
    assert same["products"].count() == len(products) and same["offers"].count() == len(offers) and same["history"].isEmpty()
    fresh = run(spark, [record(1, ML, "a"), record(2, ML, "a", price=9.0), record(3, ML, " ", gtin="12345678")], [], [], [])
    assert [(r.price, r.ml_id) for r in fresh["products"].collect()] == [(9.0, "a")] and [r.error for r in fresh["refused"].collect()] == ["no external id"]


def test_components_and_previous_rows(spark):
    r = random.Random(1)
    pairs = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("x", "y"), ("y", None), ("hub", "x")] + [("hub2", f"s{i}") for i in range(50)]
    r.shuffle(pairs)
    got = {x.node: x.component for x in components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(71)} == {"n000"} and got["y"] == got["x"] == got["hub"] == "hub" and {got[f"s{i}"] for i in range(50)} == {"hub2"}
    rows = [(None if k == 9 else k, n, n * 10) for k, m in ((1, 300), (2, 1), (9, 40)) for n in range(m)]
    shuffled = r.sample(rows, len(rows))
    back = with_previous(spark.createDataFrame(shuffled, "k int, n int, v int"), ["k"], ["n"], ["v"]).collect()
    assert len(back) == len(rows) and all((x.previous.v if x.previous else None) == (x.v - 10 if x.n else None) for x in back)


def test_facts_meet_records_however_tasks_are_merged(spark):
    """Facts and records that joins have dealt by component already: their tasks are merged by size, few of facts, many of records."""
    settings = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1b", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        each = spark.range(300).select(F.concat(F.lit("c"), "id").alias("component"))
        facts = spark.range(300).select(F.concat(F.lit("c"), "id").alias("component"), F.lit("offer").alias("kind"), F.concat(F.lit("p"), "id").alias("product_id"), F.lit("AMAZON").alias("marketplace"), F.concat(F.lit("x"), "id").alias("value"))
        records = spark.range(9000).select(F.concat(F.lit("c"), F.col("id") % 300).alias("component"), F.col("id").alias("seq"), F.lit("AMAZON").alias("marketplace"), F.concat(F.lit("x"), F.col("id") % 300).alias("external_id"), F.lit(None).cast("string").alias("canonical_key"), F.lit(None).cast("string").alias("_target"))
        got = identity._follow(records.join(each.hint("merge"), "component"), facts.join(each.hint("merge"), "component", "left_semi")).collect()
        assert len(got) == 9000 and all(r.product_id == f"p{r.seq % 300}" and not r.is_new for r in got)
        rows = records.select("component", "seq", F.lit(5.0).alias("price")).join(each.hint("merge"), "component")
        stored = facts.select("component", F.lit(-1).cast("long").alias("seq"), F.lit(5.0).alias("price")).join(each.hint("merge"), "component", "left_semi")
        assert {r.seq for r in offers_rules.price_log(stored.unionByName(rows), ["component"], "seq", "price").collect()} == {-1}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_refused_records_take_no_snapshots_and_labels_no_broadcast(spark, monkeypatch):
    given, tags, plans = scene(2), [], []
    monkeypatch.setattr(flow, "save", lambda df, tag, kept=flow.save: tags.append(tag) or kept(df, tag))
    monkeypatch.setattr(component_module, "save", lambda df, tag, kept=component_module.save: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, tag))
    got = flow.refused_records(frame(spark, given[0], RECORD), frame(spark, given[1], PRODUCT), frame(spark, given[2], OFFER))
    assert sorted(r.seq for r in got.collect()) == sorted(one_by_one(*given)[3])
    assert tags == ["checked", "assigned"] and plans and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("seed", [1, 2])
def test_large_components_equal_one_by_one(spark, monkeypatch, seed):
    """Components of more rows than LARGE are told by aggregates where they are plain."""
    monkeypatch.setattr(identity, "LARGE", 2)
    test_batches_equal_one_by_one(spark, seed)


def _tables(monkeypatch, module) -> list:
    kept = []

    def save(df, tag, real=module.save):
        kept.append((tag, out := real(df, tag)))
        return out

    monkeypatch.setattr(module, "save", save)
    return kept


def test_components_are_sought_among_keys_and_products(spark, monkeypatch):
    """A code is no node: of 500 records of one key with a code each nothing is left to connect but the key and its product."""
    kept = _tables(monkeypatch, component_module)
    records = [record(n, "AMAZON", f"c{n}", gtin="12345678", target_product_id=None) for n in range(500)]
    products = [{"id": "p", "name": "p", "canonical_key": "gtin:12345678", "category": "TV"}]
    got = flow.refused_records(frame(spark, records, RECORD), frame(spark, products, PRODUCT), frame(spark, [], OFFER))
    assert got.isEmpty() and [rows.count() for tag, rows in kept if tag == "edges"] == [2]


def test_offers_and_history_take_no_other_snapshots(spark, monkeypatch):
    given = scene(2)
    _, offers, added, _ = one_by_one(*given)
    frames = frame(spark, given[0], RECORD), frame(spark, given[1], PRODUCT), frame(spark, given[2], OFFER)
    kept = _tables(monkeypatch, flow)
    got = flow.offers_after(*frames, F.lit(NOW).cast("timestamp_ntz")).collect()
    assert {(r.product_id, r.marketplace): r.price for r in got} == {k: o["price"] for k, o in offers.items()}
    logged = flow.prices_logged(*frames, spark.createDataFrame(given[3], "offer_id string, price double, recorded_at timestamp_ntz"))
    assert sorted((r.offer_id, r.seq, r.price) for r in logged.collect()) == sorted(added)
    assert [tag for tag, _ in kept] == ["checked", "assigned"] * 2


def test_products_store_of_offers_what_they_take(spark, monkeypatch):
    given = scene(1)
    products = one_by_one(*given)[0]
    kept = _tables(monkeypatch, flow)
    got = flow.products_after(frame(spark, given[0], RECORD), frame(spark, given[1], PRODUCT), frame(spark, given[2], OFFER), F.lit(NOW).cast("timestamp_ntz")).collect()
    assert {(r.id, r.name, r.price, r.store, r.canonical_key) for r in got} == {(p["id"], p["name"], p["price"], p["store"], p["canonical_key"]) for p in products.values()}
    (stored,) = [rows for tag, rows in kept if tag == "offers"]
    assert not {"title", "url", "image", "seller", "external_id"} & set(stored.columns)


def test_few_rows_of_a_hot_product_are_fetched(spark):
    """Of 3000 records of a product those are fetched that it takes something from."""
    said = spark.range(3000).select(F.lit("p").alias("product_id"), "id")
    picked = said.groupBy("product_id").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.max(F.when(F.col("id") < 7, F.col("id"))).alias("c"), F.max("id").alias("d"))
    rows = flow._fetched(picked, ["product_id"], ["a", "b", "c", "d"], spark.range(3000).select(F.col("id").alias("seq"), F.lit("t").alias("title")), ["title"])
    assert sorted(r.seq for r in rows.collect()) == [0, 6, 2999]


def test_arrow_columns_are_listed_unchanged():
    import pyarrow as pa

    from vitrine.operators.ordered import listed

    for values, kind in (([1, None, 2**62 + 1], pa.int64()), ([2**62 + 1, 3], pa.int64()), (["a", None], pa.string()), ([True, None], pa.bool_()), ([1.5, None], pa.float64()), ([datetime(2020, 1, 1), None], pa.timestamp("us"))):
        assert listed(pa.array(values, kind)) == values
