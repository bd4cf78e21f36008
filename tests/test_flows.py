"""Edges of the flows whose whole results the queries compare with SQL."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vitrine.functions import jsons
from vitrine.operators import detail, discovery, favorites, publish, workflow
from vitrine.operators.nested import MISSING, NO_RELATED, Plan, ToMany, ToOne, nested_write
from vitrine.operators.where import where
from vitrine.sources import landed, redirects

NOW = datetime(2030, 1, 1)
ACCOUNT = "user_id long, product_id string, created_at timestamp_ntz"


def test_chains_of_any_length_end_and_loops_are_named(spark):
    hops = [(f"a{i}", f"a{i + 1}") for i in range(37)] + [("x", "y"), ("y", "z"), ("z", "x"), ("in", "x"), ("self", "self"), (None, "q"), ("two", "b"), ("two", "a37")]
    known = spark.createDataFrame(hops, "url string, final_url string")
    links = spark.createDataFrame([(u,) for u in ("a0", "a30", "x", "in", "self", "two", "other", None)], "url string")
    got = {r.url: (r.destination, r.hops, r.redirect_error) for r in redirects.follow(links, known, most=36).collect()}
    assert got["a30"] == ("a37", 7, None) and got["self"] == ("self", 0, None) and got["two"] == ("a37", 1, None) and got["other"] == ("other", 0, None) and got[None] == (None, 0, None)
    assert got["a0"][2] == redirects.FAR and {got["x"][2], got["in"][2]} == {redirects.LOOP}
    assert redirects.ends(known.limit(0)).collect() == []
    ok = landed.destinations(links, spark.createDataFrame([("a0", "https://x.meli.la/1"), ("x", "https://bad.example/")], "url string, final_url string"), ("meli.la",))
    assert {r.url: r.destination_ok for r in ok.collect()} == {"a0": True, "x": False, **dict.fromkeys(("a30", "in", "self", "two", "other", None), True)}


def test_syncing_again_changes_nothing(spark):
    account = spark.createDataFrame([(1, "p1", datetime(2020, 1, 1)), (1, "p2", datetime(2021, 1, 1)), (3, "p9", NOW)], ACCOUNT)
    local = spark.createDataFrame([(1, ["p7", " p1", "", "p5", "gone", "p7"]), (2, []), (4, None)], "user_id long, ids array<string>")
    removed = spark.createDataFrame([(1, "gone", NOW)], "user_id long, product_id string, removed_at timestamp_ntz")
    now = F.lit(NOW).cast("timestamp_ntz")
    after, lists = favorites.sync(account, local, now, removed)
    assert {r.user_id: r.ids for r in lists.collect()} == {1: ["p7", "p5", "p2", "p1"], 2: [], 4: []}
    again, same = favorites.sync(after, lists, F.lit(datetime(2031, 1, 1)).cast("timestamp_ntz"), removed)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, after.collect())) and {r.user_id: r.ids for r in same.collect()} == {1: ["p7", "p5", "p2", "p1"], 2: [], 4: []}
    shown = favorites.favorite_products(lists, spark.createDataFrame([("p1", "a"), ("p5", "b")], "id string, name string"), most=3)
    assert [(r.position, r.id) for r in shown.collect()] == [(1, "p5")]


def test_a_failing_item_leaves_the_others(spark):
    items = spark.createDataFrame([(1, 1, "a", "https://meli.la/1"), (1, 2, "b", "https://meli.la/2"), (1, 3, "c", "https://meli.la/3"), (2, 1, "d", "https://meli.la/https://meli.la/4"), (2, 2, "e", "https://meli.la/5")], "batch int, position int, id string, link string")
    opportunities = spark.createDataFrame([(i, s, f"u{i}", None, p, "old", None, None) for i, s, p in (("a", "PUBLISHED", None), ("b", "ERROR", None), ("c", "READY_TO_QUEUE", None), ("d", "READY_TO_QUEUE", None), ("e", "READY_TO_QUEUE", None))], "id string, status string, source_url string, affiliate_link string, product_id string, error_message string, queued_at timestamp_ntz, published_at timestamp_ntz")
    queue = spark.createDataFrame([("q", "uc", "MERCADO_LIVRE", None, None, "SUCCESS", "old", "p", NOW)], "id string, url string, marketplace string, affiliate_link string, opportunity_id string, status string, error_message string, product_id string, processed_at timestamp_ntz")
    products = spark.createDataFrame([("p", None, False, 3.0, None, None, 2)], "id string, affiliate_link string, active boolean, price double, old_price double, installments string, stock int")
    offers = spark.createDataFrame([], "id string, product_id string, marketplace string, affiliate_link string, active boolean, price double, old_price double, installments string, stock int")
    got = publish.publish(items, opportunities, queue, products, offers, F.lit(NOW).cast("timestamp_ntz"))
    assert {r.id: (r.success, r.status, r.queue_id) for r in got["results"].collect()} == {"a": (False, None, None), "b": (True, "PENDING", "queue:b"), "c": (True, "PUBLISHED", "q"), "d": (False, None, None), "e": (False, None, None)}
    assert {r.id: (r.status, r.affiliate_link) for r in got["opportunities"].collect()} == {"a": ("PUBLISHED", None), "b": ("QUEUED", "https://meli.la/2"), "c": ("PUBLISHED", "https://meli.la/3"), "d": ("READY_TO_QUEUE", None), "e": ("READY_TO_QUEUE", None)}
    assert [(r.product_id, r.affiliate_link, r.price, r.active) for r in got["offers"].collect()] == [("p", "https://meli.la/3", 3.0, True)]
    assert sorted((r.id, r.status, r.opportunity_id) for r in got["queue"].collect()) == [("q", "SUCCESS", "c"), ("queue:b", "PENDING", "b")]
    assert got["products"].first().affiliate_link == "https://meli.la/3"


def test_discovery_of_nothing(spark):
    highlights = spark.createDataFrame([("c", 1, "x", "ITEM")], "category_id string, position int, external_id string, type string")
    offers = spark.createDataFrame([], "external_id string, place int, item_id string, price double, original_price double, status string, permalink string, image string")
    details = spark.createDataFrame([], "external_id string, title string, image string")
    none = spark.createDataFrame([], "id string, name string")
    added, tally = discovery.discover(highlights, offers, details, none, details.select("external_id"), 99)
    assert added.collect() == [] and [tuple(r) for r in tally.collect()] == [("c", "c", 10, 0, 0, 0, 0)]


def test_nested_write_is_whole_or_not_at_all_and_repeatable(spark):
    plan = Plan("post", "slug", ("title",), one=(ToOne("author", "author", "name", "author_id", connect=True),), many=(ToMany("notes", "note", ("n",), "post_id", upsert=True),))
    schema = "request_id int, action string, slug string, title string, author struct<name:string>, notes array<struct<n:int,text:string>>"
    rows = [(1, "create", "a", "t1", ("ann",), [(1, "x"), (1, "y"), (None, "z")]), (2, "update", "missing", "t", None, [(5, "lost")]), (3, "create", "b", "t", ("bob",), [(6, "lost")]), (4, "update", "a", "t2", None, None)]
    tables = {"post": spark.createDataFrame([], "id string, slug string, title string, author_id string"), "author": spark.createDataFrame([("A", "ann")], "id string, name string"), "note": spark.createDataFrame([], "id string, post_id string, n int, text string")}
    got = nested_write(spark.createDataFrame(rows, schema), tables, plan)
    post = got["post"].first()
    assert (post.slug, post.title, post.author_id) == ("a", "t2", "A") and got["post"].count() == 1
    assert [(r.post_id, r.n, r.text) for r in got["note"].collect()] == [(post.id, 1, "y")]
    assert {r.request_id: r.error for r in got["refused"].collect()} == {2: MISSING, 3: NO_RELATED}
    rest = spark.createDataFrame([(1, "upsert", *rows[0][2:]), rows[3]], schema)
    again = nested_write(rest, {k: v for k, v in got.items() if k != "refused"}, plan)
    for name in tables:
        assert sorted(map(tuple, again[name].collect())) == sorted(map(tuple, got[name].collect()))


@pytest.mark.parametrize(
    "test, found",
    [
        ({"path": ["a"], "array_contains": [1]}, [1]),
        ({"path": ["a"], "array_ends_with": {"k": [True], "j": None}}, [1]),
        ({"path": ["a", 0], "equals": 1.0}, [1]),
        ({"path": ["a b"], "string_starts_with": "X", "mode": "insensitive"}, [2]),
        ({"path": ["n"], "gt": 4}, [2]),
        ({"path": ["n"], "not": 5}, [3]),
        ({"path": ["n"], "equals": None}, [3]),
        ({"path": ["it's"], "lt": "b"}, [3]),
    ],
)
def test_json_filters(spark, test, found):
    rows = [(1, '{"a": [1, {"j": null, "k": [true]}]}'), (2, '{"a b": "xyz", "n": 5.0}'), (3, '{"n": null, "it\'s": "a"}'), (4, "not json"), (5, None)]
    df = spark.createDataFrame(rows, "id int, doc string")
    assert [r.id for r in df.where(where({"doc": test})).collect()] == found


def test_bodies_that_are_not_json_are_kept(spark):
    df = spark.createDataFrame([("{ \"b\": 1, \"a\": 2.50 }",), ("<p>",), ("null",), (None,)], "t string")
    assert [tuple(r.b) for r in df.select(jsons.body(F.col("t")).alias("b")).collect()] == [(True, '{"a":2.5,"b":1}'), (False, "<p>"), (True, "null"), (False, None)]


def test_long_messages_are_cut_before_they_meet_the_queue(spark):
    rows = spark.range(20).select("id", F.lit("PROCESSING").alias("status"), F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("product_id"))
    done = workflow.finish(rows, rows.select("id", "product_id", F.repeat(F.lit("x"), 3000).alias("error")))
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert {(r.status, len(r.error_message)) for r in done.collect()} == {("ERROR", 2000)}


def test_loops_are_told_in_few_rounds_and_by_shuffle(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(redirects, "save", lambda df, tag, kept=redirects.save: rounds.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, tag))
    hops = [(f"x{i}", f"x{(i + 1) % 3}") for i in range(3)] + [(f"t{i}", f"t{i + 1}" if i < 4 else "x0") for i in range(5)] + [(f"s{i}", f"e{i}") for i in range(2000)]
    got = {r.url: (r.end, r.hops) for r in redirects.ends(spark.createDataFrame(hops, "url string, final_url string")).collect()}
    assert {got[u] for u in ("x0", "x1", "x2", "t0", "t4")} == {(None, 2009)} and got["s7"] == ("e7", 1) and len(got) == 2008
    assert len(rounds) <= 7 and not any("Broadcast" in p for p in rounds)


def test_links_are_taken_apart_once_and_joined_by_shuffle(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(publish, "save", lambda df, tag, kept=publish.save: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df, tag))
    items = spark.createDataFrame([(1, 1, "a", "https://meli.la/old-b"), (1, 2, "b", " "), (2, 1, "c", "https://meli.la/old-b"), (2, 2, "d", "https://meli.la/d")], "batch int, position int, id string, link string")
    opportunities = spark.createDataFrame([(i, "READY_TO_QUEUE", f"u{i}", f"https://meli.la/old-{i}", None, None, None, None) for i in "abcd"], "id string, status string, source_url string, affiliate_link string, product_id string, error_message string, queued_at timestamp_ntz, published_at timestamp_ntz")
    queue = spark.createDataFrame([], "id string, url string, marketplace string, affiliate_link string, opportunity_id string, status string, error_message string, product_id string, processed_at timestamp_ntz")
    products = spark.createDataFrame([], "id string, affiliate_link string, active boolean, price double, old_price double, installments string, stock int")
    offers = spark.createDataFrame([], "id string, product_id string, marketplace string, affiliate_link string, active boolean, price double, old_price double, installments string, stock int")
    got = publish.publish(items, opportunities, queue, products, offers, F.lit(NOW).cast("timestamp_ntz"))
    # b is of a's batch, though its own link is blank, so a's link isn't another's; c's is.
    assert {r.id: r.error for r in got["results"].collect()} == {"a": "batch refused", "b": "blank", "c": "link of another opportunity", "d": "batch refused"}
    plans += [got[name]._jdf.queryExecution().executedPlan().toString() for name in ("results", "opportunities", "queue", "products", "offers")]
    assert sum("decode(" in p for p in plans) == 1 and not any("Broadcast" in p for p in plans)


def test_offers_meet_their_own_history_only(spark):
    rows = [("p", 2, 5.0), ("p", 1, 5.0), ("p", 1, 3.0), ("p", None, 9.0), ("q", 1, 4.0)]
    offers = spark.createDataFrame(rows, "product_id string, id long, price double").withColumns({"marketplace": F.lit("AMAZON"), "affiliate_link": F.lit("l"), "status": F.lit("ACTIVE"), "available": F.lit(True)})
    history = spark.createDataFrame([("p", 1, 9, 1.0), ("p", 1, 8, 2.0), ("p", 1, 8, 1.0), ("p", None, 1, 1.0), ("p", 7, 1, 1.0), ("r", 1, 1, 1.0)], "product_id string, offer_id long, recorded_at int, price double")
    nested = detail.nested_offers(offers, history)
    past = [(8, 1.0), (8, 2.0), (9, 1.0)]
    got = {r.product_id: [(o.id, o.price, [tuple(h) for h in o.history]) for o in r.offers] for r in nested.collect()}
    assert got == {"p": [(1, 3.0, past), (1, 5.0, past), (2, 5.0, []), (None, 9.0, [])], "q": [(1, 4.0, [])], "r": []}
    plan = nested._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(" not in plan and plan.count("RepartitionByExpression") == 1


def test_similar_products_are_put_together_once_for_a_category_and_brand(spark):
    rows = [(i, ["c1", "c2", None][i % 3], ["b1", " ", None, "b2"][i % 4], i % 5 == 0, i * 7 % 11, i % 6 > 0) for i in range(40)] + [(90, "alone", "b9", True, 99, True), (91, "alone", None, False, 0, False)]
    products = spark.createDataFrame(rows, "id int, category string, brand string, featured boolean, updated_at int, shown boolean")
    found = detail.similar(products, 4)
    got = {r.id: (r.similar, r.n_direct) for r in found.collect()}
    for i, c, b, *_ in rows:
        b = (b or "").strip()
        near = lambda r: (c is not None and r[1] == c) or (b != "" and r[2] == b)
        order = sorted((r for r in rows if r[5] and r[0] != i), key=lambda r: (not near(r), not r[3], -r[4], r[0]))
        assert got[i] == ([r[0] for r in order[:4]], min(4, sum(map(near, order)))), i
    assert len(got) == len(rows) and "array_sort(" not in found._jdf.queryExecution().optimizedPlan().toString()
