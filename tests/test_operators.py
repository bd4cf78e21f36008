from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from vitrine.operators import merge, offers, query, workflow
from vitrine.operators.where import where

SF = "/root/testdata/sf0.001"


def test_price_log_compares_with_what_was_kept(spark):
    rows = [(1, datetime(2020, 1, n + 1), p) for n, p in enumerate((10.00, 10.005, 10.012, 11.0))]
    got = offers.price_log(spark.createDataFrame(rows, "id int, at timestamp_ntz, price double"), ["id"], "at", "price")
    assert sorted(r.price for r in got.collect()) == [10.0, 10.012, 11.0]


def test_price_log_holds_no_group_whole(spark):
    rows = [(k, datetime(2020, 1, 1 + n // 24, n % 24), p) for k, ps in ((1, [float(n % 3) for n in range(600)]), (2, [None, 5.0]), (None, [1.0, None, 1.005, 3.0])) for n, p in enumerate(ps)]
    log = offers.price_log(spark.createDataFrame(rows, "id int, at timestamp_ntz, price double"), ["id"], "at", "price")
    assert "collect_list" not in log._jdf.queryExecution().toString()
    got = log.groupBy("id").count().collect()
    assert {(r.id, r["count"]) for r in got} == {(1, 600), (2, 1), (None, 2)}


def test_positional_zip_pairs_all_rows(spark, tmp_path):
    spark.range(1000, 1250).select(F.col("id").alias("s_suppkey")).repartition(3).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(230).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("n"), "id").alias("n_name")).repartition(5).write.parquet(f"{tmp_path}/nation.parquet")
    got = entry.queries()["positional_zip"](spark, str(tmp_path)).collect()
    assert sorted((r.s_suppkey, r.n_name) for r in got) == [(1000 + i, f"n{i}") for i in range(230)]


@pytest.mark.parametrize("given, expected", [(None, 5), (2.5, 5), (0, 1), (99, 10), (7, 7)])
def test_clamp(given, expected):
    assert query.clamp(given) == expected


def test_filter_tree_and_empty_or(spark):
    df = spark.createDataFrame([(1, "Ab", ["x"]), (2, None, [])], "id int, name string, tags array<string>")
    assert [r.id for r in df.where(where({"name": {"contains": "aB", "mode": "insensitive"}})).collect()] == [1]
    assert df.where(where({"OR": []})).count() == 0
    assert [r.id for r in df.where(where({"tags": {"isEmpty": True}})).collect()] == [2]


def test_upsert_insert_and_cascade(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, n int")
    new = spark.createDataFrame([(2, "z", 9), (3, "c", 3)], "id int, name string, n int")
    got = merge.upsert(old, new, ["id"], {"name": merge.first_writer("name")})
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1), (2, "b", 9), (3, "c", 3)]
    fresh, tally = merge.insert_new(old, new.union(new), ["id"])
    assert [r.id for r in fresh.collect()] == [3] and tuple(tally.first()) == (4, 1, 3)
    assert merge.cascade(old, new, "id").count() == 1
    assert merge.cascade(old, new, "id", set_null=True).where("id is null").count() == 1


def test_queue_claims_oldest_and_finishes(spark):
    rows = [(i, "PENDING", 0, None, None, 10 - i) for i in range(4)]
    queue = spark.createDataFrame(rows, "id int, status string, attempts int, error_message string, product_id string, created_at int")
    claimed = workflow.claim(queue, 2)
    assert sorted(r.id for r in claimed.where("status = 'PROCESSING'").collect()) == [2, 3]
    results = spark.createDataFrame([(2, "p", None), (3, None, "x" * 3000), (0, "q", None)], "id int, product_id string, error string")
    done = {r.id: r for r in workflow.finish(claimed, results).collect()}
    assert done[2].status == "SUCCESS" and done[3].status == "ERROR" and len(done[3].error_message) == 2000 and done[0].status == "PENDING"


def test_best_offer_prefers_available(spark):
    rows = [(1, 1, 5.0, False, "ACTIVE", True), (2, 1, 9.0, True, "ACTIVE", True), (3, 2, 4.0, False, "ERROR", True)]
    df = spark.createDataFrame(rows, "id int, product_id int, price double, available boolean, status string, active boolean")
    assert sorted(r.id for r in offers.best_offers(df).collect()) == [2, 3]


@pytest.mark.parametrize("name", ["catalog_search_ci", "best_offer", "price_change_log", "opportunity_transition", "canonical_keys", "extract_links"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    said = con.sql(entry.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(said.columns)
    rows = sorted((tuple(r[c] for c in order) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(r[said.columns.index(c)] for c in order) for r in said.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["save_products", "save_offers", "save_history", "price_drift_log", "bot_wall_filter", "marketplace_of_links", "batch_publish_problems", "opportunity_results", "text_cases", "url_cases", "value_cases", "times_and_expiry", "product_detail_link", "link_destinations"])
def test_flow_equals_its_sql(spark, name):
    test_query_equals_its_sql(spark, name)


def test_records_of_one_new_product_meet(spark):
    from vitrine.operators import save

    schema = "seq int, marketplace string, external_id string, url string, title string, brand string, image string, description string, rating double, reviews int, sales int, seller string, price double, old_price double, discount double, stock int, affiliate_link string, category string, gtin string, auto_created boolean"
    row = lambda n, shop, code, title, price, auto=False: (n, shop, code, "http://u", title, None, "i", None, None, None, None, None, price, None, None, None, None, None, "78912345", auto)
    records = spark.createDataFrame([row(1, "AMAZON", "A", "first", 9.0), row(2, "SHOPEE", "B", "second", 5.0), row(3, "SHOPEE", " ", "refused", 5.0), row(4, "SHOPEE", "C", "refused", -1.0)], schema)
    product = "id string, name string, image string, description string, rating double, reviews int, sales int, slug string, canonical_name string, model string, ean string, gtin string, mpn string, brand string, canonical_key string, ml_id string, category string, store string, price double, old_price double, discount int, stock int, affiliate_link string, auto_created boolean, active boolean"
    offer = "product_id string, marketplace string, id string, external_id string, url string, title string, image string, seller string, price double, old_price double, stock int, affiliate_link string, status string, match_status string, active boolean, available boolean, review_reason string, checked_at timestamp_ntz, price_changed_at timestamp_ntz"
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    got = save.save_products(records, spark.createDataFrame([], product), spark.createDataFrame([], offer), spark.createDataFrame([], "offer_id string, price double, recorded_at timestamp_ntz"), now)
    made = got["products"].collect()
    assert [(p.name, p.category, p.publication_status, p.store) for p in made] == [("first", "Ofertas", "LIVE_PARTIAL", "Shopee")]  # the best offer's store
    assert sorted((o.marketplace, o.is_best, o.status) for o in got["offers"].collect()) == [("AMAZON", False, "PENDING_AFFILIATE"), ("SHOPEE", True, "PENDING_AFFILIATE")]
    assert got["history"].count() == 2 and sorted(r.error for r in got["refused"].collect()) == ["no external id", "no valid price"]


def test_first_row_or_error(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id int, name string")
    assert query.first_row(df, [("id", "asc")]) == {"id": 1, "name": "a"} and query.first_row(df.where("id > 5")) is None
    with pytest.raises(LookupError, match="no such row"):
        query.first_row(df.where("id > 5"), missing="no such row")


def test_one_best_offer_where_ids_repeat(spark):
    rows = [("p", 1, 5.0, True), ("p", 1, 2.0, True), ("p", 2, 2.0, True), ("q", 1, 3.0, True), ("q", 1, 3.0, True), ("q", 1, 1.0, False), ("r", 4, None, True)]
    frame = spark.createDataFrame(rows, "product_id string, id int, price double, available boolean").withColumns({"status": F.lit("ACTIVE"), "active": F.lit(True)})
    got = offers.flag_best(frame)
    assert sorted((r.product_id, r.id, r.price, r.is_best) for r in got.where("product_id <> 'r'").collect()) == [("p", 1, 2.0, True), ("p", 1, 5.0, False), ("p", 2, 2.0, False), ("q", 1, 1.0, False), ("q", 1, 3.0, False), ("q", 1, 3.0, True)]
    assert [r.is_best for r in got.where("product_id = 'r'").collect()] == [True]
