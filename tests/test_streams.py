import json
import os
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.operators import offers
from vitrine.streaming import queue as stream

START = datetime(2024, 1, 1)
PRICES = "offer_id long, at timestamp, price double"


def land(spark, folder, rows, schema, number):
    """Rows as one file of their own time."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    newest = max((f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".parquet")), key=os.path.getmtime)
    os.utime(newest, (1_700_000_000 + number, 1_700_000_000 + number))


def run(spark, frame, name, checkpoint, mode="append"):
    out = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    out.awaitTermination(180)
    assert out.exception() is None
    return spark.table(name).collect()


def test_price_changes_keep_state_between_batches_and_tell_late_rows(spark, tmp_path):
    r = random.Random(3)
    folder, batches = str(tmp_path / "in"), []
    for n in range(3):
        rows = [(k, START + timedelta(hours=100 * n + i), r.choice([1.0, 1.005, 1.012, 2.0])) for k in (1, 2, 3) for i in range(30)]
        r.shuffle(rows)
        batches.append(rows)
    batches[2].append((1, START + timedelta(hours=5.5), 9.0))
    batches[1] += [(None, START, 4.0), (2, None, 9.0), (2, START + timedelta(hours=150), None)]
    for n, rows in enumerate(batches):
        land(spark, folder, rows, PRICES, n)
    source = spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(spark, stream.price_changes(source), "kept_prices", str(tmp_path / "c"))
    want = {(None, START, 4.0)}
    for k in (1, 2, 3):
        last = None
        for _, at, p in sorted((x for b in batches for x in b if x[0] == k and x[1] and x[2] and x[2] < 9), key=lambda x: (x[1], x[2])):
            if last is None or abs(p - last) > offers.TOLERANCE:
                last = p
                want.add((k, at, p))
    assert {(r.offer_id, r.at, r.price) for r in got if not r.late} == want
    assert [(r.offer_id, r.price) for r in got if r.late] == [(1, 9.0)]


def test_state_is_forgotten_after_its_time(spark, tmp_path):
    folder = str(tmp_path / "in")
    land(spark, folder, [(1, START, 5.0)], PRICES, 0)
    source = spark.readStream.schema(PRICES).option("maxFilesPerTrigger", 1).parquet(folder)
    out = stream.price_changes(source, keep=1).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", str(tmp_path / "c")).start()

    def rows(n):
        end = time.time() + 90
        while spark.table("forgotten").count() < n and time.time() < end and out.isActive:
            time.sleep(0.5)
        return spark.table("forgotten").count()

    try:
        assert rows(1) == 1
        time.sleep(3)
        land(spark, folder, [(1, START + timedelta(days=1), 5.0)], PRICES, 1)
        assert rows(2) == 2  # the same price again, but nothing is remembered
    finally:
        out.stop()


@pytest.mark.parametrize("seed", range(3))
def test_kept_prices_equal_the_plain_fold(spark, seed):
    r = random.Random(seed)
    prices = [r.choice([1.0, 1.0, 1.005, 1.01, 1.02, float("nan")]) for _ in range(500)]
    last, want = 1.0, []
    for i, p in enumerate(prices):
        if p == p and abs(p - last) > 0.009:
            last = p
            want.append(i)
    assert stream.kept_prices(np.array(prices), 1.0, 0.009) == want and stream.kept_prices(np.array([]), None, 0.1) == []
    rows = [(r.choice([1, 2, None]), START + timedelta(hours=i), r.choice([1.0, 1.0, 1.005, 2.0, None])) for i in range(400)]
    got = offers.price_log(spark.createDataFrame(rows, "id int, at timestamp_ntz, price double"), ["id"], "at", "price").collect()
    for k in (1, 2, None):
        kept, last, first = [], None, True
        for _, at, p in (x for x in rows if x[0] == k):
            if first or (last is not None and p is not None and abs(p - last) > offers.TOLERANCE):
                kept.append((at, p))
                last, first = p, False
        assert sorted((x.at, x.price) for x in got if x.id == k) == kept or kept[0][1] is None


def queue_rows(numbers, at=START):
    return [{"id": str(i), "url": f"u{i}", "marketplace": "AMAZON", "status": "SUCCESS" if i % 5 == 4 else "PENDING", "created_at": at.isoformat()} for i in numbers]


def handler():
    """Made here, so that it travels to the workers by value."""

    def handle(row):
        if row["id"] == "3":
            raise ValueError("no page " + "x" * 3000)
        return "p" + row["id"]

    return handle


def test_a_failing_row_leaves_the_others_and_a_batch_run_again_changes_nothing(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    os.mkdir(source)
    for n in range(3):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, queue_rows(range(4 * n, 4 * n + 4)))))
        os.utime(f"{source}/{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))

    def go():
        done = stream.process(stream.read_queue(spark, source, 1), stream.each_row(handler()), target, checkpoint).start()
        done.awaitTermination(180)
        rows = stream.processed(spark, target).collect()
        return sorted((int(r.id), r.status, r.product_id, len(r.error or ""), r.batch) for r in rows)

    first = go()
    assert [(i, s, p, e) for i, s, p, e, _ in first] == [(i, "ERROR" if i == 3 else "SUCCESS", None if i == 3 else f"p{i}", 2000 if i == 3 else 0) for i in range(12) if i % 5 != 4]
    assert len({b for *_, b in first}) == 3
    commits = tmp_path / "check" / "commits"
    for name in ("2", ".2.crc"):  # as if the driver was lost after the last batch's output, before its commit
        (commits / name).unlink(missing_ok=True)
    assert go() == first


def test_lost_rows_are_errors(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(map(json.dumps, queue_rows(range(4)))))
    lossy = lambda rows: stream.each_row(handler())(rows.where("id <> '2'"))
    stream.process(stream.read_queue(spark, str(source)), lossy, str(tmp_path / "out"), str(tmp_path / "c")).start().awaitTermination(180)
    got = {r.id: (r.status, r.error) for r in stream.processed(spark, str(tmp_path / "out")).collect()}
    assert got["2"] == ("ERROR", "no result") and got["0"] == ("SUCCESS", None)


def test_links_come_once_and_late_rows_not_at_all(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "url string, created_at timestamp"
    land(spark, folder, [("a", START), ("a", START + timedelta(hours=1)), ("b", START)], schema, 0)
    land(spark, folder, [("a", START + timedelta(hours=2)), ("c", START + timedelta(days=9))], schema, 1)
    land(spark, folder, [("d", START + timedelta(days=9))], schema, 2)
    land(spark, folder, [("late", START), ("c", START + timedelta(days=9, hours=1))], schema, 3)  # two batches after the watermark moved
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    got = run(spark, stream.new_links(source), "links", str(tmp_path / "c"))
    assert sorted(r.url for r in got) == ["a", "b", "c", "d"]


def test_price_changes_ask_for_their_store(spark):
    frame = spark.createDataFrame([(1, START, 1.0)], PRICES)
    old = spark.conf.get(stream.STORE)
    spark.conf.unset(stream.STORE)
    try:
        if not str(spark.conf.get(stream.STORE, "")).endswith("RocksDBStateStoreProvider"):
            with pytest.raises(RuntimeError, match="RocksDB"):
                stream.price_changes(frame.where(F.col("price") > 0))
    finally:
        spark.conf.set(stream.STORE, old)
