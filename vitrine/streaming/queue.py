"""The import queue and the price log as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from vitrine.functions.money import TOLERANCE
from vitrine.operators.query import clamp

QUEUE = "id string, url string, marketplace string, status string, created_at timestamp"
#: What `process` writes of a row.
DONE = "id string, status string, product_id string, error string"
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_queue(spark: SparkSession, folder: str, files: int = 5, schema: str = QUEUE) -> DataFrame:
    """Queue rows as they land, some files to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", clamp(files)).json(folder)


def new_links(queue: DataFrame, key: str = "url", at: str = "created_at", delay: str = "1 day") -> DataFrame:
    """Rows whose url wasn't seen within the delay; the state of older ones is dropped, and so are rows older than the watermark."""
    return queue.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def each_row(handle: Callable[[dict], str]) -> Callable[[DataFrame], DataFrame]:
    """Work that gives each row, as a dict, to `handle` in the executors; what it returns is the product's id, what it raises the row's error.

    A row that fails doesn't touch the others. Rows come to `handle` again if a task or a batch is run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                try:
                    made.append((row["id"], str(handle(row)), None))
                except Exception as e:  # the row's own failure, told in its error
                    made.append((row["id"], None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*made, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["id", "product_id", "error"])

    return lambda rows: rows.withColumn("id", F.col("id").cast("string")).mapInArrow(run, "id string, product_id string, error string")


def process(queue: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> DataStreamWriter:
    """Writer that handles what is there and stops: each batch's pending rows go through `work` (rows to id, product_id, error)
    and are written with SUCCESS or ERROR, messages cut at 2000 characters, to the batch's own folder below `target`.

    A batch that is run again replaces its folder, so each batch's rows stand there once; see `processed`. A row
    that `work` loses is an ERROR. Blank errors are errors too.
    """

    def one(batch: DataFrame, number: int) -> None:
        pending = batch.where("status = 'PENDING'").withColumn("id", F.col("id").cast("string"))
        done = work(pending).select("id", "product_id", "error", F.lit(True).alias("_done"))
        rows = pending.select("id").join(done, "id", "left")
        error = F.when(F.col("_done").isNull(), "no result").otherwise(F.substring("error", 1, 2000))
        out = rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNotNull(), "ERROR").otherwise("SUCCESS"))
        out.select("id", "status", F.when(F.col("error").isNull(), F.col("product_id")).alias("product_id"), "error").write.mode("overwrite").parquet(f"{target}/batch={number}")

    return queue.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def processed(spark: SparkSession, target: str) -> DataFrame:
    """The results of all batches, with their batch number."""
    return spark.read.schema(f"{DONE}, batch long").parquet(target)


def kept_prices(prices: np.ndarray, last: float | None, tolerance: float) -> list[int]:
    """Places of the prices that differ from the last one kept, in order; `last`: kept before them, if any.

    A price that equals the one before it can't be kept, so only changes are gone through.
    """
    changes = np.flatnonzero(np.concatenate([[True], prices[1:] != prices[:-1]])) if len(prices) else ()
    out = []
    for i in changes:
        price = float(prices[i])
        if price == price and (last is None or abs(price - last) > tolerance):
            last = price
            out.append(int(i))
    return out


class _PriceLog(StatefulProcessor):
    """State of a key: the time of its last row and the last price kept."""

    def __init__(self, key: str, tolerance: float, keep_ms: int | None):
        self.key, self.tolerance, self.keep_ms = key, tolerance, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at timestamp, price double", self.keep_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        at, price = self.last.get() if self.last.exists() else (None, None)
        for frame in rows:
            ordered = frame.dropna(subset=["at", "price"]).sort_values(["at", "price"], kind="stable")
            late = ordered["at"] < pd.Timestamp(at) if at is not None else pd.Series(False, index=ordered.index)
            due = ordered[~late]
            kept = due.iloc[kept_prices(due["price"].to_numpy(), price, self.tolerance)]
            if len(kept):
                price = float(kept["price"].iloc[-1])
            if len(due):
                at = due["at"].iloc[-1].to_pydatetime()
            out = pd.concat([kept.assign(late=False), ordered[late].assign(late=True)])
            yield pd.DataFrame({self.key: [key[0]] * len(out), "at": out["at"], "price": out["price"], "late": out["late"].astype(bool)})
        if at is not None and price is not None:
            self.last.update((at, price))

    def close(self) -> None:
        pass


def price_changes(prices: DataFrame, key: str = "offer_id", tolerance: float = TOLERANCE, keep: int | None = None) -> DataFrame:
    """(key, at, price, late): of a stream (key, at, price) the prices that differ from the last one kept of their offer.

    Rows of a key come in order of time; one that is older than a row its key has had in an earlier Arrow batch changes nothing and is
    passed on as late. The state is one time and price for each key; it is forgotten after `keep` seconds
    without a change, if given; such a stream keeps looking for what to forget, so it is stopped by its owner and doesn't
    end with an availableNow trigger. Rows are gone through batch by batch, none is held. Rows without time or price fall out.
    """
    if not str(prices.sparkSession.conf.get(STORE, "")).endswith("RocksDBStateStoreProvider"):
        raise RuntimeError(f"set {STORE} to {ROCKS}: other stores don't hold this state")
    kind = dict(prices.dtypes)[key]
    rows = prices.select(key, F.col("at").cast("timestamp").alias("at"), F.col("price").cast("double").alias("price"))
    log = _PriceLog(key, tolerance, None if keep is None else keep * 1000)
    return rows.groupBy(key).transformWithStateInPandas(log, f"`{key}` {kind}, at timestamp, price double, late boolean", "Append", "None" if keep is None else "ProcessingTime")
