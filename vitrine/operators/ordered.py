"""What needs the rows of a key in order, with long keys split over tasks by range."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.storage import save


def listed(column: pa.Array) -> list:
    """An Arrow column's values as Python's, nulls as None. By NumPy, which is many times faster, where that changes none."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_boolean(kind) or (not column.null_count and (pa.types.is_integer(kind) or pa.types.is_floating(kind))):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def in_ranges(rows: DataFrame, keys: list[str], part: str = "_part") -> DataFrame:
    """The rows stored in ranges of the keys, the number of its range with each: a key's rows may lie in several."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return save(rows.repartitionByRange(tasks, *keys).withColumn(part, F.spark_partition_id()), "ranges")


def with_previous(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str = "previous") -> DataFrame:
    """The rows with a struct of `columns` of the row before, of the same keys in `order`; null for a key's first row.

    `order` tells rows of a key apart. A range's first row looks back to the last row of the range before, of which
    there is one per range, so no key needs a task of its own.
    """
    placed = in_ranges(rows, [*keys, *order])
    place = F.struct(*[F.col(c) for c in (*keys, *order)])
    held = F.struct(F.struct(*keys).alias("key"), F.struct(*columns).alias("value"))
    before = F.lag(held).over(Window.partitionBy("_part").orderBy(*keys, *order))
    ends = placed.groupBy("_part").agg(F.max_by(held, place).alias("_end"))
    borders = ends.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_border"))  # one row per range
    near = F.coalesce("_before", "_border")
    joined = placed.withColumn("_before", before).join(F.broadcast(borders), "_part")
    same = near["key"].eqNullSafe(F.struct(*[F.col(k) for k in keys]))
    return joined.withColumn(out, F.when(same, near["value"])).drop("_part", "_before", "_border")
