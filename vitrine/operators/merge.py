"""Entity resolution and snapshot maintenance: resolve chain, upsert, insert-only, cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve(records: DataFrame, steps: list[tuple[DataFrame, list[str], str]], out: str = "product_id") -> DataFrame:
    """Id of the first step that knows the record. A step: (table, key columns of both sides, its id column)."""
    found = []
    for n, (table, keys, id) in enumerate(steps):
        name = f"_found_{n}"
        known = table.where(F.col(id).isNotNull()).groupBy(*keys).agg(F.min(id).alias(name))
        records = records.join(known, keys, "left")
        found.append(name)
    return records.withColumn(out, F.coalesce(*found)).drop(*found)


def group_unmatched(records: DataFrame, id: str, canonical: str, fallback: list[str], made: str = "group_key") -> DataFrame:
    """Key under which records without an id become one new product: the canonical key, else the fallback columns."""
    other = F.concat_ws(":", F.lit("offer"), *fallback)
    return records.withColumn(made, F.when(F.col(id).isNull(), F.coalesce(F.col(canonical), other)))


def upsert(snapshot: DataFrame, changes: DataFrame, keys: list[str], update: dict[str, Column] | None = None) -> DataFrame:
    """The next snapshot: changed rows replace stored ones column by column, new keys are added.

    update: by column, an expression over old.<column> and new.<column>; other columns take the new value
    where there is a changed row.
    """
    old, new = snapshot.alias("old"), changes.withColumn("_changed", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys]
    joined = old.join(new, on, "full_outer")
    out = []
    for c in snapshot.columns:
        if c in keys:
            out.append(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c))
        elif c in changes.columns:
            rule = (update or {}).get(c, F.col(f"new.{c}"))
            out.append(F.when(F.col("new._changed"), rule).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            out.append(F.col(f"old.{c}").alias(c))
    return joined.select(*out)


def first_writer(column: str) -> Column:
    return F.coalesce(F.col(f"old.{column}"), F.col(f"new.{column}"))


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows to add: one for each key that the table lacks; one row received, added, ignored)."""
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    tally = rows.agg(F.count("*").alias("received")).join(F.broadcast(fresh.agg(F.count("*").alias("added"))))
    return fresh, tally.withColumn("ignored", F.col("received") - F.col("added"))


def cascade(children: DataFrame, deleted: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children after parents are deleted: gone too, or with their key null."""
    if not set_null:
        return children.join(deleted.select(key), key, "left_anti")
    gone = deleted.select(key, F.lit(True).alias("_gone")).distinct()
    return children.join(gone, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*children.columns)
