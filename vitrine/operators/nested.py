"""Nested writes: a parent with its related rows in one request, over immutable tables, giving all their next snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.storage import save

EXISTS, MISSING, NO_RELATED, NO_KEY = "exists already", "not found", "related row not found", "no key"


@dataclass(frozen=True)
class ToOne:
    """A struct column of the request that names one related row by its key: `connect` wants it there, else it is made."""

    column: str
    table: str
    key: str
    fk: str
    connect: bool = False


@dataclass(frozen=True)
class ToMany:
    """An array column of structs that become children, one for each parent and key: `upsert` replaces the others' columns, else what is there stays."""

    column: str
    table: str
    key: tuple[str, ...]
    fk: str
    upsert: bool = False


@dataclass(frozen=True)
class Plan:
    """The parent's table, unique column and other columns that a request sets, and its relations."""

    table: str
    key: str
    columns: tuple[str, ...]
    one: tuple[ToOne, ...] = ()
    many: tuple[ToMany, ...] = ()


def content_id(table: str, *parts: Column) -> Column:
    """An id made of what identifies a row, the same whenever it is made."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(table), *[p.cast("string") for p in parts]), 256), 1, 32)


def _latest(rows: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__new"))


def nested_write(requests: DataFrame, tables: dict[str, DataFrame], plan: Plan) -> dict[str, DataFrame]:
    """The next snapshot of every table of the plan, and `refused` (request_id, error).

    requests: request_id (their order), action (create, upsert, update), the parent's key and columns, a struct or array column for each
    relation. A request is refused whole, with all its related rows: a create of a parent that is there or that an
    earlier request makes, an update of one that isn't there yet, a null key, a related row to connect that isn't there.
    A to-one row is made once, whoever names it first; its other columns are those of the first request. Columns are set by a
    parent's last request. Children count in the order of requests, then of the array; those with a null key part fall out. New
    ids are made from keys (content_id), so the same requests make the same rows.

    Tables have an id column; a null struct or array relates nothing and keeps a stored foreign key.
    """
    parents = tables[plan.table]
    named = requests.withColumns({f"_{r.column}": F.col(f"{r.column}.{r.key}") for r in plan.one})
    lost = F.lit(False)
    for r in plan.one:
        if r.connect:
            there = tables[r.table].select(F.col(r.key).alias(f"_{r.column}"), F.lit(True).alias(f"_{r.column}_there")).distinct()
            named = named.join(there, f"_{r.column}", "left")
            lost = lost | (F.col(f"_{r.column}").isNotNull() & F.col(f"_{r.column}_there").isNull())
    able = named.withColumn("_able", F.col(plan.key).isNotNull() & ~lost)
    stored = parents.where(F.col(plan.key).isNotNull()).select(F.col("id").alias("_stored"), plan.key)
    begun = able.where("_able and action in ('create', 'upsert')").groupBy(plan.key).agg(F.min("request_id").alias("_begun"))
    rows = able.join(stored, plan.key, "left").join(begun, plan.key, "left")
    known = F.col("_stored").isNotNull()
    error = (
        F.when(F.col(plan.key).isNull(), NO_KEY)
        .when(~F.col("_able"), NO_RELATED)
        .when((F.col("action") == "create") & (known | (F.col("request_id") > F.col("_begun"))), EXISTS)
        .when((F.col("action") == "update") & ~known & F.coalesce(F.col("request_id") < F.col("_begun"), F.lit(True)), MISSING)
    )
    marked = save(rows.withColumns({"error": error, "_id": F.coalesce("_stored", content_id(plan.table, F.col(plan.key)))}), "requests")
    good, out = marked.where("error is null"), {"refused": marked.where("error is not null").select("request_id", "error")}

    for r in plan.one:
        target = out.get(r.table, tables[r.table])
        if not r.connect:
            fields = [c for c in target.columns if c != "id" and c in good.schema[r.column].dataType.names]
            first = good.where(F.col(f"_{r.column}").isNotNull()).groupBy(F.col(f"_{r.column}").alias(r.key)).agg(F.min_by(r.column, "request_id").alias("__new"))
            fresh = first.join(target.select(r.key), r.key, "left_anti").select(content_id(r.table, F.col(r.key)).alias("id"), *[F.col(f"__new.{c}").alias(c) for c in fields])
            target = target.unionByName(fresh, allowMissingColumns=True)
        out[r.table] = target
        good = good.join(target.select(F.col(r.key).alias(f"_{r.column}"), F.col("id").alias(f"_{r.column}_id")), f"_{r.column}", "left")

    fks = {r.fk: F.col(f"_{r.column}_id") for r in plan.one}
    keyed = good.select("_id", "request_id", plan.key, *plan.columns, *[c.alias(f"__{fk}") for fk, c in fks.items()])
    change = keyed.groupBy("_id").agg(F.max_by(F.struct(plan.key, *plan.columns), "request_id").alias("__new"), *[F.max_by(f"__{fk}", F.when(F.col(f"__{fk}").isNotNull(), F.col("request_id"))).alias(f"__{fk}") for fk in fks])
    both = parents.join(change.withColumnRenamed("_id", "id"), "id", "full_outer")
    hit = F.col("__new").isNotNull()
    taken = {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in (plan.key, *plan.columns)} | {fk: F.coalesce(f"__{fk}", fk) for fk in fks}
    out[plan.table] = both.withColumns(taken).select(*parents.columns)

    for r in plan.many:
        children = tables[r.table]
        listed = good.select("request_id", F.col("_id").alias(r.fk), F.posexplode(r.column).alias("_at", "_c")).select("request_id", "_at", r.fk, "_c.*").dropna(subset=list(r.key))
        keys = [r.fk, *r.key]
        fields = [c for c in children.columns if c in listed.columns and c not in keys]
        order = F.struct("request_id", "_at")
        picked = _latest(listed, keys, order, fields) if r.upsert else listed.groupBy(*keys).agg(F.min_by(F.struct(*fields), order).alias("__new"))
        both = children.join(picked, keys, "full_outer")
        hit = F.col("__new").isNotNull() & (F.lit(r.upsert) | F.col("id").isNull())
        taken = {c: F.when(hit, F.col(f"__new.{c}")).otherwise(F.col(c)) for c in fields} | {"id": F.coalesce("id", content_id(r.table, *[F.col(k) for k in keys]))}
        out[r.table] = both.withColumns(taken).select(*children.columns)
    return out
