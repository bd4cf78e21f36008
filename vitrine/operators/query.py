"""Query shapes over a table: find, page, aggregate, group, count by value, ordered lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.operators.where import where
from vitrine.storage import save

_AGG = {"count": F.count, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}


def ordering(order: list[tuple[str, str]]) -> list[Column]:
    """Sort columns from (name, 'asc' | 'desc'), nulls last in either direction unless marked ' nulls first'."""
    out = []
    for name, way in order:
        first = way.endswith("nulls first")
        make = {("asc", False): F.asc_nulls_last, ("asc", True): F.asc_nulls_first, ("desc", False): F.desc_nulls_last, ("desc", True): F.desc_nulls_first}
        out.append(make[way.split()[0], first](name))
    return out


def find_many(df: DataFrame, filter: dict | None = None, select: list[str] | None = None, omit: list[str] | None = None, order: list[tuple[str, str]] | None = None, distinct: list[str] | None = None, cursor: Column | None = None, skip: int = 0, take: int | None = None) -> DataFrame:
    """Rows that meet the filter, one for each value of `distinct` (the first in order), after a keyset cursor."""
    out = df.where(where(filter)) if filter else df
    if cursor is not None:
        out = out.where(cursor)
    keys = ordering(order or [])
    if distinct:
        rank = F.row_number().over(Window.partitionBy(*distinct).orderBy(*(keys or [F.col(c) for c in distinct])))
        out = out.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    if take is not None and take < 0:  # the last rows of the order
        keys = ordering([(n, "desc" if w.startswith("asc") else "asc") for n, w in order or []])
        take = -take
    if keys:
        out = out.orderBy(*keys)
    if skip:
        out = out.offset(skip)
    if take is not None:
        out = out.limit(take)
    out = out.drop(*omit) if omit else out
    return out.select(*select) if select else out


def aggregate(df: DataFrame, **columns: list[str]) -> DataFrame:
    """One row: aggregate(df, avg=['price'], count=['*']) names its columns avg_price, count_all."""
    return df.agg(*_aggregates(columns))


def _aggregates(columns: dict[str, list[str]]) -> list[Column]:
    return [_AGG[kind](F.lit(1) if c == "*" else F.col(c)).alias(f"{kind}_{'all' if c == '*' else c}") for kind, names in columns.items() for c in names]


def group_by(df: DataFrame, by: list[str], having: Column | None = None, order: list[tuple[str, str]] | None = None, skip: int = 0, take: int | None = None, **columns: list[str]) -> DataFrame:
    if (skip or take is not None) and not order:
        raise ValueError("group_by needs an order to skip or take")
    out = df.groupBy(*by).agg(*_aggregates(columns))
    return find_many(out if having is None else out.where(having), order=order, skip=skip, take=take)


def count_by(df: DataFrame, column: str, values: dict[str, str]) -> DataFrame:
    """One row in one pass: total, and a count for each named value, zeros too."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == v).alias(n) for n, v in values.items()])


def ordered_lookup(ids: DataFrame, table: DataFrame, ids_column: str, key: str, most: int = 100) -> DataFrame:
    """Rows of the table for an array of ids, with each id's place; blank and repeated ids fall out, order stays."""
    wanted = F.slice(F.array_distinct(ids_column), 1, most)
    places = ids.select(F.posexplode(wanted).alias("position", key))
    return places.join(table, key).orderBy("position")


def clamp(value, default: int = 5, low: int = 1, high: int = 10) -> int:
    """A limit as given if whole, within bounds; else the default."""
    if isinstance(value, bool) or not isinstance(value, (int, float)) or value != int(value):
        return default
    return max(low, min(high, int(value)))


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each key in the order; plans as a grouped top-1 before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def numbered(rows: DataFrame, key: str, name: str = "_number") -> DataFrame:
    """All rows with their number from 0 in order of the key: ranges are numbered apart, after the counts of earlier ones."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored, so that counts and numbers are of the same ranges.
    placed = save(rows.repartitionByRange(tasks, key).sortWithinPartitions(key).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(F.col(name), 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.select(*rows.columns, (F.col(name).bitwiseAND((1 << 33) - 1) + F.col("_start")).alias(name))


def first_row(df: DataFrame, order: list[tuple[str, str]] | None = None, missing: str | None = None) -> dict | None:
    """The first row in order as a dict; without any, null or, where `missing` is given, a LookupError of that text."""
    got = (df.orderBy(*ordering(order)) if order else df).limit(1).collect()
    if not got and missing is not None:
        raise LookupError(missing)
    return got[0].asDict(recursive=True) if got else None


def lacking(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The wanted keys, each once, that the table doesn't have."""
    return wanted.select(key).distinct().join(table.select(key), key, "left_anti")


def order_by_related(parents: DataFrame, children: DataFrame, on: tuple[str, str], measure: Column, descending: bool = True, take: int | None = None) -> DataFrame:
    """Parents by an aggregate of their children (`related`), those without children last, ties by key."""
    seen = children.groupBy(F.col(on[1]).alias(on[0])).agg(measure.alias("related"))
    out = parents.join(seen, on[0], "left").orderBy(F.desc_nulls_last("related") if descending else F.asc_nulls_last("related"), on[0])
    return out if take is None else out.limit(take)
