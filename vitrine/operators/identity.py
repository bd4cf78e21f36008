"""Which product each record of a batch belongs to, as if the records were saved one after another.

A record finds its product by its offer's code, then its catalog id, the product it is meant for, and its canonical
key; else it makes one. What it writes, later ones find: codes and keys change hands. Records that share a code or a
key, directly or through a stored product, are connected; what isn't connected can't meet. A code's records, keys and
products hang on one of these, so that components are sought among keys and products only. Names there are 64-bit
hashes: equal ones by chance put components together, which changes no result. Records are gone through in order, one
component after another, with only its keys in memory. Of components of more than LARGE rows most are plain: all their
records fall to one product whatever their order, which aggregates tell, so these need no task of their own.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions import money
from vitrine.functions.money import TOLERANCE
from vitrine.operators.components import components
from vitrine.operators.ordered import listed, with_previous
from vitrine.storage import save

CATALOG_MARKET = "MERCADO_LIVRE"
ML_TAKEN = "catalog id of another product"
#: Rows of a component from which on aggregates are tried first. Results are the same.
LARGE = 100_000
#: What `assign` tells of a record.
TOLD = {"product_id": "string", "is_new": "boolean", "takes_key": "boolean", "owns_key": "boolean", "refused": "string", "by_code": "boolean", "gate": "boolean", "moved": "boolean"}
_FACT = ("kind", "product_id", "marketplace", "value")


def _node(kind: str, *parts: Column) -> Column:
    """A node's number; null if a part is."""
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    return F.when(known, F.xxhash64(F.lit(kind), *parts))


def _new_id(marketplace: Column, code: Column, seq: Column) -> Column:
    return F.concat_ws(":", F.lit("new"), marketplace, code, seq.cast("string"))


def _facts(products: DataFrame, offers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kind, product_id, marketplace, value): stored codes and catalog ids, canonical keys, products made by the engine."""
    none = F.lit(None).cast("string")
    codes = offers.select(F.lit("offer").alias("kind"), "product_id", "marketplace", F.col("external_id").alias("value"))
    codes = codes.unionByName(products.select(F.lit("ml").alias("kind"), F.col("id").alias("product_id"), F.lit(CATALOG_MARKET).alias("marketplace"), F.col("ml_id").alias("value")))
    keys = products.select(F.lit("key").alias("kind"), F.col("id").alias("product_id"), none.alias("marketplace"), F.col("canonical_key").alias("value"))
    made = products.where("auto_created").select(F.lit("auto").alias("kind"), F.col("id").alias("product_id"), none.alias("marketplace"), none.alias("value"))
    return codes.where("marketplace is not null and value is not null"), keys.where("value is not null"), made


def assign(records: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """The records (seq, marketplace, external_id, canonical_key, target_product_id, price, auto_created, ...), less code, key and target, with product_id,
    is_new (it makes the product), takes_key (the product has its canonical key from then on), owns_key (the product had it before), refused,
    by_code (the offer had the record's code), gate (it makes the product, its code or catalog id was the offer's or product's, or the
    product was made by the engine before) and moved (the price differs from the offer's record before; null where there is none).

    products: id, ml_id, canonical_key, auto_created; offers: product_id, marketplace, external_id. seq numbers the records, each once.
    refused: the catalog id belongs to another product than the offer's code, so the record isn't saved and changes nothing.
    Stored tables are compressed, so Spark takes them for few: joins are by shuffle, and rows without a key stay out of them.
    """
    aimed = records.where("target_product_id is not null").join(products.select(F.col("id").alias("target_product_id"), F.col("id").alias("_target")).hint("merge"), "target_product_id", "left")
    asked = aimed.unionByName(records.where("target_product_id is null").withColumn("_target", F.lit(None).cast("string"))).select(*records.columns, "_target")
    codes, keys, made = _facts(products, offers)
    code = lambda value: F.xxhash64(F.lit("c"), "marketplace", value)
    told = codes.select(*_FACT, code("value").alias("_code"), _node("p", F.col("product_id")).alias("_p"))
    asked = asked.withColumns({"_code": code("external_id"), "_k": _node("k", F.col("canonical_key")), "_p": _node("p", F.col("_target"))})

    # Of each code that records have the least key or product, on which the code's rows hang; by partial aggregates.
    ends = asked.select("_code", F.least("_k", "_p").alias("hub"), F.lit(True).alias("asked")).unionByName(told.select("_code", F.col("_p").alias("hub"), F.lit(False).alias("asked")))
    hubs = ends.groupBy("_code").agg(F.min("hub").alias("hub"), F.max("asked").alias("asked")).where("asked").select("_code", F.coalesce("hub", "_code").alias("hub"))
    both = asked.unionByName(told, allowMissingColumns=True)
    held = save(both.join(hubs.hint("merge"), "_code"), "records")
    mentioned = held.where("_k is not null").select("_k").distinct()
    named = save(keys.withColumns({"_k": _node("k", F.col("value")), "_p": _node("p", F.col("product_id"))}).join(mentioned.hint("merge"), "_k", "left_semi"), "keys")
    edges = held.select(F.col("hub").alias("a"), F.col("_k").alias("b")).union(held.select("hub", "_p")).union(named.select("_k", "_p")).where("a <> b").distinct()
    labels = components(edges)

    def placed(rows: DataFrame, hub: str) -> DataFrame:
        return rows.join(labels.withColumnRenamed("node", hub).hint("merge"), hub, "left").withColumn("component", F.coalesce("component", hub))

    touched = held.where("_p is not null").select("_p").union(named.select("_p")).distinct()
    made = made.withColumn("_p", _node("p", F.col("product_id"))).join(touched.hint("merge"), "_p", "left_semi")
    rows = placed(held, "hub")
    facts = rows.where("kind is not null").select("component", *_FACT).unionByName(placed(named.unionByName(made, allowMissingColumns=True), "_p").select("component", *_FACT))
    rows = rows.where("kind is null").select("component", *records.columns, "_target", "_code")
    # Components by their rows, counted by hub first.
    many = placed(held.groupBy("hub").agg(F.count("*").alias("n")), "hub").groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") > LARGE)
    large = save(many.select("component"), "large")
    if large.isEmpty():
        return _follow(rows, facts)
    # Of these there is at most one for each LARGE rows.
    apart = lambda rows, how: rows.join(F.broadcast(large), "component", how)
    plain, rest = _plain(save(apart(rows, "left_semi"), "large_rows"), save(apart(facts, "left_semi"), "large_facts"), products, offers)
    followed = _follow(apart(rows, "left_anti"), apart(facts, "left_anti")).unionByName(_follow(*rest))
    return followed.unionByName(plain.select(*followed.columns))


def _plain(records: DataFrame, facts: DataFrame, products: DataFrame, offers: DataFrame) -> tuple[DataFrame, tuple[DataFrame, DataFrame]]:
    """What holds for the records of plain components; the records and facts of the others."""
    found = {
        "_by_code": facts.where("kind = 'offer'").groupBy("marketplace", F.col("value").alias("external_id")).agg(F.min("product_id").alias("_by_code")),
        "_by_ml": facts.where("kind = 'ml'").groupBy("marketplace", F.col("value").alias("external_id")).agg(F.min("product_id").alias("_by_ml")),
        "_by_key": facts.where("kind = 'key'").groupBy(F.col("value").alias("canonical_key")).agg(F.min("product_id").alias("_by_key")),
    }
    held = records
    for name, lookup in found.items():
        held = held.join(lookup.hint("merge"), ["canonical_key"] if name == "_by_key" else ["marketplace", "external_id"], "left")
    held = save(held.withColumn("_found", F.coalesce("_by_code", "_by_ml", "_target", "_by_key")).drop("_by_code", "_by_ml", "_by_key"), "placed")

    owned = facts.where("kind <> 'auto'").select("component", "kind", "product_id", "value").unionByName(held.where("_target is not null").select("component", F.lit("target").alias("kind"), F.col("_target").alias("product_id"), F.lit(None).cast("string").alias("value")))
    of_facts = owned.groupBy("component").agg(F.min("product_id").alias("_p"), F.max("product_id").alias("_q"), F.min(F.when(F.col("kind") == "key", F.col("value"))).alias("_held"), F.max(F.when(F.col("kind") == "key", F.col("value"))).alias("_held_too"))
    first = lambda c: F.min_by(F.struct(F.col(c).alias("v")), "seq")["v"]
    coded = F.struct("marketplace", "external_id")
    of_records = held.groupBy("component").agg(
        F.min("seq").alias("_first"), first("_found").alias("_first_found"), F.min_by(_new_id(F.col("marketplace"), F.col("external_id"), F.col("seq")), "seq").alias("_made"), (F.min(coded) == F.max(coded)).alias("_one_code"),
        F.min("canonical_key").alias("_k"), F.max("canonical_key").alias("_l"), (F.count("canonical_key") == F.count("*")).alias("_all_keyed"), F.min(F.when(F.col("canonical_key").isNotNull(), F.col("seq"))).alias("_keyed_at"),
    )
    one_product = F.col("_p").isNull() | (F.col("_p") == F.col("_q"))
    one_key = F.coalesce(F.least("_k", "_held") == F.greatest("_l", "_held_too"), F.lit(True))
    keyed = F.col("_all_keyed") & (F.col("_p").isNull() | F.coalesce(F.col("_held") == F.col("_k"), F.lit(False)))
    one_code = F.col("_one_code") & (F.col("_p").isNull() | F.col("_first_found").isNotNull())
    kinds = save(of_records.join(of_facts, "component", "left").withColumn("_plain", one_product & one_key & (keyed | one_code)), "kinds")
    sorted_out = held.join(F.broadcast(kinds), "component")

    has_key = F.col("canonical_key").isNotNull()
    plain = sorted_out.where("_plain").withColumns(
        {
            "product_id": F.coalesce("_first_found", "_made"),
            "is_new": F.col("_first_found").isNull() & (F.col("seq") == F.col("_first")),
            "takes_key": has_key,
            "owns_key": has_key & (F.coalesce(F.col("_held") == F.col("canonical_key"), F.lit(False)) | (F.col("_keyed_at") < F.col("seq"))),
            "refused": F.lit(None).cast("string"),
        }
    )
    kept = [c for c in records.columns if c not in ("component", "_target", "_code")]
    others = F.broadcast(kinds.where("not _plain").select("component"))
    return _step_by_step(plain.select(*kept, *list(TOLD)[:5]), products, offers), (records.join(others, "component", "left_semi"), facts.join(others, "component", "left_semi"))


def _step_by_step(records: DataFrame, products: DataFrame, offers: DataFrame) -> DataFrame:
    """Assigned records with by_code, gate and moved."""
    before = with_previous(records, ["product_id", "marketplace"], ["seq"], ["external_id", "price"])
    stored = offers.select("product_id", "marketplace", F.col("external_id").alias("_stored"))
    engine = records.groupBy("product_id").agg(F.min(F.when(F.col("auto_created"), F.col("seq"))).alias("_auto_from"))
    owners = products.select(F.col("id").alias("product_id"), F.col("auto_created").alias("_auto"), F.col("ml_id").alias("_ml"))
    rows = before.join(stored.hint("merge"), ["product_id", "marketplace"], "left").join(engine.hint("merge"), "product_id").join(owners.hint("merge"), "product_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    by_code = yes(F.coalesce("previous.external_id", "_stored") == F.col("external_id"))
    same = by_code | yes((F.col("marketplace") == CATALOG_MARKET) & (F.coalesce("previous.external_id", "_ml") == F.col("external_id")))
    auto = yes(F.col("_auto")) | yes(F.col("_auto_from") < F.col("seq"))
    moved = F.when(F.col("previous").isNotNull(), money.price_changed(F.col("price"), F.col("previous.price")))
    return rows.withColumns({"by_code": by_code, "gate": F.col("is_new") | same | auto, "moved": moved}).select(*records.columns, "by_code", "gate", "moved")


#: What the steps look at of a row; other columns of records go through unread.
_STEP = ["component", "stage", "seq", "kind", "product_id", "marketplace", "external_id", "canonical_key", "_target", "price", "auto_created"]
_READ = [c for c in _STEP if c != "stage"]


def _follow(records: DataFrame, facts: DataFrame) -> DataFrame:
    """The records with what each finds and writes, in order of seq after the stored facts of its component."""
    missing = {c: F.lit(None).cast(t) for c, t in (("price", "double"), ("auto_created", "boolean")) if c not in records.columns}
    asked = records.withColumns({"stage": F.lit(1), "seq": F.col("seq").cast("long"), "kind": F.lit("record"), "product_id": F.lit(None).cast("string"), **missing})
    also = [c for c in asked.columns if c not in (*_STEP, "_code")]
    told = facts.select("component", F.lit(0).alias("stage"), F.lit(0).cast("long").alias("seq"), "kind", "product_id", "marketplace", F.col("value").alias("external_id"))
    # By a hash of the component: both sides may be dealt by component already, when Spark leaves out the exchange and merges the
    # tasks of each side by itself, so that a component's facts and records no longer meet.
    rows = told.unionByName(asked.select(*_STEP, *also), allowMissingColumns=True).select(*_STEP, *also).repartition(F.xxhash64("component")).sortWithinPartitions("component", "stage", "seq")
    kept = [f for f in rows.schema if f.name in ("seq", "marketplace", "price", "auto_created", *also)]
    return rows.mapInArrow(_steps([f.name for f in kept]), ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"{c} {t}" for c, t in TOLD.items())]))


def _steps(kept: list[str]):
    kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_())

    def run(batches):
        # A value's owner and an owner's value: setting one releases the owner's old value.
        at = coded = code_of = catalog = ml_of = keys = key_of = engine = prices = None
        for batch in batches:
            out = []
            say = out.append
            read = batch.select(_READ)
            for component, seq, kind, product, market, value, key, target, price, auto in zip(*(listed(c) for c in read.columns), strict=True):
                if component != at:
                    at, coded, code_of, catalog, ml_of, keys, key_of, engine, prices = component, {}, {}, {}, {}, {}, {}, set(), {}
                if kind == "record":
                    in_catalog = market == CATALOG_MARKET
                    code = (market, value)
                    owner = keys.get(key) if key is not None else None
                    found = coded.get(code) or (catalog.get(value) if in_catalog else None) or target or owner
                    mine = found or ":".join(["new", *filter(None, (market, value)), str(seq)])
                    if in_catalog and catalog.get(value) not in (None, mine):
                        say((None, False, False, False, ML_TAKEN, False, False, None))
                        continue
                    slot = (mine, market)
                    was, before = code_of.get(slot), prices.get(slot)
                    by_code = was == code
                    gate = found is None or by_code or mine in engine or (in_catalog and ml_of.get(mine) == value)
                    takes = key is not None and owner in (None, mine)
                    say((mine, found is None, takes, takes and owner is not None, None, by_code, gate, None if before is None else abs(price - before) > TOLERANCE))
                    if not by_code:
                        coded.pop(was, None)
                        code_of[slot] = code
                    coded[code] = mine
                    if in_catalog:
                        catalog.pop(ml_of.get(mine), None)
                        ml_of[mine], catalog[value] = value, mine
                    if takes:
                        keys.pop(key_of.get(mine), None)
                        key_of[mine], keys[key] = key, mine
                    if auto:
                        engine.add(mine)
                    prices[slot] = price
                elif kind == "offer":
                    coded.pop(code_of.get((product, market)), None)
                    code_of[product, market], coded[market, value] = (market, value), product
                elif kind == "ml":
                    catalog.pop(ml_of.get(product), None)
                    ml_of[product], catalog[value] = value, product
                elif kind == "key":
                    keys.pop(key_of.get(product), None)
                    key_of[product], keys[value] = value, product
                elif kind == "auto":
                    engine.add(product)
            if out:
                records = batch.filter(pa.compute.equal(batch.column("stage"), 1)).select(kept)
                told = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*records.columns, *told], names=[*kept, *TOLD])

    return run
