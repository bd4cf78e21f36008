"""Corpus pipeline: toxicity filter, near-duplicate and repeated-passage removal, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import toxicity
from vitrine.llm.common import few, save
from vitrine.llm.decontaminate import overlaps
from vitrine.llm.minhash import near_duplicates
from vitrine.llm.packing import pack
from vitrine.llm.suffix import remove_repeats


KEY = "__document"


def _keyed(docs: DataFrame) -> DataFrame:
    """The documents with a key: their doc_id, or a number of its own for each row that has none (from 2**62)."""
    if docs.where("doc_id is null").isEmpty():
        return docs.withColumn(KEY, F.col("doc_id"))
    return save(docs.withColumn(KEY, F.coalesce("doc_id", (1 << 62) + F.monotonically_increasing_id())), "keyed")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The documents whose key isn't among `keys`, a table that is broadcast only while it is small."""
    return docs.join(few(save(keys.select(KEY).distinct(), "dropped")), KEY, "left_anti").drop(KEY)


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network, trained on the labelled ones among them, doesn't reject; each row by its own text."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = toxicity.with_score(docs, toxicity.fit(docs, labels), name="__toxicity")
    return scored.where(F.col("__toxicity") < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that with the smallest doc_id.

    Rows without an id are documents of their own, after all that have one; rows that share an id are one document.
    """
    keyed = _keyed(docs)
    found = near_duplicates(keyed, id_col=KEY, words=5, percent=80)
    return _without(keyed, found.where("not kept")).select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 200 bytes or more that occur more than once; n_chars follows the text."""
    cut = remove_repeats(docs, span=200, whole_chars=True, kept_col="__kept", spans_col="__spans")
    changed = F.size("__spans") > 0
    text = F.when(changed, F.decode("__kept", "utf-8")).otherwise(F.col("text"))
    made = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(changed, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage, rows without an id included; rows that share an id go together."""
    keyed = _keyed(docs)
    found = overlaps(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=KEY)
    return _without(keyed, found.withColumnRenamed("doc_id", KEY)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 2048."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=0)


STAGES = [
    ("toxicity", filter_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: The network, the sketches and the packing have no SQL form; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over documents, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
