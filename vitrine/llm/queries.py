"""Queries of this subpackage: one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm import language_model, licenses, toxicity, urls, warc
from vitrine.llm.decontaminate import overlaps
from vitrine.llm.fingerprint import with_next
from vitrine.llm.html import RULES, extract
from vitrine.llm.minhash import near_duplicates
from vitrine.llm.negatives import hard_negatives
from vitrine.llm.packing import pack
from vitrine.llm.periodic import periodic_runs
from vitrine.llm.suffix import remove_repeats


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: 3-word shingles, Jaccard 0.85 or more."""
    return near_duplicates(_read(spark, sf_dir, "documents"), words=3, percent=85)


def held_out(column: str, fold: int):
    """Whether crc32 of the id as text leaves `fold` modulo 5."""
    return F.crc32(F.col(column).cast("string")) % 5 == fold


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return with_next(_read(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document under deleted interpolation."""
    return language_model.score(_read(spark, sf_dir, "documents"), held_out("doc_id", 1))


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    texts = extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"), *[F.col(f"removed.{r}").alias(f"by_{r}") for r in RULES])


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back through their index."""
    records = warc.round_trip(_read(spark, sf_dir, "pages"), least=0)
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a network trained on the labels outside the held-out fold."""
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~held_out("doc_id", 0)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages, with the passage and how much of it."""
    found = overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "covered_words", "coverage", F.size("tiles").alias("n_tiles"))


#: Rules of the URL query: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's URL by rule, else by the trained weights."""
    judged = urls.judge(_read(spark, sf_dir, "pages"), URL_RULES, urls.fit(urls.labelled_urls(spark)))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing repeated 200-byte strings leaves of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return remove_repeats(docs, span=200).select(
        "doc_id",
        (F.octet_length("kept") + removed).cast("long").alias("n_bytes"),
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces placed in sequences of 2048."""
    import public_tokenizers

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), length=2048, end_id=0)


def with_repetitions(docs: DataFrame) -> DataFrame:
    """The documents of which every tenth is made to repeat: with h = crc32(doc_id), g = floor(h / 10) and h % 10 = 0, word i from
    a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def repeated(words):
        n = F.size(words)
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    bound = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise("")), F.lit(0))  # the words are made once
    return docs.withColumn("text", F.when((h % 10 == 0) & F.col("text").isNotNull(), bound).otherwise(F.col("text")))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document's words, the longest one, and digests of all runs and of the text without them."""
    docs = with_repetitions(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic_runs(docs).withColumn("best", F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"], r["period"]))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, for each of its five best positives."""
    rows = _read(spark, sf_dir, "embeddings").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where("vec_id % 100 = 0"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    found = licenses.scan_licenses(_read(spark, sf_dir, "documents"))
    labels = F.array_union("base", F.transform("found", lambda x: x["label"]))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(labels), ",").alias("labels"), "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_fingerprint, op3_language_model, op4_html, op5_warc, op6_toxicity, op7_decontaminate, op8_urls, op9_suffix, op10_packing, op11_periodic, op12_hard_negatives, op13_licenses)}


_OP1_SQL = """WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS (SELECT x, y FROM p UNION SELECT y, x FROM p),
r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) c ON c.x = s.doc_id"""


_OP12_SQL = """WITH e AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, a.label AS al, e.vec_id AS id, e.label, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.vec_id <> e.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, id, score FROM s WHERE label = al QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id) <= 5)
SELECT p.a AS anchor_id, p.id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a WHERE s.label <> s.al AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.a, p.id ORDER BY s.score DESC, s.id) <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": _OP1_SQL, "op12_hard_negatives": _OP12_SQL, "op13_licenses": licenses.sql()}
