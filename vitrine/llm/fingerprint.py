"""Document fingerprints: hashed byte triplets counted in buckets, bucket quartiles and length as a digest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.common import release, save, text_rows

BUCKETS = 128
#: Bytes of text that one task takes.
TASK_BYTES = 16 << 20
#: Triplets of a five-byte window: the newest byte with every pair of the others.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
_TABLE = np.random.default_rng(11).integers(0, 1 << 16, (len(TRIPLETS), 3, 256), dtype=np.uint16)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """(texts x BUCKETS) counts of the hashed triplets in every five-byte window of each text."""
    lengths = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    out = np.zeros(len(texts) * BUCKETS, np.int64)
    if len(data) < 3:
        return out.reshape(-1, BUCKETS)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * BUCKETS, lengths)
    shift = np.uint16(16 - BUCKETS.bit_length() + 1)
    for k, (a, b) in enumerate(TRIPLETS):
        far = max(a, b)
        if len(data) <= far:
            continue
        t = _TABLE[k]
        key = (t[0][data[far:]] + t[1][data[far - a : len(data) - a]] + t[2][data[far - b : len(data) - b]]) * np.uint16(0x9E35)
        held = place[far:] >= far
        out += np.bincount(row[far:][held] + (key[held] >> shift), minlength=len(out))
    return out.reshape(-1, BUCKETS)


def digests(texts: list[bytes]) -> list[str]:
    """Hex digest of each text: length code (2), quartile ratios (2), two bits for each bucket (64 digits).

    A bucket's code tells which quartile of the text's own bucket counts it is in. Texts without a triplet
    have all codes 0.
    """
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    codes = (counts > q1[:, None]).astype(np.uint8) + (counts > q2[:, None]) + (counts > q3[:, None])
    parts = codes.reshape(len(texts), -1, 4)
    packed = (parts[:, :, 0] << 6) | (parts[:, :, 1] << 4) | (parts[:, :, 2] << 2) | parts[:, :, 3]
    size = np.array([len(t) for t in texts])
    length = np.minimum(255, np.round(np.log1p(size) * 12)).astype(np.uint8)
    top = np.maximum(q3, 1)
    ratios = ((np.minimum(15, 16 * q1 // top) << 4) | np.minimum(15, 16 * q2 // top)).astype(np.uint8)
    return [bytes([a, b]).hex() + c.tobytes().hex() for a, b, c in zip(length, ratios, packed, strict=True)]


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """1 less the bounded difference of two digests each: 0 to 1, and 1 for equal digests.

    The difference adds up the steps between bucket codes (an outermost step counts double), of the length
    code beyond one and of the ratios, over what two unrelated texts of even codes would have.
    """
    if not a:
        return np.zeros(0)
    x, y = (np.frombuffer(bytes.fromhex("".join(s)), dtype=np.uint8).reshape(len(s), -1).astype(np.int16) for s in (a, b))
    cost = np.array([0, 1, 2, 6])
    total = sum(cost[np.abs(((x[:, 2:] >> k) & 3) - ((y[:, 2:] >> k) & 3))].sum(axis=1) for k in (0, 2, 4, 6))
    total = total + np.minimum(24, np.maximum(0, np.abs(x[:, 0] - y[:, 0]) - 1)) + (np.abs((x[:, 1] >> 4) - (y[:, 1] >> 4)) + np.abs((x[:, 1] & 15) - (y[:, 1] & 15))) // 2
    return np.clip(1 - total / (1.75 * BUCKETS), 0, 1)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; null texts are empty, other columns ignored."""

    def run(batches):
        for ids, texts in text_rows(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests(texts))], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def _row(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    sizes = [len(t) for t in texts]
    edited = [(t[: n - n // 4] + f[: n // 4]).encode() for t, n, f in zip(texts, sizes, following, strict=True)]
    own = digests([t.encode() for t in texts])
    other, changed = digests([f.encode() for f in following]), digests(edited)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(sizes, pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array(own),
            pa.array(changed),
            pa.array(likeness(own, changed)),
            pa.array(likeness(own, other)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _pairs(limit: int):
    """Rows (id, text) in order: each with the one after it. The first and the last of the partition go on with their texts."""

    def edge(kind: str, doc, text: str) -> pa.RecordBatch:
        from pyspark import TaskContext

        values = [doc, None, None, None, None, None, None, kind, TaskContext.get().partitionId(), text]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], names=_NAMES)

    def full(ids: list, texts: list[tuple[str, str]]) -> pa.RecordBatch:
        made = _row(ids, [t for t, _ in texts], [f for _, f in texts])
        return pa.RecordBatch.from_arrays([*made.columns, *[pa.nulls(len(ids), t) for t in _TYPES[-3:]]], names=_NAMES)

    def run(batches):
        ids, texts, size, before = [], [], 0, None
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                if before is None:
                    yield edge("first", doc, text)
                else:
                    ids.append(before[0])
                    texts.append((before[1], text))
                    size += len(text)
                    if size > limit:
                        yield full(ids, texts)
                        ids, texts, size = [], [], 0
                before = (doc, text)
        if ids:
            yield full(ids, texts)
        if before is not None:
            yield edge("last", *before)
        release()

    return run


def _across(batches):
    """Rows (id, text, following): the last document of a partition and the first of the next."""
    for batch in batches:
        ids, texts, following = (c.to_pylist() for c in batch.columns)
        for k in range(len(ids)):
            yield _row(ids[k : k + 1], texts[k : k + 1], following[k : k + 1])


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", task_bytes: int = TASK_BYTES) -> DataFrame:
    """Every document with its edited text's digest and fingerprint, and their likeness to its own.

    The edited text has its last quarter of characters replaced by the first as many of the next document by
    id (the first follows the last). The documents are sorted once, in ranges of ids of about `task_bytes`; each
    range pairs its own neighbours and passes on its first and last document only, which are joined after.

    Null texts are empty; rows of equal id follow one another by text and share a range; rows with a null id
    come first; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(max(1, -(-total // task_bytes)))
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), F.coalesce("text", F.lit("")))
    made = save(ordered.mapInArrow(_pairs(1 << 20), f"{_SCHEMA}, kind string, part int, text string"), "neighbours")
    ends = [made.where(F.col("kind") == kind).select("part", F.col("doc_id").alias("id"), F.col("text").alias(name)) for kind, name in (("last", "text"), ("first", "following"))]
    numbers = made.where("kind = 'first'").select("part")
    after = numbers.withColumn("next", F.lead("part").over(Window.orderBy("part")))  # one small number for each range
    least = numbers.agg(F.min("part").alias("least"))
    after = after.join(F.broadcast(least)).select("part", F.coalesce("next", "least").alias("next"))
    across = ends[0].join(after, "part").join(ends[1].select(F.col("part").alias("next"), "following"), "next").select("id", "text", "following")
    return made.where("kind is null").select(*_NAMES[:7]).unionByName(across.mapInArrow(_across, _SCHEMA))


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [*(c.split()[0] for c in _SCHEMA.split(", ")), "kind", "part", "text"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
