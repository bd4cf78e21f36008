"""Shared pieces: scratch tables, Arrow helpers, vectorised hashing and word shingles."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20
#: Bytes of an Arrow batch between Spark and Python, and the setting's own default.
BATCH_BYTES = 4 << 20
_BATCH_SETTING, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
U64 = np.uint64
_MASK = (1 << 64) - 1


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a temporary folder stands in for it, in local mode only; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold some megabytes, where their size isn't set: texts differ much in length."""
    if spark.conf.get(_BATCH_SETTING, None) in (None, _BATCH_DEFAULT):
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps start from the files."""
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def weight(df: DataFrame) -> tuple[int, int]:
    """Rows of a frame, and about how many bytes they hold."""

    def bytes_of(field) -> Column:
        kind, c = field.dataType.typeName(), F.col(f"`{field.name}`")
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        return F.greatest(F.size(c), F.lit(0)) * 16 if kind == "array" else F.lit(16)

    each = reduce(add, [bytes_of(f).cast("long") for f in df.schema.fields])
    got = df.agg(F.count("*"), F.sum(each)).first()
    return got[0], got[1] or 0


def few(df: DataFrame) -> DataFrame:
    """The frame with a broadcast hint if its rows and bytes, counted here, are within the limits."""
    rows, size = weight(df)
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0xD1342543DE82EF95
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << n.bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            out = np.ones(size, dtype=U64)
            done = 1
            while done < size:
                step = min(done, size - done)
                out[done : done + step] = out[:step] * U64(pow(base, done, 1 << 64))
                done += step
            _POWERS[name] = out
    return _POWERS["up"], _POWERS["down"]


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE[data] * up[: len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))

    def every(self, width: int) -> np.ndarray:
        """Hashes of all spans of one width, in order."""
        count = max(0, len(self.sums) - width)
        raw = (self.sums[width:] - self.sums[:count]) * self.down[:count]
        return mix(raw + U64(width * 0x9E3779B97F4A7C15 & _MASK))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def as_bytes(texts) -> list[bytes]:
    """UTF-8 of each text, empty for null."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") if isinstance(t, str) else bytes(t) for t in texts]


#: Bytes between words if only letters, digits and what isn't ASCII make words.
NO_WORD = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts in order, and the number of words of each text.

    Words are runs of bytes other than those marked in `between` (space and 0x09-0x0D), A-Z lower-cased.
    """
    if not texts:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)]
    blank = between[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends_of_text = np.cumsum([len(t) + 1 for t in texts])
    upto = np.searchsorted(start, ends_of_text)
    return SpanHash(data)(start, end), np.diff(np.concatenate([[0], upto]))


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word shingles of each text, joined, and their numbers.

    A text of fewer words has its whole word sequence as the one shingle; one without words has none.
    """
    hashes, counts = word_hashes(texts)
    factor = [U64(pow(0xA24BAED4963EE407, j + 1, 1 << 64)) for j in range(words)]
    n = len(hashes)
    if n >= words:
        run = np.zeros(n - words + 1, dtype=U64)
        for j in range(words):
            run += hashes[j : n - words + 1 + j] * factor[j]
        run = mix(run)
    else:
        run = np.zeros(0, U64)
    out, sizes, at = [], np.zeros(len(texts), np.int64), 0
    for i, c in enumerate(counts):
        if c >= words:
            got = np.sort(run[at : at + c - words + 1])
            if len(got) > 1:
                got = got[np.concatenate([[True], got[1:] != got[:-1]])]
        elif c:
            part = hashes[at : at + 1] * factor[0] + U64(int(c))
            for j in range(1, c):
                part = part * U64(0x9E3779B97F4A7C15) + hashes[at + j : at + j + 1] * factor[j]
            got = mix(part)
        else:
            got = run[:0]
        out.append(got)
        sizes[i] = len(got)
        at += c
    return (np.concatenate(out) if out else run[:0]), sizes


def slices(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about `limit` bytes; a longer row stands alone."""
    begin, held = 0, 0
    for i, s in enumerate(sizes):
        if i > begin and held + s > limit:
            yield begin, i
            begin, held = i, 0
        held += s
    if begin < len(sizes):
        yield begin, len(sizes)


def text_rows(batches, limit: int = 1 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """(ids, UTF-8 texts) of Arrow batches (id, text), about `limit` bytes at a time."""
    for batch in batches:
        column = batch.column(1)
        sizes = pc.binary_length(column).fill_null(0).to_pylist()
        for a, b in slices(sizes, limit):
            yield batch.column(0).slice(a, b - a).to_pylist(), as_bytes(column.slice(a, b - a).cast(pa.large_binary()).to_pylist())


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their tasks, and an executor's are many."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def int64(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
