"""Corpus-wide counts by request and answer.

Documents travel as chunks: one row holding some megabytes of documents, compressed. A chunk asks for what
it needs to know of its hashed keys, one compact row for each range of hash values; the task of a range
merges all requests and answers each chunk in the same order. Keys are hashes, so ranges are even however
often one word or passage occurs, since a chunk asks for a key once.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import U64, release, slices

CHUNK_BYTES = 8 << 20
#: Most ranges that a chunk's requests are dealt to.
MOST_RANGES = 1 << 13


def _encode(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def decode(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks().to_batches()[0]


def _cut(text_at: int, limit: int):
    def run(batches):
        for batch in batches:
            sizes = pc.binary_length(batch.column(text_at)).fill_null(0).to_pylist()
            for a, b in slices(sizes, limit):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(a, b - a)]) for c in batch.columns], names=batch.schema.names)
                blob = _encode(part)
                name = int.from_bytes(blake2b(blob, digest_size=8).digest(), "big", signed=True)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([blob], pa.binary())], names=["chunk", "blob"])

    return run


def from_documents(docs: DataFrame, text_col: str, limit: int, run, schema: str) -> DataFrame:
    """`run` over the rows of chunked(docs, text_col, limit), cut and used in the same Python process."""
    cut = _cut(docs.columns.index(text_col), limit)

    def both(batches):
        yield from run(cut(batches))
        release()

    return docs.mapInArrow(both, schema)


def chunked(docs: DataFrame, text_col: str, limit: int = CHUNK_BYTES) -> DataFrame:
    """(chunk, blob): all columns of the documents in rows of about `limit` text bytes, named by a digest of their content.

    The name is the same whenever the same rows are read in the same order; docs should be a stored table.
    """
    return docs.mapInArrow(_cut(docs.columns.index(text_col), limit), "chunk long, blob binary")


def ranges(docs: DataFrame, text_col: str, each: int) -> int:
    """A power of two: ranges of hash values such that each answers for about `each` bytes of text."""
    total = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return min(MOST_RANGES, 1 << max(0, (max(1, total) // each).bit_length()))


def range_bounds(keys: np.ndarray, count: int) -> np.ndarray:
    """Where each of `count` ranges begins in the sorted keys, and the end."""
    if count == 1:
        return np.array([0, len(keys)])
    cuts = np.arange(1, count, dtype=U64) * U64((1 << 64) // count)
    return np.concatenate([[0], np.searchsorted(keys, cuts), [len(keys)]])


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as compressed differences, byte planes apart."""
    steps = np.diff(keys, prepend=U64(0)) if len(keys) else keys
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).reshape(-1), dtype=U64)


def pack_array(values: np.ndarray) -> bytes:
    """Any fixed-width numbers, byte planes apart, compressed."""
    width = values.dtype.itemsize
    return zstandard.compress(np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unpack_array(blob: bytes, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    planes = np.frombuffer(zstandard.decompress(blob), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def answers_by_chunk(answers: DataFrame) -> DataFrame:
    """(chunk, answers): each chunk's answers (kind, part, data), joined into one row."""
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("kind", "part", "data"))).alias("answers"))


def text_buffer(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts end to end as bytes, and where each begins, with the end."""
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)
