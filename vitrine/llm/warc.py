"""WARC archives with a record index: written first, read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm.common import few, save, scratch

#: Bytes skipped rather than read apart, the most that one read takes, and what a reading task takes.
GAP, MOST_READ, TASK_BYTES = 64 << 10, 8 << 20, 32 << 20
INDEX = "id long, file string, offset long, length long, url string, digest string, payload_bytes long, record_type string, refers_to long"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # that of URLs


def _member(head: list[str], block: bytes) -> bytes:
    """One gzip member: WARC/1.1 header, empty line, block, two line ends."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    text = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return pack.compress(text) + pack.flush()


def _name(page, digest: str) -> str:
    """Record id of the response that holds the page's payload."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}:{digest}')}>"


def _info(file: str, date: str) -> bytes:
    """The record that opens an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_NAMESPACE, file)}>", f"WARC-Date: {date}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"]
    return _member(head, b"software: vitrine\r\nformat: WARC File Format 1.1\r\n")


def _record(kind: str, page, url: str, date: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its HTTP head and payload, or a revisit with the head alone."""
    name = _name(page, digest) if kind == "response" else f"<urn:uuid:{uuid.uuid4()}>"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(head, http + (payload if kind == "response" else b""))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, date: str):
    """One archive for each task attempt, named anew so that a repeated attempt never touches another's file."""

    def run(batches):
        files, path = _filesystem(folder)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for batch in batches:
                rows = []
                for page, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    kind = "response" if first is None else "revisit"
                    clean = "".join(c for c in url or "" if c not in "\r\n")
                    record = _record(kind, page, clean, date, payload, digest, first)
                    if out is None:
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                        at = out.write(opening := _info(name, date)) or len(opening)
                    out.write(record)
                    rows.append((page, name, at, len(record), url, digest, len(payload), kind, first))
                    at += len(record)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])
        finally:
            if out:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: datetime | None = None) -> DataFrame:
    """Write every page to gzip WARC archives in `folder`, a place that all executors reach; gives the index.

    Index: id, file, offset, length, url, digest (base32 SHA-1), payload_bytes, record_type, refers_to. Every
    archive begins with a warcinfo record; responses hold an HTTP head and the payload, revisits the head. Of
    pages with equal payloads of at least `least` bytes the one with the smallest id is a response and the
    others revisit it. Null html is an empty payload, a null url an empty target; rows with a null id revisit
    a named page of their payload and else are responses without a page number; rows of one id are written
    each. An empty table gives an empty index. Other columns are ignored.

    Which pages revisit is decided on ids, digests and sizes alone; pages meet that by id and digest.
    """
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    marked = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    sizes = marked.where(F.octet_length("html") >= least).select("id", "sha")
    firsts = save(sizes.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first"), "firsts")
    again = save(sizes.join(few(firsts), "sha").where("id is null or id <> first").select("id", "sha", "first").distinct(), "revisits").toDF("_id", "_sha", "first")
    told = marked.join(few(again), F.col("id").eqNullSafe(F.col("_id")) & (F.col("sha") == F.col("_sha")), "left").select("id", "url", "html", "first")
    stamp = (date or datetime(2020, 1, 1, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    return save(told.mapInArrow(_write(folder, stamp), INDEX), "warc-index")


def _read(folder: str):
    """Records of sorted index rows, neighbouring byte ranges of a file read at once."""

    def parsed(member: bytes) -> dict:
        raw = zlib.decompress(member, 31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        fields["payload"] = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
        return fields

    def answer(files, path: str, group: list[tuple]) -> pa.RecordBatch:
        begin = group[0][1]
        with files.open_input_file(f"{path}/{group[0][0]}") as source:
            data = source.read_at(max(o + n for _, o, n in group) - begin, begin)
        found = [parsed(data[o - begin : o - begin + n]) for _, o, n in group]
        number = lambda f, key: int(f[key]) if key in f else None
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number(f, "X-Page-ID") for f in found], pa.int64()),
                pa.array([f["WARC-Target-URI"] for f in found], pa.string()),
                pa.array([f["payload"] if f["WARC-Type"] == "response" else None for f in found], pa.binary()),
                pa.array([int(f["X-Payload-Length"]) for f in found], pa.int64()),
                pa.array([f["WARC-Payload-Digest"].removeprefix("sha1:") for f in found], pa.string()),
                pa.array([f["WARC-Type"] for f in found], pa.string()),
                pa.array([number(f, "X-Refers-To-Page") for f in found], pa.int64()),
            ],
            names=["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"],
        )

    def run(batches):
        files, path = _filesystem(folder)
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (row[0] != group[0][0] or row[1] - (group[-1][1] + group[-1][2]) > GAP or row[1] + row[2] - group[0][1] > MOST_READ):
                    yield answer(files, path, group)
                    group = []
                group.append(row)
        if group:
            yield answer(files, path, group)

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the selected index rows: id, url, payload (null for a revisit), payload_bytes, payload_digest, record_type, refers_to.

    Rows are dealt to tasks of about TASK_BYTES of records and sorted by file and offset; ranges less than GAP
    apart are read together, MOST_READ at once.
    """
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    block = F.floor(F.col("offset") / MOST_READ)
    rows = index.repartition(tasks, "file", block).sortWithinPartitions("file", "offset").select("file", "offset", "length")
    return rows.mapInArrow(_read(folder), "id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    folder = scratch(pages.sparkSession, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return read_records(write_archives(pages, folder, least=least), folder)
