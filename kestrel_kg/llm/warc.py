"""Dictionary-compressed WARC archives.

An archive is a run of records. A Zstandard dictionary is trained from its records, stored in a leading skippable frame
(magic 0x184D2A5D), and each record is compressed as a frame of its own with that dictionary, so a reader can start at any record.
Of records with equal payloads the one of smallest page_id is a ``response``, the others are ``revisit`` records without payload
that name it; if several rows have that smallest id, all of them are responses.

Archives are rows (archive, n_records, content) of a table in the shared folder, a file's bytes each: Spark's own writer commits
them, so a lost executor leaves no half file, and ``export`` writes them out as files. Limits: an archive is closed at
``archive_bytes`` of record bytes; its dictionary is trained from whole records, every n-th of them, so that they make about
``sample_bytes``.

Cases: null html is an empty payload; empty payloads are equal payloads. Null ids sort after all others. An empty table gives no
archives. Extra columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts, written

SKIPPABLE = 0x184D2A5D
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
ARCHIVES = "archive string, n_records long, content binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page}')}>"


def record(page: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A response, or a revisit that keeps only the HTTP headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {clean(url)}"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head += [] if page is None else [f"X-Page-ID: {page}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def clean(url: str | None) -> str:
    return "".join(url.split()) if url else "urn:none"


def archive(records: list[bytes], samples: list[bytes], dictionary_bytes: int, level: int) -> bytes:
    """The dictionary's frame, then a frame for each record."""
    try:
        trained = zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8)
    except zstandard.ZstdError:  # too little to train from
        trained = None
    held = trained.as_bytes() if trained else b""
    writer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    return b"".join([struct.pack("<II", SKIPPABLE, len(held)), held, *(writer.compress(r) for r in records)])


def read_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("an archive starts with its dictionary")
    held = content[8 : 8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    whole, at = memoryview(content), 8 + size
    while at < len(whole):
        # in slices that grow with the frame: what a frame leaves unread is copied, so never hand over the whole rest
        one, parts, step = reader.decompressobj(), [], 4096
        while not one.eof:
            if at >= len(whole):
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(whole[at : at + step]))
            at = min(at + step, len(whole))
            step *= 2
        at -= len(one.unused_data)
        head, _, block = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield fields, block[: int(fields["Content-Length"])]


def resolve(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, first (smallest page_id of equal payloads)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    # one row for each payload that occurs twice or more; the payload's length guards the digest
    firsts = (
        rows.select("page_id", "digest", F.length("payload").alias("size"))
        .groupBy("digest", "size")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("d"), "size", "first")
    )
    found = rows.join(firsts, (rows["digest"] == firsts["d"]) & (F.length(rows["payload"]) == firsts["size"]), "left")
    return found.select("page_id", "url", "payload", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))


def write(pages: DataFrame, *, archive_bytes: int = 32 << 20, sample_bytes: int = 2 << 20, dictionary_bytes: int = 64 << 10, level: int = 3) -> DataFrame:
    """The archives of ``pages``: archive (name), n_records, content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, records, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            name = f"part-{part:05d}-{number:05d}.warc.zst"
            samples = records[:: math.ceil(size / sample_bytes)]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(records)]), pa.array([archive(records, samples, dictionary_bytes, level)], pa.binary())], names=["archive", "n_records", "content"])

        for batch in batches:
            at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            pages, urls, firsts, revisits = (at[n].to_pylist() for n in ("page_id", "url", "first", "revisit"))
            for i, payload in enumerate(texts(batch, "payload")):
                made = record(pages[i], urls[i], payload, digest(payload), firsts[i], revisits[i])
                records.append(made)
                size += len(made)
                if size >= archive_bytes:
                    yield close()
                    number, records, size = number + 1, [], 0
        if records:
            yield close()

    return written(resolve(pages).mapInArrow(run, ARCHIVES), "archives")


def read(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and payload (null for revisits, or if not wanted) of every record."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = []
                for fields, block in read_archive(batch.column(0)[i].as_py()):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(http.rpartition(b"Content-Length: ")[2])
                    revisit, stated = fields["WARC-Type"] == "revisit", fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and (len(payload) != size or digest(payload) != stated):
                        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
                    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
                    rows.append((None if page is None else int(page), fields["WARC-Target-URI"], size, stated, fields["WARC-Type"], None if refers is None else int(refers), payload if payloads and not revisit else None))
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return archives.select("content").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def export(archives: DataFrame, folder: str) -> None:
    """Write the archives out as files of a folder that every executor has mounted."""

    def put(rows) -> None:
        os.makedirs(folder, exist_ok=True)
        for row in rows:
            with open(f"{folder}/.{row.archive}.{uuid.uuid4().hex}", "wb") as f:
                f.write(row.content)
            os.replace(f.name, f"{folder}/{row.archive}")

    archives.foreachPartition(put)
