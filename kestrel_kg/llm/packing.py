"""Packing along a space-filling curve.

A document's tokens are hashed to a vector (a mean of pseudo-random directions, one for each id), which the hash itself projects to
``dims`` dimensions. The Hilbert index of the normalised vector orders all documents: a range partitioning by (index, tie) and a
sort inside the partitions lay them out along the curve, and neighbours are packed one after the other. Documents are cut where a
sequence is full. What is left at a partition's end fills sequences of power-of-two lengths, so nothing needs padding.

The tie, a hash of the id, lets equal documents be dealt over several partitions. The tokenised table is written to the shared
folder, so that the range bounds are drawn from it and not from a second tokenisation. A task holds one document at a time.

Cases: null and empty texts have the end id alone. Null ids and repeated rows are packed each as a row. An empty table gives no
rows. Extra columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import lean, texts, written

#: Bytes of ids for which there is a partition; its last sequences are the short ones.
PART_BYTES = 16 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Partitions take this many sequence ids each at most.
SEQUENCES = 1 << 32


def directions(ids: np.ndarray, dims: int) -> np.ndarray:
    """A pseudo-random vector in [-1, 1) ** dims for each id."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, dims + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of ``points``, unsigned coordinates of ``bits`` bits (Skilling's transposition)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[dims - 1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def tokenised(docs: DataFrame, path: str, end_id: int, dims: int, bits: int) -> DataFrame:
    """doc_id, ids (little-endian, of 16 bits if no id needs more, after a first byte that tells the width), key on the curve, tie."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        at = directions(np.arange(1 << 16), dims)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                ids, vectors = [], []
                for text in texts(part):
                    found = np.append(encode(text.decode("utf-8", "replace")), np.uint32(end_id))
                    ids.append(b"\x02" + found.astype("<u2").tobytes() if found.max() < 1 << 16 else b"\x04" + found.astype("<u4").tobytes())
                    vectors.append(at[found].mean(0) if found.max() < len(at) else directions(found, dims).mean(0))
                v = np.array(vectors).reshape(-1, dims)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                points = np.clip((v + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(hilbert(points, bits))], names=["doc_id", "ids", "key"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, key long")
    return found.withColumn("tie", F.xxhash64("doc_id"))


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, length: int = 2048, dims: int = 4, bits: int = 10, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document in a sequence; ``with_ids`` adds the piece's ids."""
    path = tokenizer or tokens.default_path()
    table = written(tokenised(docs, path, end_id, dims, bits), "tokenised")
    size = table.agg(F.coalesce(F.sum(F.octet_length("ids")), F.lit(0))).first()[0]
    ordered = table.repartitionByRange(max(1, -(-size // PART_BYTES)), "key", "tie").sortWithinPartitions("key", "tie", "doc_id", "ids")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() * SEQUENCES
        sequence, room, open_rows = 0, length, []
        names = [c.split()[0] for c in PIECES.split(", ")]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in columns[7]], pa.list_(pa.int64())))
            return pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

        for batch in batches:
            done: list[tuple] = []
            for doc, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(held, f"<u{held[0]}", offset=1).astype("<u4").tobytes()
                n, start = len(ids) // 4, 0
                while start < n:
                    take = min(room, n - start)
                    part = ids[4 * start : 4 * (start + take)]
                    open_rows.append((doc, start, take, zlib.crc32(part), n, base + sequence, length - room, part))
                    start, room = start + take, room - take
                    if not room:
                        done += open_rows
                        sequence, room, open_rows = sequence + 1, length, []
            if done:
                yield batch_of(done)
        if open_rows:
            yield batch_of(list(in_powers(open_rows, base + sequence)))

    return ordered.select("doc_id", "ids").mapInArrow(run, PIECES + (", ids array<long>" if with_ids else ""))


def in_powers(rows: list[tuple], sequence: int) -> Iterator[tuple]:
    """The pieces of an unfinished sequence, in sequences of falling power-of-two lengths."""
    left = sum(r[2] for r in rows)
    size = room = 1 << (left.bit_length() - 1)
    for doc, start, n, _, total, _, _, ids in rows:
        used = 0
        while used < n:
            take = min(room, n - used)
            part = ids[4 * used : 4 * (used + take)]
            yield doc, start + used, take, zlib.crc32(part), total, sequence, size - room, part
            used, room, left = used + take, room - take, left - take
            if not room and left:
                sequence += 1
                size = room = 1 << (left.bit_length() - 1)
