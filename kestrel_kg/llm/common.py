"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space bytes; ``bytes.split()`` splits on exactly these.
SPACE = b" \t\n\r\x0b\x0c"
#: UTF-8 continuation bytes: deleting them leaves one byte for each code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Words kept in a worker's word-hash cache before it is emptied: about 19 MB (a million took 132 MB), of each worker of an executor.
WORD_CACHE = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            found = context.getCheckpointDir().get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            found = tempfile.mkdtemp(prefix="corpus-")
        else:
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


#: Bytes of an Arrow batch while an intermediate table is made. Spark's own limit (64 MB) is taken outside the heap, twice over and in each
#: task; rows that hold whole lists of texts would fill it.
BATCH_BYTES = 8 << 20


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ARROW_BYTES, None)
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(ARROW_BYTES) if before is None else spark.conf.set(ARROW_BYTES, before)


def bound_batches(spark: SparkSession) -> None:
    """The same for what the caller writes later, by the session's setting, if it has none of its own."""
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it again: no task's result is lost with its executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A key with more than one in so many rows is dealt to several tasks; there can't be more such keys than this.
SHARE = 500


def dealt_join(rows: DataFrame, unique: DataFrame, keys: list[str], counts: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with a table in which ``keys`` are unique. Rows of a key that holds over one in ``SHARE`` of them are dealt to as
    many parts as that share asks for, and the key's row of ``unique`` is repeated for each. ``counts``: rows by key (column ``n``)."""
    total = rows.count() if counts is None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    often = counts.where(F.col("n") * SHARE > total).select(*keys, F.ceil(F.col("n") * SHARE / F.lit(max(total, 1))).cast("int").alias("_parts"))
    found = often.toArrow()  # a DataFrame made of rows would start workers of another kind on the executors
    if not found.num_rows:
        return rows.join(unique, keys)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, often.schema))
    # the part of a row is a hash of it, so that a task done again deals it alike
    plain = [c for c, kind in rows.dtypes if not kind.startswith("map")]
    left = rows.join(hot, keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*plain), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")
    right = unique.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return left.join(right, [*keys, "_part"]).drop("_part")


#: Rows that a worker turns into Python objects at a time.
PART_ROWS = 500


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``function`` on parts of at most ``PART_ROWS`` rows of each batch. Spark uses workers again and keeps idle ones, so what a task freed
    goes back to the system at its end; else each worker would hold the most that any of its tasks ever took."""

    @wraps(function)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, PART_ROWS) for b in batches for at in range(0, max(b.num_rows, 1), PART_ROWS))
        try:
            yield from function(parts)
        finally:
            del parts
            release_memory()

    return run


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not the GNU C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


class WordHash(dict):
    """word -> 64-bit hash; the cache is emptied when it has grown to ``WORD_CACHE`` words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def code_points(text: bytes) -> int:
    return len(text.translate(None, CONTINUATION))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string or binary column; null is the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(
    docs: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, pa.Array]]], added: str, keep: list[str] | None = None, need: list[str] | None = None
) -> DataFrame:
    """Pass the ``keep`` columns (all: None) of ``docs`` on with those that ``function`` makes of each batch.

    ``added`` is the DDL of the new columns; older columns of the same names go. ``need``: columns read but not kept.
    """
    new = T.StructType.fromDDL(added)
    fresh = {f.name.lower() for f in new}
    kept = [f for f in docs.schema if (keep is None or f.name in keep) and f.name.lower() not in fresh]
    read = [f.name for f in kept] + [n for n in need or [] if n not in {f.name for f in kept}]
    schema, names = T.StructType(kept + list(new)), [f.name for f in kept]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def feed() -> Iterator[pa.RecordBatch]:
            for b in batches:
                held.append(b)
                yield b

        for out in function(feed()):
            b = held.pop(0)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [out[f.name] for f in new], names=names + [f.name for f in new])

    return docs.select(*[F.col(f"`{n}`") for n in read]).mapInArrow(run, schema)
