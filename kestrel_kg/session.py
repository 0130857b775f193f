"""Session settings the engine relies on, and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(cores: int | None = None, **more: str) -> SparkSession:
    """A local session; on a cluster the submitted configuration wins over ``cores``."""
    builder = SparkSession.builder.appName("kestrel-kg")
    if cores:
        builder = builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    for key, value in (SETTINGS | {"spark.ui.enabled": "false"} | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the session; a local session without one gets a temporary folder."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="kestrel-", dir=os.environ.get("TMPDIR")))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a table in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of the shared folder, made in Arrow batches that small tasks can hold."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    path, before = f"{shared_folder(spark)}/kept_{uuid.uuid4().hex}", spark.conf.get(name)
    spark.conf.set(name, str(8 << 20))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(name, before)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` in a table of the shared folder, dealt to buckets by ``key``: joins on the key read it without a shuffle."""
    spark = df.sparkSession
    name = f"kestrel_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, key).write.bucketBy(parts, key).sortBy(key).option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)
