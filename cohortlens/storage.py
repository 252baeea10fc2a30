"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """A folder name below ``spark.checkpoint.dir``; only on one machine, where that is unset, in the warehouse. It goes when the application ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work"
    path = f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write a frame as a committed Parquet table and read it again, so all uses see the same rows and partitions."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Spark's settings, their defaults and what stands for them where rows are large: bytes of an Arrow batch, about, and rows that a Parquet reader holds.
LARGE_ROWS = {"spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", 4 << 20), "spark.sql.parquet.columnarReaderBatchSize": ("4096", 4)}


@contextmanager
def large_rows(spark: SparkSession) -> Iterator[None]:
    """Small batches for what is run inside, whose rows are large; what the session or its user set stays."""
    before = {name: spark.conf.get(name) for name in LARGE_ROWS}
    for name, (default, small) in LARGE_ROWS.items():
        if before[name] == default:
            spark.conf.set(name, small)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
