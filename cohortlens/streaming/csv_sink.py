"""A CSV sink for streams: every micro-batch is written whole, with a header in each file, and counted once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import write_csv


def write_csv_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to ``path``: a folder ``batch=N`` a micro-batch, and then a row (batch, rows) of the ledger.

    A batch that was interrupted is run again with the same number; it writes its folder anew and its ledger row into a folder of that
    number, so nothing is there twice. :func:`read_csv_stream` reads committed batches only.
    """
    root = path.rstrip("/")

    def commit(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            write_csv(batch, f"{root}/batch={number}", mode="overwrite")
            done = batch.agg(F.count("*").alias("rows")).withColumn("batch", F.lit(number).cast("long"))
            done.coalesce(1).write.mode("overwrite").parquet(f"{root}/_ledger/entry={number}")
        finally:
            batch.unpersist()

    return df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_csv_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of the committed batches, with their ``batch``."""
    root = path.rstrip("/")
    ledger = spark.read.schema("rows long, batch long, entry int").parquet(f"{root}/_ledger").select("batch")
    rows = spark.read.option("basePath", root).schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(f"{root}/batch=*")
    number = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("long")
    return rows.withColumn("batch", number).join(F.broadcast(ledger), "batch", "left_semi")
