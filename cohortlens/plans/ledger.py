"""Runs of several parts that can be taken up again: a part whose result is committed is read, not computed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Ledger:
    """A folder with the result of each finished part and one entry for it.

    A part is named by its name and by what it depends on (``key``: anything JSON can hold); with another key it is another part. A result is
    committed by its entry, which is written after it: a run that was killed in between computes the part again. Parts don't
    touch each other's files, so several runs may go on with one ledger.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, name: str, key: object) -> str:
        return hashlib.sha256(json.dumps([name, key], sort_keys=True).encode()).hexdigest()[:32]

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def done(self, name: str, key: object = None) -> bool:
        return self._exists(f"{self.path}/entries/part={self._place(name, key)}/_SUCCESS")

    def run(self, name: str, part: Callable[[], DataFrame], key: object = None) -> DataFrame:
        """The result of a part, computed unless it is committed."""
        place = self._place(name, key)
        result = f"{self.path}/results/{place}"
        if not self.done(name, key):
            part().write.mode("overwrite").parquet(result)
            rows = self.spark.read.parquet(result).agg(F.count("*").alias("rows")).withColumns({"name": F.lit(name), "key": F.lit(json.dumps(key, sort_keys=True)), "at": F.current_timestamp()})
            rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/entries/part={place}")
        return self.spark.read.parquet(result)

    def entries(self) -> DataFrame:
        """(name, key, rows, at) of the committed parts."""
        return self.spark.read.parquet(f"{self.path}/entries").select("name", "key", "rows", "at")
