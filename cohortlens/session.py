"""Sessions with the settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str | None = None, app: str = "cohortlens", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and case-sensitive column names.

    Feature names that differ only in case are different features, so name resolution must be exact.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.caseSensitive": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
