"""A Spark session with the settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "complaintflow", master: str | None = None, **conf: object) -> SparkSession:
    """Adaptive execution with skew handling, UTC. ``conf`` keys use ``__`` for dots."""
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               # lists of looked-up keys reach the Parquet filters one by one
               .config("spark.sql.parquet.pushdown.inFilterThreshold", "500")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.adaptive.coalescePartitions.enabled", "true"))
    if master:
        builder = builder.master(master)
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), str(v))
    return builder.getOrCreate()
