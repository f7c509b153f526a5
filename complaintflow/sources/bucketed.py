"""Stores that are bucketed and sorted by a key, so that joins on the key move no rows.

Reviews by ``id``, results and scores by ``review_id``, all in the same number of buckets: then every join on the review key
is a merge of files that lie ready. A table is its folder; a session that doesn't know it yet attaches it by name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256
#: A bucket is read by one task.
BUCKET_BYTES = 32 * 1024 * 1024


def buckets_for(*tables: DataFrame, at_least: int = 4) -> int:
    """A number of buckets for tables that are joined with each other, a power of two, so that a bucket of the largest holds
    about ``BUCKET_BYTES``, whatever the size of the tables."""
    def size(rows: DataFrame) -> int:
        texts = [F.coalesce(F.octet_length(c), F.lit(0)).cast("long") for c, t in rows.dtypes if t == "string"]
        return rows.agg(F.coalesce(F.sum(sum(texts, F.lit(8 * len(rows.columns)).cast("long"))), F.lit(0))).first()[0]

    wanted = max(at_least, *(-(-size(rows) // BUCKET_BYTES) for rows in tables))
    return 1 << (wanted - 1).bit_length()


def write_bucketed(rows: DataFrame, name: str, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Writes ``rows`` as table ``name`` below ``path``, one sorted file for each bucket."""
    (rows.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet")
     .option("path", path).saveAsTable(name))
    return rows.sparkSession.table(name)


def attach_bucketed(spark: SparkSession, name: str, path: str, schema: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """The table ``name`` that an earlier session wrote below ``path`` with the same key and number of buckets."""
    place = path if ":" in path else f"file://{path}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS `{name}` ({schema}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) "
              f"INTO {int(buckets)} BUCKETS LOCATION '{place}'")
    return spark.table(name)
