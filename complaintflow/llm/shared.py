"""Helpers shared by the operators: shared scratch tables, whole-table readers, Arrow in and out of tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: What separates words: ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a temporary one only where all run on one machine."""
    conf = spark.sparkContext.getConf()
    root = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not root:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder and read from there: cuts lineage, survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """One output batch for each input batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None:
                yield out

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> list[bytes]:
    """Each value as UTF-8 bytes; null as no bytes."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra ones can't clash with what an operator adds."""
    return df.select(*(F.col(f"`{n}`") for n in names))


#: Stands for a null doc_id: smaller than any other.
NO_ID = -(1 << 63)


def numbered(docs: DataFrame) -> DataFrame:
    """own_id (the doc_id as it is), doc_id (a number for it, never null, in the same order), text.

    Where a doc_id, or no doc_id, stands for several texts, each (doc_id, text) gets a number of its own, in the order of the
    MD5 of the texts. Rows that repeat both are one document. As long as no doc_id does, ids are their own numbers.
    """
    rows = columns(docs, "doc_id", "text").select(F.col("doc_id").alias("own_id"), "text")
    digest = F.md5(F.coalesce("text", F.lit("")))
    several = rows.groupBy("own_id").agg((F.min(digest) != F.max(digest)).alias("several")).filter("several")
    if several.isEmpty():
        return rows.select("own_id", F.coalesce("own_id", F.lit(NO_ID)).alias("doc_id"), "text")
    rows = rows.withColumn("digest", digest)
    keys = rows.select("own_id", "digest").distinct().repartitionByRange("own_id", "digest").sortWithinPartitions("own_id", "digest")
    # partitions follow the order, and so do the identifiers of their rows; stored, so that they stay what they are
    keys = stored(keys.withColumn("doc_id", F.monotonically_increasing_id())).withColumnRenamed("own_id", "key_id").withColumnRenamed("digest", "key_digest")
    return (rows.join(keys, F.col("own_id").eqNullSafe(F.col("key_id")) & (F.col("digest") == F.col("key_digest")))
            .select("own_id", "doc_id", "text"))
