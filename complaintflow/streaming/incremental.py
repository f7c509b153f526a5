"""Incremental ingest and analysis: the batch rules on a stream of files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from complaintflow import schemas
from complaintflow.operators.ingest import accepted, new_reviews
from complaintflow.operators.taxonomy import Taxonomy
from complaintflow.plans.analysis import Rules, analyze
from complaintflow.plans.rollups import Parts
from complaintflow.sources.segments import rows_of
from complaintflow.sources.tables import append_results, read_results, result_rows
from complaintflow.streaming.key_index import PARTS, KeyIndex, row_count

RUN, BATCH = "ingest_run", "ingest_batch"
SEED_RUN = "seed"
REVIEW_COLUMNS = [f.split()[0] for f in schemas.REVIEWS.split(", ")]


def stored_reviews(spark: SparkSession, store: str, without: tuple[str, int] | None = None) -> DataFrame:
    """The review store, optionally without the partition (run, batch) that is being written."""
    rows = spark.read.schema(f"{schemas.REVIEWS}, {RUN} string, {BATCH} long").parquet(store)
    return rows if without is None else rows.filter(~((F.col(RUN) == without[0]) & (F.col(BATCH) == without[1])))


def key_index(spark: SparkSession, store: str, parts: int = PARTS) -> KeyIndex:
    """The index beside a store. A new one gets ``parts`` hash parts: more of them for large stores and small batches."""
    return KeyIndex(spark, f"{store.rstrip('/')}_keys", parts)


def _index_missing(spark: SparkSession, store: str, checkpoint: str) -> None:
    """Brings the index up to a store that was seeded, written before there was an index, or left by a broken run. The last batch
    of this very run stays a segment of its own, since it may have to be run again."""
    index, rows = key_index(spark, store), stored_reviews(spark, store)
    total = row_count(spark, store, schemas.REVIEWS)
    if index.note.get("rows", 0) == total:
        return
    run = _run_of(spark, checkpoint)
    own = rows.filter(F.col(RUN) == run)
    last = own.agg(F.max(BATCH)).first()[0]
    if last is not None and f"{run}-{last}" not in index.segments:
        index.put(f"{run}-{last}", own.filter(F.col(BATCH) == last))
    index.catch_up(rows, total, f"found-{uuid.uuid4().hex}")


def _run_of(spark: SparkSession, checkpoint: str) -> str:
    """The identifier of the run that a checkpoint belongs to; empty ahead of its first start."""
    try:
        return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]
    except AnalysisException:
        return ""


def ingest_stream(raw: DataFrame, store: str, checkpoint: str, arrival: Column, max_rating: int = 0,
                  date_from: str | None = None, date_to: str | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Insert-or-ignore of a raw stream into ``store``, whatever was put into it before by this or another run.

    A run is a checkpoint; its identifier lies in there. Each micro-batch overwrites its own partition (run, batch) and
    its own segment of the key index, and is compared with the index of all others, so a batch that is run again after a
    failure gives the same store. The store itself is not read. One run writes into a store at a time. ``compact`` brings the
    partitions of ended runs together.
    """
    rows = accepted(raw.withColumn("arrival", arrival), max_rating, date_from, date_to)
    spark = raw.sparkSession
    spark.createDataFrame([], schemas.REVIEWS).write.mode("ignore").parquet(f"{store}/{RUN}=none/{BATCH}=-1")
    _index_missing(spark, store, checkpoint)

    def insert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = _run_of(spark, checkpoint)
        name, target = f"{run}-{batch_id}", f"{store}/{RUN}={run}/{BATCH}={batch_id}"
        index = key_index(spark, store)
        index.merge(name)
        first = new_reviews(batch, None).persist()
        try:
            fresh = new_reviews(first, index.known(first, name))
            if "scraped_at" not in fresh.columns:
                fresh = fresh.withColumn("scraped_at", F.localtimestamp())
            fresh.select(*REVIEW_COLUMNS).write.mode("overwrite").parquet(target)
        finally:
            first.unpersist()
        before = index.segments.get(name, {}).get("rows", 0)
        index.put(name, spark.read.schema("id string").parquet(target))
        index.note["rows"] = index.note.get("rows", 0) + index.segments[name]["rows"] - before
        index.commit()

    return (rows.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def seed_store(reviews: DataFrame, store: str) -> None:
    """Reviews known before any stream starts."""
    reviews.select(*REVIEW_COLUMNS).write.mode("overwrite").parquet(f"{store}/{RUN}={SEED_RUN}/{BATCH}=-1")


def compact(spark: SparkSession, store: str, target: str, files: int) -> None:
    """The whole store as the seed of a new one, in ``files`` files sorted by id: what a later run reads stays small in number."""
    rows = stored_reviews(spark, store).repartitionByRange(files, "id").sortWithinPartitions("id")
    seed_store(rows, target)


def analysis_stream(reviews: DataFrame, taxonomy: Taxonomy, sink: str, checkpoint: str, analyzed_at: Column,
                    rules: Rules = Rules(), trigger: dict | None = None) -> StreamingQuery:
    """The batch analysis on a review stream, for reviews without a stored result only; the sink is that of ``append_results``.

    Beside the sink lie an index of the analysed reviews, so that its results are not read again, and the partial counts
    behind the dashboard (``dashboard_parts``). A batch that is run again, a review that is delivered again and a new
    checkpoint add nothing twice, nor does an attempt that broke off while it was appending: what it left is found by its
    mark, and counted once.
    """
    spark = reviews.sparkSession
    spark.createDataFrame([], schemas.RESULTS).withColumn("analyzed_on", F.to_date("analyzed_at")).write.mode("ignore").partitionBy("analyzed_on").parquet(sink)
    start = key_index(spark, sink)
    if not start.note.get("pending"):  # results appended by others
        start.catch_up(read_results(spark, sink).select(F.col("review_id").alias("id")), row_count(spark, sink, schemas.RESULTS), f"found-{uuid.uuid4().hex}")

    def append(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        index, counts = key_index(spark, sink), dashboard_parts(spark, sink)
        index.merge()
        counts.merge()
        first = batch.dropDuplicates(["id"])
        open_ = first.join(index.known(first), "id", "left_anti").persist()
        found = None
        if index.note.get("pending"):
            results = read_results(spark, sink)
            found = results.join(open_.select(F.col("id").alias("review_id")), "review_id", "left_semi").select(*results.columns).persist()
            found.count()
        fresh = open_ if found is None else open_.join(found.select(F.col("review_id").alias("id")), "id", "left_anti")
        rows = result_rows(analyze(fresh, taxonomy, rules=rules), analyzed_at).persist()
        name = index.note.get("pending") or uuid.uuid4().hex
        index.note["pending"] = name
        index.commit()
        append_results(rows, sink)
        written = rows if found is None else rows.unionByName(found.select(*rows.columns))
        if name not in counts.segments:
            counts.put(name, written, open_)
            counts.commit()
        index.put(name, written.select(F.col("review_id").alias("id")))
        index.note |= {"pending": None, "rows": index.note.get("rows", 0) + rows_of(written)}
        index.commit()
        for df in (open_, rows, *([found] if found is not None else [])):
            df.unpersist()

    return (reviews.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def dashboard_parts(spark: SparkSession, sink: str) -> Parts:
    """The partial counts beside a sink of results."""
    return Parts(spark, f"{sink.rstrip('/')}_parts")
