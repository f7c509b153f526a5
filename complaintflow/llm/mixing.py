"""Mixing sources to target weights by weighted fair queueing.

Every source is a flow whose documents wait in a shuffled order. A document's virtual finish time is the number of words
of its source up to its own end, divided by the source's target; all flows reach their targets at virtual time 1. The
whole corpus is range-sorted by virtual finish time, and the mix ends where the budget is used up: a document that is
being served at that moment is cut there, so every source gets its target to the word. A source whose target exceeds its
size is served a second time in the same order.

Defined results: null or blank texts have size 0 and take nothing; a null source is a source of its own, last in order;
repeated rows are documents like any other; an empty table gives an empty result; extra columns are ignored unless named
in ``keep``, which must not repeat the result's own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from complaintflow.llm.shared import columns, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"
#: Each source's order is dealt into this many slices, whose sums give each slice its offset: no source meets in one task.
SLICE_DIGITS = 3

BLANKS = " \t\n\x0b\x0c\r"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to one row for each source (``flow``, ``source_size``), by filling up to the caps in order of cap / weight.

    These windows see one row for each source, never documents.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("flow")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy("ratio", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        ranked.withColumn("weight", weight.cast("long"))
        .withColumn("cap", epochs * F.col("source_size"))
        .withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
        .withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.col("open_weight"))
        .withColumn("capped", F.col("cap") <= F.col("weight") * F.col("level"))
        .withColumn("final", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.struct("ratio", "rank"))).over(everything))
    )
    return filled.select("flow", "source_size",
                         F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
        epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, virtual_finish (of its first serving) and ``keep``, sorted by virtual_finish."""
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(
        columns(docs, "doc_id", "source", "text", *(k for k in keep if k not in ("doc_id", "source", "text")))
        .select("doc_id", *keep, n_words(F.col("text")).alias("size"), key.alias("order_key"),
                F.coalesce(F.concat(F.lit("a"), F.col("source")), F.lit("b")).alias("flow"))
        .withColumn("slice", F.substring("order_key", 1, SLICE_DIGITS)))
    slices = sized.groupBy("flow", "slice").agg(F.sum("size").alias("slice_size"))
    sources = targets(slices.groupBy("flow").agg(F.sum("slice_size").alias("source_size")), weights, share, epochs)
    order = Window.partitionBy("flow").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (slices.withColumn("offset", F.coalesce(F.sum("slice_size").over(order), F.lit(0)))
               .join(sources, "flow").drop("slice_size"))
    within = Window.partitionBy("flow", "slice").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0))
    served = (sized.join(offsets, ["flow", "slice"]).withColumn("start", start)
              .withColumn("budget", F.floor("target").cast("long")))
    taken = sum((F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("start") - n * F.col("source_size")))
                 for n in range(epochs)), F.lit(0))
    finish = F.when(F.col("target") > 0, (F.col("start") + F.col("size")) / F.col("target")).otherwise(F.lit(0.0))
    return (served.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"),
                          finish.alias("virtual_finish"), *keep)
            .orderBy("virtual_finish", "doc_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("virtual_finish")


def sql(documents: str = "documents") -> str:
    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    return f"""
WITH sized AS (
  SELECT doc_id, source, CAST({words} AS BIGINT) AS size, md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM {documents}),
ranked AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY CASE WHEN source IS NULL THEN 1 ELSE 0 END, source COLLATE "C") AS rk
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST(list_extract([5, 2, 1], CAST((rk - 1) % 3 + 1 AS INTEGER)) AS BIGINT) AS w,
         2 * source_size AS cap, 2 * source_size / CAST(list_extract([5, 2, 1], CAST((rk - 1) % 3 + 1 AS INTEGER)) AS DOUBLE) AS ratio
  FROM ranked),
filled AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
             - coalesce(CAST(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM weighed),
final AS (SELECT arg_min(level, (ratio, rk)) AS level FROM filled WHERE NOT cap <= w * level),
target AS (
  SELECT f.source, f.source_size, CASE WHEN f.cap <= f.w * f.level THEN CAST(f.cap AS DOUBLE) ELSE f.w * final.level END AS target
  FROM filled f CROSS JOIN final),
served AS (
  SELECT doc_id, size, t.source_size, t.target,
         CAST(coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, CAST(floor(target) AS BIGINT) - start))
            + greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - source_size)) AS BIGINT) AS taken
FROM served"""
