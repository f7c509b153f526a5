"""Dashboards from partial counts that are kept while results arrive, instead of a scan of all results on each view.

A partial count has one row for each day of analysis and combination of the dashboard's columns. Counts and sums add up
whatever the order and the number of batches, so late results only add rows to an earlier day; segments are merged as they
become many.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.plans import reporting
from complaintflow.sources.segments import Segments, crowded, rows_of

KEYS = ["analyzed_on", "sentiment", "is_complaint", "escalated", "category", "subcategory", "layer1", "layer2", "layer3"]
SUMS = ["n", "rating_sum", "rated"]
SCHEMA = ("analyzed_on date, sentiment string, is_complaint boolean, escalated boolean, category string, subcategory string, "
          "layer1 string, layer2 string, layer3 string, n long, rating_sum long, rated long")
FANOUT = 8
LEVEL_ROWS = 10_000

COUNT = "sum(n)"


def partial_counts(results: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row for each day and combination. Results are counted by review first, so one analysed very often is few rows in the join."""
    by_review = (results.withColumn("analyzed_on", F.to_date("analyzed_at"))
                 .groupBy(*KEYS, F.col("review_id").alias("id")).agg(F.count("*").alias("n")))
    rated = by_review.join(reviews.select("id", F.col("rating").cast("long").alias("rating")), "id", "left")
    return rated.groupBy(*KEYS).agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.col("rating") * F.col("n")), F.lit(0)).cast("long").alias("rating_sum"),
        F.coalesce(F.sum(F.when(F.col("rating").isNotNull(), F.col("n"))), F.lit(0)).cast("long").alias("rated"))


def added(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))


class Parts(Segments):
    """The partial counts of a result store."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT):
        super().__init__(spark, path)
        self.fanout = fanout

    def counts(self, day_from: str | None = None, day_to: str | None = None) -> DataFrame:
        """All partial rows, optionally of some days only."""
        rows = self.read(SCHEMA, list(self.segments))
        if day_from:
            rows = rows.filter(F.col("analyzed_on") >= F.lit(day_from).cast("date"))
        return rows.filter(F.col("analyzed_on") <= F.lit(day_to).cast("date")) if day_to else rows

    def put(self, name: str, results: DataFrame, reviews: DataFrame) -> None:
        """Segment ``name`` counts ``results``; written again, it is replaced. Takes effect with ``commit``."""
        self._save(name, partial_counts(results, reviews))

    def _save(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self.folder(name))
        self.segments[name] = {"rows": rows_of(self.read(SCHEMA, [name]))}

    def merge(self) -> None:
        while names := crowded(self.segments, LEVEL_ROWS, self.fanout):
            self._save(f"merged-{uuid.uuid4().hex}", added(self.read(SCHEMA, names)))
            for n in names:
                del self.segments[n]
            self.commit()
            self.clear(SCHEMA, names)

    def rebuild(self, results: DataFrame, reviews: DataFrame) -> None:
        """From all results, as after writes that didn't come through the stream."""
        old = list(self.segments)
        self._save(f"whole-{uuid.uuid4().hex}", partial_counts(results, reviews))
        for n in old:
            del self.segments[n]
        self.commit()
        self.clear(SCHEMA, old)


def totals(parts: DataFrame, n_reviews: Column) -> DataFrame:
    """As ``reporting.totals``; ``n_reviews`` is a literal or a scalar subquery."""
    def total(condition: str | None = None) -> Column:
        return F.coalesce(F.sum(F.when(F.expr(condition), F.col("n")) if condition else F.col("n")), F.lit(0))

    return parts.agg(total().alias("total_analyzed"), total("is_complaint").alias("total_complaints"),
                     total("escalated").alias("escalated_count")).withColumn("total_reviews", n_reviews)


def sentiment_distribution(parts: DataFrame) -> DataFrame:
    return reporting.sentiment_distribution(parts, COUNT)


def category_distribution(parts: DataFrame) -> DataFrame:
    return reporting.category_distribution(parts, COUNT)


def drill_down(parts: DataFrame) -> DataFrame:
    return reporting.drill_down(parts, COUNT)


def average_rating(parts: DataFrame) -> DataFrame:
    mean = F.sum("rating_sum").cast("double") / F.nullif(F.sum("rated"), F.lit(0))
    return parts.agg(F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_rating"))
