"""Evaluation metrics. All of them read one small table: the counted (actual, predicted) pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_F1, MIN_KAPPA = 0.75, 0.61


def confusion_cells(predictions: DataFrame) -> DataFrame:
    """Non-zero cells (actual, predicted, n): the only step that reads the predictions."""
    return predictions.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def label_axis(cells: DataFrame) -> DataFrame:
    """The union of true and predicted labels, sorted."""
    return (cells.select(F.col("actual").alias("label")).union(cells.select("predicted"))
            .distinct().orderBy("label"))


def dense_matrix(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Long form with a cell for every pair of the given labels, zeros included, and every other cell that occurs.

    The caller names the labels, as the matrix grows with the square of their number; ``confusion_cells`` and
    ``label_axis`` are the complete form for any number of labels.
    """
    spark = cells.sparkSession
    axis = spark.createDataFrame([(x,) for x in labels], "label string").select("label", F.lit(list(labels)).cast("array<string>").alias("all"))
    zeros = axis.select(F.col("label").alias("actual"), F.explode("all").alias("predicted"), F.lit(0).cast("long").alias("n"))
    return cells.union(zeros).groupBy("actual", "predicted").agg(F.sum("n").alias("n"))


def wide_matrix(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """One row per true label that is given or occurs, one column per given label."""
    return (dense_matrix(cells, labels).groupBy("actual").pivot("predicted", list(labels))
            .agg(F.sum("n")).orderBy("actual"))


def class_report(cells: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per label of the axis; a zero division gives 0."""
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    roles = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted_n"),
                 hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted_n"),
                 F.lit(0).cast("long").alias("hits")))
    sums = (cells.select(F.explode(roles).alias("r")).select("r.*").groupBy("label")
            .agg(*[F.sum(c).alias(c) for c in ("support", "predicted_n", "hits")]))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    both = F.col("support") + F.col("predicted_n")
    return sums.select("label", "support", "predicted_n", "hits",
                       ratio(F.col("hits"), F.col("predicted_n")).alias("precision"),
                       ratio(F.col("hits"), F.col("support")).alias("recall"),
                       ratio(2 * F.col("hits"), both).alias("f1"))


def kappa_band(kappa: Column) -> Column:
    """Agreement band; an undefined kappa has none."""
    known = F.when(~F.isnan(kappa), kappa)
    return (F.when(known.isNull(), None).when(known < 0.21, "Buruk").when(known < 0.41, "Cukup")
            .when(known < 0.61, "Sedang").when(known < 0.81, "Baik").otherwise("Sangat Baik"))


def summary(cells: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro and weighted F1, Cohen's kappa with band, acceptance.

    Kappa is null when only one class occurs on both sides.
    """
    one = class_report(cells).agg(
        F.sum("support").alias("n"), F.sum("hits").alias("hits"), F.avg("f1").alias("macro_f1"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf1"),
        F.sum(F.col("support").cast("double") * F.col("predicted_n")).alias("_chance"))
    n = F.col("n").cast("double")
    po, pe = F.col("hits") / n, F.col("_chance") / (n * n)
    one = one.select("n", po.alias("accuracy"), "macro_f1", (F.col("_wf1") / n).alias("weighted_f1"),
                     F.try_divide(po - pe, 1 - pe).alias("kappa"))
    return one.select("*", kappa_band(F.col("kappa")).alias("band"),
                      ((F.col("macro_f1") >= MIN_F1) & F.coalesce(F.col("kappa") >= MIN_KAPPA, F.lit(False))).alias("accepted"))
