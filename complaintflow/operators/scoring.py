"""Model scores as tables: one aggregation brings them to one row per review."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from complaintflow.functions import lexicon as lx
from complaintflow.operators.joins import is_small, small_side


def best_label(scores: DataFrame, keys: Iterable[str] = ("review_id", "target")) -> DataFrame:
    """The best label per key: highest score, the first in source order on ties.

    A plain aggregate with map-side combine, so a key with very many rows is reduced before
    the shuffle.
    """
    top = F.max_by(F.struct("label", "score"), F.struct(F.col("score"), -F.col("ord")))
    return scores.groupBy(*keys).agg(top.alias("b")).select(*keys, "b.label", "b.score")


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits, shifted by the maximum against overflow."""
    exps = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(exps, lambda e: e / F.aggregate(exps, F.lit(0.0), lambda a, x: a + x))


def best_class(probabilities: Column, labels: Iterable[str]) -> Column:
    """struct(score, first, label) of the most probable class, the lower index on ties."""
    names = F.lit(list(labels))
    return F.array_max(F.transform(probabilities, lambda p, i: F.struct(
        p.alias("score"), (-i).alias("first"), F.get(names, i).alias("label"))))


def per_review(scores: DataFrame, labels: DataFrame | None = None, by_review: bool = False) -> DataFrame:
    """One row per review: ``sentiment_top`` and ``layer1..3_top`` (struct(label, score)), and
    ``layer4_scores`` / ``layer5_scores`` (map option -> score).

    Rows are first reduced to one per (review, target, label); only layers
    4 and 5 are collected, and ``labels`` (column ``label``) limits them to taxonomy labels. Scores that are stored
    ``by_review`` (bucketed) stay where they are.
    """
    if labels is not None:
        upper = ~F.col("target").isin("layer4", "layer5")
        known = labels.select("label").distinct()
        known = small_side(known, is_small(known)).withColumn("_known", F.lit(True))
        scores = scores.join(known, "label", "left").filter(upper | F.col("_known")).drop("_known")
    # both aggregates, and the join with the reviews, work on this one exchange
    once = (scores if by_review else scores.repartition("review_id")).groupBy("review_id", "target", "label").agg(
        F.max("score").alias("score"), F.min("ord").alias("ord"))

    def of(target: str) -> Column:
        return F.col("target") == target

    ranking = F.struct(F.col("score"), -F.col("ord"))
    picked = F.struct("label", "score")
    pair = F.struct("label", "score")
    return once.groupBy("review_id").agg(
        *[F.max_by(F.when(of(t), picked), F.when(of(t), ranking)).alias(f"{t}_top")
          for t in ("sentiment", "layer1", "layer2", "layer3")],
        *[F.map_from_entries(F.collect_list(F.when(of(f"layer{i}"), pair))).alias(f"layer{i}_scores")
          for i in (4, 5)],
    )


def overlay_labels(df: DataFrame) -> DataFrame:
    """Model labels replace keyword labels per layer where present and not empty. The layer-3
    confidence follows its label; the source says whether any layer came from a model."""
    has = {i: F.coalesce(F.col(f"layer{i}_top.label"), F.lit("")) != "" for i in (1, 2, 3)}
    plain = [c for c in df.columns if c not in
             ("layer1", "layer2", "layer3", "class_source", "class_confidence", "layer1_top", "layer2_top", "layer3_top")]
    return df.select(
        *plain,
        *[F.when(has[i], F.col(f"layer{i}_top.label")).otherwise(F.col(f"layer{i}")).alias(f"layer{i}") for i in (1, 2, 3)],
        F.when(has[1] | has[2] | has[3], lx.SOURCE_LABEL_MODEL).otherwise(F.col("class_source")).alias("class_source"),
        F.when(has[3], F.col("layer3_top.score")).otherwise(F.col("class_confidence")).alias("class_confidence"))
