"""Predictions of the analysis on a labelled test set: no rating, no gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintflow.functions.normalize import normalize_text
from complaintflow.operators.scoring import overlay_labels, per_review
from complaintflow.plans.analysis import Rules, with_layers, with_sentiment

TARGETS = ("sentiment", "layer1", "layer2", "layer3")


def predict(test: DataFrame, target: str, rules: Rules = Rules(), scores: DataFrame | None = None,
            key: str = "id") -> DataFrame:
    """(actual, predicted) for ``test`` (text, label and, with scores, ``key``); incomplete rows dropped."""
    if target not in TARGETS:
        raise ValueError(f"unknown target {target!r}")
    df = test.dropna(subset=["text", "label"])
    if scores is not None:
        df = df.join(per_review(scores).withColumnRenamed("review_id", key), key, "left")
    if target == "sentiment":
        df = with_sentiment(df, "text", rules, "sentiment_top" if scores is not None else None)
    else:
        df = with_layers(normalize_text(df, "text", "normalized", rules.text))
        df = overlay_labels(df) if scores is not None else df
    return df.select(F.col("label").cast("string").alias("actual"), F.col(target).alias("predicted"))
