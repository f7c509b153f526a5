"""Class-weighted text classifier on MLlib, and its scores in the form the analysis consumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, StringIndexer, Tokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from complaintflow.operators.metrics import confusion_cells, summary
from complaintflow.operators.training_sets import weighted

CANDIDATES = ({"regParam": 0.01, "maxIter": 20}, {"regParam": 0.1, "maxIter": 20})


def classifier(reg_param: float, max_iter: int, features: int = 1 << 14) -> Pipeline:
    return Pipeline(stages=[
        StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"),
        Tokenizer(inputCol="text", outputCol="words"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="y", featuresCol="features", weightCol="weight", regParam=reg_param, maxIter=max_iter),
    ])


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def apply_model(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """The model without its label indexer, so rows need no label and may have an unseen one."""
    return PipelineModel(model.stages[1:]).transform(rows)


def predictions(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """(actual, predicted) label names."""
    names = F.lit(class_names(model))
    return apply_model(model, rows).select(
        F.col("label").alias("actual"), F.get(names, F.col("prediction").cast("int")).alias("predicted"))


def train_best(train: DataFrame, test: DataFrame, candidates: Sequence[dict] = CANDIDATES,
               features: int = 1 << 14) -> tuple[PipelineModel, DataFrame]:
    """Fits every candidate on class-weighted rows and keeps the one with the best macro-F1 on the
    held-out rows. Returns the model and its metrics row."""
    rows = weighted(train).cache()
    try:
        best = None
        for c in candidates:
            model = classifier(c["regParam"], c["maxIter"], features).fit(rows)
            metrics = summary(confusion_cells(predictions(model, test)))
            row = metrics.first()
            # without held-out rows there is no score; the first candidate then stays
            if best is None or (row["macro_f1"] or 0.0) > (best[1]["macro_f1"] or 0.0):
                best = (model, row, metrics.schema)
        return best[0], train.sparkSession.createDataFrame([best[1]], best[2])
    finally:
        rows.unpersist()


def score_rows(model: PipelineModel, rows: DataFrame, target: str, key: str = "id") -> DataFrame:
    """(review_id, target, ord, label, score): class probabilities as a score table."""
    names = F.lit(class_names(model))
    each = apply_model(model, rows).select(F.col(key).alias("review_id"), F.posexplode(vector_to_array("probability")).alias("ord", "score"))
    return each.select("review_id", F.lit(target).alias("target"), "ord", F.get(names, F.col("ord")).alias("label"), "score")
