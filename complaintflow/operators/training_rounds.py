"""Training in rounds: class-weighted gradient steps over the rows, a score on held-out rows after each round, the best one kept.

A step sums the gradient of one slice of the rows: each task adds up its own rows, the sums per feature are added by a
shuffle, and the driver moves the weights (Adam). What the driver holds is features x classes numbers, whatever the number of
rows. The state, with the moments of the steps so far, can be stored and taken up again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintflow.functions.text import tokens
from complaintflow.operators.metrics import confusion_cells, summary
from complaintflow.operators.training_sets import weighted

FEATURES = 1 << 14
ROUNDS = 5
STEPS = 4
RATE = 0.2
_DECAY, _DECAY2, _TINY = 0.9, 0.99, 1e-8


@dataclass(frozen=True)
class State:
    """Weights (features + 1 bias row, classes), the moments of the steps, and how the rounds went."""

    labels: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    steps: int = 0
    rounds: int = 0
    macro_f1: float | None = None
    history: tuple[tuple[int, float, float | None], ...] = field(default=())  # round, loss a row, macro-F1

    @property
    def features(self) -> int:
        return len(self.idf)


def features(text: Column, n: int) -> Column:
    """Hashed words in lower case; repeated words stay repeated, a null text has none."""
    words = F.filter(tokens(F.lower(F.coalesce(text, F.lit("")))), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n)).cast("int"))


def begin(train: DataFrame, n: int = FEATURES) -> State:
    """No weights yet; the labels and the inverse document frequencies of ``train`` (text, label)."""
    labels = tuple(r["label"] for r in train.select("label").distinct().orderBy("label").collect())
    total = train.count()
    seen = (train.select(F.explode(F.array_distinct(features(F.col("text"), n))).alias("i")).groupBy("i").agg(F.count("*").alias("n")).toPandas())
    counts = np.zeros(n)
    counts[seen["i"].to_numpy(np.int64)] = seen["n"]
    zeros = np.zeros((n + 1, len(labels)))
    return State(labels, np.log((total + 1) / (counts + 1)) + 1, zeros, zeros, zeros)


def _with_labels(state: State, train: DataFrame) -> State:
    """Columns for labels that the state hasn't met."""
    new = sorted({r["label"] for r in train.select("label").distinct().collect()} - set(state.labels))
    wide = lambda a: np.concatenate([a, np.zeros((len(a), len(new)))], axis=1)
    return replace(state, labels=(*state.labels, *new), weights=wide(state.weights), first=wide(state.first), second=wide(state.second)) if new else state


def _matrix(words: Sequence[np.ndarray], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number, feature and value of all cells: (1 + log of the count) times idf, each row of length one."""
    lengths = np.array([len(w) for w in words], np.int64)
    if not lengths.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    cells = np.repeat(np.arange(len(words)), lengths) * len(idf) + np.concatenate([np.asarray(w, np.int64) for w in words])
    found, n = np.unique(cells, return_counts=True)
    rows, cols = found // len(idf), found % len(idf)
    values = (1 + np.log(n)) * idf[cols]
    return rows, cols, values / np.sqrt(np.bincount(rows, values * values))[rows]


def _probabilities(n: int, cells, weights: np.ndarray) -> np.ndarray:
    row, col, value = cells
    logits = weights[-1] + np.stack([np.bincount(row, w[col] * value, n) for w in weights.T], axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True)


def _gradient(rows: DataFrame, state: State) -> tuple[np.ndarray, float, float]:
    """Sum of the weighted gradients over ``rows`` (words, y, weight), of the losses and of the weights."""
    shipped = rows.sparkSession.sparkContext.broadcast((state.idf, state.weights))
    classes = len(state.labels)

    def add_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        idf, weights = shipped.value
        total, loss, mass = np.zeros_like(weights), 0.0, 0.0
        for frame in frames:
            cells, weight = _matrix(frame["words"].tolist(), idf), frame["weight"].to_numpy(np.float64)
            p, y = _probabilities(len(frame), cells, weights), frame["y"].to_numpy(np.int64)
            at = np.arange(len(frame))
            loss -= float(weight @ np.log(p[at, y] + 1e-300))
            mass += float(weight.sum())
            p[at, y] -= 1
            p *= weight[:, None]
            for c in range(classes):
                total[:, c] += np.bincount(cells[1], p[cells[0], c] * cells[2], len(total))
            total[-1] += p.sum(axis=0)
        touched = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pd.DataFrame({"i": [*touched.tolist(), -1, -2], "g": [*total[touched].tolist(), [loss] + [0.0] * (classes - 1), [mass] + [0.0] * (classes - 1)]})

    parts = rows.select("words", "y", "weight").mapInPandas(add_up, "i int, g array<double>")
    sums = parts.groupBy("i").agg(*(F.sum(F.col("g")[c]).alias(f"c{c}") for c in range(classes))).toPandas()
    gradient, at, g = np.zeros_like(state.weights), sums["i"].to_numpy(np.int64), sums.iloc[:, 1:].to_numpy(np.float64)
    gradient[at[at >= 0]] = g[at >= 0]
    return gradient, float(g[at == -1, 0].sum()), float(g[at == -2, 0].sum())


def _step(state: State, gradient: np.ndarray, rate: float) -> State:
    t = state.steps + 1
    first = _DECAY * state.first + (1 - _DECAY) * gradient
    second = _DECAY2 * state.second + (1 - _DECAY2) * gradient * gradient
    move = rate * (first / (1 - _DECAY ** t)) / (np.sqrt(second / (1 - _DECAY2 ** t)) + _TINY)
    return replace(state, weights=state.weights - move, first=first, second=second, steps=t)


def train_rounds(train: DataFrame, held_out: DataFrame, rounds: int = ROUNDS, steps: int = STEPS, rate: float = RATE,
                 n: int = FEATURES, state: State | None = None) -> State:
    """The state after the best of ``rounds`` further rounds by macro-F1 on ``held_out``, the first of equal ones; after the last
    round where there are no held-out rows. Rows are (text, label); ``state`` is where to begin, a new one by default."""
    now = begin(train, n) if state is None else _with_labels(state, train)
    index = F.array_position(F.lit(list(now.labels)), F.col("label")) - 1
    rows = weighted(train).select(features(F.col("text"), now.features).alias("words"), index.cast("int").alias("y"), "weight",
                                  F.pmod(F.xxhash64("text", "label"), F.lit(steps)).alias("slice")).persist()
    held = held_out.select(features(F.col("text"), now.features).alias("words"), "label").persist()
    best = None
    try:
        for _ in range(rounds):
            loss = mass = 0.0
            for s in range(steps):
                gradient, some_loss, some_mass = _gradient(rows.filter(F.col("slice") == s), now)
                loss, mass = loss + some_loss, mass + some_mass
                if some_mass:
                    now = _step(now, gradient / some_mass, rate)
            score = summary(confusion_cells(_predicted(now, held))).first()["macro_f1"]
            now = replace(now, rounds=now.rounds + 1, macro_f1=score)
            now = replace(now, history=(*now.history, (now.rounds, loss / mass if mass else 0.0, score)))
            if best is None or score is None or score > (best.macro_f1 or 0.0):
                best = now
    finally:
        rows.unpersist()
        held.unpersist()
    return replace(best, history=now.history) if best else now


def _scored(state: State, rows: DataFrame, words: Column, name: str) -> DataFrame:
    shipped = rows.sparkSession.sparkContext.broadcast((state.idf, state.weights))

    @F.pandas_udf("array<double>")
    def score(words: pd.Series) -> pd.Series:
        idf, weights = shipped.value
        return pd.Series(list(_probabilities(len(words), _matrix(words.tolist(), idf), weights)))

    return rows.withColumn(name, score(words))


def probabilities(state: State, rows: DataFrame, text: str = "text", name: str = "probability") -> DataFrame:
    """``rows`` with the probability of each label in ``name``, in the order of ``state.labels``."""
    return _scored(state, rows, features(F.col(text), state.features), name)


def _predicted(state: State, rows: DataFrame) -> DataFrame:
    """(actual, predicted) label names for rows of (words, label); the first label on ties."""
    p = _scored(state, rows, F.col("words"), "probability")
    best = F.array_position("probability", F.array_max("probability")).cast("int")
    return p.select(F.col("label").alias("actual"), F.element_at(F.lit(list(state.labels)), best).alias("predicted"))


def predictions(state: State, rows: DataFrame) -> DataFrame:
    """(actual, predicted) label names; the first label on ties."""
    return _predicted(state, rows.select(features(F.col("text"), state.features).alias("words"), "label"))


def score_rows(state: State, rows: DataFrame, target: str, key: str = "id") -> DataFrame:
    """(review_id, target, ord, label, score): class probabilities as the score table that the analysis reads."""
    each = probabilities(state, rows.select(key, "text")).select(F.col(key).alias("review_id"), F.posexplode("probability").alias("ord", "score"))
    return each.select("review_id", F.lit(target).alias("target"), "ord", F.get(F.lit(list(state.labels)), F.col("ord")).alias("label"), "score")


def history(spark: SparkSession, state: State) -> DataFrame:
    """(round, loss, macro_f1, kept): one row for each round."""
    return spark.createDataFrame([(r, loss, f1, r == state.rounds) for r, loss, f1 in state.history],
                                 "round int, loss double, macro_f1 double, kept boolean")


def save(spark: SparkSession, state: State, path: str) -> None:
    """The state as a Parquet table of its features and one JSON line."""
    table = pd.DataFrame({"i": np.arange(state.features + 1), "idf": [*state.idf, 0.0], **{
        c: getattr(state, c).tolist() for c in ("weights", "first", "second")}})
    spark.createDataFrame(table, "i int, idf double, weights array<double>, first array<double>, second array<double>").write.mode("overwrite").parquet(f"{path}/features")
    rest = {c: getattr(state, c) for c in ("labels", "steps", "rounds", "macro_f1", "history")}
    spark.createDataFrame([(json.dumps(rest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/rounds")


def load(spark: SparkSession, path: str) -> State:
    table = spark.read.parquet(f"{path}/features").toPandas().sort_values("i")
    rest = json.loads(spark.read.text(f"{path}/rounds").first()["value"])
    arrays = {c: np.array(table[c].tolist()) for c in ("weights", "first", "second")}
    return State(tuple(rest["labels"]), table["idf"].to_numpy()[:-1], **arrays, steps=rest["steps"], rounds=rest["rounds"],
                 macro_f1=rest["macro_f1"], history=tuple(map(tuple, rest["history"])))
