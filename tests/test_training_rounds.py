"""Training in rounds: the best round, warm starts, stored states."""

import numpy as np
import pytest

from complaintflow.operators import training_rounds as op

GOOD, BAD = "good happy fine nice", "bad broken error slow"


@pytest.fixture(scope="module")
def rows(spark):
    words = {"pos": GOOD.split(), "neg": BAD.split(), "rare": ["odd", "strange"]}
    data = [(f"{w[i % len(w)]} {w[(i * 7 + 1) % len(w)]} common{i % 5} the", label) for label, w in words.items() for i in range(8 if label == "rare" else 60)]
    return spark.createDataFrame(data, "text string, label string").repartition(3).cache()


def labels_of(state, rows):
    return sorted(map(tuple, op.predictions(state, rows).collect()))


def test_rounds_learn_and_the_loss_falls(spark, rows):
    state = op.train_rounds(rows, rows, rounds=4, n=256)
    assert state.labels == ("neg", "pos", "rare") and state.macro_f1 == 1.0
    losses = [loss for _, loss, _ in state.history]
    assert losses[-1] < losses[0] / 2 and [r for r, _, _ in state.history] == [1, 2, 3, 4]
    assert state.rounds == 1 or state.history[state.rounds - 2][2] < 1.0  # the first of the best
    kept = op.history(spark, state).filter("kept").collect()
    assert [r["round"] for r in kept] == [state.rounds]


def test_the_best_round_is_kept_where_it_is_not_the_last(spark, rows):
    good = op.train_rounds(rows, rows, rounds=2, n=256)
    flipped = rows.selectExpr("text", "CASE label WHEN 'pos' THEN 'neg' WHEN 'neg' THEN 'pos' ELSE label END AS label")
    after = op.train_rounds(flipped, rows, rounds=6, steps=2, rate=0.3, state=good)
    scores = [f1 for r, _, f1 in after.history if r > good.rounds]
    best = scores.index(max(scores))
    assert best < len(scores) - 1 and scores[-1] < scores[best]
    assert after.rounds == good.rounds + 1 + best and after.macro_f1 == scores[best]
    again = [a == p for a, p in labels_of(after, rows)]
    assert sum(again) / len(again) > 0.5  # the weights are those of that round


def test_a_stored_state_goes_on_as_if_never_stopped(spark, rows, tmp_path):
    none = rows.limit(0)  # without held-out rows the last round stays
    whole = op.train_rounds(rows, none, rounds=3, n=256)
    half = op.train_rounds(rows, none, rounds=1, n=256)
    op.save(spark, half, str(tmp_path / "s"))
    again = op.load(spark, str(tmp_path / "s"))
    assert again.labels == half.labels and again.steps == half.steps and np.array_equal(again.weights, half.weights)
    done = op.train_rounds(rows, none, rounds=2, state=again)
    assert done.rounds == 3 and done.steps == whole.steps and done.macro_f1 is None
    assert np.allclose(done.weights, whole.weights, rtol=1e-6, atol=1e-9)
    op.save(spark, done, str(tmp_path / "s"))
    scores = op.score_rows(op.load(spark, str(tmp_path / "s")), rows.selectExpr("text", "text AS id").distinct(), "sentiment")
    assert scores.columns == ["review_id", "target", "ord", "label", "score"]
    want = {(r["review_id"], r["label"]): r["score"] for r in op.score_rows(done, rows.selectExpr("text", "text AS id").distinct(), "sentiment").collect()}
    assert {(r["review_id"], r["label"]): r["score"] for r in scores.collect()} == want
    sums = scores.groupBy("review_id").agg({"score": "sum"}).collect()
    assert all(r[1] == pytest.approx(1) for r in sums)


def test_new_labels_and_empty_texts(spark, rows):
    state = op.train_rounds(rows, rows, rounds=1, n=256)
    more = spark.createDataFrame([("brand new", "aaa"), ("brand new thing", "aaa"), ("", "aaa"), (None, "neg")], "text string, label string")
    wider = op.train_rounds(more, more, rounds=3, state=state)
    assert wider.labels == ("neg", "pos", "rare", "aaa") and wider.weights.shape == (257, 4)
    assert ("aaa", "aaa") in labels_of(wider, more)


def test_classes_weigh_alike(spark, rows):
    state = op.begin(rows, 64)
    prepared = op.weighted(rows).selectExpr("label", "weight").groupBy("label").agg({"weight": "sum"}).collect()
    assert max(r[1] for r in prepared) == pytest.approx(min(r[1] for r in prepared))
    assert state.features == 64 and state.weights.shape == (65, 3)


def test_cells_of_many_rows_at_once():
    idf = np.linspace(0.5, 2, 8)
    words = [np.array([3, 1, 3, 7]), np.array([], int), np.array([0]), np.array([7, 7, 7, 1])]
    row, col, value = op._matrix(words, idf)
    want = [(i, c, (1 + np.log((w == c).sum())) * idf[c]) for i, w in enumerate(words) for c in sorted(set(w.tolist()))]
    norm = {i: np.sqrt(sum(x * x for k, _, x in want if k == i)) for i in range(4)}
    assert [(r, c) for r, c in zip(row, col)] == [(i, c) for i, c, _ in want]
    assert np.allclose(value, [x / norm[i] for i, _, x in want])
    assert all(len(x) == 0 for x in op._matrix([np.array([], int)], idf)) and all(len(x) == 0 for x in op._matrix([], idf))
    weights = np.arange(18.0).reshape(9, 2) / 10
    logits = np.array([weights[-1] + sum((weights[c] * v for r, c, v in zip(row, col, value) if r == i), np.zeros(2)) for i in range(4)])
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    assert np.allclose(op._probabilities(4, (row, col, value), weights), p)
