import math
import random

from pyspark.sql import functions as F

from complaintflow.checks import views
from complaintflow.operators import metrics, scoring, training, training_sets
from complaintflow.operators.taxonomy import Taxonomy
from complaintflow.plans.analysis import analyze

from conftest import plan


def cells(spark, pairs):
    return metrics.confusion_cells(spark.createDataFrame(pairs, "actual string, predicted string"))


def test_metrics_against_brute_force(spark):
    rng = random.Random(2)
    pairs = [(rng.choice("abc"), rng.choice("abcd")) for _ in range(200)]
    c = cells(spark, pairs)
    names = sorted({x for p in pairs for x in p})
    f1 = {}
    for x in names:
        hit = sum(a == b == x for a, b in pairs)
        both = sum(a == x for a, _ in pairs) + sum(b == x for _, b in pairs)
        f1[x] = 2 * hit / both if both else 0.0
    po = sum(a == b for a, b in pairs) / 200
    pe = sum(sum(a == x for a, _ in pairs) * sum(b == x for _, b in pairs) for x in names) / 200 ** 2
    r = metrics.summary(c).first()
    assert math.isclose(r["accuracy"], po) and math.isclose(r["macro_f1"], sum(f1.values()) / len(names))
    assert math.isclose(r["kappa"], (po - pe) / (1 - pe))
    assert math.isclose(r["weighted_f1"], sum(f1[x] * sum(a == x for a, _ in pairs) for x in names) / 200)
    assert metrics.dense_matrix(c, names).count() == 16 and metrics.wide_matrix(c, names).columns == ["actual", *names]
    text = plan(metrics.dense_matrix(c, names))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_any_number_of_labels(spark):
    c = cells(spark, [(f"l{i:04}", f"l{i:04}") for i in range(1001)])
    assert metrics.label_axis(c).count() == 1001 == metrics.class_report(c).count()
    # cells that the caller's list doesn't name stay
    assert metrics.dense_matrix(c, ["l0000", "new"]).count() == 1001 + 3


def test_training_without_held_out_rows(spark):
    rows = spark.createDataFrame([("a b", "x"), ("c d", "y")] * 3, "text string, label string")
    model, metrics_row = training.train_best(rows, rows.limit(0))
    assert training.class_names(model) == ["x", "y"] and metrics_row.first()["macro_f1"] is None


def test_undefined_kappa_is_null(spark):
    r = metrics.summary(cells(spark, [("a", "a")] * 3)).first()
    assert r["kappa"] is None and r["band"] is None and r["accuracy"] == 1.0 and r["accepted"] is False


def test_kappa_bands(spark):
    df = spark.createDataFrame([(0.20,), (0.21,), (0.41,), (0.61,), (0.81,), (None,), (float("nan"),)], "k double").coalesce(1)
    assert [r[0] for r in df.select(metrics.kappa_band(F.col("k"))).collect()] == ["Buruk", "Cukup", "Sedang", "Baik", "Sangat Baik", None, None]


def test_rare_classes(spark):
    df = spark.createDataFrame([(x,) for x, n in (("A", 12), ("B", 10), ("C", 9)) for _ in range(n)], "label string")
    got = {r["label"]: r["n"] for r in training_sets.label_counts(training_sets.fold_rare(df)).collect()}
    assert got == {"A": 12, "B": 10, "Lainnya": 9}


def test_split_is_exact_with_one_dominant_class(spark):
    df = spark.range(0, 3000).select(F.col("id"), F.expr(
        "CASE WHEN id < 2000 THEN 'big' WHEN id = 2999 THEN 'single' ELSE concat('c', id % 7) END").alias("label"))
    for slices in (1, 64, 4096):
        split = training_sets.stratified_split(df, "id", slices=slices)
        per = {r["label"]: (r["n"], r["t"]) for r in split.groupBy("label").agg(
            F.count("*").alias("n"), F.count_if(F.col("part") == "test").alias("t")).collect()}
        assert per["big"] == (2000, 400) and per["single"] == (1, 0)
        assert all(t == math.floor(0.2 * n + 0.5) for k, (n, t) in per.items() if k != "single")
        test_ids = {r["id"] for r in split.filter("part = 'test'").collect()}
        first = test_ids if slices == 1 else first
        assert test_ids == first


def test_class_weights_are_balanced(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    got = {r["label"]: r["weight"] for r in training_sets.class_weights(df).collect()}
    assert got == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}


def test_classifier_saves_scores_and_feeds_the_analysis(spark, tmp_path):
    good, bad = "Token & Pembayaran", "Pengaduan"
    rows = spark.range(0, 60).select(F.col("id").alias("row"), F.expr(
        f"CASE WHEN id % 3 = 0 THEN concat('padam lagi malam ', id) ELSE concat('token saya hilang ', id) END").alias("text"),
        F.expr(f"CASE WHEN id % 3 = 0 THEN '{bad}' ELSE '{good}' END").alias("label"))
    split = training_sets.stratified_split(rows, "row")
    model, result = training.train_best(split.filter("part = 'train'"), split.filter("part = 'test'"), features=256)
    assert result.first()["accuracy"] > 0.9
    model.write().overwrite().save(str(tmp_path / "m"))
    again = training.PipelineModel.load(str(tmp_path / "m"))
    assert training.class_names(again) == sorted([good, bad])
    review = spark.createDataFrame([("r1", "token saya hilang padam error", 1)], "id string, text string, rating int")
    scores = training.score_rows(again, review, "layer3")
    assert scores.count() == 2 and abs(scores.agg(F.sum("score")).first()[0] - 1) < 1e-9
    record = analyze(review.withColumnRenamed("text", "review_text"), views.fixture_taxonomy(spark), scores).first()
    best = scoring.best_label(scores).first()
    assert record["layer3"] == best["label"] and record["classification_confidence"] == round(best["score"], 3)


def test_hot_review_scores_are_reduced_before_collecting(spark):
    scores = spark.range(0, 5000).selectExpr("'hot' AS review_id", "'layer4' AS target", "0 AS ord", "concat('L', id % 3) AS label", "id / 5000.0D AS score")
    row = scoring.per_review(scores).first()
    assert len(row["layer4_scores"]) == 3
    assert plan(scoring.per_review(scores)).count("partial_max") >= 1


def test_main_path_stays_in_the_jvm_without_a_shuffle(spark):
    d = "/root/testdata/sf0.001"
    reviews = views.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("review_text"), F.lit(1).alias("rating"))
    for literal_rows in (20_000, 0):
        t = Taxonomy(views.fixture_taxonomy(spark).rows, literal_rows)
        text = plan(analyze(reviews, t))
        assert "Python" not in text and "CartesianProduct" not in text and "NestedLoopJoin" not in text
        assert "hashpartitioning(_k" not in text and "hashpartitioning(id" not in text
        if literal_rows:
            assert "Exchange" not in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text.replace("\n", "")


def test_rows_do_not_move_to_the_task_of_their_class(spark):
    rows = spark.range(500).selectExpr("id AS row", "concat('text ', id) AS text", "CASE WHEN id % 100 = 0 THEN concat('r', id) WHEN id % 7 > 0 THEN 'a' END AS label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        done = training_sets.fold_rare(rows, 10)
        assert "BroadcastHashJoin" in plan(done) and "SortMergeJoin" not in plan(done)
        nulls = sum(i % 100 != 0 and i % 7 == 0 for i in range(500))
        want = {None: nulls, "a": 495 - nulls, training_sets.lx.RARE_LABEL: 5}
        assert {r["label"]: r["n"] for r in done.groupBy("label").agg(F.count("*").alias("n")).collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
