"""Bucketed stores: joins on the review key without an exchange."""

import pytest
from conftest import plan

from complaintflow import schemas
from complaintflow.checks import views
from complaintflow.plans import analysis, reporting
from complaintflow.sources import bucketed

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stores(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("bucketed")
    write = lambda name, rows, key: bucketed.write_bucketed(rows, f"b_{name}", f"{base}/{name}", key, 4)
    yield (write("reviews", views.reviews(spark, SMALL), "id"), write("results", views.results(spark, SMALL), "review_id"),
           write("scores", views.model_scores(spark, SMALL), "review_id"), base)
    for name in ("reviews", "results", "scores", "again"):
        spark.sql(f"DROP TABLE IF EXISTS b_{name}")


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def moved(df):
    """Exchanges of rows by the review key; the taxonomy's few labels are another matter."""
    return [line for line in plan(df).splitlines() if "Exchange hashpartitioning(id#" in line or "Exchange hashpartitioning(review_id#" in line]


def test_feed_and_scored_analysis_move_nothing(spark, stores, no_broadcast):
    reviews, results, scores, _ = stores
    assert moved(reporting.result_feed(reviews, results)) == []
    scored = analysis.analyze(reviews, views.fixture_taxonomy(spark), scores, by_review=True)
    assert moved(scored) == [] and "SortMergeJoin" in plan(scored)
    assert moved(analysis.analyze(views.reviews(spark, SMALL), views.fixture_taxonomy(spark), views.model_scores(spark, SMALL)))


def test_rows_are_the_same(spark, stores):
    reviews, results, scores, _ = stores
    want = reporting.result_feed(views.reviews(spark, SMALL), views.results(spark, SMALL))
    assert sorted(map(str, reporting.result_feed(reviews, results).collect())) == sorted(map(str, want.collect()))


def test_a_later_session_attaches_the_table(spark, stores, no_broadcast):
    base = stores[3]
    again = bucketed.attach_bucketed(spark, "b_again", f"{base}/reviews", schemas.REVIEWS, "id", 4)
    assert again.count() == stores[0].count()
    assert moved(reporting.result_feed(again, stores[1])) == []


def test_buckets_follow_the_size(spark, monkeypatch):
    small, large = views.results(spark, SMALL), views.reviews(spark, SMALL)
    assert bucketed.buckets_for(small, large) == 4 == bucketed.buckets_for(small.limit(0))
    monkeypatch.setattr(bucketed, "BUCKET_BYTES", 10_000)
    n = bucketed.buckets_for(small, large)
    assert n == bucketed.buckets_for(large, small) > 4 and n & (n - 1) == 0
    assert n / 2 < large.selectExpr("sum(octet_length(review_text)) / 10000").first()[0] * 2 < n * 4
