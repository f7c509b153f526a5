from datetime import datetime

import pytest
from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.checks import views
from complaintflow.operators import ingest
from complaintflow.plans import analysis, reporting
from complaintflow.sources import tables
from complaintflow.streaming import incremental

from conftest import plan

RAW = "review_id string, user_name string, content string, score int, at timestamp_ntz, app_version string, arrival long"
JAN = datetime(2024, 1, 15)
ROWS = [
    ("rating3", "u", "long enough text", 3, JAN, "1", 1), ("edge", "u", "long enough text", 2, datetime(2024, 1, 31, 23, 59, 59), "1", 2),
    ("late", "u", "long enough text", 2, datetime(2024, 2, 1), "1", 3), ("nodate", "u", "long enough text", 1, None, "1", 4),
    ("nine", "u", "123456789", 1, JAN, "1", 5), ("ten", "u", "1234567890", 1, JAN, "1", 6), ("", "u", "long enough text", 1, JAN, "1", 7),
    ("twice", "u", "first copy here", 1, JAN, "1", 8), ("twice", "u", "second copy here", 1, JAN, "1", 9),
    ("noscore", None, "long enough text", None, JAN, None, 10), ("stored", "u", "other text here", 1, JAN, "1", 11), ("nulltext", "u", None, 1, JAN, "1", 12),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW).repartition(3)


def test_row_rules(raw):
    kept = {r["id"]: r for r in ingest.accepted(raw, 2, "2024-01-01", "2024-01-31").collect()}
    assert sorted(kept) == ["edge", "nodate", "noscore", "stored", "ten", "twice"]
    assert kept["noscore"]["rating"] == 0 and kept["noscore"]["username"] is None and kept["noscore"]["app_version"] == ""
    assert [r["arrival"] for r in ingest.quarantine(raw).collect()] == [7]
    assert ingest.accepted(raw, 0, "31/01/2024", "nonsense").count() == 9
    assert ingest.to_reviews(raw.drop("user_name")).first()["username"] == "Anonim"


def test_insert_or_ignore_is_idempotent(spark, raw):
    stored = spark.createDataFrame([("stored",)], "id string")
    first = ingest.new_reviews(ingest.to_reviews(raw), stored)
    got = {r["id"]: r["review_text"] for r in first.collect()}
    assert got["twice"] == "first copy here" and "stored" not in got and "nulltext" not in got and "" not in got
    assert ingest.new_reviews(ingest.to_reviews(raw), stored.unionByName(first.select("id"))).count() == 0


def test_copies_of_one_key_are_cut_before_the_shuffle(spark):
    df = spark.range(0, 10).select(F.expr("concat('k', id % 2)").alias("id"), F.col("id").alias("arrival"))
    text = plan(ingest.first_per_key(df.repartition(3), "id", "arrival"))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_queue_is_a_top_k(spark):
    d = "/root/testdata/sf0.001"
    text = plan(ingest.pending_queue(views.reviews(spark, d), views.results(spark, d), 10))
    assert "TakeOrderedAndProject" in text and "LeftAnti" in text and "CartesianProduct" not in text


def test_stream_equals_batch_and_survives_a_repeated_batch(spark, tmp_path):
    raw = spark.createDataFrame(ROWS, RAW)
    for i in range(3):
        raw.filter(F.col("arrival") % 3 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    store = str(tmp_path / "store")
    known = spark.createDataFrame([("stored", "u", "kept as it is", 5, JAN, "1", JAN)], schemas.REVIEWS)
    incremental.seed_store(known, store)
    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    arrival = F.col("arrival")

    def drain(checkpoint):
        incremental.ingest_stream(stream, store, str(tmp_path / checkpoint), arrival, 2, "2024-01-01", "2024-01-31").awaitTermination()
        return sorted((r["id"], r["review_text"]) for r in incremental.stored_reviews(spark, store).collect())

    once = drain("c1")
    want = {r["id"] for r in ingest.accepted(raw, 2, "2024-01-01", "2024-01-31").collect()}
    assert {k for k, _ in once} == want and len(once) == len(want)
    assert dict(once)["stored"] == "kept as it is"
    # the same batches again, as after a lost commit
    assert drain("c2") == once
    # another run with other and with overlapping input adds what is new and loses nothing
    more = [("fresh", "u", "arrives in a later run", 1, JAN, "1", 900), ("stored", "u", "would change it now", 1, JAN, "1", 901)]
    spark.createDataFrame(more, RAW).coalesce(1).write.parquet(str(tmp_path / "in2"))
    stream = spark.readStream.schema(RAW).parquet(str(tmp_path / "in2"))
    assert drain("c3") == sorted([*once, ("fresh", "arrives in a later run")])
    incremental.compact(spark, store, str(tmp_path / "store2"), 2)
    assert sorted((r["id"], r["review_text"]) for r in incremental.stored_reviews(spark, str(tmp_path / "store2")).collect()) == drain("c3")


def test_only_reviews_without_result_are_analysed(spark, tmp_path):
    rows = spark.createDataFrame([("a", "aplikasi error terus tidak bisa", 1), ("b", "bagus sekali", 5)], "id string, review_text string, rating int")
    sink = str(tmp_path / "out")
    for run, part in enumerate((rows.limit(1), rows, rows)):  # new, delivered again with one more, and again with a new checkpoint
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{run // 2}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{run // 2}"))
        incremental.analysis_stream(stream, views.fixture_taxonomy(spark), sink, str(tmp_path / f"c{run}"), F.expr(f"timestamp_ntz'2024-03-0{run + 1} 00:00:00'")).awaitTermination()
    got = sorted((r["review_id"], r["analyzed_at"].day) for r in tables.read_results(spark, sink).collect())
    assert got == [("a", 1), ("b", 2)]


def test_flags_and_lists(spark):
    d = "/root/testdata/sf0.001"
    results, reviews = views.results(spark, d), views.reviews(spark, d)
    events = spark.createDataFrame(
        [("a0", True, " wrong ", JAN), ("a0", False, "ok", datetime(2024, 1, 16)), ("a9", True, "  ", JAN), ("zz", True, "x", JAN)], schemas.FLAG_EVENTS)
    flags = {r["result_id"]: r for r in reporting.current_flags(events).collect()}
    assert (flags["a0"]["flagged"], flags["a0"]["flag_note"], flags["a0"]["flagged_at"]) == (False, "ok", None)
    assert flags["a9"]["flag_note"] is None and flags["a9"]["flagged_at"] == JAN
    assert [r["result_id"] for r in reporting.unknown_flags(events, results).collect()] == ["zz"]
    feed = reporting.result_feed(reviews, results, reporting.current_flags(events))
    assert len(feed.columns) == 25
    assert len(reporting.export_table(feed).columns) == 17
    assert reporting.recent_results(reviews, results, None, 500).count() == 500
    text = plan(reporting.recent_results(reviews, results, None, 10, sentiment="Negatif", rating="2"))
    assert "TakeOrderedAndProject" in text and "Cartesian" not in text


def test_search_terms_are_taken_as_they_are(spark):
    df = spark.createDataFrame([("a\\b",), ("axb",), ("A\\B%",)], "t string")
    assert sorted(r["t"] for r in df.filter(reporting.search(F.col("t"), "a\\b")).collect()) == ["A\\B%", "a\\b"]
    assert df.filter(reporting.search(F.col("t"), "a_b")).count() == 3


def test_drill_down_computes_only_what_it_needs(spark):
    reviews = views.reviews(spark, "/root/testdata/sf0.001")
    text = plan(reporting.drill_down(analysis.analyze(reviews, views.fixture_taxonomy(spark), columns=reporting.DRILL_COLUMNS)))
    assert "Negative complaint" not in text and "Keandalan" not in text
    assert "Negative complaint" in plan(analysis.analyze(reviews, views.fixture_taxonomy(spark)))


def test_drill_down_levels_add_up(spark):
    results = views.results(spark, "/root/testdata/sf0.001")
    sums = {r["level"]: r["n"] for r in reporting.drill_down(results).groupBy("level").agg(F.sum("n").alias("n")).collect()}
    assert set(sums.values()) == {results.filter("is_complaint").count()} and set(sums) == {1, 2, 3}


def test_empty_page(spark):
    d = "/root/testdata/sf0.001"
    reviews, results = views.reviews(spark, d), views.results(spark, d)
    assert reporting.raw_page(reviews, results, term="no such text at all").count() == 0
    page = reporting.raw_page(reviews, results, 0, 7).collect()
    assert len(page) == 7 and page[0]["total_pages"] == -(-page[0]["total"] // 7)


def test_dictionary_and_taxonomy_files(spark, tmp_path):
    (tmp_path / "slang.json").write_text('{"gk": "tidak", "sih": "",\n "mks": "terima kasih"}', encoding="utf-8")
    assert tables.read_slang(spark, str(tmp_path / "slang.json")) == {"gk": "tidak", "sih": "", "mks": "terima kasih"}
    assert tables.read_slang(spark, str(tmp_path / "missing.json"))["gak"] == "tidak"
    (tmp_path / "t.json").write_text('[{"l1": "A", "l2": "B", "l3": "C"},\n {"l1": "A", "param": "p"}]', encoding="utf-8")
    got = [tuple(r) for r in tables.read_taxonomy(spark, str(tmp_path / "t.json")).orderBy("ord").collect()]
    assert got == [(0, "A", "B", "C", None, None, None), (1, "A", None, None, None, None, "p")]
    assert tables.read_taxonomy(spark, str(tmp_path / "none.json")).count() == 0
