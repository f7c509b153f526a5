"""Stores that grow by batches: key index, partial counts, and attempts that broke off."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from complaintflow import schemas
from complaintflow.checks import views
from complaintflow.plans import reporting, rollups
from complaintflow.sources import segments, tables
from complaintflow.streaming import incremental, key_index

RAW = "review_id string, user_name string, content string, score int, at timestamp_ntz, app_version string, arrival long"
DAY = datetime(2024, 1, 15)


def ids(spark, values):
    return spark.createDataFrame([(x,) for x in values], "id string")


def batches(tmp_path, spark, rows, per_file):
    for i in range(0, len(rows), per_file):
        spark.createDataFrame(rows[i:i + per_file], RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def raw_rows(n, keys, seed=1):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys)}", "u", f"text number {i} of the feed", 1, DAY, "1", i) for i in range(n)]


# --------------------------------------------------------------------------- segments
def test_a_manifest_that_breaks_off_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "s")
    one = segments.Segments(spark, path)
    one.segments["a"] = {"rows": 3}
    one.commit()
    two = segments.Segments(spark, path)
    assert two.segments == {"a": {"rows": 3}} and two.version == 1
    two.segments["b"] = {"rows": 4}
    slot = tmp_path / "s" / "manifest" / "slot=0"
    two._write = lambda state, mode: [f.unlink() for f in slot.iterdir() if f.name.startswith("part")]  # dies while it overwrites the slot
    two.commit()
    assert segments.Segments(spark, path).segments == {"a": {"rows": 3}}


def test_levels_follow_the_rows():
    assert [segments.level(n, 10, 8) for n in (0, 10, 11, 80, 81, 640, 641)] == [0, 0, 1, 1, 2, 2, 3]
    few = {str(i): {"rows": 5} for i in range(7)}
    assert segments.crowded(few, 10, 8) == []
    assert segments.crowded(few | {"x": {"rows": 9}, "y": {"rows": 900}}, 10, 8) == sorted([*few, "x"])
    assert segments.crowded(few | {"x": {"rows": 9}}, 10, 8, but="x") == []


# --------------------------------------------------------------------------- key index
def test_a_batch_reads_the_parts_its_keys_hash_to(spark, tmp_path):
    index = key_index.KeyIndex(spark, str(tmp_path / "i"))
    index.put("first", ids(spark, [f"k{i}" for i in range(3000)]))
    index.commit()
    index = key_index.KeyIndex(spark, str(tmp_path / "i"))
    asked = ids(spark, ["k1", "k2999", "new"])
    touched = {r[0] for r in asked.select(index.part(F.col("id"))).collect()}
    found = index.known(asked)
    assert {r["id"] for r in found.collect()} == {"k1", "k2999"}
    text = found._jdf.queryExecution().executedPlan().toString()
    partitions = text.split("PartitionFilters: [")[1].split("], ")[0]
    assert f"IN ({','.join(map(str, sorted(touched)))})" in partitions
    assert "PushedFilters: [In(id" in text
    many = index.known(ids(spark, [f"k{i}" for i in range(0, 6000, 2)]))
    assert many.count() == 3000 and "In(id" not in many._jdf.queryExecution().executedPlan().toString()
    assert index.known(asked, but="first").count() == 0 and index.known(asked.limit(0)).count() == 0


def test_many_batches_leave_few_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(key_index, "LEVEL_ROWS", 40)
    index = key_index.KeyIndex(spark, str(tmp_path / "i"), parts=2, fanout=4)
    most, n = 0, 18
    for batch in range(n):
        index.merge()
        index.put(f"run-{batch}", ids(spark, [f"k{batch}-{i}" for i in range(10)]))
        index.commit()
        most = max(most, len(index.segments))
    levels = 1 + segments.level(10 * n, 40, 4)
    assert most <= levels * 4
    every = index.read(key_index.SCHEMA, list(index.segments))
    assert every.count() == every.distinct().count() == 10 * n
    assert index.known(ids(spark, [f"k{b}-3" for b in range(n)])).count() == n


def test_ingest_through_the_index_reads_no_store(spark, tmp_path, monkeypatch):
    rows = raw_rows(600, 150)
    stream = batches(tmp_path, spark, rows, 60)
    store = str(tmp_path / "store")
    real, reads = incremental.stored_reviews, []
    monkeypatch.setattr(incremental, "stored_reviews", lambda *a: reads.append(a) or real(*a))
    incremental.ingest_stream(stream, store, str(tmp_path / "c"), F.col("arrival")).awaitTermination()
    assert len(reads) == 1  # once at the start, to see what is there
    got = {r["id"]: r["review_text"] for r in real(spark, store).collect()}
    want = {}
    for r in rows:
        want.setdefault(r[0], r[2])
    # within a batch the earliest arrival wins, and batches come in the order of their files
    assert got.keys() == want.keys() and real(spark, store).count() == len(want)
    index = incremental.key_index(spark, store)
    assert index.note["rows"] == len(want) == sum(s["rows"] for s in index.segments.values())


class Broken(Exception):
    pass


@pytest.mark.parametrize("after", ["store", "index"])
def test_an_ingest_that_breaks_off_is_run_again(spark, tmp_path, monkeypatch, after):
    rows = raw_rows(200, 90, seed=2)
    stream = batches(tmp_path, spark, rows, 50)
    store, checkpoint = str(tmp_path / "store"), str(tmp_path / "c")
    put, commit, calls = key_index.KeyIndex.put, key_index.KeyIndex.commit, []

    def failing(real):
        def call(self, *args):
            calls.append(real)
            if len(calls) == 3:
                raise Broken
            return real(self, *args)
        return call

    if after == "store":  # the partition is written, its keys aren't
        monkeypatch.setattr(key_index.KeyIndex, "put", failing(put))
    else:  # the keys are written, but not committed
        monkeypatch.setattr(key_index.KeyIndex, "commit", failing(commit))
    with pytest.raises(Exception):
        incremental.ingest_stream(stream, store, checkpoint, F.col("arrival")).awaitTermination()
    monkeypatch.undo()
    incremental.ingest_stream(stream, store, checkpoint, F.col("arrival")).awaitTermination()
    got = [r["id"] for r in incremental.stored_reviews(spark, store).collect()]
    assert sorted(got) == sorted({r[0] for r in rows})


def test_another_run_finds_what_a_broken_one_stored(spark, tmp_path, monkeypatch):
    rows = raw_rows(100, 60, seed=3)
    stream = batches(tmp_path, spark, rows, 50)
    store = str(tmp_path / "store")
    monkeypatch.setattr(key_index.KeyIndex, "put", lambda *a: (_ for _ in ()).throw(Broken()))
    with pytest.raises(Exception):
        incremental.ingest_stream(stream, store, str(tmp_path / "c1"), F.col("arrival")).awaitTermination()
    monkeypatch.undo()
    incremental.ingest_stream(stream, store, str(tmp_path / "c2"), F.col("arrival")).awaitTermination()
    got = [r["id"] for r in incremental.stored_reviews(spark, store).collect()]
    assert sorted(got) == sorted({r[0] for r in rows})


# --------------------------------------------------------------------------- analysis and dashboard
def same_dashboard(spark, sink, reviews):
    results = tables.read_results(spark, sink)
    parts = incremental.dashboard_parts(spark, sink).counts()
    n = reviews.agg(F.count("*")).scalar()
    for got, want in ((rollups.totals(parts, n), reporting.totals(reviews, results)),
                      (rollups.sentiment_distribution(parts), reporting.sentiment_distribution(results)),
                      (rollups.category_distribution(parts), reporting.category_distribution(results)),
                      (rollups.average_rating(parts), reporting.average_rating(reviews, results)),
                      (rollups.drill_down(parts), reporting.drill_down(results))):
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


REVIEWS = [("a", "aplikasi error terus tidak bisa", 1), ("b", "bagus sekali", 5), ("c", "token tidak masuk gagal terus", None),
           ("d", "padam mulu tidak ada petugas", 2), ("e", "lambat sekali", 3), ("f", "sangat membantu", 4)]


def test_partial_counts_equal_the_scan_after_late_and_repeated_batches(spark, tmp_path):
    rows = spark.createDataFrame(REVIEWS, "id string, review_text string, rating int")
    sink = str(tmp_path / "out")
    for run, (part, day) in enumerate((([0, 1], 2), ([1, 2, 3], 3), ([0, 1, 2, 3], 1), ([4, 5], 1))):
        spark.createDataFrame([REVIEWS[i] for i in part], rows.schema).coalesce(1).write.parquet(str(tmp_path / f"in{run}"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / f"in{run}"))
        incremental.analysis_stream(stream, views.fixture_taxonomy(spark), sink, str(tmp_path / f"c{run}"), F.expr(f"timestamp_ntz'2024-03-0{day} 00:00:00'")).awaitTermination()
    assert sorted(r["review_id"] for r in tables.read_results(spark, sink).collect()) == list("abcdef")
    same_dashboard(spark, sink, rows)
    one_day = incremental.dashboard_parts(spark, sink).counts("2024-03-01", "2024-03-01")
    assert one_day.agg(F.sum("n")).first()[0] == 2


@pytest.mark.parametrize("where", ["append", "counts", "index"])
def test_an_analysis_that_breaks_off_counts_once(spark, tmp_path, monkeypatch, where):
    rows = spark.createDataFrame(REVIEWS, "id string, review_text string, rating int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "c")

    def run():
        incremental.analysis_stream(stream, views.fixture_taxonomy(spark), sink, checkpoint, F.expr("timestamp_ntz'2024-03-01 00:00:00'")).awaitTermination()

    append = incremental.append_results

    def half(results, path):  # a part of the results is there, the rest isn't
        append(results.filter("review_id < 'c'"), path)
        raise Broken

    if where == "append":
        monkeypatch.setattr(incremental, "append_results", half)
    else:
        owner = rollups.Parts if where == "counts" else key_index.KeyIndex
        monkeypatch.setattr(owner, "put", lambda *a: (_ for _ in ()).throw(Broken()))
    with pytest.raises(Exception):
        run()
    monkeypatch.undo()
    run()
    assert sorted(r["review_id"] for r in tables.read_results(spark, sink).collect()) == list("abcdef")
    same_dashboard(spark, sink, rows)
    index = incremental.key_index(spark, sink)
    assert index.note["pending"] is None and index.note["rows"] == 6


def test_results_from_elsewhere(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    sink = str(tmp_path / "out")
    results, reviews = views.results(spark, d), views.reviews(spark, d)
    tables.append_results(results, sink)
    parts = incremental.dashboard_parts(spark, sink)
    parts.rebuild(tables.read_results(spark, sink), reviews)
    same_dashboard(spark, sink, reviews)
    parts.rebuild(tables.read_results(spark, sink), reviews)
    same_dashboard(spark, sink, reviews)
    index = incremental.key_index(spark, sink)
    keys = results.select(F.col("review_id").alias("id"))
    assert index.catch_up(keys, results.count(), "found") and not index.catch_up(keys, results.count(), "again")
    assert index.known(keys.distinct()).count() == keys.distinct().count()


def test_empty_parts(spark, tmp_path):
    parts = rollups.Parts(spark, str(tmp_path / "p")).counts()
    assert [tuple(r) for r in rollups.totals(parts, F.lit(0)).collect()] == [(0, 0, 0, 0)]
    assert rollups.average_rating(parts).first()["avg_rating"] == 0.0 and rollups.drill_down(parts).count() == 0
    assert spark.createDataFrame([], schemas.RESULTS).count() == 0
